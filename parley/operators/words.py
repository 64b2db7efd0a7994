"""Words of transcripts on a recording's clock: their times, whose they are, bubbles of them, and what a call adds to what was said before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import speaker_at

BLANK = "[BLANK_AUDIO]"
#: Characters of texts a task.
EACH = 1 << 20


def timed_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for each word of segments (..., s, e, text): their columns and pos, word, ws, we. A segment's time is parted evenly, so word i is [s + i * step, s + (i + 1) * step).

    Null bounds are 0, and s, where one is missing; segments without both bounds, without text, of blank audio or that end before they begin have no words.
    """
    known = rows.where(F.col("s").isNotNull() | F.col("e").isNotNull()).withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("e", F.coalesce("e", "s"))
    words = known.where((F.col("e") > F.col("s")) & (F.trim(text) != BLANK)).withColumn("__w", T.tokens(F.col(text))).where("size(__w) > 0")
    step = F.greatest(F.col("e") - F.col("s"), F.lit(1e-3)) / F.size("__w")
    out = words.select(*rows.columns, step.alias("__step"), F.posexplode("__w").alias("pos", "word"))
    return out.select(*rows.columns, "pos", "word", (F.col("s") + F.col("pos") * F.col("__step")).alias("ws"), (F.col("s") + (F.col("pos") + 1) * F.col("__step")).alias("we"))


def attributed(words: DataFrame, segments: DataFrame, keys: list[str], missing: str = "unknown") -> DataFrame:
    """Words (rec, *keys, t) with ``spk``: the speaker of the last segment (rec, ord, s, e, spk) that holds t, or ``missing``."""
    hit = speaker_at(words.select("rec", *keys, "t"), segments, missing).select(*keys, "spk")
    return words.join(hit, keys, "left").withColumn("spk", F.coalesce("spk", F.lit(missing)))


def speaker_runs(words: DataFrame, by: list[str], order: list[str], missing: str = "unknown") -> DataFrame:
    """(by, run, spk, n, text): neighbouring words (word, spk) of one speaker, in ``order``, as one line."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce((F.coalesce("spk", F.lit(missing)) != F.lag(F.coalesce("spk", F.lit(missing))).over(w)).cast("int"), F.lit(1))
    runs = words.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "word"))), lambda x: x["word"]), " ")
    return runs.groupBy(*by, "run", F.coalesce("spk", F.lit(missing)).alias("spk")).agg(F.count("*").alias("n"), said.alias("text"))


def squashed(words: DataFrame, by: list[str], order: str = "pos", longest: int = 4) -> DataFrame:
    """Words without those that repeat the one before: equal when plain, not empty and of at most ``longest`` characters."""
    p = words.withColumn("__p", T.plain(F.col("word")))
    before = F.lag("__p").over(Window.partitionBy(*by).orderBy(order))
    same = (F.col("__p") == F.col("__b")) & (F.col("__p") != "") & (F.char_length("__p") <= longest)
    return p.withColumn("__b", before).where(~F.coalesce(same, F.lit(False))).drop("__p", "__b")


def bubbles(turns: DataFrame, by: list[str], order: str, speaker: str, text: str = "text", separated: Column | None = None, most: int = 18) -> DataFrame:
    """(by, run, speaker, separated, bubble, n, text): words of neighbouring turns, in bubbles of up to ``most``. A run ends where the speaker or the ``separated`` flag changes."""
    w = Window.partitionBy(*by).orderBy(order)
    flag = F.coalesce(separated, F.lit(False)) if separated is not None else F.lit(False)
    turns = turns.select(*by, order, speaker, flag.alias("separated"), T.tokens(F.col(text)).alias("__w"))
    changed = ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | (F.col("separated") != F.lag("separated").over(w))
    turns = turns.withColumn("__new", F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(changed.cast("int"))).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = turns.select(*by, "run", speaker, "separated", order, F.posexplode("__w").alias("pos", "word"))
    place = F.row_number().over(Window.partitionBy(*by, "run").orderBy(order, "pos")) - 1
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "pos", "word"))), lambda x: x["word"]), " ")
    return words.withColumn("bubble", F.floor(place / most).cast("bigint")).groupBy(*by, "run", speaker, "separated", "bubble").agg(F.count("*").alias("n"), listed.alias("text"))


def call_words(segments: DataFrame) -> DataFrame:
    """(session, ord, s, words, starts, ends), one row a call, ready for ``live.Snippets``. Segments: (session, call, ord, begin, end, s, e, text).

    A call hears some context before ``begin``, but only segments that end after it and start before ``end`` have words; all words of such a segment count.
    Calls without any have no row.
    """
    heard = timed_words(segments).where((F.col("e") > F.col("begin")) & (F.col("s") < F.col("end")))  # of all a segment's words, after missing bounds are filled in
    listed = F.array_sort(F.collect_list(F.struct("ord", "pos", "word", "ws", "we")))
    calls = heard.groupBy("session", "call").agg(F.min("begin").alias("s"), listed.alias("w"))
    part = lambda name: F.transform("w", lambda x: x[name])
    return calls.select("session", F.col("call").alias("ord"), "s", part("word").alias("words"), part("ws").alias("starts"), part("we").alias("ends"))


def with_phonemes(segments: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", most: int = 1 << 18, most_chars: int = 1 << 24) -> DataFrame:
    """Segments with s and e as doubles (null is 0) and ``phonemes``, from a dictionary (word, phonemes) in lower case; all other columns and every row stay. ``keys`` tell rows apart.

    A word is read from left to right by the longest entry that fits at each place; letters that begin none have no sound. Null and blank texts give "". A dictionary of at most ``most`` entries and ``most_chars``
    characters is sent to all tasks, which read texts where they lie; a larger one is joined with the pieces of words.
    """
    entries = dictionary.where("word is not null and word <> ''").groupBy(F.lower("word").alias("__piece")).agg(F.min("phonemes").alias("__sound"))
    size = entries.agg(F.max(F.length("__piece")).alias("longest"), F.count("*").alias("n"), F.sum(F.length("__piece") + F.coalesce(F.length("__sound"), F.lit(0))).alias("chars")).first()
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows, words = segments.withColumns({"s": number("s"), "e": number("e")}), T.tokens(F.lower(F.col(text)))
    if size["n"] <= most and (size["chars"] or 0) <= most_chars:
        return rows.withColumn("phonemes", _read(dict(entries.collect()))(words))
    chars = segments.agg(F.sum(F.length(text))).first()[0] or 0
    spoken = _joined_phonemes(segments.select(*keys, F.posexplode(words).alias("__pos", "__word")), entries, keys, size["longest"], chars)
    return rows.join(spoken, keys, "left").withColumn("phonemes", F.coalesce("phonemes", F.lit("")))


def _read(sounds: dict):
    lengths: dict = {}
    for n in sorted({len(p) for p in sounds}, reverse=True):
        for first in {p[0] for p in sounds if len(p) == n}:
            lengths.setdefault(first, []).append(n)

    def said(word: str) -> str | None:
        at, found, end = 0, [], len(word)
        while at < end:
            n = next((n for n in lengths.get(word[at], ()) if at + n <= end and word[at : at + n] in sounds), 0)
            if n:
                found.append(sounds[word[at : at + n]])
            at += n or 1
        return " ".join(x for x in found if x is not None) if found else None

    def read(texts: pd.Series) -> pd.Series:
        known: dict = {}  # of a batch
        out = []
        for words in texts:
            listed = []
            for w in words if words is not None else ():
                if w not in known:
                    known[w] = said(w)
                if known[w] is not None:
                    listed.append(known[w])
            out.append(" ".join(listed))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(read, "string")


def _joined_phonemes(words: DataFrame, entries: DataFrame, keys: list[str], longest: int, chars: int) -> DataFrame:
    """(keys, phonemes): each different word is looked up once; its pieces, none longer than the longest entry, are joined with the dictionary, so neither has to fit into one task's memory. Tasks are as many as the text asks for."""
    parts = max(1, -(-chars // EACH))
    words = words.repartition(parts, "__word")
    vocabulary = words.select("__word").distinct()
    starts = vocabulary.select("__word", F.explode(F.sequence(F.lit(1), F.length("__word"))).alias("i"))
    room = F.least(F.lit(longest), F.length("__word") - F.col("i") + 1)
    pieces = starts.where(room > 0).select("__word", "i", F.explode(F.sequence(F.lit(1), room)).alias("n")).withColumn("__piece", F.substr("__word", F.col("i"), F.col("n")))
    pieces = pieces.repartition(parts * min(longest, 32), "__piece")
    found = F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("n"), "__sound")))
    # the first piece at or after the place that is free, and of those at one place the longest
    taken = F.aggregate(
        "x", F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("said")),
        lambda a, p: F.when(p["i"] >= a["free"], F.struct((p["i"] - p["n"]).alias("free"), F.concat(a["said"], F.array(p["__sound"])).alias("said"))).otherwise(a), lambda a: F.array_join(a["said"], " "),
    )
    sounds = pieces.join(entries, "__piece").repartition(parts, "__word").groupBy("__word").agg(found.alias("x")).select("__word", taken.alias("__said"))
    spoken = words.join(sounds, "__word").repartition(parts, *keys).groupBy(*keys)
    return spoken.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__said"))), lambda x: x["__said"]), " ").alias("phonemes"))
