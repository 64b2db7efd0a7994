"""Transcript text: token normalisation, error rates and repetition measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def tokens(text):
    """Words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def plain(token):
    """Lower case without what isn't a letter, digit or underscore at either end."""
    return F.regexp_replace(F.lower(F.trim(token)), r"(?U)^\W+|\W+$", "")


def char_errors(reference, hypothesis):
    """100 * edit distance / length of the reference, on trimmed text; 0 for an empty reference. Characters are code points; long texts take a few operations for each character of the hypothesis."""

    def distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(r, h) if isinstance(r, str) and isinstance(h, str) else None for r, h in zip(reference, hypothesis)], dtype="Int64")

    n = F.char_length(F.trim(reference))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.pandas_udf(distance, "long")(F.trim(reference), F.trim(hypothesis)) / F.greatest(n, F.lit(1)))


def edit_distance(a: list | str, b: list | str) -> int:
    """Columns of the usual table as whole numbers of one bit a row, where the value goes up or down by one (Myers, Hyyro): a few operations on numbers for each word of ``b``, however long ``a`` is."""
    if not a:
        return len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for w in b:
        same = places.get(w, 0)
        straight = same | down
        across = ((same & up) + up ^ up) | same
        rises, falls = (down | ~(across | up)) & full, up & across
        distance += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = (falls | ~(straight | rises)) & full, rises & straight
    return distance


def joined_texts(rows, by: list[str], order: list[str], *texts: str):
    """The texts of each group one after another, a space between them, for error rates of a whole corpus rather than means of rows."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *texts)))
    return rows.groupBy(*by).agg(listed.alias("x")).select(*by, *[F.array_join(F.col(f"x.{t}"), " ").alias(t) for t in texts])


def parsed_segment(line):
    """A struct (s, e, spk) of a line "start end speaker"."""
    part = F.split(F.trim(line), r"\s+")
    return F.struct(F.try_element_at(part, F.lit(1)).cast("double").alias("s"), F.try_element_at(part, F.lit(2)).cast("double").alias("e"), F.try_element_at(part, F.lit(3)).alias("spk"))


def segment_line(s, e, spk):
    """A line "start end speaker" with three decimals."""
    return F.format_string("%.3f %.3f %s", s, e, spk)


def word_errors(reference, hypothesis):
    """100 * word edit distance / words of the reference; 0 for an empty reference. Also serves phonemes. Equal pairs of a batch are scored once."""

    def score(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for pair in zip(reference.fillna(""), hypothesis.fillna("")):
            if pair not in seen:
                r, h = pair[0].split(), pair[1].split()
                seen[pair] = 100.0 * edit_distance(r, h) / len(r) if r else 0.0
            out.append(seen[pair])
        return pd.Series(out, dtype=float)

    return F.pandas_udf(score, "double")(reference, hypothesis)


def adjacent_repeats(words):
    """Equal neighbours over n - 1; 0 for fewer than two words."""
    n = F.size(words)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.try_element_at(words, i) == F.try_element_at(words, i + 1)))
    return F.when(n < 2, F.lit(0.0)).otherwise(same.cast("double") / F.greatest(n - 1, F.lit(1)))


def trigram_repeats(words):
    """Share of trigrams that occurred before; 0 for fewer than six words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.when(n < 6, F.lit(0.0)).otherwise((F.size(grams) - F.size(F.array_distinct(grams))).cast("double") / F.size(grams))


def prompt_worthy(text):
    """No '...', at least three words, and a full stop (.!?) at the end or six words."""
    n = F.size(tokens(text))
    return ~F.contains(text, F.lit("...")) & (n >= 3) & (F.rlike(F.trim(text), F.lit(r"[.!?]$")) | (n >= 6))


def rolling_prompt(old, new, most: int = 240):
    """The last ``most`` characters, without blanks in front."""
    return F.ltrim(F.right(F.concat_ws(" ", old, new), F.lit(most)))


def clock(seconds):
    """m:ss, or --:-- for null."""
    whole = F.floor(seconds).cast("bigint")
    return F.coalesce(F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")), F.lit("--:--"))


def clamp(x, low: float, high: float):
    """Where x lies between two values, cut to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
