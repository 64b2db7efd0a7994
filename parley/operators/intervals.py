"""Interval algebra on rows (rec, s, e, ...): joins by overlap, merging, sweeps, thresholds and integer frames.

Joins are on the recording and on time buckets, and a pair is kept in its first common bucket only, so that long
recordings are spread over tasks and no ``distinct`` is needed. Rows with null bounds match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 300.0


def _bucket(x, width: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(width)).cast("bigint")


def _spread(rows: DataFrame, low, high, width: float) -> DataFrame:
    first, last = _bucket(low, width), _bucket(high, width)
    return rows.withColumn("__first", first).withColumn("__b", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, keep: Column | None = None, width: float = BUCKET) -> DataFrame:
    """Pairs of rows of a recording whose half-open intervals overlap; the right's columns get the prefix ``r_``. ``keep`` is a further condition on both."""
    r = _spread(right, "s", "e", width).select([F.col(c).alias(f"r_{c}") for c in (*right.columns, "__first", "__b")])
    on = (F.col("rec") == F.col("r_rec")) & (F.col("__b") == F.col("r___b")) & (F.col("s") < F.col("r_e")) & (F.col("r_s") < F.col("e"))
    on = on & (F.col("__b") == F.greatest("__first", "r___first"))
    if keep is not None:
        on = on & keep
    return _spread(left, "s", "e", width).join(r, on).drop("__b", "__first", "r___b", "r___first", "r_rec")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left's rows cut to what they share with each of the right's."""
    both = overlap_join(left, right)
    cut = both.withColumn("s", F.greatest("s", "r_s")).withColumn("e", F.least("e", "r_e"))
    return cut.select(*left.columns, (F.col("e") - F.col("s")).alias("dur"))


def point_join(points: DataFrame, spans: DataFrame, before: float = 0.0, after: float = 0.0, width: float = BUCKET) -> DataFrame:
    """Points (rec, t, ...) with each closed interval [s - before, e + after] that holds them; the spans' columns get the prefix ``r_``."""
    r = _spread(spans, F.col("s") - before, F.col("e") + after, width).select([F.col(c).alias(f"r_{c}") for c in (*spans.columns, "__b")])
    on = (F.col("rec") == F.col("r_rec")) & (_bucket("t", width) == F.col("r___b")) & (F.col("t") >= F.col("r_s") - before) & (F.col("t") <= F.col("r_e") + after)
    return points.join(r, on).drop("r___b", "r_rec")


def speaker_at(points: DataFrame, spans: DataFrame, fallback: str = "unknown", width: float | None = None) -> DataFrame:
    """Points (rec, t, ...) with the speaker of the last span (by ord) that holds them, or the fallback; every point and column stays.

    Points and spans meet in chunks of time, in which spans take points from the last one down and a point that is taken is passed over: no pairs are made, however many spans hold a point.
    """
    from .chunked import chunk_width

    width = width or chunk_width(points.select("rec", "t").union(spans.select("rec", F.col("s").alias("t"))), "t")
    held = spans.where("rec is not null and ord is not null and s <= e")
    # names of its own, as both sides may come from one table
    held = _spread(held, "s", "e", width).select(*[F.col(c).alias(f"__{c}") for c in ("rec", "ord", "s", "e", "spk")], F.col("__b").alias("__at"))
    asked = points.drop("spk").withColumn("__chunk", _bucket("t", width))
    out = points.drop("spk").withColumn("spk", F.lit(fallback))

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        t = mine["t"].to_numpy(zero_copy_only=False).astype(float)
        order = np.argsort(t)  # times that are missing are last, and in no span
        ranked = theirs.take(pc.sort_indices(theirs, sort_keys=[("__ord", "descending")]))
        low = np.searchsorted(t[order], ranked["__s"].to_numpy(), side="left").tolist()
        high = np.searchsorted(t[order], ranked["__e"].to_numpy(), side="right").tolist()
        taken, free, left = np.full(len(t), -1), list(range(len(t) + 1)), len(t)
        for k, (i, end) in enumerate(zip(low, high)):
            while i < end:
                if free[i] != i:
                    free[i] = i = free[free[i]]  # on to the next one that is free, and the way to it halved
                    continue
                taken[order[i]], free[i], left = k, i + 1, left - 1
                i += 1
            if not left:
                break
        spk = ranked["__spk"].combine_chunks().take(pa.array(taken, mask=taken < 0))
        return mine.drop_columns("__chunk").append_column("spk", pc.fill_null(spk.cast(pa.string()), fallback))

    return asked.groupBy("rec", "__chunk").cogroup(held.groupBy("__rec", "__at")).applyInArrow(look, out.schema)


def overlap_texts(rows: DataFrame, others: DataFrame, width: float | None = None) -> DataFrame:
    """(rec, ord, n, text) for each (rec, ord) of ``rows``: how many of ``others`` overlap it, and their known speakers in the order of ord, null where there are none.

    Rows and others meet in chunks of time, where a row's text is written at once, so pairs are never rows of a table. Only rows longer than a chunk, or that share their ord, take the pairs of ``overlap_join``.
    """
    from .chunked import SLACK, chunk_width

    keyed = rows.groupBy("rec", "ord").agg(F.count("*").alias("__k"), F.min("s").alias("s"), F.min("e").alias("e"))
    width = width or chunk_width(rows.select("rec", "s").union(others.select("rec", "s")), "s", each=4000)
    short = (F.col("__k") == 1) & F.coalesce(F.col("e") - F.col("s") <= width, F.lit(True))
    mine = keyed.where(short).select("rec", "ord", "s", "e", _bucket("s", width).alias("__chunk"))
    longest = max(mine.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0.0, 0.0) + SLACK
    known = others.where("rec is not null and ord is not null and s is not null and e is not null")
    sent = _spread(known, F.col("s") - longest, "e", width).select(*[F.col(c).alias(f"__{c}") for c in ("rec", "ord", "s", "e", "spk")], F.col("__b").alias("__at"))
    out = mine.select("rec", "ord", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("text")).schema

    def write(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[("__ord", "ascending")]))
        low, high = (mine[c].to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("s", "e"))
        starts, ends = theirs["__s"].to_numpy(), theirs["__e"].to_numpy()
        spk = theirs["__spk"].combine_chunks()
        named = ~spk.is_null().to_numpy(zero_copy_only=False)
        tile, counts, texts = max(1, (1 << 22) // max(1, len(starts))), [np.empty(0, dtype=int)], []
        for at in range(0, len(mine), tile):
            i, j = np.nonzero((low[at : at + tile] < ends[None, :]) & (starts[None, :] < high[at : at + tile]))
            n = len(low[at : at + tile])
            counts.append(np.bincount(i, minlength=n))
            i, j = i[named[j]], j[named[j]]
            each = np.bincount(i, minlength=n)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), spk.take(pa.array(j)))
            texts.append(pc.if_else(pa.array(each > 0), pc.binary_join(listed, " "), pa.scalar(None, pa.string())))
        text = pa.chunked_array(texts, pa.string())
        return pa.table({"rec": mine["rec"], "ord": mine["ord"], "n": pa.array(np.concatenate(counts), pa.int64()), "text": text})

    found = mine.groupBy("rec", "__chunk").cogroup(sent.groupBy("__rec", "__at")).applyInArrow(write, out)
    rest = keyed.where(~short).select(F.col("rec").alias("__rec"), F.col("ord").alias("__ord"))
    same = F.col("rec").eqNullSafe(F.col("__rec")) & F.col("ord").eqNullSafe(F.col("__ord"))
    pairs = overlap_join(rows.join(rest, same, "left_semi"), known).groupBy("rec", "ord")
    listed = F.array_sort(F.collect_list(F.when(F.col("r_spk").isNotNull(), F.struct("r_ord", "r_spk"))))
    told = pairs.agg(F.count("*").alias("n"), F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda x: x["r_spk"]), " ")).alias("text"))
    return found.union(rest.join(told, same, "left").select(F.col("__rec"), F.col("__ord"), F.coalesce("n", F.lit(0)).cast("bigint"), "text"))


def overlapping_pairs(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of segments of different speakers, earlier ord first, that overlap by at least ``least``: (rec, a, b, s, e, spk_a, spk_b)."""
    both = overlap_join(rows, rows, (F.col("ord") < F.col("r_ord")) & (F.col("spk") != F.col("r_spk")) & (F.least("e", "r_e") - F.greatest("s", "r_s") >= least))
    return both.select("rec", F.col("ord").alias("a"), F.col("r_ord").alias("b"), F.greatest("s", "r_s").alias("s"), F.least("e", "r_e").alias("e"), F.col("spk").alias("spk_a"), F.col("r_spk").alias("spk_b"))


def merge(rows: DataFrame, by: tuple = ("rec",), gap: float = 0.0, n: Column | None = None) -> DataFrame:
    """Unions of intervals that overlap, touch or lie within ``gap``: (*by, s, e, n), n being the number of rows or the given aggregate."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.coalesce((F.col("s") > reach + F.lit(gap)).cast("int"), F.lit(1)))
    grouped = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"), (F.count("*") if n is None else n).alias("n")).drop("__island")


def speaker_islands(rows: DataFrame) -> DataFrame:
    """(rec, s, e, spk): each speaker's segments merged, which overlap the same intervals as the segments do, however many of one speaker there are. Rows that end before they begin stay as they are."""
    whole = merge(rows.where("s <= e"), ("rec", "spk")).select("rec", "s", "e", "spk")
    return whole.union(rows.where("e < s").select("rec", "s", "e", "spk"))


def _pairable(rows: DataFrame, least: float) -> DataFrame:
    """Rows that can overlap another by ``least``."""
    if least <= 0:
        raise ValueError("least is not over 0")
    return rows.where(F.col("rec").isNotNull() & F.col("ord").isNotNull() & F.col("spk").isNotNull() & (F.col("e") - F.col("s") >= least))


def _best_of_others(rows: DataFrame, value: Column, order, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` among the rows before it, in ``order``, of other speakers than its own (null where there are none).

    The largest of all and its speaker are a running maximum. While one speaker leads, the best of the others is the largest value of theirs since then, or what led before: so it is a running
    maximum too, of values that are put under the number of the lead.
    """
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    led = rows.withColumn("__x", value).withColumn("__lead", F.max(F.struct("__x", "spk")).over(upto))
    led = led.withColumn("__was", F.lag("__lead").over(order))
    fresh = F.coalesce((F.col("__lead.spk") != F.col("__was.spk")).cast("int"), F.lit(1))
    led = led.withColumn("__turn", F.sum(fresh).over(upto))
    other = F.when(fresh == 1, F.col("__was.__x")).when(F.col("spk") != F.col("__lead.spk"), F.col("__x"))
    led = led.withColumn("__next", F.max(F.struct("__turn", F.coalesce(other, F.lit(float("-inf"))).alias("x"))).over(upto))
    second = F.lag("__next").over(order)["x"]
    best = F.when(F.col("__was.spk") != F.col("spk"), F.col("__was.__x")).when(second > float("-inf"), second)
    return led.withColumn(name, best).drop("__x", "__lead", "__was", "__turn", "__next")


def shared_spans(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec, ord, spk, s, e, n): for each segment the union of what it shares, by at least ``least``, with the ``n`` segments of other speakers that start before it (of equal starts, those of smaller ord).

    All of these parts begin where the segment does, so the longest is their union: no pairs are made. ord is unique in a recording.
    """
    able = _pairable(rows, least).select("rec", "ord", "spk", "s", "e")
    gone = able.select("rec", "ord", "spk", (F.col("e") - F.lit(least)).alias("s"), "e", F.lit(1).alias("__k"))  # from then on it shares too little with what starts
    step = F.when(F.col("__k") == 0, 1).otherwise(-1)
    running = lambda *by: F.sum(step).over(Window.partitionBy(*by).orderBy("s", "__k", "ord").rowsBetween(Window.unboundedPreceding, 0))
    counted = able.withColumn("__k", F.lit(0)).union(gone).withColumn("n", running("rec") - running("rec", "spk")).where("__k = 0").drop("__k")
    found = _best_of_others(counted, F.col("e"), Window.partitionBy("rec").orderBy("s", "ord"), "__reach")
    return found.withColumn("e", F.least("e", "__reach")).where(F.col("__reach").isNotNull() & (F.col("e") - F.col("s") >= least)).drop("__reach")


def overlap_regions(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Merged regions, of at least ``least``, where two speakers are active: (rec, s, e, n), n being the number of pairs of segments."""
    found = merge(shared_spans(rows, least), n=F.sum("n")) if least > 0 else merge(overlapping_pairs(rows, least))
    return found.where(F.col("e") - F.col("s") >= least)


def first_pair_at(points: DataFrame, rows: DataFrame, least: float = 0.5, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """(rec, ord, t, a, b): for each point (rec, ord, t) the first, by start and then by ord, of the overlapping pairs whose common part, from ``before`` sooner to ``after`` later, holds it; points without one have no row.

    The start is that of the first shared span that reaches the point, and only spans that reach further than all before them can be that. At such a start, of each speaker only segments that
    last longer than those of smaller ord can be in the pair. So pairs are made of few rows for a start, and none for a point.
    """
    able = _pairable(rows, least).select("rec", "ord", "spk", "s", "e")
    starts = shared_spans(rows, least).groupBy("rec", "s").agg((F.max("e") + F.lit(after)).alias("top"))
    sooner = lambda c, by, *order: F.max(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    longer = lambda df, c, by, *order: df.withColumn("__m", sooner(c, by, *order)).where(F.col("__m").isNull() | (F.col(c) > F.col("__m"))).drop("__m")
    starts = longer(starts, "top", ["rec"], "s")
    both = points.where("t is not null").select("rec", "ord", "t", F.col("t").alias("__x"), F.lit(1).alias("__k"), F.lit(None).cast("double").alias("at"))
    both = both.union(starts.select("rec", F.lit(None).cast(points.schema["ord"].dataType).alias("ord"), F.lit(None).cast("double").alias("t"), F.col("top").alias("__x"), F.lit(0).alias("__k"), F.col("s").alias("at")))
    down = Window.partitionBy("rec").orderBy(F.col("__x").desc(), "__k").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("at", F.last("at", ignorenulls=True).over(down)).where((F.col("__k") == 1) & (F.col("at") - F.lit(before) <= F.col("t"))).select("rec", "ord", "t", "at")
    active = point_join(starts.select("rec", F.col("s").alias("t")), able).where(F.col("r_e") - F.col("t") >= least)
    each = ["rec", "t", "r_spk"]
    mine = longer(active.where("r_s = t"), "r_e", each, "r_ord").select("rec", "t", *[F.col(f"r_{c}").alias(f"m_{c}") for c in ("spk", "ord", "e")])
    pairs = longer(active, "r_e", each, "r_ord").join(mine, ["rec", "t"]).where("r_spk <> m_spk")
    pairs = pairs.select("rec", F.col("t").alias("at"), F.least("r_ord", "m_ord").alias("a"), F.greatest("r_ord", "m_ord").alias("b"), (F.least("r_e", "m_e") + F.lit(after)).alias("top"))
    listed = longer(pairs, "top", ["rec", "at"], "a", "b").groupBy("rec", "at").agg(F.array_sort(F.collect_list(F.struct("a", "b", "top"))).alias("__p"))
    found = placed.join(listed, ["rec", "at"]).withColumn("__p", F.get(F.filter("__p", lambda p: p["top"] >= F.col("t")), F.lit(0)))
    return found.select("rec", "ord", "t", "__p.a", "__p.b")


def in_overlap(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """``rows`` with ``overlapped``: whether a segment of another speaker overlaps it by at least ``least``, found from the furthest end of those before it and the nearest start of those after it."""
    able = F.col("rec").isNotNull() & F.col("ord").isNotNull() & F.col("spk").isNotNull() & (F.col("e") - F.col("s") >= least)
    able = F.coalesce(able, F.lit(False))
    order = Window.partitionBy("rec", "__able").orderBy("s", "ord")
    back = Window.partitionBy("rec", "__able").orderBy(F.col("s").desc(), F.col("ord").desc())
    both = _best_of_others(rows.withColumn("__able", able), F.col("e"), order, "__reach")
    both = _best_of_others(both, -F.col("s"), back, "__start")
    hit = (F.least("e", "__reach") - F.col("s") >= least) & F.col("__reach").isNotNull()
    hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.col("e") + F.col("__start") >= least, F.lit(False))
    return both.withColumn("overlapped", F.col("__able") & hit).drop("__able", "__reach", "__start")


def merge_same_speaker(rows: DataFrame, gap: float = 0.1) -> DataFrame:
    """In the order of (s, ord), a row joins the one before it if the speaker is the same and it starts within ``gap`` of its end: (rec, spk, s, e, n)."""
    order = Window.partitionBy("rec").orderBy("s", "ord")
    runs = rows.withColumn("__turn", F.coalesce((F.col("spk") != F.lag("spk").over(order)).cast("int"), F.lit(1)))
    runs = runs.withColumn("__run", F.sum("__turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merge(runs, ("rec", "__run", "spk"), gap).drop("__run")


def close_silences(rows: DataFrame, shortest: float) -> DataFrame:
    """Joins neighbours with a silence under ``shortest`` between them; the end is the last row's: (rec, s, e, n)."""
    order = Window.partitionBy("rec").orderBy("s", "ord")
    marked = rows.withColumn("__new", F.coalesce((F.col("s") - F.lag("e").over(order) >= shortest).cast("int"), F.lit(1)))
    grouped = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("rec", "__island").agg(F.min("s").alias("s"), F.max_by("e", F.struct("s", "ord")).alias("e"), F.count("*").alias("n")).drop("__island")


def sweep(rows: DataFrame) -> DataFrame:
    """Elementary intervals (rec, s, e, depth) between neighbouring bounds, with the number of active rows: no pairs are made."""
    edges = rows.select("rec", F.col("s").alias("t"), F.lit(1).alias("d")).union(rows.select("rec", F.col("e").alias("t"), F.lit(-1).alias("d")))
    edges = edges.groupBy("rec", "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("rec").orderBy("t")
    deep = edges.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("e", F.lead("t").over(order))
    return deep.where("e is not null").select("rec", F.col("t").alias("s"), "e", "depth")


def boundaries(points: DataFrame, durations: DataFrame) -> DataFrame:
    """Change points (rec, ts) and durations (rec, dur) as consecutive segments (rec, s, e) from 0 to the duration."""
    every = points.select("rec", "ts").union(durations.select("rec", F.lit(0.0).alias("ts"))).union(durations.select("rec", F.col("dur").alias("ts"))).distinct()
    order = Window.partitionBy("rec").orderBy("ts")
    return every.select("rec", F.col("ts").alias("s"), F.lead("ts").over(order).alias("e")).where("e is not null")


def hysteresis(frames: DataFrame, onset: float, offset: float) -> DataFrame:
    """Segments (rec, first, last, n) of frames (rec, ix, score) that begin at a score of ``onset`` and end below ``offset``.

    The state is the last decisive frame's, which is exact only where onset is not below offset.
    """
    if onset < offset:
        raise ValueError("onset is below offset")
    order = Window.partitionBy("rec").orderBy("ix")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(F.col("score") >= onset, 1).when(F.col("score") < offset, 0)
    active = frames.withColumn("__on", F.coalesce(F.last(decided, ignorenulls=True).over(upto), F.lit(0)))
    active = active.withColumn("__new", ((F.col("__on") == 1) & (F.coalesce(F.lag("__on").over(order), F.lit(0)) == 0)).cast("int"))
    grouped = active.withColumn("__island", F.sum("__new").over(upto)).where("__on = 1")
    return grouped.groupBy("rec", "__island").agg(F.min("ix").alias("first"), F.max("ix").alias("last"), F.count("*").alias("n")).drop("__island")


def to_frames(rows: DataFrame, frame: float = 0.01, durations: DataFrame | None = None) -> DataFrame:
    """Merged integer frame intervals (rec, s, e) [floor(s/frame), min(floor(e/frame), n)): what a frame-wise mask would hold, without a row a frame."""
    cut = rows.select("rec", F.floor(F.col("s") / F.lit(frame)).cast("bigint").alias("s"), F.floor(F.col("e") / F.lit(frame)).cast("bigint").alias("e"))
    if durations is not None:
        n = F.ceil(F.col("dur") / F.lit(frame)).cast("bigint")
        cut = cut.join(durations, "rec").select("rec", F.greatest("s", F.lit(0)).alias("s"), F.least("e", n).alias("e"))
    return merge(cut.where("e > s"), ("rec",)).select("rec", "s", "e")


def dilate(frames: DataFrame, k: int) -> DataFrame:
    """Frame intervals widened by ``k`` on both sides (from 0 on), merged."""
    return merge(frames.select("rec", F.greatest(F.col("s") - k, F.lit(0)).alias("s"), (F.col("e") + k).alias("e"))).select("rec", "s", "e")


def min_duration(rows: DataFrame, least: float = 0.5, rate: int = 16_000) -> DataFrame:
    """Rows that last at least ``least`` seconds, counted in whole samples of each bound, as an embedding model takes them. Rows without a bound go."""
    n = sample_index("e", rate) - sample_index("s", rate)
    return rows.where(n >= int(least * rate))


def sample_index(t, rate: int = 16_000) -> Column:
    """The sample at a time: cut towards zero."""
    return ((F.col(t) if isinstance(t, str) else t) * F.lit(float(rate))).cast("bigint")


def shifted(rows: DataFrame, by, *columns: str) -> DataFrame:
    """``rows`` with s and e (or the given columns) moved by a column or number; nulls stay null."""
    return rows.withColumns({c: F.col(c) + by for c in columns or ("s", "e")})


def several_active(frames: DataFrame, onset: float) -> DataFrame:
    """Frames (rec, ix, scores) as (rec, ix, score): 1 where more than one of the scores is at least ``onset``, else 0, ready for ``hysteresis``."""
    return frames.select("rec", "ix", (F.size(F.filter("scores", lambda x: x >= onset)) > 1).cast("double").alias("score"))


def class_probability(frames: DataFrame, classes: list[int]) -> DataFrame:
    """Frames (rec, ix, scores) as (rec, ix, score): the probability of the given classes (from 0) together. If any score of the recording is negative they are logarithms."""
    logs = F.min(F.array_min("scores")).over(Window.partitionBy("rec")) < 0
    wanted = F.filter(F.transform("scores", lambda x, i: F.when(i.isin(classes), x)), lambda x: x.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return frames.select("rec", "ix", F.when(logs, add(F.transform(wanted, F.exp))).otherwise(add(wanted)).alias("score"))


def change_score(frames: DataFrame, logs: bool | None = None) -> DataFrame:
    """Frames (rec, ix, scores) as (rec, ix, score): the L1 distance to the frame before (0 for the first), over the recording's largest; 0 where nothing changes.

    Of logarithms the probabilities are compared. Scores are logarithms where ``logs`` says so; where it is None, in each recording in which none is over 0, which takes logarithms of scores over 1 for plain ones."""
    logs = F.max(F.array_max("scores")).over(Window.partitionBy("rec")) <= 0 if logs is None else F.lit(logs)
    frames = frames.withColumn("scores", F.when(logs, F.transform("scores", F.exp)).otherwise(F.col("scores")))
    before = F.lag("scores").over(Window.partitionBy("rec").orderBy("ix"))
    far = F.coalesce(F.aggregate(F.zip_with("scores", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    moved = frames.select("rec", "ix", far.alias("d")).withColumn("top", F.max("d").over(Window.partitionBy("rec")))
    return moved.select("rec", "ix", F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(F.lit(0.0)).alias("score"))


def signal_windows(durations: DataFrame, width: float, hop: float) -> DataFrame:
    """(rec, n, s, e) for each recording (rec, dur): windows of ``width`` every ``hop``, and a last shorter one if over half of it is left."""
    whole = F.when(F.col("dur") >= width, F.floor((F.col("dur") - width) / hop).cast("bigint") + 1).otherwise(F.lit(0))
    left = F.col("dur") - F.col("whole") * F.lit(hop)
    rows = durations.where("dur > 0").select("rec", "dur", whole.alias("whole"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("whole")))).where((F.col("n") < F.col("whole")) | (left > width / 2))
    return rows.select("rec", F.col("n").cast("bigint").alias("n"), (F.col("n") * F.lit(hop)).alias("s"), F.least(F.col("n") * F.lit(hop) + F.lit(width), "dur").alias("e"))


def stitched(rows: DataFrame, length: float, overlap: float, gap: float = 0.1) -> DataFrame:
    """Segments (rec, chunk, ord, s, e, spk) with times within chunks of ``length`` that overlap, on the recording's clock: (rec, spk, s, e, n).

    A segment joins the one before it if that is the same speaker's and ends no more than ``gap`` before it starts; another speaker in between parts them."""
    ordered = rows.withColumn("ord", F.struct("ord", "chunk"))  # two chunks may find the same
    return merge_same_speaker(shifted(ordered, F.col("chunk") * F.lit(length - overlap)), gap)


def numbered_frames(frames: DataFrame) -> DataFrame:
    """Frames (rec, chunk, ix, score) of chunks one after another as (rec, ix, score)."""
    sizes = frames.groupBy("rec", "chunk").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("rec").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("rec", "chunk").orderBy("ix")) - 1
    return frames.withColumn("ix", place).join(sizes.select("rec", "chunk", start.alias("start")), ["rec", "chunk"]).select("rec", (F.col("start") + F.col("ix")).cast("bigint").alias("ix"), "score")


def with_processed(regions: DataFrame, processed: DataFrame, keys: tuple = ("rec", "s", "e")) -> DataFrame:
    """Regions with what was made of them, where something was: an equal join on the region's own bounds, bit by bit, or on any other ``keys``. Null bounds meet nothing; extra columns of ``processed`` follow."""
    return regions.join(processed, list(keys), "left")


def with_embeddings(speakers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Speakers separated from regions (region, idx, ...) with the cluster and place of their embedding (region, idx, cluster, place), null where none was made."""
    return speakers.join(embeddings.select("region", "idx", "cluster", "place"), ["region", "idx"], "left")
