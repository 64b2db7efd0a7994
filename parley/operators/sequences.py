"""Order-dependent operators: change points, runs, thinning, peaks and folds along a recording."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import thin, turn_truth  # noqa: F401


def _order():
    return Window.partitionBy("rec").orderBy("s", "ord")


def change_points(rows: DataFrame) -> DataFrame:
    """(rec, ord, ts): the start of each row whose speaker is not the one before it."""
    before = F.lag("spk").over(_order())
    return rows.withColumn("__before", before).where(F.col("__before").isNotNull() & (F.col("spk") != F.col("__before"))).select("rec", "ord", F.col("s").alias("ts"))


def change_points_outside_overlap(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change points of the rows that are in no overlapping pair (rec, a, b)."""
    inside = pairs.select("rec", F.col("a").alias("ord")).union(pairs.select("rec", F.col("b").alias("ord"))).distinct()
    return change_points(rows.join(inside, ["rec", "ord"], "left_anti"))


def segment_ends(rows: DataFrame) -> DataFrame:
    """(rec, ord, ts): the end of every row but the last, in list order."""
    last = F.max("ord").over(Window.partitionBy("rec"))
    return rows.withColumn("__last", last).where("ord < __last").select("rec", "ord", F.col("e").alias("ts"))


def run_lengths(rows: DataFrame, value: str, flag: str | None = None, durations: DataFrame | None = None) -> DataFrame:
    """(rec, spk, s, e, n, mean), and the flag if one is named: runs of rows with one speaker and one value of ``flag``. A run ends where the next begins, the last at the recording's duration
    (rec, dur) if given, else at its largest end. Null speakers and flags are values of their own."""
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    kept = ["spk", *([flag] if flag else [])]
    same = F.lit(True)
    for c in kept:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(_order()))
    turn = F.when(F.row_number().over(_order()) == 1, F.lit(1)).otherwise((~same).cast("int"))
    runs = rows.withColumn("__turn", turn).withColumn("__run", F.sum("__turn").over(upto))
    grouped = runs.groupBy("rec", "__run", *kept).agg(F.min("s").alias("s"), F.max("e").alias("__e"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    last = F.max("__e").over(Window.partitionBy("rec"))
    if durations is not None:
        grouped, last = grouped.join(durations.select("rec", F.col("dur").alias("__dur")), "rec", "left"), F.coalesce("__dur", last)
    grouped = grouped.withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy("rec").orderBy("__run")), last))
    return grouped.select("rec", *kept, "s", "e", "n", "mean")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than what is on both sides; of a plateau its middle, the left one of two. The first and last values are none."""
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))  # of runs of equal values
    last = np.append(first[1:], len(x)) - 1
    level = x[first]
    top = np.zeros(len(first), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (first[top] + last[top]) // 2


def prominences(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How far each peak stands over the higher of its two sides' lowest values, a side reaching to the next higher value: a stack of falling values, with the least value since each, in one pass a side."""

    def lows(values: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(values)), []
        for i, v in enumerate(values.tolist()):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((v, low))
        return out

    left, right = lows(x), lows(x[::-1])[::-1]
    return x[places] - np.maximum(left[places], right[places])


def apart(places: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Places of which any two are at least ``distance`` apart: higher ones first, the later one of equals."""
    kept: list[int] = []
    for p in places[np.lexsort((-places, -heights))].tolist():
        at = bisect_left(kept, p)
        if (at == len(kept) or kept[at] - p >= distance) and (not at or p - kept[at - 1] >= distance):
            kept.insert(at, p)
    return np.array(kept, dtype=int)


def peaks(frames: DataFrame, prominence: float, distance: int = 1) -> DataFrame:
    """(rec, ix, score): local maxima (the middle of a plateau) at least ``distance`` apart, higher ones first, and at least as prominent. A recording is folded by one task, in time of n log n."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        x = pdf["score"].to_numpy()
        found = local_maxima(x)
        found = apart(found, x[found], distance)
        return pdf.iloc[found[prominences(x, found) >= prominence] if len(found) else found][["rec", "ix", "score"]]

    return frames.groupBy("rec").applyInPandas(find, frames.select("rec", "ix", "score").schema)


def backfill(rows: DataFrame) -> DataFrame:
    """Null speakers take the next known one, or else the last known one. Both are running values, the next one in the opposite order: a frame that reaches forward is read again for each row."""
    back = Window.partitionBy("rec").orderBy(F.col("s").desc(), F.col("ord").desc())
    known = lambda order: F.last("spk", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("spk", F.coalesce(known(back), known(_order())))
