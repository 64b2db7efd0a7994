"""Scores of segmentations: frame, boundary and IoU precision and recall, label agreement, and diarization error."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import greedy_pairs, matched
from .intervals import dilate, intersect, merge, overlap_join, speaker_islands, sweep, to_frames


def prf(rows: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """precision_pct, recall_pct and f1_pct (0 where undefined)."""
    part = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.lit(100.0) * a / F.greatest(b, F.lit(1)))
    p, r = part(F.col(tp), F.col(tp) + F.col(fp)), part(F.col(tp), F.col(tp) + F.col(fn))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-300)))
    return rows.withColumns({"precision_pct": p, "recall_pct": r, "f1_pct": f1})


def _total(frames: DataFrame, name: str) -> DataFrame:
    return frames.groupBy("rec").agg(F.sum(F.col("e") - F.col("s")).cast("bigint").alias(name))


def _common(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    both = overlap_join(a, b, width=30_000.0)
    return both.groupBy("rec").agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).cast("bigint").alias(name))


def frame_counts(truth: DataFrame, predicted: DataFrame, frame: float = 0.01, tolerance: int = 0) -> DataFrame:
    """(rec, tp, fp, fn) in frames, by intersecting integer intervals. With a tolerance, truth is widened for tp and fp, but not for fn."""
    t, p = to_frames(truth, frame), to_frames(predicted, frame)
    wide = dilate(t, tolerance) if tolerance else t
    recs = truth.select("rec").union(predicted.select("rec")).distinct()
    out = recs
    for part in (_common(wide, p, "tp"), _common(t, p, "hit"), _total(p, "np"), _total(t, "nt")):
        out = out.join(part, "rec", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("rec", z("tp").alias("tp"), (z("np") - z("tp")).alias("fp"), (z("nt") - z("hit")).alias("fn"))


def near_points(predicted: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """Predicted change points (rec, ts) with a reference within the tolerance: a semi-join on buckets."""
    width = max(tolerance, 1.0)
    cell = F.floor(F.col("ts") / width)
    left = predicted.withColumn("__c", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = truth.select(F.col("rec").alias("r_rec"), F.col("ts").alias("r_ts"), cell.alias("r_c"))
    hit = left.join(right, (F.col("rec") == F.col("r_rec")) & (F.col("__c") == F.col("r_c")) & (F.abs(F.col("ts") - F.col("r_ts")) <= tolerance), "left_semi")
    return hit.drop("__c").distinct()


def change_point_scores(predicted: DataFrame, truth: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(rec, tp, n_pred, n_ref, precision_pct, recall_pct, f1_pct). A reference may be used again, so recall can pass 100; both empty give 100s,
    no references (0, 100, 0), no predictions (100, 0, 0)."""
    count = lambda df, name: df.groupBy("rec").agg(F.count("*").alias(name))
    recs = predicted.select("rec").union(truth.select("rec")).distinct()
    rows = recs.join(count(near_points(predicted, truth, tolerance), "tp"), "rec", "left").join(count(predicted, "n_pred"), "rec", "left").join(count(truth, "n_ref"), "rec", "left").fillna(0, ["tp", "n_pred", "n_ref"])
    none, nor, nop = (F.col("n_pred") == 0) & (F.col("n_ref") == 0), F.col("n_ref") == 0, F.col("n_pred") == 0
    p = F.lit(100.0) * F.col("tp") / F.greatest("n_pred", F.lit(1))
    r = F.lit(100.0) * F.col("tp") / F.greatest("n_ref", F.lit(1))
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-300)))
    case = lambda a, b, c, x: F.when(none, F.lit(a)).when(nor, F.lit(b)).when(nop, F.lit(c)).otherwise(x)
    return rows.withColumns({"precision_pct": case(100.0, 0.0, 100.0, p), "recall_pct": case(100.0, 100.0, 0.0, r), "f1_pct": case(100.0, 0.0, 0.0, f)})


def match_points(a, b, tolerance: float) -> int:
    """The most one-to-one pairs within the tolerance; two pointers over sorted points find it."""
    a, b = sorted(a), sorted(b)
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def boundary_scores(predicted: DataFrame, truth: DataFrame, tolerances=(0.5, 1.0, 2.0, 3.0, 5.0)) -> DataFrame:
    """(rec, tolerance, tp, n_pred, n_ref, precision_ratio, recall_ratio, f1_ratio) by one-to-one matching, in chunks of each recording."""
    count = lambda df, name: df.groupBy("rec").agg(F.count("ts").alias(name))
    each = F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance")
    sizes = count(predicted, "n_pred").join(count(truth, "n_ref"), "rec", "full").fillna(0, ["n_pred", "n_ref"]).select("rec", each, "n_pred", "n_ref")
    rows = sizes.join(matched(predicted, truth, tuple(tolerances)), ["rec", "tolerance"], "left").fillna(0, ["tp"])
    part = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    rows = rows.select("rec", "tolerance", "tp", "n_pred", "n_ref", part("tp", "n_pred").alias("precision_ratio"), part("tp", "n_ref").alias("recall_ratio"))
    both = F.col("precision_ratio") + F.col("recall_ratio")
    return rows.withColumn("f1_ratio", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision_ratio") * F.col("recall_ratio") / F.greatest(both, F.lit(1e-300))))


def iou_scores(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec, tp, fp, fn): in list order, each prediction takes the first free reference with at least that intersection over union."""
    count = lambda df, name: df.groupBy("rec").agg(F.count("*").alias(name))
    rows = count(predicted, "np").join(count(truth, "nt"), "rec", "full").join(greedy_pairs(predicted, truth, least), "rec", "left").fillna(0, ["np", "nt", "tp"])
    return rows.select("rec", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


def overlap_labels(predicted: DataFrame, truth: DataFrame, missing: str = "none", width: float | None = None) -> DataFrame:
    """Predictions (rec, ord, spk) with true_spk: the speaker of the one reference segment that overlaps most, the first of those that tie. ord is unique in a recording.

    Rows meet in chunks of time. Of the references that began before a prediction only those that last longer than all of smaller ord can be the one, and these are kept as they come; only where none of
    them covers the prediction, those that begin within it are looked at. So a prediction has a row for each of its chunks, and none for a pair.
    """
    from .chunked import chunk_width

    width = width or chunk_width(predicted.select("rec", "s").union(truth.select("rec", "s")), "s")
    at = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    over = lambda df: df.withColumn("own", at("s")).withColumn("chunk", F.explode_outer(F.sequence(at("s"), F.greatest(at("s"), at("e")))))
    asked = over(predicted).select("rec", "ord", "spk", "s", "e", "own", "chunk")
    held = over(truth.where("rec is not null and ord is not null and s is not null and e is not null")).select(*[F.col(c).alias(f"r_{c}") for c in ("rec", "ord", "spk", "s", "e", "own", "chunk")])

    def label(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by([("r_s", "ascending"), ("r_ord", "ascending")])
        ts, te, no = (theirs[c].to_numpy() for c in ("r_s", "r_e", "r_ord"))
        starts, s, e = ts.tolist(), mine["s"].to_numpy(zero_copy_only=False).astype(float), mine["e"].to_numpy(zero_copy_only=False).astype(float)
        ends, numbers, places = te.tolist(), no.tolist(), list(range(len(ts)))
        here = mine["chunk"].to_numpy(zero_copy_only=False) == mine["own"].to_numpy(zero_copy_only=False)
        fresh = int(np.searchsorted(theirs["r_own"].to_numpy(), theirs["r_chunk"][0].as_py())) if len(theirs) else 0  # those before began in earlier chunks
        share, found = np.full(len(s), np.nan), np.full(len(s), -1)
        reach: list[float] = []  # rising ends of those that have begun, each with the smallest ord of all that end no sooner
        first: list[int] = []
        k = 0
        for i in np.argsort(s, kind="stable").tolist():
            low, high = float(s[i]), float(e[i])
            if low != low or high != high:
                continue
            best = None
            if here[i]:
                while k < len(starts) and starts[k] <= low:
                    p = bisect_left(reach, ends[k])
                    if p == len(reach) or numbers[first[p]] > numbers[k]:
                        q = p + (p < len(reach) and reach[p] == ends[k])
                        while p and numbers[first[p - 1]] > numbers[k]:
                            p -= 1
                        reach[p:q], first[p:q] = [ends[k]], [places[k]]
                    k += 1
                if high <= low:  # of no length: only those that hold it, and all share as much
                    inside = np.flatnonzero((ts < high) & (te > low))
                    if len(inside):
                        best = (high - low, int(inside[no[inside].argmin()]))
                else:
                    gone = bisect_right(reach, low)
                    del reach[:gone], first[:gone]
                    if reach:
                        p = min(bisect_left(reach, high), len(reach) - 1)
                        best = (min(reach[p], high) - low, first[p])
            if high > low and (best is None or best[0] < high - low):
                p, q = max(fresh, bisect_right(starts, low)), bisect_left(starts, high)
                if p < q:
                    shared = np.where(te[p:q] > low, np.minimum(te[p:q], high) - ts[p:q], -np.inf)
                    most = shared.max()
                    if most > -np.inf and (best is None or most >= best[0]):
                        tied = p + np.flatnonzero(shared == most)
                        j = int(tied[no[tied].argmin()])
                        if best is None or most > best[0] or numbers[j] < numbers[best[1]]:
                            best = (float(most), j)
            if best is not None:
                share[i], found[i] = best
        take = pa.array(found, mask=found < 0)
        told = mine.select(["rec", "ord", "spk"]).append_column("share", pa.array(share, mask=np.isnan(share)))
        return told.append_column("r_ord", theirs["r_ord"].combine_chunks().take(take)).append_column("true_spk", theirs["r_spk"].combine_chunks().take(take))

    kinds = ", ".join(f"{c} {predicted.schema[c].dataType.simpleString()}" for c in ("rec", "ord", "spk"))
    kinds += f", share double, r_ord {truth.schema['ord'].dataType.simpleString()}, true_spk {truth.schema['spk'].dataType.simpleString()}"
    parts = asked.groupBy("rec", "chunk").cogroup(held.groupBy("r_rec", "r_chunk")).applyInArrow(label, kinds)
    best = parts.groupBy("rec", "ord", "spk").agg(F.max_by("true_spk", F.when(F.col("share").isNotNull(), F.struct("share", -F.col("r_ord")))).alias("true_spk"))
    return best.select("rec", "ord", "spk", F.coalesce("true_spk", F.lit(missing)).alias("true_spk"))


def confusion(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("spk", "true_spk").agg(F.count("*").alias("n"))


def best_assignment(table: np.ndarray) -> list[tuple[int, int]]:
    """A one-to-one mapping of rows to columns with the largest sum, by shortest augmenting paths."""
    rows, columns = table.shape
    if rows > columns:
        return sorted((i, j) for j, i in best_assignment(table.T))
    cost = -table.astype(float)
    u, v, match = np.zeros(rows + 1), np.zeros(columns + 1), np.zeros(columns + 1, dtype=int)
    for i in range(1, rows + 1):
        match[0], j = i, 0
        low, back, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, dtype=int), np.zeros(columns + 1, dtype=bool)
        while True:
            used[j] = True
            row = match[j]
            free = np.flatnonzero(~used[1:]) + 1
            gain = cost[row - 1, free - 1] - u[row] - v[free]
            better = gain < low[free]
            low[free[better]], back[free[better]] = gain[better], j
            nxt = free[np.argmin(low[free])]
            delta = low[nxt]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j = nxt
            if not match[j]:
                break
        while j:
            match[j] = match[back[j]]
            j = back[j]
    return sorted((match[j] - 1, j - 1) for j in range(1, columns + 1) if match[j])


def label_alignment(labelled: DataFrame, predicted: str = "predicted", true: str = "label") -> DataFrame:
    """(predicted, label): the one-to-one mapping of predicted to true labels that most rows agree with. Counts are aggregated first; the table of labels is solved in one task."""
    counts = labelled.groupBy(F.col(predicted).cast("string").alias("p"), F.col(true).cast("string").alias("t")).agg(F.count("*").alias("n"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="p", columns="t", values="n", fill_value=0, aggfunc="sum")
        return pd.DataFrame([(table.index[i], table.columns[j]) for i, j in best_assignment(table.to_numpy())], columns=[predicted, true])

    return counts.groupBy().applyInPandas(assign, f"{predicted} string, {true} string")


def class_scores(labelled: DataFrame, predicted: str = "predicted", true: str = "label", noise=None) -> DataFrame:
    """One row (n, macro_precision, macro_recall, macro_f1, weighted_precision, weighted_recall, weighted_f1) of predicted against true labels.

    Rows with the ``noise`` label are left out; so are, after ``label_alignment``, null predictions. Means are over the classes that either side has, weights are the true rows of each.
    """
    rows = labelled.where(F.col(predicted).isNotNull() & F.col(true).isNotNull())
    rows = rows.where(F.col(predicted) != noise) if noise is not None else rows
    side = lambda c, name: rows.groupBy(F.col(c).alias("c")).agg(F.count("*").alias(name))
    same = rows.where(F.col(predicted) == F.col(true)).groupBy(F.col(true).alias("c")).agg(F.count("*").alias("tp"))
    each = side(true, "nt").join(side(predicted, "np"), "c", "full").join(same, "c", "left").fillna(0, ["nt", "np", "tp"])
    part = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.greatest(b, F.lit(1)))
    each = each.select("nt", part(F.col("tp"), F.col("np")).alias("precision"), part(F.col("tp"), F.col("nt")).alias("recall"), part(2 * F.col("tp"), F.col("np") + F.col("nt")).alias("f1"))
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [(F.sum(F.col(c) * F.col("nt")) / F.sum("nt")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return each.agg(F.sum("nt").alias("n"), *means)


def elementary(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(rec, s, e, refs, hyps): intervals between neighbouring bounds with the speakers active in each, as sorted lists without repeats."""
    both = ref.select("rec", "s", "e", "spk", F.lit(0).alias("side")).union(hyp.select("rec", "s", "e", "spk", F.lit(1).alias("side")))
    cells = sweep(both).where("depth > 0").select("rec", "s", "e")
    inside = overlap_join(cells, both)
    name = lambda n: F.sort_array(F.collect_set(F.when(F.col("r_side") == n, F.col("r_spk"))))
    return inside.groupBy("rec", "s", "e").agg(name(0).alias("refs"), name(1).alias("hyps"))


def speaker_mapping(cells: DataFrame) -> DataFrame:
    """(rec, hyp, ref): for each recording, the one-to-one mapping of speakers that shares the most seconds."""
    shared = cells.select("rec", (F.col("e") - F.col("s")).alias("d"), F.explode("refs").alias("ref"), "hyps").select("rec", "d", "ref", F.explode("hyps").alias("hyp")).groupBy("rec", "ref", "hyp").agg(F.sum("d").alias("d"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="hyp", columns="ref", values="d", fill_value=0.0, aggfunc="sum")
        pairs = best_assignment(table.to_numpy())
        return pd.DataFrame([(pdf["rec"].iloc[0], table.index[i], table.columns[j]) for i, j in pairs if table.iat[i, j] > 0], columns=["rec", "hyp", "ref"])

    return shared.groupBy("rec").applyInPandas(assign, "rec string, hyp string, ref string")


def diarization_error(ref: DataFrame, hyp: DataFrame, optimal: bool = True, collar: float = 0.0, uem: DataFrame | str | None = None) -> DataFrame:
    """(rec, total, miss, false_alarm, confusion, der_pct). Overlapped speech counts; without ``optimal``, speakers are taken by name.

    ``collar`` is the whole width left out around each reference boundary. ``uem`` limits what is scored: intervals (rec, s, e), such as 0 to the duration, or "reference" for the
    union of the reference's regions. A speaker's segments are merged first, so an instant has a row for each speaker that is active and not for each segment.
    """
    if uem is not None:
        parts = merge(ref if isinstance(uem, str) else uem).select("rec", "s", "e")
        ref, hyp = (intersect(x.select("rec", "s", "e", "spk"), parts).drop("dur") for x in (ref, hyp))
    cells = elementary(*(speaker_islands(x.where("s < e")) for x in (ref, hyp)))
    if collar:
        bounds = ref.select("rec", F.explode(F.array("s", "e")).alias("t")).distinct().select("rec", (F.col("t") - collar / 2).alias("s"), (F.col("t") + collar / 2).alias("e"))
        bounds = merge(bounds).select("rec", "s", "e")
        out = sweep(cells.select("rec", "s", "e").union(bounds))
        scored = overlap_join(out.select("rec", "s", "e"), cells).select("rec", "s", "e", F.col("r_refs").alias("refs"), F.col("r_hyps").alias("hyps"))
        hidden = overlap_join(scored, bounds).select("rec", "s", "e").distinct()
        cells = scored.join(hidden, ["rec", "s", "e"], "left_anti")
    if optimal:
        named = speaker_mapping(cells).groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("hyp", "ref"))).alias("names"))
        cells = cells.join(named, "rec", "left").withColumn("hyps", F.transform("hyps", lambda h: F.coalesce(F.try_element_at("names", h), F.concat(F.lit("?"), h))))
    d, r, h = F.col("e") - F.col("s"), F.size("refs"), F.size("hyps")
    ok = F.size(F.array_intersect("refs", "hyps"))
    z = F.lit(0)
    sums = cells.groupBy("rec").agg(F.sum(d * r).alias("total"), F.sum(d * F.greatest(r - h, z)).alias("miss"), F.sum(d * F.greatest(h - r, z)).alias("false_alarm"), F.sum(d * (F.least(r, h) - ok)).alias("confusion"))
    error = F.col("miss") + F.col("false_alarm") + F.col("confusion")
    return sums.withColumn("der_pct", F.when(F.col("total") > 0, F.lit(100.0) * error / F.greatest("total", F.lit(1e-300))).otherwise(0.0))


def adjusted_rand(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari) from two label columns."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / F.lit(2.0))
    count = lambda *by: labelled.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    both, left, right = count(a, b).agg(pairs("n").alias("ij"), F.sum("n").alias("n")), count(a).agg(pairs("n").alias("i")), count(b).agg(pairs("n").alias("j"))
    row = both.crossJoin(left).crossJoin(right)  # one row each
    every = F.col("n") * (F.col("n") - 1) / F.lit(2.0)
    expected = F.col("i") * F.col("j") / F.when(every == 0, F.lit(1.0)).otherwise(every)
    most = (F.col("i") + F.col("j")) / F.lit(2.0)
    return row.select(F.col("n").cast("bigint").alias("n"), F.when(most == expected, F.lit(1.0)).otherwise((F.col("ij") - expected) / F.when(most == expected, F.lit(1.0)).otherwise(most - expected)).alias("ari"))
