"""Folds along recordings of any length, in chunks of time.

Each rule says what a chunk does to every state in which it can be entered; such a summary is far smaller than the chunk. A walk over a recording's summaries, in order, gives the state in which
each chunk is entered, and then the chunks are folded on their own. So one recording of millions of rows is spread over as many tasks as it has chunks, and only summaries meet in one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the longest recording that a chunk should have.
EACH = 20_000
#: Beyond a tolerance, so that rounding never leaves a point out of a neighbour's chunk.
SLACK = 1e-6


def chunk_width(rows: DataFrame, at: str, least: float = 0.0, each: int = EACH) -> float:
    """Seconds a chunk, so that the recordings of over ``each`` rows are parted into chunks of about as many, and shorter ones are not."""
    sizes = rows.groupBy("rec").agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    found = sizes.where(F.col("n") > each).agg(F.min(F.col("span") / F.ceil(F.col("n") / each))).first()[0]
    return 1e9 if found is None else max(float(found), least, 1e-3)


def _in_chunks(rows: DataFrame, at: str, width: float) -> DataFrame:
    return rows.where(F.col(at).isNotNull()).withColumn("__chunk", F.floor(F.col(at) / F.lit(width)).cast("bigint"))


def _frame(rows: list[tuple], *columns: str) -> pd.DataFrame:
    """Rows with Python values in every column."""
    return pd.DataFrame(rows, columns=list(columns), dtype=object)


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _entries(chunked: DataFrame, by: list[str], summarise: Callable[[pd.DataFrame], object], start, step: Callable) -> DataFrame:
    """(by, __chunk, entry): the state in which each chunk is entered, as JSON. ``step(state, summary, chunk)`` gives the state after a chunk."""
    keys = ", ".join(f"{c} {_kind(chunked, c)}" for c in by)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([(*key, json.dumps(summarise(pdf)))], *by, "__chunk", "summary")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for chunk, summary in pdf.sort_values("__chunk")[["__chunk", "summary"]].itertuples(index=False):
            out.append((*key, chunk, json.dumps(state)))
            state = step(state, json.loads(summary), chunk)
        return _frame(out, *by, "__chunk", "entry")

    summaries = chunked.groupBy(*by, "__chunk").applyInPandas(one, f"{keys}, __chunk long, summary string")
    return summaries.groupBy(*by).applyInPandas(walk, f"{keys}, __chunk long, entry string")


def next_points(t: np.ndarray, gap: float) -> np.ndarray:
    """For each of the sorted points the first one with t_j - t_i >= gap, or len(t)."""
    n = len(t)
    at = np.searchsorted(t, t + gap, side="left")
    back = at > 0
    back[back] = t[at[back] - 1] - t[back] >= gap  # t + gap was rounded up
    at = at - back
    on = at < n
    on[on] = t[at[on]] - t[on] < gap  # or down
    return at + on


def thin(points: DataFrame, gap: float, width: float | None = None) -> DataFrame:
    """Points (rec, ts), of each recording the first and then each that is at least ``gap`` after the last one kept.

    A chunk's point leads to the next one kept, and pointers are doubled until they reach the last one of the chunk. Only points less than a gap after the chunk's first can be its first kept, and most of
    them soon lead to the same last one, so a summary has a row for each different one. Null times are left out; points at one time count once.
    """
    chunked = _in_chunks(points.select("rec", "ts"), "ts", width or chunk_width(points, "ts", 8 * gap))

    def summary(pdf: pd.DataFrame) -> list:
        t = np.unique(pdf["ts"].to_numpy())
        to = next_points(t, gap)
        last = np.where(to < len(t), to, np.arange(len(t)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        most = min(len(t), int(np.searchsorted(t, t[0] + gap)) + 2)
        ends = np.append(np.flatnonzero(np.diff(last[:most])), most - 1)
        return [[float(t[i]), float(t[last[i]])] for i in ends]

    def step(state, summary, _):
        return next((end for t, end in summary if state is None or t - state >= gap), state)

    def keep(key: tuple, mine: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(mine["ts"].to_numpy())
        out = []
        if len(t):
            state, to = json.loads(entry["entry"].iloc[0]), next_points(t, gap)
            i = 0 if state is None else int(np.searchsorted(t - state, gap))
            while i < len(t):
                out.append(t[i])
                i = int(to[i])
        return _frame([(key[0], float(t)) for t in out], "rec", "ts")

    entries = _entries(chunked, ["rec"], summary, None, step)
    return chunked.groupBy("rec", "__chunk").cogroup(entries.groupBy("rec", "__chunk")).applyInPandas(keep, f"rec {_kind(points, 'rec')}, ts double")


class _Turns:
    """Who holds the turn, and until when: a row of another speaker takes it when it starts no more than ``tolerance`` before the end, or outlasts it."""

    def __init__(self, pdf: pd.DataFrame, shortest: float, tolerance: float):
        rows = pdf.sort_values(["s", "ord"])
        rows = rows[~(rows["e"] - rows["s"] < shortest)]
        self.rows, self.tolerance = list(rows[["s", "e", "spk"]].itertuples(index=False, name=None)), tolerance

    def takes(self, s: float, e: float, end: float) -> bool:
        return s >= end - self.tolerance or e > end

    def run(self, state: list | None, first: int = 0, known: dict | None = None) -> tuple[list | None, list[float]]:
        """The state after the rows from ``first`` on, and the times at which the turn went over. ``known``: states at the end by the row that took the turn."""
        out: list[float] = []
        for k in range(first, len(self.rows)):
            s, e, spk = self.rows[k]
            if state is None:
                state = [spk, e]
            elif spk == state[0]:
                state = [spk, max(state[1], e)]
            elif self.takes(s, e, state[1]):
                if known is not None and k in known:
                    return known[k], out
                out.append(s)
                state = [spk, e]
        return state, out

    def summary(self) -> dict:
        known: dict = {}

        def after(k: int) -> list:
            if k not in known:
                known[k] = self.run([self.rows[k][2], self.rows[k][1]], k + 1, known)[0]
            return known[k]

        for k in range(len(self.rows) - 1, -1, -1):
            after(k)  # from the end on, so that each is a short way to one that is known
        held = {}
        for speaker in {r[2] for r in self.rows} | {None}:  # None stands for all who have no row here
            best, own, ways = -np.inf, -np.inf, []
            for k, (s, e, spk) in enumerate(self.rows):
                if spk == speaker:
                    own = max(own, e)
                elif max(s + self.tolerance, e) > best - SLACK and self.takes(s, e, own):
                    # it takes turns that those before it don't
                    best = max(best, s + self.tolerance, e)
                    ways.append([s, e, known[k]])
            held["" if speaker is None else "=" + speaker] = [None if own == -np.inf else own, ways]
        return {"first": known[0] if self.rows else None, "held": held}


def turn_truth(rows: DataFrame, shortest: float = 0.2, tolerance: float = 0.3, width: float | None = None) -> DataFrame:
    """(rec, ts) reference change points: rows under ``shortest`` are ignored; a new speaker takes the turn when it starts no more than ``tolerance`` before the current one ends, or when it outlasts
    the current one. Null speakers are one speaker of no name."""
    chunked = _in_chunks(rows.select("rec", "ord", "s", "e", F.coalesce("spk", F.lit("")).alias("spk")), "s", width or chunk_width(rows, "s"))

    def step(state, summary, _):
        if state is None:
            return summary["first"]
        own, ways = summary["held"].get("=" + state[0], summary["held"][""])
        for s, e, after in ways:
            if s >= state[1] - tolerance or e > state[1]:
                return after
        return [state[0], state[1] if own is None else max(state[1], own)]

    def changes(key: tuple, mine: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = _Turns(mine, shortest, tolerance).run(json.loads(entry["entry"].iloc[0]))[1] if len(mine) else []
        return _frame([(key[0], float(t)) for t in out], "rec", "ts")

    entries = _entries(chunked, ["rec"], lambda pdf: _Turns(pdf, shortest, tolerance).summary(), None, step)
    return chunked.groupBy("rec", "__chunk").cogroup(entries.groupBy("rec", "__chunk")).applyInPandas(changes, f"rec {_kind(rows, 'rec')}, ts double")


def match_summary(a: np.ndarray, b: np.ndarray, before: tuple[int, int], next_start: float, tolerance: float) -> list:
    """What a chunk makes of the points left over before it: [side, left, matched, side after, left after] for each way. ``before``: how many of the sorted ``a`` and ``b`` lie before the chunk.

    Matching in order leaves points of one side only, and always the last ones, so their number is the state.
    """
    known: dict[tuple[int, int], tuple[int, int, int]] = {}
    out = []
    ways = [(0, left) for left in range(before[0] + 1)] + [(1, left) for left in range(1, before[1] + 1)]
    for side, left in ways:
        i, j = before[0] - (left if side == 0 else 0), before[1] - (left if side == 1 else 0)
        path = []
        n = 0
        while i < len(a) and j < len(b) and (i, j) not in known:
            path.append((i, j, n))
            if abs(a[i] - b[j]) <= tolerance:
                n, i, j = n + 1, i + 1, j + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        more, i, j = known.get((i, j), (0, i, j))
        n += more
        for x, y, had in path:
            known[x, y] = (n - had, i, j)
        still_a = int((a[i:] >= next_start - tolerance - SLACK).sum())
        still_b = int((b[j:] >= next_start - tolerance - SLACK).sum())
        out.append([side, left, n, 0 if still_a else 1, still_a or still_b])
    return out


def matched(predicted: DataFrame, truth: DataFrame, tolerances: tuple, width: float | None = None) -> DataFrame:
    """(rec, tolerance, tp): the most one-to-one pairs of points (rec, ts) within each tolerance, by matching in order. A chunk also sees the points that the chunk before may leave to it."""
    both = predicted.select("rec", "ts", F.lit(0).alias("side")).union(truth.select("rec", "ts", F.lit(1).alias("side")))
    width = max(width or chunk_width(both, "ts"), 4 * max(tolerances))
    rows = _in_chunks(both, "ts", width).withColumn("tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    near = F.col("ts") >= (F.col("__chunk") + 1) * F.lit(width) - F.col("tolerance") - F.lit(SLACK)
    rows = rows.withColumn("own", F.col("__chunk")).withColumn("__chunk", F.explode(F.when(near, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rec, tolerance, chunk = key
        sides = [pdf[pdf["side"] == k].sort_values("ts") for k in (0, 1)]
        before = tuple(int((x["own"] < chunk).sum()) for x in sides)
        found = match_summary(*(x["ts"].to_numpy() for x in sides), before, (chunk + 1) * width, tolerance)
        return _frame([(rec, tolerance, chunk, json.dumps(found))], "rec", "tolerance", "__chunk", "summary")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, side, left, last = 0, 0, 0, None
        for chunk, summary in pdf.sort_values("__chunk")[["__chunk", "summary"]].itertuples(index=False):
            if last is None or chunk != last + 1 or not left:
                side, left = 0, 0
            way = next(w for w in json.loads(summary) if w[:2] == [side, left])
            n, (side, left), last = n + way[2], way[3:], chunk
        return _frame([(*key, n)], "rec", "tolerance", "tp")

    kind = _kind(predicted, "rec")
    summaries = rows.groupBy("rec", "tolerance", "__chunk").applyInPandas(one, f"rec {kind}, tolerance double, __chunk long, summary string")
    return summaries.groupBy("rec", "tolerance").applyInPandas(walk, f"rec {kind}, tolerance double, tp long")


def greedy_pairs(predicted: DataFrame, truth: DataFrame, least: float, islands: int = 1000) -> DataFrame:
    """(rec, tp): in list order each row of ``predicted`` (rec, ord, s, e) takes the first free one of ``truth`` that it overlaps with at least that intersection over union.

    Rows whose spans don't meet can't take each other, so each run of spans that overlap is matched on its own; up to ``islands`` neighbouring ones go to a task together. A task holds rows and no pairs: those that
    can have such a share begin near a row's start, and are looked at when it is its turn. A run of any density is one task's, as each row's choice rests on all before it.
    """
    known = lambda df, side: df.where("rec is not null and s is not null and e is not null").select("rec", "ord", "s", "e", F.lit(side).alias("side"))
    order = Window.partitionBy("rec").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = known(predicted, 0).union(known(truth, 1)).withColumn("__new", F.coalesce((F.col("s") >= reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("__island", F.floor(F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) / islands))

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending")])
        side = table["side"].to_numpy()
        mine, theirs = (table.filter(pa.array(side == k)) for k in (0, 1))
        # places in list order; rows that share their ord have one place, and those without have each their own
        places = []
        for part in (mine, theirs):
            same = pc.fill_null(pc.equal(part["ord"][1:], part["ord"][:-1]), False).to_numpy() if len(part) else np.empty(0, dtype=bool)
            places.append(np.append(0, np.cumsum(~same.astype(bool)))[: len(part)])
        s, e = mine["s"].to_numpy(), mine["e"].to_numpy()
        by_start = np.argsort(theirs["s"].to_numpy(), kind="stable")
        starts, ends, rank = theirs["s"].to_numpy()[by_start], theirs["e"].to_numpy()[by_start], places[1][by_start]
        tp = 0
        if len(s) and len(starts):
            at = np.empty(len(starts), dtype=int)
            at[by_start] = np.arange(len(starts))
            runs = np.append(np.searchsorted(places[1], np.arange(places[1][-1] + 1)), len(starts))
            none, longest = len(runs), float((ends - starts).max())
            first = np.maximum(s - longest, e - (e - s) / least if least > 0 else -np.inf) - SLACK
            low, high = np.searchsorted(starts, first), np.searchsorted(starts, e - max(least, 0.0) * (e - s) + SLACK, side="right")
            best, now = none, 0
            for k, (lo, hi, a, b, place) in enumerate(zip(low.tolist(), high.tolist(), s.tolist(), e.tolist(), places[0].tolist())):
                if place != now:
                    best, now = none, place
                if lo < hi:
                    t, u = starts[lo:hi], ends[lo:hi]
                    share = np.minimum(u, b) - np.maximum(t, a) >= least * (np.maximum(u, b) - np.minimum(t, a))
                    share &= (u > a) & (t < b)
                    best = min(best, int(np.where(share, rank[lo:hi], none).min()))
                if best < none and (k + 1 == len(s) or places[0][k + 1] != place):
                    rank[at[runs[best] : runs[best + 1]]] = none  # taken
                    tp += 1
        return pa.table({"rec": table["rec"][:1], "tp": pa.array([tp], pa.int64())})

    parts = marked.select("rec", "__island", "ord", "s", "e", "side").groupBy("rec", "__island").applyInArrow(greedy, f"rec {_kind(predicted, 'rec')}, tp long")
    return parts.groupBy("rec").agg(F.sum("tp").alias("tp"))
