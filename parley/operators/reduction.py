"""Fewer dimensions and good centres for many vectors: principal components, k-means seeded in a few passes, agglomerative linkage of small groups.

Only matrices of dimensions times components, sums of clusters and a bounded number of candidate centres reach the driver; vectors stay in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors that are not null and hold no null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))


def _added(parts: DataFrame, keys: list[str]) -> dict[tuple, float]:
    """{keys: sum} of rows (keys, x): partial sums of tasks."""
    return {tuple(r[k] for k in keys): r["x"] for r in parts.groupBy(*keys).agg(F.sum("x").alias("x")).collect()}


def principal_components(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "v", seed: int = 42, more: int = 10, passes: int = 6) -> tuple[DataFrame, DataFrame]:
    """(component, variance, share, direction) of the ``k`` directions of largest variance, and (key, coordinates) of all usable vectors.

    A random subspace of ``k + more`` directions is multiplied by the covariance and made orthogonal again ``passes`` times; each pass sums the products X'(XQ) over tasks, so the covariance itself is never
    made. ``share`` is of the whole variance, ``variance`` over n - 1. The largest entry of a direction is positive. With fewer than two vectors there are no components.
    """
    spark = rows.sparkSession
    clean = _usable(rows, key, vector)
    stats = clean.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.count("*").alias("n")).collect()
    d, n = len(stats), max((r["n"] for r in stats), default=0)
    if any(r["n"] != n for r in stats):
        raise ValueError("vectors have different lengths")
    mean = np.zeros(d)
    for r in stats:
        mean[r["i"]] = r["mean"]
    total = sum(r["var"] or 0.0 for r in stats)
    found = "component int, variance double, share double, direction array<double>"
    if n < 2:
        return spark.createDataFrame([], found), clean.select(key, F.array().cast("array<double>").alias("coordinates"))
    width = min(d, k + more)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    sc = spark.sparkContext

    def multiplied(q: np.ndarray) -> np.ndarray:
        share = sc.broadcast((mean, q))

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mean, q = share.value
            out = np.zeros_like(q)
            for pdf in frames:
                x = np.stack(pdf["v"].to_numpy()) - mean
                out += x.T @ (x @ q)
            i, j = np.indices(out.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": out.ravel()})

        out = np.zeros_like(q)
        for (i, j), x in _added(clean.select("v").mapInPandas(partial, "i int, j int, x double"), ["i", "j"]).items():
            out[i, j] = x
        return out / (n - 1)

    for _ in range(passes):
        q = np.linalg.qr(multiplied(q))[0]
    values, turn = np.linalg.eigh(q.T @ multiplied(q))
    order = np.argsort(values)[::-1][:k]
    directions = (q @ turn[:, order]).T
    directions *= np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])[:, None]
    out = [(i + 1, float(values[o]), float(values[o] / total) if total else 0.0, directions[i].tolist()) for i, o in enumerate(order)]
    share = sc.broadcast((mean, directions))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, directions = share.value
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "coordinates": list((np.stack(pdf["v"].to_numpy()) - mean) @ directions.T)})

    kind = rows.schema[key].dataType.simpleString()
    return spark.createDataFrame(out, found), clean.mapInPandas(placed, f"{key} {kind}, coordinates array<double>")


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def candidates(rows: DataFrame, k: int, seed: int, rounds: int, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Candidate centres and how many vectors are nearest to each. A round takes each vector with a probability of 2 k times its share of the squared distances to what has been taken; the draw is a
    hash of the key, so it is the same in every run. About 2 k a round are expected."""
    draw = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    first = rows.orderBy(draw(-1), key).select("v").limit(1).collect()
    taken = np.array([r["v"] for r in first])
    sc = rows.sparkSession.sparkContext
    kind = f"{key} {rows.schema[key].dataType.simpleString()}"

    def measured(taken: np.ndarray) -> DataFrame:
        share = sc.broadcast(taken)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                far = _far(np.stack(pdf["v"].to_numpy()), share.value)
                yield pd.DataFrame({key: pdf[key], "v": pdf["v"], "near": far.argmin(axis=1), "d": far.min(axis=1)})

        return rows.select(key, "v").mapInPandas(run, f"{kind}, v array<double>, near int, d double")

    for r in range(rounds):
        far = measured(taken)
        cost = far.agg(F.sum("d")).first()[0] or 0.0
        if cost <= 1e-12:
            break
        new = far.where(draw(r) < F.lit(2.0 * k / cost) * F.col("d")).select(key, "v").collect()
        new = [r["v"] for r in sorted(new, key=lambda r: r[key])]
        taken = np.unique(np.vstack([taken, *[np.array(new)] * bool(new)]), axis=0)
    weight = np.zeros(len(taken))
    for r in measured(taken).groupBy("near").agg(F.count("*").alias("n")).collect():
        weight[r["near"]] = r["n"]
    return taken, weight


def plus_plus(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` starts among weighted candidates, each drawn by weight times squared distance to those before; all of them where there are no more than ``k``."""
    if len(x) <= k:
        return x
    picked = [int(rng.choice(len(x), p=weight / weight.sum()))]
    near = _far(x, x[picked]).min(axis=1)
    while len(picked) < k:
        p = weight * near
        p = p if p.sum() > 0 else np.where(np.isin(np.arange(len(x)), picked), 0.0, 1.0)
        picked.append(int(rng.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, _far(x, x[picked[-1:]])[:, 0])
    centres = x[picked]
    for _ in range(20):  # settled among the candidates, before any pass over the vectors
        at = _far(x, centres).argmin(axis=1)
        centres = np.stack([np.average(x[at == c], axis=0, weights=weight[at == c]) if weight[at == c].sum() else centres[c] for c in range(k)])
    return centres


def kmeans(rows: DataFrame, k: int, seed: int = 42, restarts: int = 10, rounds: int = 4, passes: int = 30, key: str = "vec_id", vector: str = "v", still: float = 1e-9) -> tuple[DataFrame, float]:
    """(key, cluster) of all usable vectors by Euclidean distance, and the sum of squared distances, of the best of ``restarts`` runs.

    Candidates are sampled once, in ``rounds`` passes; every run starts from its own draw among them, and all runs move together, so a pass of the data serves each of them. Ties go to the smaller
    cluster, an empty cluster keeps its centre, clusters are numbered by their centres. The same seed gives the same labels, but for sums that rounding makes equal.
    """
    spark = rows.sparkSession
    clean = _usable(rows, key, vector)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}"
    if not clean.limit(1).count():
        return spark.createDataFrame([], f"{kind}, cluster int"), 0.0
    x, weight = candidates(clean, k, seed, rounds, key)
    sets = [plus_plus(x, weight, k, np.random.default_rng([seed, r])) for r in range(restarts)]
    sc = spark.sparkContext

    def sums(frames: Iterator[pd.DataFrame], share) -> Iterator[pd.DataFrame]:
        held = [(np.zeros_like(c), np.zeros(len(c)), 0.0) for c in share.value]
        for pdf in frames:
            v = np.stack(pdf["v"].to_numpy())
            for s, centres in enumerate(share.value):
                far = _far(v, centres).round(12)
                at = far.argmin(axis=1)
                total, n, cost = held[s]
                np.add.at(total, at, v)
                held[s] = (total, n + np.bincount(at, minlength=len(n)), cost + far.min(axis=1).sum())
        out = []
        for s, (total, n, cost) in enumerate(held):
            out.append((s, -1, 0, cost))
            out += [(s, c, -1, n[c]) for c in range(len(n)) if n[c]] + [(s, c, i, total[c, i]) for c in range(len(n)) if n[c] for i in range(total.shape[1])]
        yield pd.DataFrame(out, columns=["s", "c", "i", "x"])

    costs = np.full(restarts, np.inf)
    for step in range(passes + 1):
        share = sc.broadcast(sets)
        got = _added(clean.select("v").mapInPandas(lambda frames, share=share: sums(frames, share), "s int, c int, i int, x double"), ["s", "c", "i"])
        costs = np.array([got[s, -1, 0] for s in range(restarts)])
        moved = [c.copy() for c in sets]
        for (s, c, i), value in got.items():
            if c >= 0 and i >= 0:
                moved[s][c, i] = value / got[s, c, -1]
        if step == passes or max(np.abs(a - b).max() for a, b in zip(sets, moved)) <= still:
            break
        sets = moved
    best = int(costs.round(9).argmin())
    centres = np.array(sorted(sets[best].tolist()))
    share = sc.broadcast(centres)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "cluster": _far(np.stack(pdf["v"].to_numpy()), share.value).round(12).argmin(axis=1)})

    return clean.mapInPandas(named, f"{kind}, cluster int"), float(costs[best])


#: New distance to a cluster of two from the distances to each, their own and the sizes (Lance and Williams).
UPDATES = {
    "average": lambda a, b, ab, i, j, n: (i * a + j * b) / (i + j),
    "complete": lambda a, b, ab, i, j, n: np.maximum(a, b),
    "ward": lambda a, b, ab, i, j, n: ((i + n) * a + (j + n) * b - n * ab) / (i + j + n),
}


def merges(far: np.ndarray, kind: str) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges, in the order of height, found by following nearest neighbours until two are each other's: square time, as each merge costs one row.

    A neighbour tie goes to the one before in the chain, else to the smaller number; merges of one height keep the order in which they were found. ``far`` is used up.
    """
    n = len(far)
    np.fill_diagonal(far, np.inf)
    size, live, chain, out = np.ones(n), np.ones(n, dtype=bool), [], []
    update = UPDATES[kind]
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            row = far[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        b, a = sorted((chain.pop(), chain.pop()), reverse=True)
        out.append((float(far[a, b]), a, b))
        new = update(far[a], far[b], far[a, b], size[a], size[b], size)
        new[~live] = np.inf
        size[a] += size[b]
        live[b] = False
        new[[a, b]] = np.inf
        far[a], far[:, a] = new, new
        far[b], far[:, b] = np.inf, np.inf
    return sorted(out, key=lambda m: m[0])


def cut(n: int, steps: list[tuple[float, int, int]], clusters: int) -> np.ndarray:
    """Labels 0, 1, ... in the order of each cluster's first member, after as many merges as leave ``clusters``."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in steps[: max(0, n - max(1, clusters))]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)])


def linkage(rows: DataFrame, group: str, key: str, clusters: int, kind: str = "average", metric: str | None = None) -> DataFrame:
    """(group, key, cluster) for each group of up to some thousand vectors, agglomerative: ``kind`` average, complete or ward. ``metric`` is cosine, but for ward, which is Euclidean.

    A group takes the square of its size in memory and time. A zero vector is at a cosine distance of 1 from all.
    """
    if kind not in UPDATES:
        raise ValueError(f"no linkage {kind}")
    metric = metric or ("euclidean" if kind == "ward" else "cosine")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["v"].to_numpy())
        if metric == "cosine":
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(size == 0, 1, size)
            far = 1 - x @ x.T
        else:
            far = _far(x, x)
            far = far if kind == "ward" else np.sqrt(far)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": cut(len(x), merges(far, kind), clusters)})

    kinds = rows.schema
    return rows.select(group, key, "v").groupBy(group).applyInPandas(join, f"{group} {kinds[group].dataType.simpleString()}, {key} {kinds[key].dataType.simpleString()}, cluster int")
