"""Choosing and refining clusterings: distance search, Euclidean silhouette, centroid passes, centres that follow a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from .speakers import average_linkage, graph_components


def cells(rows: DataFrame, columns: list[str], key: str, parts: int) -> DataFrame:
    """Each row with its block (own, of ``parts``) once for each pair of blocks (p <= q) that it is in, so that any two rows meet in a pair, whose number is ``cell``. Up to 4096 pairs each have a partition of their own."""
    own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda t: F.struct(F.least(t, F.col("own")).alias("p"), F.greatest(t, F.col("own")).alias("q")))
    met = rows.select(*columns, own.alias("own")).withColumn("cell", F.explode(pairs)).select(*columns, "own", "cell.p", "cell.q")
    return met.withColumn("cell", (F.col("q") * (F.col("q") + 1) / 2 + F.col("p")).cast("int")).repartitionById(min(4096, parts * (parts + 1) // 2), F.col("cell"))


def blocks(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def joined(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray | None = None, tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the links of a spanning forest, a root for each of ``n`` nodes): in each round every tree takes its best link (largest ``s``, the first on ties) to another one. ``tree``: roots to begin with."""
    order = np.arange(len(a)) if s is None else np.argsort(-s, kind="stable")
    tree, at, kept = np.arange(n) if tree is None else tree, np.arange(len(a)), [np.empty(0, dtype=int)]
    a, b = a[order], b[order]
    while True:
        u, v = tree[a[at]], tree[b[at]]
        out = u != v
        at, u, v = at[out], u[out], v[out]
        if not len(at):
            return order[np.concatenate(kept)], tree
        best, other = np.full(n, len(a)), np.full(n, len(a))
        best[u[::-1]], other[v[::-1]] = at[::-1], at[::-1]  # the last one written stays
        best = np.minimum(best, other)
        roots = np.flatnonzero(best < len(a))
        link = best[roots]
        kept.append(np.unique(link))
        up = np.arange(n)
        up[roots] = tree[a[link]] + tree[b[link]] - roots
        low = roots[(up[up[roots]] == roots) & (roots < up[roots])]
        up[low] = low
        while (up[up] != up).any():
            up = up[up]
        tree = up[tree]


class _Forest:
    """A maximum spanning forest that takes links bit by bit, and knows which ones can't change it: those whose ends are in one tree by links that are no worse.

    That is known at some scores, ``at``, from large to small: given levels, to which scores are lowered, or quantiles of the forest's own scores.
    """

    def __init__(self, n: int, least: float, levels: list[float] | None, most: int):
        self.n, self.least, self.most, self.fixed = n, least, most, levels is not None
        self.at = np.array(sorted((x for x in levels or [] if x >= least), reverse=True), dtype=float)
        self.held, self.new, self.waiting = tuple(np.empty(0, dtype=t) for t in (int, int, float)), [], 0
        self.settle()

    def lowered(self, s: np.ndarray) -> np.ndarray:
        return self.at[np.searchsorted(-self.at, -s, side="left")] if self.fixed else s

    def settle(self) -> None:
        """Links that wait become part of the forest or are dropped."""
        a, b, s = (np.concatenate(x) for x in zip(self.held, *self.new))
        keep, _ = joined(self.n, a, b, s)
        self.held, self.new, self.waiting = (a[keep], b[keep], s[keep]), [], 0
        a, b, s = self.held
        if not self.fixed:
            self.at = np.unique(np.quantile(s, np.linspace(0, 1, 16)))[::-1] if len(s) else np.empty(0)
        self.trees, tree = np.empty((len(self.at), self.n), dtype=int), None
        for k, x in enumerate(self.at):
            mine = (s >= x) & (s < (self.at[k - 1] if k else np.inf))
            _, tree = joined(self.n, a[mine], b[mine], tree=tree)
            self.trees[k] = tree
        # the node that others are joined to early
        sizes = [np.bincount(t, minlength=self.n) for t in self.trees]
        wide = next((k for k in range(len(sizes)) if 2 * sizes[k].max() >= self.n), len(sizes) - 1)
        self.hub = int(sizes[wide].argmax()) if sizes else 0
        self.floor = np.full(self.n, self.least)
        self.raise_floors(np.arange(self.n))

    def raise_floors(self, nodes: np.ndarray) -> None:
        """``floor``: two nodes with a score below both of theirs are joined by way of the hub."""
        if not len(self.at):
            return
        met = self.trees[:, nodes] == self.trees[:, [self.hub]]
        first = met.argmax(axis=0)
        above = np.append(np.inf, self.at[:-1]) if self.fixed else np.nextafter(self.at, np.inf)
        self.floor[nodes] = np.where(met.any(axis=0), np.maximum(above[first], self.least), self.least)

    def hang(self, nodes: np.ndarray, on: np.ndarray, s: np.ndarray) -> None:
        """Each node by one link to another, which counts from now on."""
        good = s >= self.least
        nodes, on, s = nodes[good], on[good], self.lowered(s[good])
        self.new.append((nodes, on, s))
        self.waiting += len(nodes)
        self.trees[:, nodes] = np.where(self.at[:, None] <= s[None, :], self.trees[:, on], self.trees[:, nodes])
        self.raise_floors(nodes)

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        s = self.lowered(s)
        k = np.searchsorted(-self.at, -s, side="right") - 1
        fresh = (k < 0) | (self.trees[k, a] != self.trees[k, b]) if len(self.at) else np.ones(len(a), dtype=bool)
        self.new.append((a[fresh], b[fresh], s[fresh]))
        self.waiting += int(fresh.sum())
        if self.waiting > self.most:
            self.settle()


def spanning_links(rows: DataFrame, least: float, key: str = "vec_id", block: int = 16_384, levels: list[float] | None = None, tile: int = 1 << 21, fan: int = 8, most: int = 1 << 20) -> DataFrame:
    """(a, b, score): links whose components are those of all pairs with a cosine of s or more, for every s from ``least`` on, or for those in ``levels``, to which scores are then lowered.

    Each pair of blocks gives the maximum spanning forest of the pairs between them, so a cell returns fewer links than it has vectors and not all its near pairs. A task holds ``tile`` scores at a time, and looks
    closer only at those that can still change its forest. Forests of neighbouring pairs of blocks are joined, ``fan`` by ``fan`` of them at a time, while a task has no more than ``most`` vectors, so what is returned
    doesn't grow with the number of pairs. Equal vectors are compared once, and each is linked to the first.
    """

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(), pdf["own"].to_numpy()
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(size == 0, 1, size)
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        found = _Forest(len(x), least, levels, max(4096, len(x)))
        wide = max(1, tile // max(1, len(right)))
        # single precision rules pairs out; what is within its error of a floor is looked at in double precision
        y, slack = x.astype(np.float32), (x.shape[1] + 8) * 1.2e-7
        # a few rows at first, as all their pairs are looked at
        firsts = [0, *range(min(8, wide), len(left), wide)] if len(left) and len(right) else []
        for first, end in zip(firsts, [*firsts[1:], len(left)]):
            mine, theirs = left[first:end], right[first:] if p == q else right
            rough = y[mine] @ y[theirs].T
            if p == q:
                rough[np.tril_indices(len(mine), 0, len(theirs))] = -np.inf
            if first:
                j = np.where(np.isnan(rough), -np.inf, rough).argmax(axis=1) if np.isnan(rough[:, 0]).any() or np.isnan(rough[0]).any() else rough.argmax(axis=1)
                best = np.einsum("ij,ij->i", x[mine], x[theirs[j]])
                found.hang(mine, theirs[j], np.where(rough[np.arange(len(mine)), j] > -np.inf, best, -np.inf))
            low = (found.floor - 2 * slack).astype(np.float32)
            near = rough >= low[theirs][None, :]
            near |= rough >= low[mine][:, None]
            if p == q:
                near &= rough > -np.inf
            i, j = np.divmod(np.flatnonzero(near), len(theirs))
            score = (x[mine] @ x[theirs].T)[i, j] if len(i) * x.shape[1] > near.size else np.einsum("ij,ij->i", x[mine[i]], x[theirs[j]])
            sure = (score >= found.floor[theirs[j]]) | (score >= found.floor[mine[i]])
            found.add(mine[i[sure]], theirs[j[sure]], score[sure])
            if not first:
                found.settle()
        found.settle()
        a, b, s = found.held
        return pd.DataFrame({"p": p, "q": q, "a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "score": s})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        return pdf.iloc[joined(len(ids), at[:, 0], at[:, 1], pdf["score"].to_numpy())[0]]

    def equal(frames):
        for pdf in frames:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.empty((0, 1))
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            s = ((x / np.where(size == 0, 1, size)) ** 2).sum(axis=1).round(12)  # 1, or 0 without a direction
            if levels is not None:
                s = np.array([max((y for y in levels if y <= z), default=-np.inf) for z in s], dtype=float)
            yield pdf.assign(score=s)[["a", "b", "score"]][s >= least]

    every = rows.select(F.col(key).alias("id"), "v")
    firsts = every.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    parts, wide = blocks(firsts, block), 1
    links = cells(firsts, ["id", "v"], "id", parts).groupBy("cell").applyInPandas(forest, "p int, q int, a long, b long, score double")
    while wide < parts and wide * fan * block <= most:
        wide *= fan
        near = [F.floor(F.col(c) / fan).cast("int").alias(c) for c in ("p", "q")]
        links = links.select(*near, "a", "b", "score").groupBy("p", "q").applyInPandas(merged, links.schema)
    copies = firsts.where("n > 1").select("v", F.col("id").alias("a")).join(every.select("v", F.col("id").alias("b")), "v").where("a <> b")
    return links.select("a", "b", "score").unionByName(copies.select("a", "b", "v").mapInPandas(equal, "a long, b long, score double"))


def nested_components(links: DataFrame, nodes: DataFrame, steps: int, folder: str, key: str = "vec_id", most: int = 1 << 20) -> DataFrame:
    """(key, first, components): the smallest node reachable by links (a, b, step) of each step 0 to ``steps`` - 1 or earlier ones, and the first step at which there is a link at all.

    Each link is looked at once: at its step its ends are the components of the step before. Steps of no more than ``most`` links together are one group, larger ones spread labels in rounds.
    """
    spark = nodes.sparkSession
    links.write.mode("overwrite").parquet(f"{folder}/spanning")
    links = spark.read.parquet(f"{folder}/spanning")
    counts = {r["step"]: r["count"] for r in links.groupBy("step").count().collect()}
    ends = links.select(F.explode(F.array("a", "b")).alias("id"), "step").groupBy("id").agg(F.min("step").alias("first"))
    labels = nodes.select(F.col(key).alias("id"), F.array().cast("array<long>").alias("c"), F.col(key).alias("now")).join(ends, "id", "left")
    groups: list[list[int]] = []
    for k in range(steps):
        if groups and sum(counts.get(j, 0) for j in [*groups[-1], k]) <= most:
            groups[-1].append(k)
        else:
            groups.append([k])

    def solved(group: list[int]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
            at, step, tree, out = at.reshape(-1, 2), pdf["step"].to_numpy(), None, []
            for k in group:
                _, tree = joined(len(ids), at[step == k, 0], at[step == k, 1], tree=tree)
                low = np.full(len(ids), len(ids))
                np.minimum.at(low, tree, np.arange(len(ids)))
                out.append(ids[low[tree]])
            return pd.DataFrame({"node": ids, "to": list(np.stack(out, axis=1))})

        return run

    for group in groups:
        n = sum(counts.get(k, 0) for k in group)
        same = F.array_repeat(F.col("now"), len(group))
        if not n:
            labels = labels.select("id", "first", F.concat("c", same).alias("c"), "now")
            continue
        part = links.where(F.col("step").between(group[0], group[-1]))
        if group[0]:
            for end in ("a", "b"):
                part = part.join(labels.select(F.col("id").alias(end), F.col("now").alias("__now")), end).withColumn(end, F.col("__now")).drop("__now")
        part = part.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("step").alias("step"))
        if n <= most:
            to = part.withColumn("__all", F.lit(True)).groupBy("__all").applyInPandas(solved(group), "node long, to array<long>")  # up to twice ``most`` rows
        else:
            met = part.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            to = graph_components(part, met, f"{folder}/step-{group[0]}", "node").select("node", F.array("component").alias("to"))
        if n <= 65_536:
            after = labels.join(F.broadcast(to), F.col("now") == F.col("node"), "left")
        else:
            # one component may have nearly all nodes, but each node is one of its own before the first step
            salts = 16 if group[0] else 1
            to = to.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            after = labels.join(to, (F.col("now") == F.col("node")) & (F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int") == F.col("salt")), "left")
        after = after.select("id", "first", "c", F.coalesce("to", same).alias("to")).select("id", "first", F.concat("c", "to").alias("c"), F.element_at("to", -1).alias("now"))
        after.write.mode("overwrite").parquet(f"{folder}/labels-{group[0]}")
        labels = spark.read.parquet(f"{folder}/labels-{group[0]}")
    return labels.select(F.col("id").alias(key), "first", F.col("c").alias("components"))


def distance_clusterings(rows: DataFrame, distances: list[float], folder: str, key: str = "vec_id") -> DataFrame:
    """(step, eps, key, cluster): density clusters of two or more by cosine distance at each of ``distances``, which rise; a vector on its own is noise, -1."""
    levels = [1.0 - e for e in distances]
    if any(a <= b for a, b in zip(levels, levels[1:])):
        raise ValueError("distances don't rise")
    step = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("score")))
    links = spanning_links(rows, levels[-1], key, levels=levels).select("a", "b", step.alias("step"))
    found = nested_components(links, rows, len(levels), folder, key).select(key, "first", F.posexplode("components").alias("step", "component"))
    values = F.array(*[F.lit(float(e)) for e in distances])
    cluster = F.when(F.col("step") >= F.col("first"), F.col("component")).otherwise(F.lit(-1)).cast("bigint")
    return found.select("step", F.element_at(values, F.col("step") + 1).alias("eps"), key, cluster.alias("cluster"))


def rand_by(labelled: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, ari): the adjusted Rand index of two label columns in each group, from its counts of label pairs."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / F.lit(2.0)
    both = labelled.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    side = lambda c, name: both.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two("n")).alias(name))
    row = both.groupBy(*by).agg(F.sum(two("n")).alias("ij"), F.sum("n").alias("n")).join(side(a, "i"), by).join(side(b, "j"), by)
    every = F.when(two("n") == 0, F.lit(1.0)).otherwise(two("n"))
    row = row.select(*by, "ij", (F.col("i") * F.col("j") / every).alias("expected"), ((F.col("i") + F.col("j")) / F.lit(2.0)).alias("most"))
    gap = F.col("most") - F.col("expected")
    return row.select(*by, F.when(gap == 0, F.lit(1.0)).otherwise((F.col("ij") - F.col("expected")) / F.when(gap == 0, F.lit(1.0)).otherwise(gap)).alias("ari"))


def distance_search(rows: DataFrame, folder: str, truth: str = "label", low: float = 0.1, high: float = 1.0, steps: int = 10, key: str = "vec_id") -> DataFrame:
    """(eps, clusters, ari, chosen) for each distance: of those with two clusters or more the one with the largest index against the truth, the smaller on ties, is chosen."""
    found = distance_clusterings(rows, np.linspace(low, high, steps).tolist(), folder, key).join(rows.select(key, F.col(truth).alias("truth")), key)
    out = _counted(found).join(rand_by(found, ["step", "eps"], "truth", "cluster"), ["step", "eps"])
    best = out.where("clusters >= 2").agg(F.max_by("step", F.struct(F.round("ari", 12), -F.col("step"))).alias("best"))
    return out.crossJoin(F.broadcast(best)).select("eps", "clusters", "ari", F.coalesce(F.col("step") == F.col("best"), F.lit(False)).alias("chosen"))  # one row


def distance_for_count(rows: DataFrame, folder: str, target: int, low: float = 0.1, high: float = 2.0, steps: int = 20, key: str = "vec_id") -> DataFrame:
    """(eps, clusters, chosen): the distance whose number of clusters is closest to ``target``, the larger on ties, is chosen."""
    out = _counted(distance_clusterings(rows, np.linspace(low, high, steps).tolist(), folder, key))
    best = out.agg(F.max_by("step", F.struct(-F.abs(F.col("clusters") - target), "step")).alias("best"))
    return out.crossJoin(F.broadcast(best)).select("eps", "clusters", (F.col("step") == F.col("best")).alias("chosen"))  # one row


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("step", "eps").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))


def euclidean_silhouette(rows: DataFrame, key: str = "vec_id", label: str = "label", block: int = 16_384, tile: int = 256) -> DataFrame:
    """(key, label, silhouette) by Euclidean distance: 0 for a label of one vector, and for all where there are fewer than two labels or no more vectors than labels.

    Mean distances have no closed form, so blocks meet blocks as matrix products; a cell returns the sum of a vector's distances to each label, never pairs. A vector is sent once for each block, so
    blocks are large; a task holds the distances of ``tile`` vectors to a block at a time.
    """
    kind = rows.schema[label].dataType.simpleString()

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own = np.stack(pdf["v"].to_numpy()), pdf["own"].to_numpy()
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        out = []
        for mine, theirs in {(p, q), (q, p)}:
            left, right = np.flatnonzero(own == mine), np.flatnonzero(own == theirs)
            if not len(left) or not len(right):
                continue
            codes, names = pd.factorize(pdf["label"].to_numpy()[right])
            right, codes = right[np.argsort(codes, kind="stable")], np.sort(codes)
            firsts = np.searchsorted(codes, np.arange(len(names)))
            y = x[right]
            size = (y * y).sum(axis=1)
            for at in range(0, len(left), tile):
                part = left[at : at + tile]
                squared = (x[part] ** 2).sum(axis=1)[:, None] + size[None, :] - 2 * x[part] @ y.T
                far = np.sqrt(np.maximum(squared, 0))
                if mine == theirs:
                    far[part[:, None] == right[None, :]] = 0
                sums_of = np.add.reduceat(far, firsts, axis=1)
                each = pdf.iloc[np.repeat(part, len(names))]
                out.append(pd.DataFrame({"id": each["id"].to_numpy(), "label": each["label"].to_numpy(), "other": np.tile(names, len(part)), "d": sums_of.ravel()}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "label", "other", "d"])

    named = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), "v").where("label is not null")
    far = cells(named, ["id", "label", "v"], "id", blocks(named, block)).groupBy("cell").applyInPandas(sums, f"id long, label {kind}, other {kind}, d double")
    sizes = named.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    means = far.groupBy("id", "label", "other").agg(F.sum("d").alias("d")).join(sizes, "other")
    own = F.col("label") == F.col("other")
    sides = means.groupBy("id", "label").agg(F.max(F.when(own, F.col("d") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    every = sizes.agg(F.sum("n").alias("__rows"), F.count("*").alias("__labels"))
    worst = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | F.col("b").isNull() | (F.col("__rows") <= F.col("__labels")) | (worst == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.when(worst == 0, F.lit(1.0)).otherwise(worst))
    return sides.crossJoin(F.broadcast(every)).select(F.col("id").alias(key), F.col("label").alias(label), value.alias("silhouette"))  # one row


def refined(rows: DataFrame, labels: DataFrame, group: str, key: str, clusters: int, passes: int = 3) -> DataFrame:
    """(group, key, cluster): ``passes`` times each vector goes to its group's most similar centroid of 0 to ``clusters`` - 1, the smaller on ties.

    A cluster that has become empty has a similarity of 0. Groups of at most ``clusters`` vectors stay as they are.
    """
    now = rows.select(group, key, unit("v").alias("v")).join(labels.select(group, key, "cluster"), [group, key])
    big = now.groupBy(group).count().where(F.col("count") > clusters).select(group, F.lit(True).alias("__big"))
    now = now.join(big, group, "left")
    for _ in range(passes):
        parts = now.select(group, "cluster", F.posexplode("v").alias("pos", "x")).groupBy(group, "cluster", "pos").agg(F.avg("x").alias("x"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
        centre = parts.groupBy(group, F.col("cluster").alias("__to")).agg(unit(listed).alias("__c"))
        asked = now.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1)))).join(centre, [group, "__to"], "left")
        score = F.round(F.coalesce(dot("v", "__c"), F.lit(0.0)), 12)
        best = asked.groupBy(group, key).agg(F.max_by("__to", F.struct(score, -F.col("__to"))).alias("__best"))
        now = now.join(best, [group, key]).withColumn("cluster", F.when(F.col("__big"), F.col("__best")).otherwise(F.col("cluster"))).drop("__best")
    return now.select(group, key, F.col("cluster").cast("int").alias("cluster"))


def refined_linkage(rows: DataFrame, group: str, key: str, clusters: int, passes: int = 3) -> DataFrame:
    """Average linkage by group, then ``refined``."""
    return refined(rows, average_linkage(rows, group, key, clusters), group, key, clusters, passes)


def enrolled(registry: DataFrame, most: int = 10_000) -> dict[str, list[float]]:
    """{name: v} of a registry (name, v) in the order of the names, for a fold that every group begins with. More than ``most`` speakers are an error, never cut off."""
    rows = registry.select("name", "v").orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} enrolled speakers")
    return {r["name"]: r["v"] for r in rows}


def online_means(rows: DataFrame, references: dict[str, list[float]], group: str, key: str, weight: float = 1.0) -> DataFrame:
    """(group, key, cluster, name, distance) in the order of the key: the nearest centre moves towards a vector by one over the vectors it has had, then the nearest is named.

    Each group begins with the centres at the references, which count as ``weight`` vectors each. Ties go to the reference given first.
    """
    names, start = list(references), np.array(list(references.values()), dtype=float)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        centres, counts, out = start.copy(), np.full(len(start), float(weight)), []
        for v in pdf["v"]:
            v = np.asarray(v, dtype=float)
            at = int(((centres - v) ** 2).sum(axis=1).argmin())
            counts[at] += 1
            centres[at] += (v - centres[at]) / counts[at]
            far = np.sqrt(((centres - v) ** 2).sum(axis=1))
            at = int(far.argmin())
            out.append((at, names[at], far[at]))
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": [o[0] for o in out], "name": [o[1] for o in out], "distance": [o[2] for o in out]})

    kinds = rows.schema
    return rows.select(group, key, "v").groupBy(group).applyInPandas(fold, f"{group} {kinds[group].dataType.simpleString()}, {key} {kinds[key].dataType.simpleString()}, cluster int, name string, distance double")
