"""Embeddings of speakers: centroids, naming, assignment, cluster quality and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, si_sdr, unit
from .reduction import linkage


def centroids(rows: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """(label, n, v): means of each label's vectors, summed by element, so nothing but partial sums is shuffled."""
    parts = rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(label).agg(F.max("n").alias("n"), listed.alias("v"))


def best_matches(rows: DataFrame, registry: DataFrame, key: str, name: str, block: int = 1000, most_names: int = 100_000) -> DataFrame:
    """(key, best, score, second): the registry's most similar name for each vector and the runner-up's similarity; ties go to the smaller name.

    Names are held in blocks, one row each, so a vector meets a row a block and sends on the two best of it: no row is made for a name and
    no window sorts them. A registry of up to ``most_names`` is sent to all; a larger one is met by a shuffle.
    """
    n = registry.count()
    parts = max(1, -(-n // block))
    cell = F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("__b")
    held = registry.select(cell, F.struct(F.col(name).alias("name"), unit("v").alias("w")).alias("r")).groupBy("__b").agg(F.collect_list("r").alias("__r"))
    asked = rows.select(key, unit("v").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__b"))
    both = asked.join(F.broadcast(held) if n <= most_names else held, "__b")
    two = lambda x: F.slice(F.array_sort(x), 1, 2)
    near = F.transform("__r", lambda r: F.struct((-dot(r["w"], F.col("u"))).alias("d"), r["name"].alias("name")))
    top = both.select(key, two(near).alias("__t")).groupBy(key).agg(two(F.flatten(F.collect_list("__t"))).alias("__t"))
    return top.select(key, F.get("__t", F.lit(0))["name"].alias("best"), (-F.get("__t", F.lit(0))["d"]).alias("score"), (-F.get("__t", F.lit(1))["d"]).alias("second"))


def named(matches: DataFrame, key: str, threshold: float) -> DataFrame:
    """The best name where the similarity is over the threshold, else SPEAKER_<key>."""
    return matches.withColumn("speaker", F.when(F.col("score") > threshold, F.col("best").cast("string")).otherwise(F.concat(F.lit("SPEAKER_"), F.col(key).cast("string"))))


def named_clusters(rows: DataFrame, registry: DataFrame, cluster: str, name: str, threshold: float) -> DataFrame:
    """(cluster, speaker, score): the most similar name for each cluster's centroid where the similarity is over the threshold, else SPEAKER_<cluster>."""
    return named(best_matches(centroids(rows, cluster), registry, cluster, name), cluster, threshold).select(cluster, "speaker", "score")


def without_noise(rows: DataFrame, label: str = "label", noise: int = -1) -> DataFrame:
    """Noise gets a label of its own, one over the largest."""
    top = rows.agg((F.max(label) + 1).alias("__top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(label, F.when(F.col(label) == noise, F.col("__top")).otherwise(F.col(label))).drop("__top")  # one row


def similarity(rows: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """One row (intra, inter): the mean cosine of vectors to their own centroid, and the mean over pairs of centroids; 1 and 0 where there are fewer than two labels or no more vectors than labels.

    The latter comes from the sum of the centroids at unit length: its square holds each pair twice, and each centroid once. No pairs are made.
    """
    centre = centroids(rows, label, vector)
    own = rows.join(centre.select(label, F.col("v").alias("c")), label).agg(F.avg(cosine(vector, "c")).alias("intra"), F.count("*").alias("n"))
    parts = centre.select(F.posexplode(unit("v")).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("k"))
    total = parts.agg(F.sum(F.col("sum") * F.col("sum") - F.col("own")).alias("twice"), F.max("k").alias("k"))
    plain = F.coalesce((F.col("k") < 2) | (F.col("n") <= F.col("k")), F.lit(True))
    inter = F.col("twice") / F.greatest(F.col("k") * (F.col("k") - 1), F.lit(1))
    return own.crossJoin(total).select(F.when(plain, F.lit(1.0)).otherwise(F.col("intra")).alias("intra"), F.when(plain, F.lit(0.0)).otherwise(inter).alias("inter"))  # one row each


def verified(a, b, threshold: float = 0.5):
    """Whether two vectors are one speaker's: a cosine over the threshold."""
    return cosine(a, b) > threshold


def best_reference(sources: DataFrame, references: DataFrame, region: str, key: str, name: str = "name", least: int = 100) -> DataFrame:
    """(region, key, name, si_sdr): for each separated source (v) the region's reference (v) with the highest ratio, the smaller name on ties; one reference may win several.

    Pairs whose shorter signal has under ``least`` samples are left out, and sources without a pair have a null name.
    """
    other = references.select(region, F.col(name).alias("__name"), F.col("v").alias("__v"))
    scored = sources.join(other, region).where(F.least(F.size("v"), F.size("__v")) >= least).select(region, key, "__name", si_sdr("v", "__v").alias("__ratio"))
    best = scored.groupBy(region, key).agg(F.max("__ratio").alias("si_sdr"), F.min(F.struct(-F.col("__ratio"), F.col("__name")))["__name"].alias(name))
    return sources.select(region, key).join(best, [region, key], "left").select(region, key, name, "si_sdr")


def accepted_in_overlap(rows: DataFrame, centre: DataFrame, cluster: str = "cluster", least: float = 0.35) -> DataFrame:
    """``rows`` (with v and a cluster) with ``accepted``: the cluster where the vector is similar enough to its centroid, else -1."""
    near = rows.join(centre.select(cluster, F.col("v").alias("__c")), cluster, "left")
    return near.withColumn("accepted", F.when(cosine("v", "__c") >= least, F.col(cluster)).otherwise(F.lit(-1))).drop("__c")


def expanded_labels(rows: DataFrame, labels: DataFrame, key: str = "vec_id", reference: str = "is_reference") -> DataFrame:
    """``rows`` with the label of each from ``labels`` (key, label); references get -2."""
    return rows.join(labels, key, "left").withColumn("label", F.when(F.col(reference), F.lit(-2)).otherwise(F.coalesce("label", F.lit(-2))))


def decide(matches: DataFrame, least: float = 0.21, margin: float = 0.09) -> DataFrame:
    """``accepted``: the best is good enough and well ahead of the second."""
    return matches.withColumn("accepted", (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin))


def best_or_unknown(matches: DataFrame, threshold: float, share: float = 0.8, unknown: str = "unknown") -> DataFrame:
    """``matches`` of ``best_matches`` with speaker (the best, or ``unknown`` under the threshold, as where there is no name at all) and is_overlap: the best is known, and the second too reaches the threshold and ``share`` of the best."""
    known = F.coalesce(F.col("score") >= threshold, F.lit(False))
    close = F.coalesce((F.col("second") >= threshold) & (F.col("second") >= F.col("score") * share), F.lit(False))
    return matches.withColumn("speaker", F.when(known, F.col("best").cast("string")).otherwise(F.lit(unknown))).withColumn("is_overlap", known & close)


def fresh_labels(matches: DataFrame, key: str, threshold: float, registry_size: int) -> DataFrame:
    """Matched vectors keep their reference; the others get new labels from ``registry_size`` on, in the order of the key.

    The numbering is over the unmatched only, in two steps, so no task sees them all.
    """
    lost = matches.where(F.col("score") < threshold).select(key)
    cell = F.floor(F.col(key) / F.lit(1_000))
    counts = lost.groupBy(cell.alias("cell")).count()
    before = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("cell", "start")
    numbered = lost.withColumn("cell", cell).withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(key))).join(before, "cell").select(key, (F.col("start") + F.col("n") - 1 + registry_size).alias("fresh"))
    return matches.join(numbered, key, "left").withColumn("assigned", F.coalesce("fresh", "best")).drop("fresh")


#: Labels whose sums are sent to all as one matrix; with more, vectors meet them in blocks, by a shuffle.
MOST_LABELS = 20_000


def _label_sums(rows: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """(label, n, s): how many vectors each label has, and their sum."""
    sums = rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("s"))


def _against_labels(rows: DataFrame, sums: DataFrame, key: str, label: str, found, schema: str, block: int = 1000, most: int = MOST_LABELS) -> DataFrame:
    """``found(x, at, n, s, own)`` for batches of vectors x against blocks of labels, ordered by name: their numbers n and sums s as matrices, the names of the block, and the place of each vector's own label
    in it or -1. One block, sent to all, where there are at most ``most`` labels; else blocks are met by a shuffle. ``found`` gives the columns of ``schema`` but the key and label; a vector has a row for each block."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}
    out = f"{key} {kinds[key]}, {label} {kinds[label]}, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(pdf: pd.DataFrame, names_of: list, n: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        place = {k: i for i, k in enumerate(names_of)}
        own = np.array([place.get(k, -1) for k in pdf[label]])
        columns = found(np.stack(pdf["v"].to_numpy()), names_of, n, s, own)
        return pd.DataFrame({key: pdf[key].to_numpy(), label: pdf[label].to_numpy(), **dict(zip(names, columns))})

    rows = rows.select(key, label, "v").where(F.col(label).isNotNull())
    held = sums.where(F.col(label).isNotNull()).limit(most + 1).collect()
    if len(held) <= most:
        held = sorted((r[label], r["n"], r["s"]) for r in held)
        share = rows.sparkSession.sparkContext.broadcast(([h[0] for h in held], np.array([h[1] for h in held], dtype=float), np.array([h[2] for h in held])))

        def run(frames):
            for pdf in frames:
                for at in range(0, len(pdf), 4096):
                    yield batch(pdf.iloc[at : at + 4096], *share.value)

        return rows.mapInPandas(run, out)
    parts = max(1, -(-sums.count() // block))
    cell = F.pmod(F.xxhash64(label), F.lit(parts)).cast("int")
    lists = sums.select(cell.alias("__b"), F.struct(F.col(label).alias("name"), "n", "s").alias("r")).groupBy("__b").agg(F.sort_array(F.collect_list("r")).alias("__r"))
    salted = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    asked = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__b"), F.pmod(F.xxhash64(key), F.lit(16)).cast("int").alias("__salt"))

    def met(_, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=[key, label, *names])
        held = theirs["__r"].iloc[0]
        names_of, n, s = [h["name"] for h in held], np.array([h["n"] for h in held], dtype=float), np.array([list(h["s"]) for h in held])
        return pd.concat([batch(mine.iloc[at : at + 4096], names_of, n, s) for at in range(0, len(mine), 4096)])

    return asked.groupBy("__b", "__salt").cogroup(salted.groupBy("__b", "__salt")).applyInPandas(met, out)


def leave_one_out(rows: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, predicted): the label whose centroid, without the vector itself, is most similar, the smaller on ties; sums less the vector make it without a self-join. A label of one vector can't be predicted for it."""
    kind = rows.schema[label].dataType.simpleString()

    def found(x: np.ndarray, names: list, n: np.ndarray, s: np.ndarray, own: np.ndarray):
        at = np.flatnonzero(own >= 0)
        size = lambda v: np.where((z := np.sqrt((v * v).sum(axis=-1))) == 0, 1, z)
        score = x @ s.T / (size(x)[:, None] * size(s)[None, :])
        rest = s[own[at]] - x[at]
        score[at, own[at]] = np.where(n[own[at]] > 1, (x[at] * rest).sum(axis=1) / (size(x[at]) * size(rest)), -np.inf)
        score = score.round(12)
        best = score.argmax(axis=1)
        return np.array([names[b] for b in best], dtype=object), score[np.arange(len(x)), best]

    scored = _against_labels(rows, _label_sums(rows, label), key, label, found, f"predicted {kind}, score double")
    best = scored.groupBy(key, label).agg(F.max(F.struct("score")).alias("top"), F.min_by("predicted", F.struct(-F.col("score"), "predicted")).alias("predicted"))
    return best.where(F.col("top.score") > float("-inf")).select(key, label, "predicted")


def cosine_silhouette(rows: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, silhouette) by cosine distance: mean distances come from the clusters' sums of unit vectors, so no pairs are made. 0 for a cluster of one."""
    u = rows.select(key, label, unit("v").alias("v"))

    def found(x: np.ndarray, names: list, n: np.ndarray, s: np.ndarray, own: np.ndarray):
        near = x @ s.T
        far = 1 - near / n[None, :]
        at = np.flatnonzero(own >= 0)
        mine, members = np.full(len(x), np.nan), np.zeros(len(x))
        mine[at] = 1 - (near[at, own[at]] - (x[at] * x[at]).sum(axis=1)) / np.maximum(n[own[at]] - 1, 1)
        members[at] = n[own[at]]
        far[at, own[at]] = np.inf
        return mine, far.min(axis=1), members

    sides = _against_labels(u, _label_sums(u, label), key, label, found, "a double, b double, n double")
    sides = sides.groupBy(key, label).agg(F.max(F.when(~F.isnan("a"), F.col("a"))).alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
    worst = F.greatest("a", "b")
    alone = (F.col("n") == 1) | F.col("b").isNull() | (F.col("b") == float("inf")) | (worst == 0)
    return sides.select(key, label, F.when(alone, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.when(worst == 0, F.lit(1.0)).otherwise(worst)).alias("silhouette"))


def near_pairs(rows: DataFrame, least: float, key: str = "vec_id", block: int = 2048) -> DataFrame:
    """Pairs (a, b, score), a < b, with a cosine of at least ``least``, exactly: blocks of vectors against blocks, as matrix products.

    Every pair of vectors is looked at, as clustering by distance asks for; no task holds more than two blocks.
    """
    n = rows.count()
    parts = max(1, -(-n // block))
    own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda t: F.struct(F.least(t, F.col("own")).alias("p"), F.greatest(t, F.col("own")).alias("q")))
    dealt = rows.select(F.col(key).alias("id"), "v", own.alias("own")).withColumn("cell", F.explode(cells)).select("id", "v", "own", "cell.p", "cell.q")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x, ids = x / np.where(size == 0, 1, size), pdf["id"].to_numpy()
        left = pdf["own"].to_numpy() == pdf["p"].iloc[0]
        right = pdf["own"].to_numpy() == pdf["q"].iloc[0]
        score = x[left] @ x[right].T
        i, j = np.nonzero(score >= least)
        a, b = ids[left][i], ids[right][j]
        keep = (a < b) if pdf["p"].iloc[0] == pdf["q"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": score[i, j][keep]})

    return dealt.groupBy("p", "q").applyInPandas(compare, "a long, b long, score double")


def graph_components(pairs: DataFrame, nodes: DataFrame, folder: str, key: str = "vec_id") -> DataFrame:
    """(key, component): the smallest node reachable. Labels spread along links, and jump along labels, until nothing changes; each
    round is a stored table under ``folder``, which should be shared by the cluster."""
    spark = nodes.sparkSession
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, step = nodes.select(F.col(key).alias("id"), F.col(key).alias("c")), 0
    both.write.mode("overwrite").parquet(f"{folder}/links")
    both = spark.read.parquet(f"{folder}/links")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("d"))
        jump = hooked.select(F.col("id").alias("to"), F.col("d").alias("e"))
        after = hooked.join(jump, hooked["d"] == jump["to"], "left").select("id", F.col("c").alias("old"), F.least("d", F.coalesce("e", "d")).alias("c"))
        after.write.mode("overwrite").parquet(f"{folder}/round-{step}")
        after = spark.read.parquet(f"{folder}/round-{step}")
        if not after.where("old <> c").limit(1).count():
            return after.select(F.col("id").alias(key), F.col("c").alias("component"))
        labels, step = after.select("id", "c"), step + 1


def lloyd(rows: DataFrame, seeds: list[list[float]], passes: int, key: str = "vec_id") -> DataFrame:
    """(key, cluster): ``passes`` rounds of nearest centre (Euclidean, ties to the smaller number) and mean, from fixed centres. Only the centres reach the driver."""
    spark = rows.sparkSession
    centres = [np.array(s, dtype=float) for s in seeds]
    d = len(centres[0])

    def assigned() -> DataFrame:
        share = spark.sparkContext.broadcast(np.stack(centres))

        def near(frames):
            for pdf in frames:
                x, c = np.stack(pdf["v"].to_numpy()), share.value
                far = ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]).round(12)
                yield pd.DataFrame({key: pdf[key], "v": pdf["v"], "cluster": far.argmin(axis=1)})

        return rows.select(key, "v").mapInPandas(near, f"{key} long, v array<double>, cluster int")

    for _ in range(passes):
        means = assigned().select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x")).collect()
        new = {r["cluster"]: np.zeros(d) for r in means}
        for r in means:
            new[r["cluster"]][r["pos"]] = r["x"]
        centres = [new.get(i, c) for i, c in enumerate(centres)]
    return assigned().select(key, "cluster")


def average_linkage(rows: DataFrame, group: str, key: str, clusters: int) -> DataFrame:
    """(group, key, cluster) for each group of vectors: ``reduction.linkage``, average, cosine distance."""
    return linkage(rows, group, key, clusters, "average")


def greedy_online(rows: DataFrame, group: str, key: str, threshold: float, most: int) -> DataFrame:
    """(group, key, cluster) in the order of the key: the best centre if similar enough, else a new one up to ``most``, else the closest.

    An accepted vector moves its centre to the mean of all that carry its label, those that were forced on it included; a forced one alone doesn't move it.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        sums: list[np.ndarray] = []
        counts: list[int] = []
        centres: list[np.ndarray] = []
        out = []
        for v in pdf["v"]:
            v = np.asarray(v, dtype=float)
            size = np.sqrt(v @ v) or 1.0
            scores = [float(v @ c) / (size * (np.sqrt(c @ c) or 1.0)) for c in centres]
            best = int(np.argmax(scores)) if scores else -1
            if best >= 0 and scores[best] >= threshold:
                sums[best], counts[best] = sums[best] + v, counts[best] + 1
                centres[best] = sums[best] / counts[best]
            elif len(sums) < most or not sums:
                sums.append(v.copy())
                counts.append(1)
                centres.append(v.copy())
                best = len(sums) - 1
            else:
                sums[best], counts[best] = sums[best] + v, counts[best] + 1
            out.append(best)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": out})

    kinds = rows.schema
    return rows.select(group, key, "v").groupBy(group).applyInPandas(fold, f"{group} {kinds[group].dataType.simpleString()}, {key} {kinds[key].dataType.simpleString()}, cluster int")
