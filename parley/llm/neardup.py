"""Near-duplicate embeddings through a pivot-permutation index.

Each vector is described by its nearest pivots in order. Inverted lists are kept for pairs of pivots: two vectors are on a list together
exactly if they share at least two of their nearest pivots. Vectors on a list are compared by blocks, and each
pair is counted on the first list that both are on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage
from .vectors import matrix, unit, usable

FOUND = "id bigint, n bigint, b bigint"


def choose(sample: np.ndarray, count: int, closest: float = 0.8) -> np.ndarray:
    """Two to ``count`` vectors of a sample of unit vectors, in its order, no two with a cosine over a bound: a dense group has one pivot, not many that order at random.

    The bound is 0.5, and is loosened up to ``closest`` while it leaves less than a quarter of ``count``. A sample that has one pivot even then gives it twice, which puts all
    vectors on one list.
    """
    kept, n = np.zeros((count, sample.shape[1])), 0
    for apart in (*np.arange(0.5, closest, 0.05), closest):
        for v in sample:
            if n == count:
                break
            if not n or (kept[:n] @ v).max() <= apart:
                kept[n] = v
                n += 1
        if 4 * n >= count:
            break
    return kept[:n] if n > 1 else kept[[0, 0]]


def describe(good: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """(id, v, pivots array<int>): the vector at unit length and its ``near`` nearest pivots, nearest first; ties go to the earlier pivot."""
    share = good.sparkSession.sparkContext.broadcast(pivots)
    d = pivots.shape[1]

    def run(frames):
        for frame in frames:
            x = unit(matrix(frame.column("v"), d))
            order = np.argsort(-(x @ share.value.T), axis=1, kind="stable")[:, :near].astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int32()))
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([frame.column("id"), vectors, lists], ["id", "v", "pivots"])

    return good.mapInArrow(run, "id bigint, v array<double>, pivots array<int>")


def _labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row, and each column, of a link matrix reaches through it."""
    top = np.iinfo(np.int64).max
    rows, columns = a.copy(), b.copy()
    while True:
        c = np.minimum(columns, np.where(linked, rows[:, None], top).min(axis=0, initial=top))
        r = np.minimum(rows, np.where(linked, c[None, :], top).min(axis=1, initial=top))
        if (r == rows).all() and (c == columns).all():
            return r, c
        rows, columns = r, c


def compare(ids, x, seen, list_key, tile, cosine: float, pivots: int, other: tuple | None = None):
    """Counts and links of the vectors of one list, or of two of its tiles. ``seen`` are the nearest pivots of each row."""
    p, q = divmod(list_key, pivots)

    def earlier(near):
        """Flags for the pivots before q, but for p: those that would make an earlier list."""
        flags = np.zeros((len(near), pivots), dtype=np.float32)
        flags[np.arange(len(near))[:, None], near] = 1
        flags[:, q:] = 0
        flags[:, p] = 0
        return flags

    left = (ids, x, seen)
    right = other or left
    linked = left[1] @ right[1].T >= cosine
    linked &= left[0][:, None] != right[0][None, :]
    if not linked.any():
        return
    counted = linked & (earlier(left[2]) @ earlier(right[2]).T < 0.5)
    rows, columns = _labels(linked, left[0], right[0])
    yield left[0], counted.sum(axis=1), rows
    if other:
        yield right[0], counted.sum(axis=0), columns


def links(described: DataFrame, dimension: int, pivots: int, cosine: float, tile: int = 2048, bucket_rows: int = 4096) -> DataFrame:
    """(id, n, b): partial numbers of links, and links (id, b) that connect what the lists connect.

    Lists of up to ``tile`` rows are compared whole, many to a group of rows. Longer ones are cut into tiles, and each pair of tiles is a group, so no
    task holds more than two tiles of a hot list. The table of long lists that is broadcast has a row for each pair of pivots at most.
    """
    keys = F.flatten(F.transform("pivots", lambda p: F.transform(F.filter("pivots", lambda q: q > p), lambda q: p * pivots + q)))
    listed = described.select("id", "v", "pivots", F.explode(keys).alias("key"))
    counts = described.select(F.explode(keys).alias("key")).groupBy("key").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    long = counts.where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    listed = listed.join(F.broadcast(long), "key", "left")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    cells = F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b")))
    )
    buckets = max(256, -(-total // bucket_rows))
    dealt = listed.withColumn("own", own).withColumn("cell", F.explode(cells)).select(
        F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).otherwise(-1 - F.col("key")).alias("group"), "cell.a", "cell.b", "key", "id", "v", "pivots", "own"
    )

    def run(table: pa.Table) -> pa.Table:
        key, ids, x, near = table.column("key").to_numpy(), table.column("id").to_numpy(), matrix(table.column("v"), dimension), None
        near = np.asarray(table.column("pivots").combine_chunks().flatten()).reshape(len(ids), -1)
        out = []
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        if a == b:
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(part) > 1:
                    out += compare(ids[part], x[part], near[part], int(key[part[0]]), tile, cosine, pivots)
        else:
            first = table.column("own").to_numpy(zero_copy_only=False) == a
            if first.any() and not first.all():
                out += compare(ids[first], x[first], near[first], int(key[0]), tile, cosine, pivots, (ids[~first], x[~first], near[~first]))
        merged = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
        keep = (merged[1] > 0) | (merged[0] != merged[2])
        return pa.table([pa.array(m[keep].astype(np.int64)) for m in merged], names=["id", "n", "b"])

    return dealt.groupBy("group", "a", "b").applyInArrow(run, FOUND)


def near_duplicates(rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", near: int = 6, pivots: int | None = None) -> DataFrame:
    """Each row's ``key`` with n_links, component_id and kept.

    Rows link if their cosine is at least ``cosine`` and they share two of their ``near`` nearest pivots. Unusable vectors (see ``usable``) link with nothing;
    a null key has no component. The pivots are chosen from a sample of eight times as many vectors, by a hash of the id: 256, or more (4096 at most) for
    over a million vectors, and fewer where the sample has not enough that lie apart. Rows that repeat an id link as that id does, and not with each other.
    """
    good, dimension, n = usable(rows, key, vector)
    ids = rows.select(F.col(key).alias("id"))
    if not n:
        return ids.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    pivots = pivots or int(max(256, min(4096, n**0.4)))
    few = choose(unit(np.array([r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).collect()])), pivots, max(0.5, 2 * cosine**2 - 1))  # pivots at twice the angle of a link, or more
    described = describe(good.dropDuplicates(["id"]), few, min(near, len(few)))
    found = stage(links(described, dimension, len(few), cosine), "links")
    degrees = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("id").alias("a"), "b"))
    facts = degrees.join(joined, "id", "full")
    out = ids.join(facts, "id", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op5_pivot_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
