"""Nearest neighbours by collision counting over single projections.

Vectors are put into blocks. In a block, the values of each random projection are sorted; a query is the centre of a window in each sorted
array, and a vector that lies in enough of the windows is verified. Windows grow (virtual rehashing: the arrays stay as they
are) until ``k`` verified vectors lie within the radius, or the radius within which a sample says the k nearest are. The
largest inner product is the least distance after one more coordinate makes all vectors equally long.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import matrix, usable

WIDTH = 1.5  # half a window, in radii
INSIDE = 0.8664  # the part of a normal distribution within WIDTH standard deviations


class Block:
    """Vectors of a block with the ranks of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, projections: int, seed: int = 7):
        self.ids, self.x, self.longest = ids, x, longest
        self.axes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        flat = np.column_stack([x / longest, np.sqrt(np.maximum(0, 1 - ((x / longest) ** 2).sum(axis=1)))])
        shadow = flat @ self.axes
        order = np.argsort(shadow, axis=0, kind="stable")
        self.sorted = np.take_along_axis(shadow, order, axis=0)
        self.ranks = np.empty((projections, len(x)), dtype=np.uint16)
        np.put_along_axis(self.ranks, order.T, np.arange(len(x), dtype=np.uint16)[None, :], axis=1)
        spare = (projections * INSIDE * (1 - INSIDE)) ** 0.5
        self.enough = ceil(projections * INSIDE - 1.6 * spare)

    def search(self, queries: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int) -> Iterator[tuple]:
        """(query, ids, inner products) of each query's verified vectors within its radius, its k nearest at least if so many are near; with a radius of 2 or more, of all."""
        norm = np.sqrt((q * q).sum(axis=1))
        centre = (q / norm[:, None]) @ self.axes[:-1]
        windows = []
        for part in (0.5, 1.0):
            reach = WIDTH * part * radius
            low = np.array([np.searchsorted(s, c - reach) for s, c in zip(self.sorted.T, centre.T)], dtype=np.int64)
            high = np.array([np.searchsorted(s, c + reach, side="right") for s, c in zip(self.sorted.T, centre.T)], dtype=np.int64)
            # ranks below a window wrap round to large numbers; a window of all 65536 is one short, which costs one vector one collision
            windows.append((part, low.T.astype(np.uint16), np.minimum(high - low, 65535).T.astype(np.uint16)))
        for i, query in enumerate(queries):
            for part, low, wide in windows:
                r = part * radius[i]
                if r >= 1.9:  # no two of the unit vectors are much farther apart
                    found = np.arange(len(self.ids))
                else:
                    within = (self.ranks - low[i][:, None]) < wide[i][:, None]
                    found = np.flatnonzero(np.add.reduce(within.view(np.uint8), axis=0, dtype=np.uint8) >= self.enough)
                score = (self.x[found] * q[i]).sum(axis=1)
                # the distance from a query made as long as the others
                near = (2 - 2 * score / (norm[i] * self.longest) <= r * r + 1e-9) & (self.ids[found] != query)
                if near.sum() >= k:
                    break
            if radius[i] >= 1.9:
                near = self.ids[found] != query
            found, score = found[near], score[near]
            best = _best(self.ids[found], score, k)
            yield query, self.ids[found][best], score[best]


HITS = "query_id bigint, vec_id bigint, score double"


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:  # all that tie with the k-th stay
        least = np.partition(score, -k)[-k]
        keep = np.flatnonzero(score >= least)
        return keep[np.lexsort((ids[keep], -score[keep]))][:k]
    return np.lexsort((ids, -score))[:k]


def _search(data: DataFrame, queries: DataFrame, dimension: int, rows: int, asked: int, k: int, longest: float, projections: int, block: int, query_block: int) -> DataFrame:
    """Each query's k best of each block. ``queries`` has id, v and radius."""
    parts, rounds = -(-rows // block), -(-asked // query_block)
    left = data.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    right = queries.select("id", "v", "radius", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(rounds)).cast("int").alias("round"))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if own.num_rows and asked.num_rows:
            held = []
            x, ids = matrix(own.column("v"), dimension), own.column("id").to_numpy()
            # hashing may overfill a block; ranks have 16 bits
            blocks = [Block(ids[at : at + 65536], x[at : at + 65536], longest, projections) for at in range(0, len(ids), 65536)]
            for b in blocks:
                for query, found, score in b.search(asked.column("id").to_numpy(), matrix(asked.column("v"), dimension), asked.column("radius").to_numpy(), k):
                    held.append((np.full(len(found), query), found, score))
            out = [np.concatenate(c) for c in zip(*held)]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return left.groupBy("part", "round").cogroup(right.groupBy("part", "round")).applyInArrow(run, HITS)


def nearest(rows: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding", projections: int = 64, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product with each query, itself left out.

    ``queries`` is a condition on the rows. Rows with an unusable vector (see ``usable``) take no part, nor do null keys.
    Ties go to the smaller id; a repeated id counts as one vector, with its best score. The radius is that of a ``sample`` (a broadcast
    of at most so many vectors) around each query; a query for which fewer than ``k`` were found is searched again in full.
    """
    spark = rows.sparkSession
    good, dimension, n = usable(rows, key, vector)
    asking = good.join(rows.where(queries).select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    asked = asking.count() if n else 0
    if not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = good.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] * (1 + 1e-12)
    few = np.array([r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    place = min(len(few), ceil(3 * k * len(few) / n) + 4)
    share = spark.sparkContext.broadcast(few)

    def radii(frames):
        for frame in frames:
            q = matrix(frame.column("v"), dimension)
            ip = (q @ share.value.T) / (longest * np.sqrt((q * q).sum(axis=1, keepdims=True)))
            at = np.partition(ip, len(few) - place, axis=1)[:, len(few) - place] if len(few) > place else np.full(len(q), -1.0)
            yield pa.RecordBatch.from_arrays([frame.column("id"), frame.column("v"), pa.array(np.sqrt(np.maximum(2 - 2 * at, 1e-4)))], ["id", "v", "radius"])

    block = max(2048, min(16384, n // 24))
    ask = asking.mapInArrow(radii, "id bigint, v array<double>, radius double")
    first = stage(_search(good, ask, dimension, n, asked, k, longest, projections, block, 8192), "ann")
    out = _top(first, k)
    if n > 1:
        found = first.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
        short = asking.select("id").join(found.where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("id")), "id", "left_anti")
        short = stage(short.join(good, "id"), "ann-short")  # stored: a cogroup's sides must not share columns
        missing = short.count()
        if missing:
            again = _search(good, short.withColumn("radius", F.lit(4.0)), dimension, n, missing, k, longest, projections, block, 8192)
            out = _top(first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(again), k)
    return out


def _top(hits: DataFrame, k: int) -> DataFrame:
    one = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_collision_counting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 20 == 0, 20)
