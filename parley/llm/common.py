"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` yields; only A-Z are lower-cased (``bytes.lower()``).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new local one in local mode, and an error on a cluster, whose machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, files: int | None = None, shuffles_go: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors. ``files`` is the most it should be written as.
    ``shuffles_go``: Spark deletes the shuffle files of the write at its end, and doesn't wait for the driver to collect its garbage."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = new_folder(spark, label)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true" if shuffles_go else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def shielded(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns that are named like results (in any case) under other names, and what selects its columns, under their own names again, from a result."""
    taken = {n.lower() for n in names}
    inner = [f"__own_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)]
    outer = docs.columns
    return docs.toDF(*inner), lambda out: out.select(*[F.col(f"`{i}`").alias(c) for i, c in zip(inner, outer)])


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text):
    """A-Z to a-z, nothing else, as a native expression."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LETTERS = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.isin(np.arange(256), [ord(c) for c in SPACES])
POWER = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: list, window: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and the number of words of each.

    A word's hash comes from differences of running sums of its bytes' random numbers times powers, which is the same wherever the word stands;
    the sums are made over windows of some 256 KB of whole words.
    """
    bodies = [t.encode() if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join([b"", *bodies, b""]).lower(), dtype=np.uint8)
    blank = BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + window, side="right")))
        size = int(ends[to - 1] - base)
        room = max(window, 1 << size.bit_length())
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(LETTERS[raw[base : base + size]] * _powers(POWER, room)[:size], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * _powers(pow(POWER, -1, 1 << 64), room)[s]
        at = to
    closes = np.cumsum([len(b) + 1 for b in bodies]) if bodies else np.zeros(0, np.int64)
    return mix64(out), np.bincount(np.searchsorted(closes, starts, side="right"), minlength=len(bodies))[: len(bodies)]


def bucket_bits(size: int, each: int = 64 << 20, least: int = 8, most: int = 17) -> int:
    """How many leading bits of a hash part ``size`` bytes into buckets of about ``each``."""
    return min(most, max(least, (size // each).bit_length()))


def release() -> None:
    """Give free memory back to the system: a Python worker serves one task after another, and what one has left unused would stand beside what the next one takes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run``, a function of the batches of a task, and after it ``release``: what it held is free by then, and the worker may wait for long beside a shuffle."""

    def whole(frames: Iterator) -> Iterator:
        yield from run(frames)
        release()

    return whole


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of ``rows`` at most, and 4 MB where Spark can count bytes, unless the session has smaller ones: both sides hold a whole batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def batch_limits(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """``small_batches`` for what is written inside the block; the session's own settings hold again after it."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(key) for key in keys]
    small_batches(spark, rows)
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


class Codes(dict):
    """Maps keys to values made by ``make``. Holds ``most`` entries and as many older ones, which go when it is full again."""

    def __init__(self, make: Callable, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value


KEPT: dict = {}


def kept(name: str, make: Callable):
    """What ``make`` makes, once in a Python worker: kept for tasks to come until ``batches`` begins one that doesn't ``keep`` that name."""
    if name not in KEPT:
        KEPT[name] = make()
    return KEPT[name]


def batches(frames: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text", keep: str | None = None) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``limit`` bytes of ``column``, so that a batch of long texts stays small and one of short texts is worth its overhead.
    What other operators have ``kept`` in this worker goes."""
    for name in [n for n in KEPT if n != keep]:
        del KEPT[name]
    release()  # what the task before left in this worker
    held, size = [], 0
    for frame in frames:
        rows, at = frame.num_rows, 0
        if not rows:
            continue
        lengths = np.diff(np.frombuffer(frame.column(column).buffers()[1], dtype=np.int32, count=rows + 1, offset=4 * frame.column(column).offset)) if pa.types.is_string(frame.column(column).type) or pa.types.is_binary(frame.column(column).type) else np.full(rows, 64)
        ends = np.cumsum(lengths)
        while at < rows:
            room = limit - size + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, room, side="right")))
            held.append(frame.slice(at, to - at))
            size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if size >= limit or at < rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    release()


def by_bucket(buckets: np.ndarray, count: int, **columns: np.ndarray) -> dict[str, list]:
    """Split aligned arrays by bucket into one packed row per bucket: {'bucket': [...], name: [bytes, ...]}."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    full = np.flatnonzero(np.diff(edges))
    out: dict[str, list] = {"bucket": [int(b) for b in full]}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[edges[b] : edges[b + 1]].tobytes() for b in full]
    return out


def unpack(column, dtype) -> np.ndarray:
    """The concatenated arrays of a packed binary column, copied once."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends = np.frombuffer(chunk.buffers()[1] or bytes(4), np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(dtype)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long): one row (id, component_id) per id that has an edge to another id.

    Alternating large-star and small-star steps, until every component is a star; each is a map-side combined minimum and a join on which
    adaptive execution can split a hub. Links stay on the executors. Self links and nulls are ignored.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    files = max(1, now.count() // 250_000)  # no step makes more than twice the links: small tables stay in few files
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", files)
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large", files)
        discard(least)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least", files)
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        after = stage(small.distinct(), "edges", files)
        discard(now, large, least)
        now = after
        # in a star each id but the centre has one link, and none leads to it
        ends = now.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("b", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.where("out + into > 1").limit(1).count():
            return _with_roots(now)


def _with_roots(stars: DataFrame) -> DataFrame:
    out = stars.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = stars.select(F.col("b").alias("id")).distinct()
    out = out.union(roots.select("id", F.col("id").alias("component_id")))
    out.staged_at = getattr(stars, "staged_at", None)
    return out
