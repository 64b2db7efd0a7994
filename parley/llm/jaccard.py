"""Exact Jaccard join of documents as sets of five-word shingles, with set relations used to skip work.

Equal sets are one set. Sets that a few min-hashes show to be alike are verified against one of them, their pivot: the one that shares most with the others, which in a
group of near copies is what they were made from or close to it. So most near copies are a pivot and its members, whose differences from it are known. A prefix index (rarer shingles first) then gives every pair that could link;
its lists are cut into blocks by pivot, and blocks whose sizes and positions rule a link out are skipped. A pair of
pivots is verified once, and the answers of their members are derived from it: |z & y| lies between |p & q| - |p - z| - |q - y| and
|p & q| + |z - p| + |y - q|, which settles nearly all; the rest is verified. The order of the index affects speed only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bucket_bits, components, discard, mix64, stage, unpack, word_hashes

WORDS = 5
BANDS, DEPTH = 8, 3
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONG = 64


def _hash(data: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(data)


def shingles(texts: list) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. With fewer than five words, the whole sequence is one; with none, there is none."""
    words, sizes = word_hashes(texts)
    step = np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(sizes)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
        for part in parts:
            h = h * step + part
        return mix64(h)

    n = len(words) - WORDS + 1
    every = join([words[i : n + i] for i in range(WORDS)]) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for start, size in zip((ends - sizes).tolist(), sizes.tolist()):
        out.append(np.unique(every[start : start + size - WORDS + 1]) if size >= WORDS else join([words[start + i : start + i + 1] for i in range(size)]) if size else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(np.int64(_hash(s.tobytes()) - (1 << 63)))


def band_keys(s: np.ndarray) -> list[int]:
    if len(s) * len(FACTORS) < 1 << 18:
        least = (s[None, :] * FACTORS[:, None]).min(axis=1)
    else:
        least = np.array([(s * f).min() for f in FACTORS])
    return [int(np.int64(_hash(b"%d:" % b + least[DEPTH * b : DEPTH * (b + 1)].tobytes()) - (1 << 63))) for b in range(BANDS)]


def parity(s: np.ndarray, bits: int = 512) -> bytes:
    """``bits`` (a power of two) bits, each the parity of the shingles that fall on it: two sets differ by at least as many shingles as their parities by bits."""
    return np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def sketch(s: np.ndarray) -> bytes | None:
    """The parity of a set of over 512 shingles in as many bits, up to a power of two, as it has shingles; fewer would be full."""
    return parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > 512 else None


def parted(a: bytes, b: bytes) -> int:
    """By how many shingles at least two sets differ, from their parities. The longer one is folded to the length of the other."""
    x, y = (np.frombuffer(m, np.uint64) for m in (a, b))
    least = min(len(x), len(y))
    x, y = (m if len(m) == least else np.bitwise_xor.reduce(m.reshape(-1, least)) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, rid, bands, parity, sketch, common, times): the set's hash (null for the empty set), its min-hash bands, its parities, and on the first row of a batch the
    shingles that several of the batch's sets have, with how many."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, 8 << 20):
            sets = shingles(table.column("text").to_pylist())
            rids = [set_id(s) if len(s) else None for s in sets]
            distinct = {r: s for r, s in zip(rids, sets) if len(s)}
            every, times = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = times > 1
            rest = [None] * (len(sets) - 1)
            columns = [
                table.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(rids, pa.int64()), pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()),
                pa.array([every[often].tobytes(), *rest], pa.binary()), pa.array([times[often].astype("<i8").tobytes(), *rest], pa.binary()),
            ]
            yield from pa.table(columns, names=["doc_id", "n_shingles", "rid", "bands", "parity", "sketch", "common", "times"]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, rid long, bands array<long>, parity binary, sketch binary, common binary, times binary")


def frequent(profiled: DataFrame, least: int = 8, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that batches found to be common, sorted, and the magnitude of their frequency. Beyond ``most`` only the
    more frequent are told apart: the order of the index, and so its speed, is all that this decides."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array(unpack(frame.column("common"), np.int64)), pa.array(unpack(frame.column("times"), "<i8"))], ["s", "n"])

    counts = stage(profiled.where("common is not null").select("common", "times").mapInArrow(rows, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "common")
    held = 0
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).alias("g")).count().collect(), key=lambda r: -r["g"]):
        held += r["count"]
        if held > most:
            counts = counts.where(F.floor(F.log2("n")) > r["g"])
            break
    got = counts.toArrow()
    discard(counts)
    s = got.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order].copy(), np.log2(np.maximum(got.column("n").to_numpy()[order], 1)).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def index(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int, bits: int) -> DataFrame:
    """(s, rid, pos, long): the entries of the prefix index whose list holds more than one set, and whether it holds over ``LONG``. Each batch sends an entry of a set once, to the
    bucket of its leading ``bits`` (8 or more)."""
    share = docs.sparkSession.sparkContext.broadcast(common)

    def entries(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = share.value
        for table in batches(frames, 8 << 20):
            done, parts = set(), []
            for s in shingles(table.column("text").to_pylist()):
                if not len(s) or (rid := set_id(s)) in done:
                    continue
                done.add(rid)
                size = prefix_length(len(s), percent)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, level[at] + 1, 0)
                    if rank[:size].any():
                        s = s[np.argsort(rank, kind="stable")]
                parts.append((s[:size], np.full(size, rid, dtype=np.int64), np.minimum(np.arange(size), 65535).astype("<u2")))
            if parts:
                s, rid, pos = (np.concatenate(c) for c in zip(*parts))
                order = np.argsort(s, kind="stable")
                s, rid, pos = s[order], rid[order], pos[order]
                edges = np.searchsorted((s >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                short = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 1:7])  # the lowest byte goes, the top one is the bucket's
                full = np.flatnonzero(np.diff(edges)).tolist()
                cut = lambda a: pa.array([a[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(short), cut(rid), cut(pos)], ["bucket", "s", "rid", "pos"])

    def lists(table: pa.Table) -> pa.Table:
        bucket, short = table.column("bucket")[0].as_py(), unpack(table.column("s"), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(short), 8), dtype=np.uint8)
        wide[:, 1:7], wide[:, 7] = short, bucket >> (bits - 8)
        s, rid, pos = wide.view(np.int64).ravel(), unpack(table.column("rid"), np.int64), unpack(table.column("pos"), "<u2")
        order = np.lexsort((pos, rid, s))
        s, rid, pos = s[order], rid[order], pos[order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (rid[1:] != rid[:-1]))
        s, rid, pos = s[fresh], rid[fresh], pos[fresh]
        same = s[1:] == s[:-1]
        shared = np.append(same, False) | np.append(False, same)
        s, rid, pos = s[shared], rid[shared], pos[shared]
        _, back, times = np.unique(s, return_inverse=True, return_counts=True)
        return pa.table([pa.array(s), pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(times[back] > LONG)], names=["s", "rid", "pos", "long"])

    packed = docs.select("text").mapInArrow(entries, "bucket int, s binary, rid binary, pos binary")
    return packed.groupBy("bucket").applyInArrow(lists, "s long, rid long, pos int, long boolean")


def block_pairs(listed: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, of pivots some of whose sets could link, from (s, pos, n, pivot, kin, parity).

    In each list the sets of one pivot are a block with its least size, largest size and most shingles from the position on. Two blocks
    whose sizes or positions rule a link out are skipped; so are pairs that are already connected, lists of connected sets alone, and in long lists (whose rows have a parity)
    pairs of single sets whose parities differ in too many bits.
    """

    def run(table: pa.Table) -> pa.Table:
        s, n, pivot, kin = (table.column(c).to_numpy() for c in ("s", "n", "pivot", "kin"))
        rest = n - table.column("pos").to_numpy()
        order = np.lexsort((pivot, s))
        s, n, pivot, kin, rest = s[order], n[order], pivot[order], kin[order], rest[order]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
        marks = np.frombuffer(b"".join(m or bytes(64) for m in table.column("parity").to_pylist()), dtype=np.uint64).reshape(-1, 8)[order]
        marked = ~table.column("parity").is_null().to_numpy(zero_copy_only=False)[order]
        mixed = np.repeat(np.minimum.reduceat(kin, heads) != np.maximum.reduceat(kin, heads), np.diff(np.append(heads, len(s)))) if len(s) else np.zeros(0, bool)
        s, n, pivot, kin, rest, marks, marked = s[mixed], n[mixed], pivot[mixed], kin[mixed], rest[mixed], marks[mixed], marked[mixed]
        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (pivot[1:] != pivot[:-1]))) if len(s) else np.zeros(0, int)
        if not len(s):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["a", "b"])
        least, most, rest = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(rest, first)
        alone = np.diff(np.append(first, len(s))) == 1
        s, pivot, kin, marks, marked = s[first], pivot[first], kin[first], marks[first], marked[first] & alone
        order = np.lexsort((least, s))
        s, pivot, kin, least, most, rest, marks, marked = s[order], pivot[order], kin[order], least[order], most[order], rest[order], marks[order], marked[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        ends = np.append(starts[1:], len(s))
        # a block meets those after it in its list whose least size isn't over what its largest allows
        until = np.minimum(np.repeat(ends, ends - starts), _until(s, least, most, starts, ends, percent))
        out = [np.zeros((0, 2), np.int64)]
        step = 1
        at = np.arange(len(s))
        while len(at):
            at = at[at + step < until[at]]
            to = at + step
            ok = (kin[at] != kin[to]) & ((100 + percent) * np.minimum(rest[at], rest[to]) >= percent * (least[at] + least[to]))
            near = np.flatnonzero(ok & marked[at] & marked[to])
            total = least[at[near]] + least[to[near]]
            apart = np.bitwise_count(marks[at[near]] ^ marks[to[near]]).sum(axis=1, dtype=np.int64)
            ok[near[(100 + percent) * (total - apart) < 2 * percent * total]] = False
            pairs = np.column_stack([np.maximum(pivot[at], pivot[to]), np.minimum(pivot[at], pivot[to])])[ok]
            out.append(pairs)
            step += 1
            if sum(map(len, out)) > 1 << 20:
                out = [np.unique(np.concatenate(out), axis=0)]
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = listed.withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def possible(pairs: DataFrame, reps: DataFrame, family: DataFrame, percent: int, most: int = 2_000_000) -> DataFrame:
    """The stored ``pairs`` (a, b) of pivots whose answer can matter: by their parities they may link themselves, or some of their members may. What is left out has no link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    few = pairs.count() <= most  # then twice as many ids fit a broadcast of some 50 MB
    reach = family.where("rid <> pivot").groupBy(F.col("pivot").alias("rid")).agg(F.max("plus").alias("plus"), F.min("n").alias("least"))
    facts = reps.select("rid", "n", F.coalesce("sketch", "parity").alias("mark")).join(F.broadcast(ids) if few else ids, "rid", "left_semi").join(reach, "rid", "left")
    facts = facts.select("rid", "n", "mark", F.coalesce("plus", F.lit(0)).alias("plus"), F.least("n", "least").alias("least"))
    side = lambda x: facts.select(F.col("rid").alias(x), *[F.col(c).alias(c + x) for c in ("n", "mark", "plus", "least")])

    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([parted(x, y) for x, y in zip(a, b)], dtype="int64")

    # what two sets of n and m shingles can share at most, and what members may share besides
    shared = (F.col("na") + F.col("nb") - F.pandas_udf(apart, "long")("marka", "markb")) / 2
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared)
    may = lambda o, n, m: o * (100 + percent) >= (F.col(n) + F.col(m)) * percent
    more = F.col("plusa") + F.col("plusb")
    return met.where(may(F.col("shared"), "na", "nb") | ((more > 0) & may(F.col("shared") + more, "leasta", "leastb"))).select("a", "b")


def _until(s, least, most, starts, ends, percent) -> np.ndarray:
    out = np.repeat(ends, ends - starts)
    for a, b in zip(starts[ends - starts > 64], ends[ends - starts > 64]):
        out[a:b] = a + np.searchsorted(least[a:b] * percent, most[a:b] * 100, side="right")
    return out


def compared(docs: DataFrame, reps: DataFrame, pairs: DataFrame, use: Callable, columns: list[tuple], most: int = 2_000_000) -> DataFrame:
    """(a, b, *columns) for the stored, distinct ``pairs`` (a, b): what ``use`` makes of the sets of a and b; ``columns`` are names and types (Spark's and Arrow's).

    Sets are made again from the texts that are needed, and each goes where its pairs are compared in one exchange. ``reps`` deals sets that are alike to cells of bounded size; a pair
    is compared where the pairs of its two cells are, so in a group in which many pairs must be compared a set is sent once for each cell that it meets, not for each pair.
    """
    total = pairs.count()
    buckets = max(64, total // 1000)
    cells = reps.select("rid", "cell")
    placed = pairs.join(cells.withColumnsRenamed({"rid": "a", "cell": "ca"}), "a").join(cells.withColumnsRenamed({"rid": "b", "cell": "cb"}), "b")
    bucket = F.pmod(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")), F.lit(buckets)).cast("int")
    placed = stage(placed.select("a", "b", bucket.alias("bucket")), "placed")
    wanted = placed.select(F.col("a").alias("rid"), "bucket").union(placed.select("b", "bucket")).distinct()
    goes = wanted.groupBy("rid").agg(F.collect_list("bucket").alias("goes"))  # as many as there are cells alike, at most
    goes = stage(goes.join(reps.select("rid", "doc_id"), "rid").select("doc_id", F.col("rid").alias("own"), "goes"), "goes")
    few = total <= most  # then the ids and buckets fit a broadcast of some 100 MB
    texts = docs.select("doc_id", "text").join(F.broadcast(goes) if few else goes, "doc_id").select("own", "text", "goes")

    def make(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, 2 << 20):
            out: tuple = ([], [], [])
            size = 0
            for own, s, goes in zip(table.column("own").to_pylist(), shingles(table.column("text").to_pylist()), table.column("goes").to_pylist()):
                if len(s) and set_id(s) == own:  # another row may have the id of the set's document
                    held = s.tobytes()
                    for g in goes:
                        for c, v in zip(out, (g, own, held)):
                            c.append(v)
                        size += len(held)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, size = ([], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    kinds, names = (pa.int32(), pa.int64(), pa.binary()), ["bucket", "rid", "s"]

    def count(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets = {r: s.as_buffer() for r, s in zip(held.column("rid").to_pylist(), (s for c in held.column("s").chunks for s in c))}
        a, b = asked.column("a").to_numpy(), asked.column("b").to_numpy()
        found = [use(np.frombuffer(sets[x], np.uint64), np.frombuffer(sets[y], np.uint64)) for x, y in zip(a.tolist(), b.tolist())]
        return pa.table([pa.array(a), pa.array(b), *(pa.array([f[i] for f in found], c[2]) for i, c in enumerate(columns))], names=["a", "b", *(c[0] for c in columns)])

    made = texts.mapInArrow(make, "bucket int, rid long, s binary")
    out = stage(placed.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInArrow(count, ", ".join(["a long, b long", *(f"{c[0]} {c[1]}" for c in columns)])), "compared")
    discard(placed, goes)
    return out


def _inside(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Flags for those of ``s`` that are in ``t``; both are sorted."""
    return t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s


def overlaps(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact overlaps (a, b, o) of the sets of stored, distinct ``pairs`` (a, b)."""

    def use(a: np.ndarray, b: np.ndarray) -> tuple:
        return (int((_inside(a, b) if len(a) < len(b) else _inside(b, a)).sum()),)

    return compared(docs, reps, pairs, use, [("o", "long", pa.int64())])


def differences(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, far, w, slack, t, take, tokens) of sets a near a pivot b: how a differs from b, as far as it can matter.

    Let a and y be near b, with d and e shingles of b that a and y lack, g and h that they have besides, and s of these differences in common. Then |a & y| = |b| - d - e + s, so they link if
    (100 + percent) s >= w(a) + w(y) - (100 - percent) |b| with w(a) = 100 d + percent g. If a doesn't link to b itself (``far``, ``slack`` = w(a) - (100 - percent) |b| > 0), a link needs differences in common:
    at least slack / 100 of a's, and over w(y) / (100 + percent) of y's. So of the t differences, in any order, a link can't miss all of the first ``take``.
    """

    def use(a: np.ndarray, b: np.ndarray) -> tuple:
        more, less = a[~_inside(a, b)], b[~_inside(b, a)]
        w = 100 * len(less) + percent * len(more)
        slack = w - (100 - percent) * len(b)
        least = w // (100 + percent) + 1
        if slack > 0:
            least = max(1, min(least, -(-slack // 100)))
        tokens = np.concatenate([more & ~np.uint64(1), less | np.uint64(1)])
        return slack > 0, w, slack, len(tokens), max(0, len(tokens) - least + 1), tokens.view(np.int64)

    kinds = [("far", "boolean", pa.bool_()), *((c, "long", pa.int64()) for c in ("w", "slack", "t", "take")), ("tokens", "array<long>", pa.list_(pa.int64()))]
    return compared(docs, reps, pairs, use, kinds)


def sharing(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (z, y) of sets near one pivot, z far from it, whose ``differences`` allow a link. The rarest differences of a pivot's sets come first."""
    each = near.select("a", "b", F.explode("tokens").alias("token"))
    often = each.groupBy("b", "token").agg(F.count("*").alias("c"))
    order = each.join(often, ["b", "token"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("order"))
    rows = stage(near.drop("tokens").join(order, ["a", "b"]).select("a", "b", "far", "w", "slack", "t", F.posexplode(F.expr("slice(order.token, 1, int(take))")).alias("pos", "token")), "differing")
    left = rows.where("far").select("b", "token", F.col("a").alias("z"), "slack", (F.col("t") - F.col("pos")).alias("rest"))
    right = rows.select("b", "token", F.col("a").alias("y"), "far", "w", (F.col("t") - F.col("pos")).alias("left"))
    both = left.join(right, ["b", "token"]).where("z <> y and (not far or z > y)")
    return both.where((100 + percent) * F.least("rest", "left") >= F.col("slack") + F.col("w")).select("z", "y").distinct()


def represented(sets: DataFrame, cell: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (rid, doc_id, n, parity, sketch, cell), and (rid, n, band, score) of their min-hash bands that several have, both stored.

    A set's score is how many sets its bands are shared with. Its cell is that of its most shared band, which is cut into as many as hold about ``cell`` shingles each; a set that shares none is a cell of its own.
    """
    reps = stage(sets.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"), F.min("parity").alias("parity"), F.min("sketch").alias("sketch")), "sets-of-docs")
    banded = reps.select("rid", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1")
    banded = stage(banded.join(shared, "band"), "bands")
    facts = banded.groupBy("rid").agg(F.sum("c").alias("score"), F.max(F.struct("c", "band", "w")).alias("x"))
    alike = F.pmod(F.xxhash64("rid"), F.ceil(F.col("x.w") / cell))
    facts = stage(facts.select("rid", "score", F.xxhash64("x.band", alike).alias("cell")), "cells")
    out = stage(reps.join(facts.select("rid", "cell"), "rid", "left").select("rid", "doc_id", "n", "parity", "sketch", F.coalesce("cell", "rid").alias("cell")), "reps")
    near = stage(banded.select("rid", "n", "band").join(facts.select("rid", "score"), "rid"), "near")
    discard(reps, banded, facts)
    return out, near


def jaccard_join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id``, n_shingles, component_id for each row: the smallest doc_id reachable over links, itself included.

    Two rows link if 100 * |intersection| >= percent * |union| of their shingle sets; rows without words link with nothing, and
    neither do rows with a null id, whose component is null. Rows with equal ids are linked by their texts only.
    """
    docs = docs.select("doc_id", "text")
    profiled = stage(profile(docs), "profile")
    sets = profiled.where("rid is not null and doc_id is not null")
    reps, banded = represented(sets)
    bits = bucket_bits((reps.agg(F.sum("n")).first()[0] or 0) * 16 * (100 - percent) // 100)  # 16 bytes for each entry of the index
    like = lambda o, n, m: o * (100 + percent) >= (n + m) * percent

    # pivots
    heads = stage(banded.groupBy("band").agg(F.max(F.struct("score", "rid", "n")).alias("head")).select("band", F.col("head.rid").alias("b"), F.col("head.n").alias("m")), "heads")
    near = banded.join(heads, "band").where("rid <> b").where((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
    votes = near.groupBy("rid", "b").agg(F.count("*").alias("c"))
    tried = stage(votes.withColumn("k", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("c"), "b"))).where("k <= 2").select(F.col("rid").alias("a"), "b"), "tried")
    first = overlaps(docs, reps, tried)
    size = reps.select("rid", "n")
    sized = lambda df: df.join(size.withColumnsRenamed({"rid": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"rid": "b", "n": "nb"}), "b")
    known = stage(sized(first).where(like(F.col("o"), F.col("na"), F.col("nb"))), "known")
    best = stage(known.groupBy("a").agg(F.max(F.struct("o", "b", "nb")).alias("x"), F.max("na").alias("na")).select("a", "x.b", "x.o", "na", "x.nb"), "best")
    members = best.join(best.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("a").alias("rid"), F.col("b").alias("pivot"), (F.col("na") - F.col("o")).alias("plus"), (F.col("nb") - F.col("o")).alias("minus"))
    zero = F.lit(0).cast("long")
    # sets with the same kin are connected; that some connected ones have another is of no harm
    chain = best.select("a", "b").join(best.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left")
    kin = chain.select(F.col("a").alias("rid"), F.least("b", F.coalesce("c", "b")).alias("kin"))
    family = stage(size.join(members, "rid", "left").join(kin, "rid", "left").select("rid", "n", F.coalesce("kin", "rid").alias("kin"), F.coalesce("pivot", "rid").alias("pivot"), F.coalesce("plus", zero).alias("plus"), F.coalesce("minus", zero).alias("minus")), "family")
    discard(heads, tried, best, banded)

    # pairs of pivots, from the index
    entries = stage(index(docs, frequent(profiled), percent, bits), "entries")
    listed = entries.join(family.select("rid", "n", "pivot", "kin"), "rid")
    flat = listed.where("not long").select("s", "pos", "n", "pivot", "kin", F.lit(None).cast("binary").alias("parity"))
    listed = stage(flat.union(listed.where("long").join(reps.select("rid", "parity"), "rid").select("s", "pos", "n", "pivot", "kin", "parity")), "lists")
    met = stage(block_pairs(listed, percent, max(256, listed.count() // 20_000)), "block-pairs")
    discard(listed, entries)
    pairs = stage(possible(met, reps, family, percent), "possible-pairs")  # most have long texts in common parts only, and would send their sets far
    discard(met)
    second = overlaps(docs, reps, pairs)
    links = sized(second).where(like(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b")

    # members: derived from their pivots' answer, or verified where the bounds leave it open
    alike = sized(second).where(~like(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b", "o")
    reach = family.groupBy("pivot").agg(F.max("plus").alias("plus"), F.min("n").alias("n"), F.count("*").alias("c"))
    ra, rb = reach.withColumnsRenamed({"pivot": "a", "plus": "pa", "n": "la", "c": "ca"}), reach.withColumnsRenamed({"pivot": "b", "plus": "pb", "n": "lb", "c": "cb"})
    open_ = alike.join(ra, "a").join(rb, "b").where("pa + pb > 0").where(like(F.col("o") + F.col("pa") + F.col("pb"), F.col("la"), F.col("lb")))
    open_ = stage(open_.select("a", "b", "o", "ca", "cb"), "open")
    # a set alone against the members of a pivot: they link only if they differ from the pivot in common
    lone = open_.where("ca = 1").select("a", "b").union(open_.where("ca > 1 and cb = 1").select("b", "a"))
    about = lone.select("b").distinct()
    around = stage(lone.union(family.where("rid <> pivot").select(F.col("rid").alias("a"), F.col("pivot").alias("b")).join(about, "b", "left_semi").select("a", "b")), "around")
    near = differences(docs, reps, around, percent)
    kins = family.select("rid", "kin")
    shared = sharing(near, percent).join(kins.withColumnsRenamed({"rid": "z", "kin": "kz"}), "z").join(kins.withColumnsRenamed({"rid": "y", "kin": "ky"}), "y").where("kz <> ky").select("z", "y")
    open_ = open_.where("ca > 1 and cb > 1").select("a", "b", "o")
    side = lambda x, p: family.select(F.col("pivot").alias(p), F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("plus").alias(f"p{x}"), F.col("minus").alias(f"m{x}"), F.col("kin").alias(f"k{x}"))
    met = open_.join(side("z", "a"), "a").join(side("y", "b"), "b").where("(z <> a or y <> b) and kz <> ky")
    met = met.where(like(F.least(F.col("o") + F.col("pz") + F.col("py"), F.col("nz"), F.col("ny")), F.col("nz"), F.col("ny")))
    met = stage(met.select("z", "y", like(F.col("o") - F.col("mz") - F.col("my"), F.col("nz"), F.col("ny")).alias("sure")), "met")
    unsure = stage(met.where("not sure").select("z", "y").union(shared).select(F.greatest("z", "y").alias("a"), F.least("z", "y").alias("b")).distinct(), "unsure")
    third = overlaps(docs, reps, unsure)
    more = sized(third).where(like(F.col("o"), F.col("na"), F.col("nb"))).select("a", "b")

    edges = known.select("a", "b").union(links).union(met.where("sure").select("z", "y")).union(more)
    classes = components(edges)
    roots = reps.select("rid", "doc_id").join(classes.withColumnRenamed("id", "rid"), "rid", "left").withColumn("c", F.coalesce("component_id", "rid"))
    least = stage(roots.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    answer = stage(roots.select("rid", "c").join(least, "c").select("rid", "component_id"), "classes")
    discard(first, second, third, known, family, met, least, pairs, unsure, classes, reps, around, near)
    out = profiled.select("doc_id", "n_shingles", "rid").join(answer, "rid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, most: int = 2_000_000) -> DataFrame:
    """``docs`` without those linked to a document with a smaller doc_id. Rows with a null id, and rows without words, stay."""
    gone = stage(jaccard_join(docs, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= most  # some 32 MB
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
