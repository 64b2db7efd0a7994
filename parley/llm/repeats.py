"""Removal of repeated passages through a sparse enhanced suffix array.

Every string of ``LENGTH`` bytes holds at least one anchor: the start of the 19-byte gram with the least hash among its grams, which
depends on the string alone. Suffixes are sorted at anchors only, and only at those whose gram several documents share, so
the array holds little more than the repeats; it is dealt out by gram. In each part the suffixes of a gram are sorted, a stack scan over their common
prefixes yields the intervals of the common-prefix tree, and the occurrences in an interval are parted by what stands to their left:
those that share enough of it are one repeat group, maximal if they can't all be extended by one more byte to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bucket_bits, discard, mix64, small_batches, stage, tidy, unpack

LENGTH, GRAM = 50, 19
WINDOW = LENGTH - GRAM + 1  # 32 grams
LEFT = WINDOW - 1
CONTEXT = LEFT + LENGTH
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LETTERS = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P = np.uint64(0x9E3779B97F4A7C15)
REMOVALS = "n_bytes long, n_removed long, n_spans long"
#: Bytes of grams in a bucket, and occurrences that are grouped at once: what a task holds doesn't grow with the input.
BUCKET, SLICE = 2 << 20, 1 << 15


def _slide(x: np.ndarray, of) -> np.ndarray:
    """Minimum or maximum over each run of WINDOW."""
    for step in (1, 2, 4, 8, 16):
        x = of(x[:-step], x[step:])
    return x


def anchors(held: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of texts that lie one after another in ``held``."""
    n = len(held)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = LETTERS[held]
    two = one[:-1] * P + one[1:]
    four = two[:-2] * P + two[2:]
    eight = four[:-4] * P + four[4:]
    full = eight[:-8] * P + eight[8:]
    h = np.full(n, NONE)
    h[: n - GRAM + 1] = mix64((full[: n - GRAM + 1] * P + two[16 : n - 1][: n - GRAM + 1]) * P + one[18:])
    low = np.zeros(n, dtype=np.uint64)
    for end in ends:  # no gram or window crosses the end of a text
        h[max(0, end - GRAM + 1) : end] = NONE
    low[: n - LEFT] = _slide(h, np.minimum)
    for end in ends:
        low[max(0, end - LENGTH + 1) : end] = 0
    high = _slide(np.concatenate([np.zeros(LEFT, np.uint64), low]), np.maximum)
    at = np.flatnonzero((high == h) & (h != NONE))
    return at, mix64(h[at] + P)  # least hashes are small: mixed again, they fill all buckets


def _chunks(frames, least: int = 1 << 18):
    """(ids, starts and ends of the texts, their bytes) of about a quarter of a megabyte of texts with an id; a byte takes some hundred while its grams are hashed."""
    for table in batches(frames, least, "body"):
        table = table.combine_chunks()
        texts = [t if t else b"" for t in table.column("body").to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        # short texts hold no string of the length; equal neighbours would blur the ends
        yield table.column("doc_id").to_numpy(), starts, ends, np.frombuffer(b"".join(texts), dtype=np.uint8)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def shared_grams(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each bucket (the leading ``bits``, 8 or more, of a hash) with the packed hashes (56 bits) of the anchors' grams that more than one document has."""

    def send(hashes, which):
        order = np.lexsort((which, hashes))
        hashes, which = hashes[order], which[order]
        fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (which[1:] != which[:-1]))
        some, times = np.unique(hashes[fresh], return_counts=True)
        edges = np.searchsorted(_bucket(some, bits), np.arange((1 << bits) + 1))
        short = np.ascontiguousarray(some.view(np.uint8).reshape(-1, 8)[:, 1:7])
        many = times > 1
        full = np.flatnonzero(np.diff(edges)).tolist()
        cut = [slice(edges[b], edges[b + 1]) for b in full]
        columns = [pa.array([short[c][~many[c]].tobytes() for c in cut], pa.binary()), pa.array([short[c][many[c]].tobytes() for c in cut], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], ["bucket", "once", "more"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0
        for ids, starts, ends, body in _chunks(frames):
            at, h = anchors(body, ends)
            held.append((h, np.searchsorted(ends, at, side="right") + count))
            count, size = count + len(ids), size + len(body)
            if size > 8 << 20:
                yield send(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield send(*(np.concatenate(c) for c in zip(*held)))

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()

        def wide(short):
            out = np.zeros((len(short) // 6, 8), dtype=np.uint8)
            out[:, 1:7], out[:, 7] = short.reshape(-1, 6), bucket >> (bits - 8)
            return out.view(np.uint64).ravel()

        once, more = wide(unpack(table.column("once"), np.uint8)), wide(unpack(table.column("more"), np.uint8))
        some, times = np.unique(np.concatenate([once, more, more]), return_counts=True)
        return pa.table([pa.array([bucket], pa.int32()), pa.array([some[times > 1].tobytes()], pa.binary())], names=["bucket", "grams"])

    packed = docs.mapInArrow(tidy(run), "bucket int, once binary, more binary")
    return stage(packed.groupBy("bucket").applyInArrow(meet, "bucket int, grams binary"), "grams")


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(h >> np.uint64(8))
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def gram_filter(grams: DataFrame, bits: int, most_bits: int = 1 << 28) -> tuple[int, np.ndarray]:
    """A filter that has all shared grams, in segments by bucket that tasks make. Its 32 MB at most bound what is broadcast; a fuller one only lets more others through."""
    total = grams.agg(F.sum(F.length("grams"))).first()[0] or 0
    buckets = 1 << bits
    size = 1 << min((most_bits // buckets).bit_length() - 1, max(6, (total * 2 // buckets).bit_length()))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for grams in frame.column("grams").to_pylist():
                flags = np.zeros(size, dtype=bool)
                for at in _bits(np.frombuffer(grams, np.uint64), size):
                    flags[at] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([frame.column("bucket"), pa.array(out, pa.binary())], ["bucket", "held"])

    parts = {r["bucket"]: bytes(r["held"]) for r in grams.mapInArrow(run, "bucket int, held binary").collect()}
    return size, np.frombuffer(b"".join(parts.get(b, bytes(size // 8)) for b in range(buckets)), dtype=np.uint8)


def _merge(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each id."""
    if not len(ids):
        return ids, start, end
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    _, group = np.unique(ids, return_inverse=True)
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(end + group * wide)
    fresh = np.append(True, (start + group * wide)[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], start[first], reach[last] - group[last] * wide


SPANS = "bucket int, doc_id long, start long, end long, hash binary, docs binary, places binary, sides binary, context binary"


def occurrences(docs: DataFrame, filtered: tuple[int, np.ndarray], bits: int) -> DataFrame:
    """Anchors that the filter has. Of equal contexts in a batch, only the smallest document's are sent on, packed by bucket; the others are already known to
    repeat, and give spans (bucket -1)."""
    share = docs.sparkSession.sparkContext.broadcast(filtered)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
    names = [c.split()[0] for c in SPANS.split(", ")]

    def send(h, doc, place, left, right, context):
        key = _row_hash(context, h, left, right)
        some, back = np.unique(key, return_inverse=True)
        least = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(least, back, doc)
        again = (doc > least[back]) & (left + right >= LENGTH)
        ids, start, end = _merge(doc[again], (place - left)[again], (place + right)[again])
        empty = pa.nulls(len(ids), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), -1, np.int32)), pa.array(ids), pa.array(start), pa.array(end), *[empty] * 5], names)
        keep = ~again
        h, doc, place, context = h[keep], doc[keep], place[keep], context[keep]
        sides = np.column_stack([left[keep], right[keep]]).astype(np.uint8)
        order = np.argsort(h, kind="stable")
        edges = np.searchsorted(_bucket(h[order], bits), np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        cut = lambda a: pa.array([a[order[edges[b] : edges[b + 1]]].tobytes() for b in full], pa.binary())
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), none, none, none, cut(h), cut(doc), cut(place), cut(sides), cut(context)], names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, flags = share.value
        held, count = [], 0
        for ids, starts, ends, body in _chunks(frames):
            at, h = anchors(body, ends)
            inside = np.ones(len(at), dtype=bool)
            base = _bucket(h, bits) * size
            for bit in _bits(h >> np.uint64(8) << np.uint64(8), size):
                bit = base + bit
                inside &= flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            at, h = at[inside], h[inside]
            which = np.searchsorted(ends, at, side="right")
            left, right = np.minimum(at - starts[which], LEFT), np.minimum(ends[which] - at, LENGTH)
            padded = np.concatenate([np.zeros(LEFT, np.uint8), body, np.zeros(LENGTH, np.uint8)])
            context = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at].copy()
            # beyond the text's own ends there is nothing
            for i in np.flatnonzero((left < LEFT) | (right < LENGTH)):
                context[i, : LEFT - left[i]] = 0
                context[i, LEFT + right[i] :] = 0
            held.append((h, ids[which].astype(np.int64), at - starts[which], left, right, context))
            count += len(at)
            if count > 60_000:
                yield from send(*(np.concatenate(c) for c in zip(*held)))
                held, count = [], 0
        if held:
            yield from send(*(np.concatenate(c) for c in zip(*held)))

    return stage(docs.mapInArrow(tidy(run), SPANS), "occurrences")


def _row_hash(context: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix and of aligned numbers."""
    wide = np.zeros((len(context), -(-context.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : context.shape[1]] = context
    out = np.zeros(len(context), dtype=np.uint64)
    for column in (*wide.view(np.uint64).T, *(m.astype(np.uint64) for m in more)):
        out = mix64(out * P + column)
    return out


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(common prefix, its parent's, first, last) of every interval of a suffix array, from the common prefixes of neighbours (lcp[0] = 0): a stack scan."""
    out, stack = [], [(0, 0)]
    values = lcp.tolist() + [0]
    for i in range(1, len(values)):
        low, value = i - 1, values[i]
        while stack[-1][0] > value:
            top, low = stack.pop()
            out.append((top, max(value, stack[-1][0]), low, i - 1))
        if value > stack[-1][0]:
            stack.append((value, low))
    return out


def repeat_groups(h: np.ndarray, doc: np.ndarray, place: np.ndarray, sides: np.ndarray, context: np.ndarray) -> Iterator[tuple]:
    """Repeat groups among the occurrences of a part: for each length t of what must be shared to the left, (t, order, group, maximal).

    ``order`` sorts the occurrences, and ``group`` numbers, in that order, those that share the bytes from t before the anchor to LENGTH - t after it (-1: alone in its
    interval). ``maximal``: flags by group, whether the bytes one further left differ (or a text begins).
    """
    wide = np.zeros((len(h), -(-LENGTH // 8) * 8), dtype=np.uint8)
    wide[:, :LENGTH] = context[:, LEFT:]
    order = np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], h))
    del wide
    h, doc, sides, context = h[order], doc[order], sides[order].astype(np.int64), context[order]
    right = context[:, LEFT:]
    differ = right[1:] != right[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    lcp = np.minimum(lcp, np.minimum(sides[1:, 1], sides[:-1, 1]))
    lcp = np.where(h[1:] == h[:-1], lcp, 0)
    del differ
    node = np.full((LEFT + 1, len(h)), -1, dtype=np.int32)
    for number, (prefix, parent, first, last) in enumerate(intervals(np.append(0, lcp))):
        # for these lengths to the left, this interval and not a larger one is what shares enough to the right
        node[max(0, LENGTH - prefix) : max(0, LENGTH - parent), first : last + 1] = number
    lefts = np.zeros(len(h), dtype=np.uint64)
    for t in range(LEFT + 1):
        if t:
            lefts = mix64(lefts * P + context[:, LEFT - t].astype(np.uint64) + np.uint64(1))
        found = np.flatnonzero((node[t] >= 0) & (sides[:, 0] >= t))
        if not len(found):
            continue
        some, back = np.unique(mix64(lefts[found] + node[t][found].astype(np.uint64) * P), return_inverse=True)
        group = np.full(len(h), -1, dtype=np.int64)
        group[found] = back
        before = np.where(sides[found, 0] > t, context[found, max(0, LEFT - t - 1)].astype(np.int64), -1 - np.arange(len(found)))
        low, high = np.full(len(some), 1 << 62), np.full(len(some), -(1 << 62))
        np.minimum.at(low, back, before)
        np.maximum.at(high, back, before)
        yield t, order, group, low != high


class Spans:
    """Spans (ids, start, end) as their unions: those added since are merged when they are many, so that no more than the unions and ``most`` others are held."""

    def __init__(self, most: int):
        self.held, self.fresh, self.most = [(np.zeros(0, np.int64),) * 3], 0, most

    def add(self, *spans: np.ndarray) -> None:
        self.held.append(spans)
        self.fresh += len(spans[0])
        if self.fresh > max(self.most, len(self.held[0][0])):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.held, self.fresh = [_merge(*(np.concatenate(c) for c in zip(*self.held)))], 0
        return self.held[0]


def slices(h: np.ndarray, most: int = SLICE) -> Iterator[np.ndarray]:
    """Places in ``h`` of the values that occur more than once: all of a value are in one slice, of ``most`` or of one value."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(h)))
    order, ends = order[np.repeat(sizes > 1, sizes)], np.cumsum(sizes[sizes > 1])
    at = 0
    while at < len(order):
        to = int(ends[max(np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + most, side="right") - 1)])
        yield order[at:to]
        at = to


def repeated_spans(found: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, start, end) of the bytes that repeat a smaller document's, from ``occurrences``."""

    def run(table: pa.Table) -> pa.Table:
        h, doc, place = unpack(table.column("hash"), np.uint64), unpack(table.column("docs"), np.int64), unpack(table.column("places"), np.int64)
        sides, context = unpack(table.column("sides"), np.uint8).reshape(-1, 2), unpack(table.column("context"), np.uint8).reshape(-1, CONTEXT)
        out = Spans(4 * SLICE)
        for part in slices(h):
            for t, order, group, _ in repeat_groups(h[part], doc[part], place[part], sides[part], context[part]):
                own, at = doc[part[order]], place[part[order]]
                inside = group >= 0
                least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group[inside], own[inside])
                again = inside & (own > least[group])
                out.add(own[again], at[again] - t, at[again] - t + LENGTH)
        ids, start, end = out.merged()
        return pa.table([pa.array(ids), pa.array(start), pa.array(end)], names=["doc_id", "start", "end"])

    parts = found.where("bucket >= 0").select("bucket", "hash", "docs", "places", "sides", "context")
    spans = parts.groupBy("bucket").applyInArrow(run, "doc_id long, start long, end long")
    every = spans.union(found.where("bucket < 0").select("doc_id", "start", "end"))

    def unite(table: pa.Table) -> pa.Table:
        ids, start, end = _merge(*(table.column(c).to_numpy() for c in ("doc_id", "start", "end")))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
        pairs = np.split(np.column_stack([start, end]).astype("<i8"), first[1:]) if len(ids) else []
        return pa.table([pa.array(ids[first]), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["doc_id", "spans"])

    return every.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("part").applyInArrow(unite, "doc_id long, spans binary")


def removals(docs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(doc_id, __spans, __copy), stored: for each document that loses something, its packed spans, or that it is a whole copy."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")).where("doc_id is not null")
    marked = stage(slim.select("doc_id", F.length("body").alias("n"), F.sha2("body", 256).alias("sha")), "shas")
    bits = bucket_bits((marked.agg(F.sum("n")).first()[0] or 0) * 3 // 8, BUCKET)  # 6 bytes for each of the grams, of which there is one in 16 bytes
    firsts = stage(marked.where(F.col("n") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha", "first"), "firsts")
    copies = stage(marked.join(firsts, "sha").where("doc_id > first").select("doc_id").distinct(), "copies")
    discard(marked, firsts)
    few = copies.count() <= most  # some 32 MB
    searched = slim.join((F.broadcast if few else (lambda df: df))(copies), "doc_id", "left_anti").where(F.length("body") >= LENGTH)
    grams = shared_grams(searched, bits)
    found = occurrences(searched, gram_filter(grams, bits), bits)
    spans = stage(repeated_spans(found, max(64, found.count() // 5_000)), "spans")
    discard(grams, found)
    every = spans.select("doc_id", "spans").union(copies.select("doc_id", F.lit(None).cast("binary")))
    out = stage(every.groupBy("doc_id").agg(F.max("spans").alias("__spans"), F.max(F.col("spans").isNull()).alias("__copy")), "removals")
    discard(copies, spans)
    return out


def _schema(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _cut(docs: DataFrame, kept: list, as_text: bool) -> DataFrame:
    """The fields ``kept`` of ``docs``, with text cut in place, or with body (what is left, as bytes) and the counts of what went. Only these and the text reach Python, in batches of a few MB."""
    kinds = [*([] if as_text else [pa.binary()]), pa.int64(), pa.int64(), pa.int64()]
    names = [f.name for f in kept]
    own = [*([] if as_text else ["body"]), *(c.split()[0] for c in REMOVALS.split(", "))]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, 4 << 20):
            rows = []
            for text, packed, copy in zip(*(table.column(c).to_pylist() for c in ("text", "__spans", "__copy"))):
                body = text.encode() if text else b""
                spans = np.frombuffer(packed, "<i8").reshape(-1, 2).tolist() if packed else [[0, len(body)]] if copy else []
                parts, at = [], 0
                for start, end in spans:
                    parts.append(body[at:start])
                    at = end
                rest = b"".join([*parts, body[at:]]) if spans else body
                left = rest if not as_text else None if text is None else rest.decode("utf-8", "ignore") if spans else text
                rows.append((left, len(body), len(body) - len(rest), len(spans)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds, as_text)]
            texts = [pa.array([r[0] for r in rows], pa.string())] if as_text else []
            held = [texts[0] if texts and n == "text" else table.column(n).combine_chunks() for n in names]
            yield from pa.table(held + columns, names=names + own).to_batches()

    joined = docs.select(*dict.fromkeys([*names, "doc_id", "text"])).join(removals(docs), "doc_id", "left")
    schema = f"{_schema(kept)}, {'' if as_text else 'body binary, '}{REMOVALS}"
    return joined.mapInArrow(tidy(run), schema)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (those named in ``keep``, or all) with body (the kept bytes), n_bytes, n_removed and n_spans.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Texts are their UTF-8 bytes, null texts empty. Whole copies of
    a smaller document are told first, by length and SHA-256, and take no part in the search. Rows with a null doc_id keep all and remove
    nothing from others. A doc_id stands for one text: repeated rows remove nothing from each other. Other columns pass through; those named like the results are replaced,
    and names that begin with two underscores are reserved.
    """
    own = {"body", "n_bytes", "n_removed", "n_spans"}
    kept = [f for f in docs.schema.fields if f.name not in own and (keep is None or f.name in keep)]
    return _cut(docs, kept, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes gone from text (null stays null; a character that lost some of its bytes goes), and n_chars made anew where it is a column."""
    own = [c.split()[0] for c in REMOVALS.split(", ")]
    inner = [f"__{c}" if c in own else c for c in docs.columns]
    renamed = docs.toDF(*inner)
    out = _cut(renamed, renamed.schema.fields, True).select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("body", 256).alias("kept_sha256"))
