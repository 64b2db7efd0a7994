"""Language-model scoring with n-gram counts in a log-frequency Bloom filter.

All bigrams of the training documents are kept with their count quantised to levels; a bigram of level q is put
into the filter once for each level 1..q, and its count is read back by probing level after level until one is missing.
The filter is built in segments by hash, each by one task; its size follows from its entries. It is broadcast up to a bound;
a larger one stays in its segments, and the bigrams of the texts, distinct in a unit of some megabytes, are dealt to them; a unit takes back their levels. Unigram counts are exact: the most frequent words, as many as a bound allows, are
broadcast, and all others are joined, so the bound changes no score.

P(w | v) = (q(v w) + m P(w)) / (c(v) + m + f V): q is the mean count of the level that the filter tells for the bigram, at most c(v) and c(w); m is the mean number of different words
after a word; f is the share of absent bigrams that the filter has by mistake, and V the number of words, so f V is what false hits add over the vocabulary. The sum over all words is therefore 1 in expectation,
and off by no more than the levels are coarse. P(w) is c(w) / (N + n1 + 1) for words seen; what is left is spread evenly over one more unseen word than there are
n1 words seen once. After a word never seen, P(w | v) = P(w).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bucket_bits, discard, fold, mix64, release, small_batches, stage, unpack, word_hashes

#: The counts at which levels begin.
LEVELS = np.unique((1.5 ** np.arange(60)).astype(np.int64))
PROBES = 8
#: Bytes of text whose bigrams are dealt at once to the segments of a filter, and of keys in a segment.
UNIT, BUCKET = 4 << 20, 16 << 20
END = np.uint64(0x9E3779B97F4A7C00)
TOP = np.uint64(56)


def bigram_keys(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """The keys of the bigrams that the tokens of texts end."""
    return bigram_keys(hashes, np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes)


def token_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (the upper 56 bits) of the words of all texts, each text closed by the end, and the number of tokens of each."""
    words, sizes = word_hashes(texts)
    out = np.full(len(words) + len(texts), END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)] = words >> np.uint64(8) << np.uint64(8)
    return out, sizes + 1


def _edges(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


def _parts(keys: np.ndarray, counts: np.ndarray, kind: int, bits: int) -> list[tuple]:
    """Rows (kind, bucket, keys seen once, keys seen more often, their counts) of sorted keys; a bucket is a key's leading ``bits``, 8 or more."""
    edges = np.searchsorted(keys, _edges(bits))
    out = []
    for bucket, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges))):
        if len(k):
            # the top byte is the bucket's; of the others the lowest is dropped: 56 bits tell keys apart
            out.append((kind, bucket, _short(k[c == 1]), k[c > 1].tobytes(), c[c > 1].astype("<i8").tobytes()))
    return out


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(short: bytes, bucket: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(short) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(short, dtype=np.uint8).reshape(-1, 6)
    return (wide.view(np.uint64).ravel() << np.uint64(8)) + (np.uint64(bucket >> (bits - 8)) << TOP)


KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
PACKED = "kind int, bucket int, once binary, keys binary, counts binary"


def counted(train: DataFrame, bits: int) -> DataFrame:
    """Exact counts of the words (kind 0) and of the bigrams (kind 1): a row for each kind and bucket, with packed keys and counts.

    Batches are counted before the exchange, so a frequent n-gram is one entry of a batch. Keys are the upper 56 bits of 64-bit hashes.
    """
    names = [c.split()[0] for c in PACKED.split(", ")]

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, 8 << 20):
            tokens, _ = token_hashes(table.column("text").to_pylist())
            before = np.concatenate([[END], tokens[:-1]])
            rows = []
            for kind, keys in enumerate((tokens, bigram_keys(tokens, before))):
                rows += _parts(*np.unique(keys, return_counts=True), kind, bits)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names)

    def total(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        once = _long(b"".join(table.column("once").to_pylist()), bucket, bits)
        more = (unpack(table.column("keys"), np.uint64) >> np.uint64(8)) << np.uint64(8)
        keys, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        counts = np.bincount(at[: len(once)], minlength=len(keys)) + np.bincount(at[len(once) :], unpack(table.column("counts"), "<i8"), len(keys)).astype(np.int64)
        row = (kind, bucket, _short(keys[counts == 1]), keys[counts > 1].tobytes(), counts[counts > 1].astype("<i8").tobytes())
        return pa.table([pa.array([v], k) for v, k in zip(row, KINDS)], names=names)

    packed = train.select("text").mapInArrow(count, PACKED)
    return stage(packed.groupBy("kind", "bucket").applyInArrow(total, PACKED), "ngrams", shuffles_go=True)


def entries(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a packed row."""
    once = _long(row["once"], row["bucket"], bits)
    return np.concatenate([once, np.frombuffer(row["keys"], np.uint64)]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(row["counts"], "<i8")])


def unpacked(counts: DataFrame, bits: int) -> DataFrame:
    """Word counts as rows (key long, n long)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                keys, n = entries(frame.slice(i, 1).to_pylist()[0], bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return counts.where("kind = 0").mapInArrow(run, "key long, n long")


@dataclass
class Filter:
    """A log-frequency Bloom filter in segments by the keys' leading bits."""

    bits: np.ndarray  # of each segment
    starts: np.ndarray  # byte offsets
    held: np.ndarray  # uint8
    lead: int  # leading bits of a key that number its segment

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it isn't there. Sorted keys meet the segments one after another."""
        out = np.zeros(len(keys), dtype=np.int8)
        left = np.arange(len(keys))
        keys = keys >> np.uint64(8) << np.uint64(8)
        for level in range(1, len(LEVELS) + 1):
            k = keys[left]
            segment = (k >> np.uint64(64 - self.lead)).astype(np.int64)
            inside = np.arange(len(k))
            h, step = hashes(k, level)
            for i in range(PROBES):  # those that miss a probe are not probed again
                s = segment[inside]
                at = place(h[inside], step[inside], i, self.bits[s])
                inside = inside[self.held[self.starts[s] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 == 1]
            left = left[inside]
            if not len(left):
                break
            out[left] = level
        return out


def hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys + np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return h, mix64(h) | np.uint64(1)


def place(h: np.ndarray, step: np.ndarray, probe: int, bits: np.ndarray) -> np.ndarray:
    """The bit of a probe; a segment has fewer than 2^32."""
    return ((((h + np.uint64(probe) * step) >> np.uint64(32)) * bits.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The bytes of a segment that holds these keys, and the share of absent keys that it has by mistake."""
    level = np.searchsorted(LEVELS, counts, side="right")
    size = max(8, ceil(level.sum() * PROBES / log(2) / 8))
    flags = np.zeros(8 * size, dtype=bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        h, step = hashes(keys[level >= q], q)
        for probe in range(PROBES):
            flags[place(h, step, probe, np.array([8 * size]))] = True
    return np.packbits(flags, bitorder="little"), float(flags.mean() ** PROBES)


def by_level(counts: DataFrame, bits: int) -> dict[int, tuple[int, int]]:
    """How many bigrams there are of each level, and how often they were seen in all."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            total = np.zeros((2, len(LEVELS) + 1))
            for i in range(frame.num_rows):
                n = entries(frame.slice(i, 1).to_pylist()[0], bits)[1]
                level = np.searchsorted(LEVELS, n, side="right")
                total += np.bincount(level, minlength=len(LEVELS) + 1), np.bincount(level, n, len(LEVELS) + 1)
            found = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[0][found].astype(np.int64)), pa.array(total[1][found].astype(np.int64))], ["level", "bigrams", "seen"])

    rows = counts.where("kind = 1").select("bucket", "once", "keys", "counts").mapInArrow(run, "level long, bigrams long, seen long")
    return {r["level"]: (r["b"], r["s"]) for r in rows.groupBy("level").agg(F.sum("bigrams").alias("b"), F.sum("seen").alias("s")).collect()}


def build_filter(counts: DataFrame, bits: int, total: int, most_bytes: int) -> tuple[Filter | None, DataFrame | None, float]:
    """The filter of ``total`` entries, joined by the driver, if it has at most ``most_bytes``, else its segments (bucket, held); and its share of false hits. Each task makes the segments of its rows."""

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                row = frame.slice(i, 1).to_pylist()[0]
                held, wrong = segment(*entries(row, bits))
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([held.tobytes()], pa.binary()), pa.array([wrong])], ["bucket", "held", "wrong"])
        release()

    built = counts.where("kind = 1").select("bucket", "once", "keys", "counts").mapInArrow(build, "bucket int, held binary, wrong double")
    if total * PROBES / log(2) / 8 > most_bytes:
        built = stage(built, "filter")
        return None, built.select("bucket", "held"), built.agg(F.avg("wrong")).first()[0]
    got = built.toArrow()
    sizes = np.full(1 << bits, 8)
    at = got.column("bucket").to_numpy()
    sizes[at] = [len(x) for c in got.column("held").chunks for x in c.cast(pa.large_binary()).to_numpy(zero_copy_only=False)] if len(at) else []
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    held = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for b, x in zip(at, (x for c in got.column("held").chunks for x in c)):
        held[starts[b] : starts[b] + sizes[b]] = np.frombuffer(x.as_buffer(), np.uint8)
    return Filter(8 * sizes, starts, held, bits), None, float(np.mean(got.column("wrong").to_numpy())) if len(at) else 0.0


def distinct_bigrams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (their upper 56 bits) of the bigrams that tokens end, sorted, each once: the order in which levels are told. And the place of each token's among them."""
    some, back = np.unique(bigrams(hashes) >> np.uint64(8), return_inverse=True)
    return some << np.uint64(8), back


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys of a bucket: the steps between their lower 48 bits, byte plane by byte plane, as high bytes of small steps compress well."""
    steps = np.diff((keys >> np.uint64(8)) & np.uint64((1 << 48) - 1), prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T), codec="zstd", asbytes=True)


def unsqueezed(packed: bytes, n: int, bucket: int, bits: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(pa.decompress(packed, 6 * n, codec="zstd"), np.uint8).reshape(6, n).T
    return (np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(8)) + (np.uint64(bucket >> (bits - 8)) << TOP)


def dealt_levels(units: DataFrame, model: Model) -> DataFrame:
    """(__unit, bucket, levels): for each unit of ``units`` (__unit, text) and segment of the filter that holds anything, the levels of the unit's distinct bigrams there, in their order.

    Keys are dealt to the filter's segments, each of which meets them in parts of some 64 MB; what comes back are levels without keys, as the unit's text tells these again.
    """
    lead = model.lead
    parts = max(1, ceil(model.n * 8 / (1 << lead) / (64 << 20)))

    def deal(table: pa.Table) -> pa.Table:
        unit = table.column("__unit")[0].as_py()
        keys = np.unique(bigrams(token_hashes(table.column("text").to_pylist())[0]) >> np.uint64(8)) << np.uint64(8)
        rows = [(unit, b, unit % parts, len(x), squeezed(x)) for b, x in enumerate(np.split(keys, np.searchsorted(keys, _edges(lead)))) if len(x)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        out = pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["__unit", "bucket", "part", "n", "keys"])
        release()
        return out

    def probe(sent: pa.Table, segment: pa.Table) -> pa.Table:
        out = []
        if sent.num_rows and segment.num_rows:
            bucket, held = segment.column("bucket")[0].as_py(), np.frombuffer(segment.column("held")[0].as_py(), np.uint8)
            one = Filter(np.full(1 << lead, 8 * len(held)), np.zeros(1 << lead, np.int64), held, lead)
            for some in sent.to_batches(max_chunksize=64):  # a probe of few keys costs as much as one of many
                sizes = np.asarray(some.column("n"))
                keys = np.concatenate([unsqueezed(x, n, bucket, lead) for x, n in zip(some.column("keys").to_pylist(), sizes)])
                levels = np.split(one.levels(keys), np.cumsum(sizes)[:-1])
                out += [(unit, bucket, pa.compress(x, codec="zstd", asbytes=True)) for unit, x in zip(some.column("__unit").to_pylist(), levels)]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["__unit", "bucket", "levels"])

    sent = units.groupBy("__unit").applyInArrow(deal, "__unit long, bucket int, part int, n int, keys binary")
    segments = model.segments.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return sent.groupBy("bucket", "part").cogroup(segments.groupBy("bucket", "part")).applyInArrow(probe, "__unit long, bucket int, levels binary")


@dataclass
class Model:
    heads: np.ndarray  # hashes of the frequent words, sorted
    counts: np.ndarray
    n: int  # tokens
    v: int  # words
    n1: int  # words seen once
    lead: int  # leading bits of a bigram's key that number its segment
    mean: np.ndarray  # mean count of the bigrams of each level; 0 for level 0
    after: float  # mean number of different words after a word
    filter: Filter | None = None  # none if it is in segments
    segments: DataFrame | None = None  # (bucket, held)
    wrong: float = 0.0  # share of absent bigrams that the filter has

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the frequent words, or -1."""
        some, back = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.heads, some)
        return np.where(np.append(self.heads, np.uint64(1))[at] == some, at, -1)[back]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(count, 1) / (self.n + self.n1 + 1)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """For each token, the level of the bigram that it ends."""
        some, back = np.unique(bigrams(hashes), return_inverse=True)
        return self.filter.levels(some)[back]

    def probability(self, cw: np.ndarray, cv: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Of words seen ``cw`` times after words seen ``cv`` times, whose bigrams have a level."""
        seen = np.minimum(self.mean[level], np.minimum(cv, cw))
        both = (seen + self.after * self.unigram(cw)) / (cv + self.after + self.wrong * self.v)
        return np.where(cv > 0, both, self.unigram(cw))


def fit(train: DataFrame, most_words: int = 1_000_000, most_bytes: int = 128 << 20) -> tuple[Model, DataFrame]:
    """The model, and the counts (key, n) of the words that are not broadcast. At most ``most_words`` words are, and a filter of at most ``most_bytes``."""
    small_batches(train.sparkSession)
    lead = bucket_bits(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET)  # about a byte of keys for a byte of text
    counts = counted(train, lead)
    words = stage(unpacked(counts, lead), "words")
    spread = sorted((r["n"], r["count"]) for r in words.groupBy("n").count().collect())
    least, held = 1 << 62, 0
    for n, c in reversed(spread):
        if held + c > most_words:
            break
        least, held = n, held + c
    heads = words.where(F.col("n") >= least).toArrow()
    keys, n = (heads.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys.view(np.uint64))
    levels = by_level(counts, lead)
    mean = np.append(0.0, LEVELS)  # a level without bigrams can be read by mistake
    for q, (bigrams, seen) in levels.items():
        mean[q] = seen / bigrams
    v = sum(c for _, c in spread)
    model = Model(keys.view(np.uint64)[order].copy(), n[order], sum(n * c for n, c in spread), v, dict(spread).get(1, 0), lead, mean, sum(b for b, _ in levels.values()) / max(1, v))
    model.filter, model.segments, model.wrong = build_filter(counts, lead, sum(q * b for q, (b, _) in levels.items()), most_bytes)
    discard(counts)  # more than the text of a word or two for each bigram
    return model, words.where(F.col("n") < least)


def score(docs: DataFrame, model: Model, rare: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys`` with n_tokens, n_known, train_tokens, base_score and score of each row's whole text (null: empty). Repeated rows keep a row each.

    Words that aren't broadcast are looked up by a join on their hash, once for each document and word. Tokens that need none are scored at once; of the others, a count is
    held as it is, or as -1 - its place among the document's words that are looked up.
    """
    share = docs.sparkSession.sparkContext.broadcast(replace(model, segments=None))
    lead = model.lead
    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "n_tokens", "n_known", "base_score", "score", "rest", "times", "word", "before", "level"]
    bottom = model.n + model.v + 1

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))

    def looked_up(frames: Iterator[pa.RecordBatch], levels: Callable, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
        model = share.value
        for table in batches(frames, limit):
            hashes, sizes = token_hashes(table.column("text").to_pylist())
            rows, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            at = model.places(hashes)
            held = at >= 0
            base = np.bincount(row[held], np.log10((model.counts[at[held]] + 1) / bottom), rows).astype(float)  # of nothing it counts integers
            word = np.append(model.counts, 0)[at]
            # the rare words of each document, in order, and the place of each in it
            order = np.flatnonzero(~held)
            order = order[np.lexsort((hashes[order], row[order]))]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
            firsts = order[fresh]
            number = np.bincount(row[firsts], minlength=rows)
            index = np.cumsum(fresh) - 1
            word[order] = -1 - (index - (np.cumsum(number) - number)[row[order]])
            times = np.bincount(index, minlength=len(firsts))
            # the first word of a text follows the end, by which each text is closed
            starts = np.cumsum(sizes) - sizes
            before = np.concatenate([word[:1], word[:-1]])
            before[starts] = word[np.cumsum(sizes) - 1]
            level = levels(hashes)
            local = (before >= 0) & (word >= 0)
            logs = np.bincount(row[local], np.log10(model.probability(word[local], before[local], level[local])), rows).astype(float)
            open_ = np.bincount(row[~local], minlength=rows)
            columns = [table.column(k).combine_chunks() for k in keys] + [
                pa.array(sizes), pa.array(np.bincount(row[held], minlength=rows)), pa.array(base), pa.array(logs),
                lists(hashes[firsts].view(np.int64), number), lists(times, number), lists(word[~local], open_), lists(before[~local], open_), lists(level[~local].astype(np.int16), open_),
            ]
            yield from pa.table(columns, names=names).to_batches()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from looked_up(frames, share.value.levels)

    def run_unit(table: pa.Table, told: pa.Table) -> pa.Table:
        def levels(hashes):
            keys, back = distinct_bigrams(hashes)
            edges = np.concatenate([[0], np.searchsorted(keys, _edges(lead)), [len(keys)]])
            level = np.zeros(len(keys), np.int8)
            for bucket, packed in zip(told.column("bucket").to_pylist(), told.column("levels").to_pylist()):
                n = int(edges[bucket + 1] - edges[bucket])
                level[edges[bucket] : edges[bucket + 1]] = np.frombuffer(pa.decompress(packed, n, codec="zstd"), np.int8)
            return level[back]

        return pa.Table.from_batches(looked_up(table.to_batches(), levels, 1 << 40))

    def finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield complete(frame, np.asarray(frame.column("level").flatten()))
        release()

    def complete(frame: pa.RecordBatch, level: np.ndarray) -> pa.RecordBatch:
        model = share.value

        def flat(name):
            column = frame.column(name)
            sizes = np.asarray(column.value_lengths())
            return column.flatten(), sizes, np.repeat(np.arange(len(sizes)), sizes)

        rows = frame.num_rows
        times, number, owner = flat("times")
        starts = np.cumsum(number) - number
        counts = np.zeros(len(owner), dtype=np.int64)
        found, _, of = flat("found")
        counts[starts[of] + np.asarray(found.field("i"))] = np.asarray(found.field("n"))
        times = np.asarray(times)
        n_known = np.asarray(frame.column("n_known")) + np.bincount(owner, times * (counts > 0), rows).astype(np.int64)
        base = np.asarray(frame.column("base_score")) + np.bincount(owner, times * np.log10((counts + 1) / bottom), rows)
        word, _, row = flat("word")
        values = [np.asarray(word), np.asarray(flat("before")[0])]
        word, before = (np.where(x < 0, np.append(counts, 0)[np.where(x < 0, starts[row] - x - 1, 0)], x) for x in values)
        logs = np.asarray(frame.column("score")) + np.bincount(row, np.log10(model.probability(word, before, level)), rows)
        columns = [frame.column(k) for k in keys] + [frame.column("n_tokens"), pa.array(n_known), pa.array(base), pa.array(logs)]
        return pa.RecordBatch.from_arrays(columns, names=names[: len(keys) + 4])

    facts = f"{kinds}n_tokens long, n_known long, base_score double, score double"
    rests = f"{facts}, rest array<long>, times array<long>, word array<long>, before array<long>, level array<smallint>"
    texts = docs.select(*keys, "text")
    if model.segments is None:
        first = texts.mapInArrow(run, rests)
    else:
        units = max(1, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // UNIT)
        texts = texts.withColumn("__unit", F.pmod(F.xxhash64(*keys, "text"), F.lit(units)))
        first = texts.groupBy("__unit").cogroup(dealt_levels(texts, model).groupBy("__unit")).applyInArrow(run_unit, rests)
    first = stage(first.withColumn("__row", F.monotonically_increasing_id()), "lm-tokens", shuffles_go=True)
    sought = first.select("__row", F.posexplode("rest").alias("i", "key"))
    found = sought.join(rare, "key").groupBy("__row").agg(F.collect_list(F.struct("i", "n")).alias("found"))
    found = first.drop("rest").join(found, "__row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<i:int,n:bigint>>")))
    found = found.drop("__row")
    done = found.mapInArrow(finish, facts)
    return done.select(*keys, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model, rare = fit(docs.where(~held))
    out = score(docs, model, rare)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
