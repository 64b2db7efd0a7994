"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so the packing is decided on the count of each length (at most ``capacity``
numbers, whatever the input): lengths are placed from the longest, each into the tightest open bin, which a segment
tree over remaining capacities finds in logarithmic time. A placement puts a run of pieces, by their rank within the
length, into a run of bins. The ranks and the final look-up are distributed.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Codes, batches, kept, stage

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """A segment tree over remaining capacities 0..most, of the capacities with open bins."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, capacity: int, open_: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = open_
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least ``need``."""
        at = self.leaves + need
        while not self.any[at]:
            while at & 1:  # a right child: go up until the part to the right is under the parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, first bin, offset, pieces a bin): the pieces of a length from that rank on go, so many
    to each bin, into consecutive bins from that offset on. The runs of bins are cut at most once for each length."""
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(free: int, first: int, count: int) -> None:
        if count and free:
            if not runs.get(free):
                runs[free] = []
                tree.mark(free, True)
            runs[free].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = tree.tightest(length)
            if free is None:
                free, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = runs[free].pop()
                if not runs[free]:
                    tree.mark(free, False)
            each = free // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, first, capacity - free, each))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer than fill a bin
                plan.append((length, rank, first + full, capacity - free, left))
                put(free - left * length, first + full, 1)
                full, left = full + 1, 0
            put(free, first + full, count - full)
    return plan


class WordIds(Codes):
    """The ids (packed, 4 bytes each) of words without white space, put together from those of their parts.

    The tokenizer folds case, and a run of letters is a part of its own, so "Word," is made of "word" and ",". Only
    A-Z are folded here, and not where a special token could arise.
    """

    ENDS = re.compile(r"(?<=[a-z0-9])([.,;:!?]+)(?=[ \n]|\Z)")
    PUNCTUATION = re.compile(r"[!-&(-/:-@\[-`{-~]")
    LOWER = {a: a + 32 for a in range(65, 91)}

    def __init__(self, vocabulary: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        super().__init__(self.parts, most)

    def encode(self, word: str) -> bytes:
        ids = array("I", self.model.encode(word, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        return super().__missing__(word) if len(word) < 48 else self.encode(word)

    def text(self, body: str) -> bytes:
        """The ids of a whole text. A-Z are folded and stops parted from the words before them in one go where that changes nothing."""
        if "<" not in body:
            body = self.ENDS.sub(r" \1", body.encode().lower().decode())
        return b"".join(map(self.__getitem__, body.replace("\n", " ").split(" ")))

    def parts(self, word: str) -> bytes:
        if word.isalpha() and word.islower():
            return self.encode(word)
        if "<" not in word:
            folded = word.translate(self.LOWER)
            if folded != word:
                return self[folded]
            mark = self.PUNCTUATION.search(word)
            # the tokenizer's own folding must leave letters alone: one like U+0130 becomes two characters, of which it joins the last to what follows
            if mark and mark.start() and word[: mark.start()].isalpha() and word[: mark.start()].lower().isalpha():
                return self[word[: mark.start()]] + self[word[mark.start() :]]
        return self.encode(word)


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32[, ids]) of the token ids of whole texts, each text's ids ended by ``end_id``.

    Null and empty texts are the end id alone. The tokenizer drops white space and joins nothing across it, so words
    between spaces or line feeds are encoded once and remembered; the memory for them is bounded.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"words of {vocabulary}"
        known = kept(name, lambda: WordIds(vocabulary))
        end = np.array([end_id], dtype="<u4").tobytes()
        for frame in batches(frames, 4 << 20, text, name):
            ids = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, body in enumerate(frame.column(text).to_pylist()):
                codes = known.text(body or "") + end
                for piece, at in enumerate(range(0, len(codes), 4 * capacity)):
                    part = codes[at : at + 4 * capacity]
                    for name, value in zip(ids, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else b"")):
                        ids[name].append(value)
            rows = pa.array(ids["row"], pa.int32())
            out = [frame.column(key).combine_chunks().take(rows), pa.array(ids["piece"], pa.int32()), *(pa.array(ids[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids["ids"], pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select(key, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", salts: int = 32, slice_rows: int = 100_000) -> DataFrame:
    """``pieces`` (at least key, piece, length) with sequence_id and offset, no sequence longer than ``capacity``.

    ``pieces`` is read twice, so it should be a stored table. Lengths must be 1 to ``capacity``. Equal rows are told
    apart only by their ranks, which is enough: each gets a place of its own. A length with many pieces is ranked in
    slices of about ``slice_rows`` (``salts`` of them at least), so that a hot length is spread; the table of slices
    that is broadcast has one row for each, and the plan one for each placement.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    plan = np.array(best_fit_decreasing(histogram, capacity) or [(capacity + 1, 0, 0, 0, 1)], dtype=np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    spark = pieces.sparkSession
    share = spark.sparkContext.broadcast(((plan[:, 0] << 48) + plan[:, 1], *plan.T[1:]))
    many = {n: max(salts, -(-c // slice_rows)) for n, c in histogram.items() if c > 1000}
    cells = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), "length"), F.lit(1)) if many else F.lit(1)
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64(key, "piece"), cells))
    counts = sliced.groupBy("length", "__slice").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "__slice", start.alias("__start"))
    ranked = sliced.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__slice").orderBy(key, "piece")))
    ranked = ranked.join(F.broadcast(starts), ["length", "__slice"]).select(*pieces.columns, (F.col("__start") + F.col("__n") - 1).alias("__rank"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bins, offsets, each = share.value
        for frame in frames:
            length, rank = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth = rank - ranks[at]
            where = pa.array(bins[at] + nth // each[at]), pa.array(offsets[at] + nth % each[at] * length)
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], *where], [*frame.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with their ids: (sequence_id, length, ids). A group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole documents and pack their pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(tokenize(docs, vocabulary, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
