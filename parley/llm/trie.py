"""The trie of the prefixes of conversations, from their sorted order and the lengths of prefixes that neighbours share.

Conversations are keyed by the digests of their turns, one after another, and sorted over all tasks. A node of depth d is then an interval of
that order: it begins where the prefix shared with the neighbour before (its LCP) is shorter than d, and ends before the next such place.
These intervals are the Cartesian tree over the LCP array, with nodes of equal LCP merged and the depths between a node and its parent filled in.

Each task scans one block of the order with a stack, which gives the nearest smaller LCP on both sides of every node that begins and ends in the block.
A node that crosses the edges of blocks leaves a part in each of them. The minima of the blocks (two numbers a block) say in which block
it began: the nearest one before whose least LCP is smaller than its depth. Block and depth name the node, and its parts are summed by
them. So copies and a prefix that a third of all conversations share are spread over blocks, and no group is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

#: Characters of a turn in a key, a SHA-256 in hex.
WIDTH = 64
#: Of ids of ended conversations, in a row.
CHUNK = 1 << 16
SORTED = "block int, place long, conv_id long, lcp int, turns int, chars array<bigint>"
PARTS = "kind string, owner long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, parent_owner long, block long, part long, ids string"
_PARTS = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in PARTS.split(", ")])
EMPTY = hashlib.sha256().hexdigest()


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, key, chars): each conversation c with its first h turns replaced by those of c - c % ``group``, h being crc32(c as decimal text) % ``most``.

    Turns are ordered by ``turn``, null first, ties by digest. Null roles and texts are empty; rows without a conv_id belong to none and are left out. If the other
    conversation has fewer turns, or is absent, those it has are taken; of its own turns those after the first h stay. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("own", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("__base", F.col("conv_id") - F.col("conv_id") % group).join(first, "__base", "left")
    kept = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    whole = both.select("conv_id", F.when(F.col("first").isNull(), kept).otherwise(F.concat(F.slice("first", 1, h), kept)).alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["digest"]), "").alias("key"), F.transform("t", lambda x: x["chars"]).alias("chars"))


def shared(a: str, b: str) -> int:
    """How many leading turns two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # the first unequal turn is found by halving
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _rows(frames: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for frame in frames:
        for at in range(0, frame.num_rows, 1000):
            yield from frame.slice(at, 1000).to_pylist()


def _with_lcp(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks in order, without their keys. A block's first row may be the last of the block before; it only serves the comparison."""
    schema = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("lcp", pa.int32()), ("turns", pa.int32()), ("chars", pa.list_(pa.int64()))])
    for block, rows in groupby(_rows(frames), lambda r: r["block"]):
        before, place, out = None, 0, []
        for r in rows:
            if r["conv_id"] is not None:
                lcp = -1 if before is None else shared(before, r["key"])
                # later rows need only what they add; the first also what it shares, for the nodes that come in from the left
                out.append({"block": block, "place": place, "conv_id": r["conv_id"], "lcp": lcp, "turns": len(r["chars"]), "chars": r["chars"][max(0, lcp) if place else 0 :]})
                place += 1
            before = r["key"]
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    release()


class _Node:
    """An open node: its sums so far in this block."""

    __slots__ = ("chars", "children", "ends", "least", "leaves", "n", "owner", "saved", "waiting")

    def __init__(self, owner: int, chars: int):
        self.owner, self.chars = owner, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.waiting = None, [], []


def _scan(block: int, rows: Iterator[dict], owners: list[int], after: int) -> Iterator[dict]:
    """Nodes that begin and end in a block, and parts of those that don't. ``owners``: the blocks where the nodes of depth 0, 1, ... that come in from the left began. ``after``: the LCP of the next block's first row."""
    stack: list[_Node] = []

    def close(inside: bool) -> Iterator[dict]:
        node, depth = stack.pop(), len(stack)
        node.saved += node.n * node.chars - (node.chars if node.owner == block else 0)
        row = {"kind": "node" if inside else "part", "owner": node.owner, "depth": depth, "conv_id": node.least, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if inside:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY
            yield from ({**x, "parent_conv_id": node.least} for x in node.waiting)
        else:
            yield from ({**x, "parent_owner": node.owner} for x in node.waiting)
            texts = [str(i) for i in node.ends]
            step = CHUNK // 20
            yield from ({"kind": "ends", "owner": node.owner, "depth": depth, "block": block, "part": k, "ids": ",".join(texts[at : at + step])} for k, at in enumerate(range(0, len(texts), step)))
        if depth:
            up = stack[-1]
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)
            if inside:
                up.waiting.append(row)
            else:
                row["parent_owner"] = up.owner
        if not inside or not depth:
            yield row

    def shrink(lcp: int) -> Iterator[dict]:
        if len(stack) - 1 > lcp:
            stack[-1].leaves += 1  # nothing longer follows: it has no children
        while len(stack) - 1 > lcp:
            yield from close(stack[-1].owner == block)

    first = True
    for r in rows:
        lcp, chars = r["lcp"], r["chars"]
        if first:
            stack.extend(_Node(owner, chars[d - 1] if d else 0) for d, owner in enumerate(owners))
            chars, first = chars[max(0, lcp) :], False
        else:
            yield from shrink(lcp)
        for d in range(lcp + 1, r["turns"] + 1):
            if d:
                stack[-1].children += 1
            stack.append(_Node(block, chars[d - 1 - max(0, lcp)] if d else 0))
        node = stack[-1]
        node.n += 1
        node.least = r["conv_id"] if node.least is None else min(node.least, r["conv_id"])
        node.ends.append(r["conv_id"])
    yield from shrink(after)
    while stack:
        yield from close(False)


def _scanned(blocks: list[tuple[int, int, int]]):
    """``blocks``: (block, first LCP, least LCP) in order."""
    at = {b: k for k, (b, _, _) in enumerate(blocks)}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_rows(frames), lambda r: r["block"]):
            k = at[block]
            owners: list[int] = []
            near = k - 1
            for depth in range(blocks[k][1], -1, -1):
                while blocks[near][2] >= depth:
                    near -= 1
                owners.append(blocks[near][0])
            out = []
            for row in _scan(block, rows, owners[::-1], blocks[k + 1][1] if k + 1 < len(blocks) else -1):
                out.append(row)
                if len(out) == 5000:
                    yield pa.RecordBatch.from_pylist(out, _PARTS)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _PARTS)
        release()

    return run


def _hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, depth, ends_sha256) of sorted chunks of ids; a chunk is held at a time."""
    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for (owner, depth), rows in groupby(_rows(frames), lambda r: (r["owner"], r["depth"])):
        digest, first = hashlib.sha256(), True
        for r in rows:
            digest.update(("" if first else ",").encode() + r["ids"].encode())
            first = False
        yield pa.RecordBatch.from_pylist([{"owner": owner, "depth": depth, "ends_sha256": digest.hexdigest()}], schema)


def prefix_trie(sequences: DataFrame, turns_each: int = 50_000, most_parts: int = 500_000) -> DataFrame:
    """A row for each distinct prefix of ``sequences`` (conv_id long, not null and distinct, key string of ``WIDTH`` characters a turn, chars array<long> of code points by turn).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No rows for an empty table. A sequence is
    held whole by the task of its block, and the stack of a scan is as deep as the longest; blocks have about ``turns_each`` turns.
    The digest of ids is a chain by definition: a node at which many sequences end is hashed by one task, which reads prepared chunks in order.
    """
    spark = sequences.sparkSession
    held = stage(sequences.select("conv_id", "key", "chars"), "trie-sequences")
    turns = held.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    ranged = stage(held.repartitionByRange(max(8, turns // turns_each), "key", "conv_id").withColumn("block", F.spark_partition_id()), "trie-blocks")
    ids = sorted(r[0] for r in ranged.select("block").distinct().collect())  # a number a block
    if not ids:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    next_of = spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "block int, next int")
    edges = ranged.groupBy("block").agg(F.max("key").alias("key")).join(next_of, "block").where("next is not null")
    edges = edges.select(F.col("next").alias("block"), F.lit(None).cast("long").alias("conv_id"), "key", F.array().cast("array<bigint>").alias("chars"))
    rows = ranged.select("block", "conv_id", "key", "chars").union(edges).repartitionById(ids[-1] + 1, F.col("block")).sortWithinPartitions("block", "key", "conv_id")
    ordered = stage(rows.mapInArrow(_with_lcp, SORTED), "trie-order")
    least = ordered.groupBy("block").agg(F.min_by("lcp", "place").alias("first"), F.min("lcp").alias("least"))
    blocks = sorted((r["block"], r["first"], r["least"]) for r in least.collect())
    rows = ordered.repartitionById(ids[-1] + 1, F.col("block")).sortWithinPartitions("block", "place")
    found = stage(rows.mapInArrow(_scanned(blocks), PARTS), "trie-parts")
    ends = found.where("kind = 'ends'").select("owner", "depth", "block", "part", "ids").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block", "part")
    digests = ends.mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    crossing = found.where("kind = 'part'").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("parent_owner").alias("parent_owner"))
    crossing = stage(crossing.join(digests, ["owner", "depth"], "left"), "trie-crossing")
    parents = crossing.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("__parent"))
    parents = F.broadcast(parents) if crossing.count() <= most_parts else parents
    out = [F.col("conv_id"), F.col("depth"), F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id"), *[F.col(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    nodes = found.where("kind = 'node'").select(*crossing.columns, "parent_conv_id")
    return nodes.unionByName(crossing.withColumn("parent_conv_id", F.lit(None).cast("long"))).join(parents, ["parent_owner", "depth"], "left").select(*out)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP13_SQL = """
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS c, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(k := k, c := c) ORDER BY turn NULLS FIRST, k) AS turns,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id),
seqs AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, o.h), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, len(turns) AS size, d AS depth, list_slice(list_transform(turns, lambda x: x.k), 1, d) AS node, CASE WHEN d = 0 THEN 0 ELSE turns[d].c END AS chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM seqs)),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM prefixes GROUP BY node, depth),
kids AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
below AS (SELECT list_slice(node, 1, a) AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (node) LEFT JOIN nodes p ON c.depth > 0 AND p.node = list_slice(c.node, 1, c.depth - 1)
"""
