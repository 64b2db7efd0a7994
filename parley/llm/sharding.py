"""Sharding by histogram sort, with built-in functions only.

Documents are ordered by a 64-bit key; the splitters between shards are found by counting exact bytes below
candidate boundaries, again and again within the interval that still holds each splitter, until it meets the
tolerance or cannot be cut. Only those counts (at most ``probes`` per splitter) reach the driver. Then every row is
exchanged once, by (shard, slice), to be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

LOWEST, HIGHEST = -(1 << 63), 1 << 63


def _step(lo: int, hi: int, probes: int) -> int:
    step = max(1, -(-(hi - lo) // probes))
    return step + step % 2 if hi - lo >= HIGHEST else step


def splitters(keyed: DataFrame, shards: int, tolerance: float = 1e-4, probes: int = 1024) -> list[int]:
    """Boundaries b_1..b_{n-1}: shard i takes the keys from b_i up to b_{i+1}. ``keyed`` has ``key`` and ``size``.

    Equal keys are never parted, so a key with more bytes than the tolerance ends the refinement there, at the
    boundary nearest to the target. Empty input gives boundaries that send all to shard 0.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * i / shards for i in range(1, shards)]
    slack = total / shards * tolerance
    spans = {i: (LOWEST, HIGHEST, 0, total) for i in range(len(goals))}
    found: dict[int, int] = {}
    while spans and total:
        cuts = sorted({(lo, hi) for lo, hi, _, _ in spans.values()})
        number, cell = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for n, (lo, hi) in enumerate(cuts):
            inside, step = (F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi - 1)), _step(lo, hi, probes)
            # a distance of 2^63 or more doesn't fit a long: both ends are halved
            far = F.try_subtract(F.shiftright("key", 1), F.lit(lo >> 1)) if hi - lo >= HIGHEST else F.try_subtract(F.col("key"), F.lit(lo))
            at = F.call_function("div", far, F.lit(step // 2 if hi - lo >= HIGHEST else step))
            cell, number = F.when(inside, at).otherwise(cell), F.when(inside, F.lit(n)).otherwise(number)
        counted = keyed.select(number.alias("n"), cell.alias("cell"), "size").where("n is not null").groupBy("n", "cell").agg(F.sum("size").alias("bytes")).collect()
        held: dict[int, dict[int, int]] = {}
        for row in counted:
            held.setdefault(row["n"], {})[row["cell"]] = row["bytes"]
        for i in list(spans):
            lo, hi, below, _ = spans[i]
            step = _step(lo, hi, probes)
            cells = held.get(cuts.index((lo, hi)), {})
            for c in sorted(cells):
                if below + cells[c] >= goals[i]:
                    break
                below += cells[c]
            start, end, after = lo + c * step, min(hi, lo + (c + 1) * step), below + cells[c]
            if goals[i] - below <= slack or after - goals[i] <= slack or end - start <= 1:
                found[i] = start if goals[i] - below <= after - goals[i] else end
                del spans[i]
            else:
                spans[i] = (start, end, below, after)
    return [found.get(i, HIGHEST) for i in range(shards - 1)]


def histogram_shard(docs: DataFrame, shards: int = 8, text: str = "text", order: str | None = None, tolerance: float = 1e-4, slice_rows: int = 100_000) -> DataFrame:
    """``docs`` with size, shard (0 to shards-1) and slot (0, 1, ... within the shard), law 'bytes'.

    A size is the text's UTF-8 bytes plus 1; null texts count as empty. The key is ``order`` (a long column, nulls
    first) or a hash of the text, so that equal texts share a shard. Shards differ by at most the tolerance and one
    group of equal texts at each boundary. Repeated rows are kept, each with its slot; an empty table stays empty;
    columns named like the results are replaced, and names that begin with two underscores are reserved. Each shard is numbered in slices of about ``slice_rows`` (64 at least) by a hash of all that orders it, so a
    text that a third of the rows hold is numbered by many tasks.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(LOWEST)) if order else F.xxhash64(body)
    rows = docs.drop("size", "shard", "slot", "law").withColumns({"size": F.length(body).cast("bigint") + 1, "__key": key})
    keyed = stage(rows.select(F.col("__key").alias("key"), "size"), "shard-keys")
    slices = max(64, keyed.count() // (shards * slice_rows))
    cuts = splitters(keyed, shards, tolerance)
    discard(keyed)
    shard = F.lit(0)
    for b in cuts:
        shard = shard + (F.lit(b < HIGHEST) & (F.col("__key") >= F.lit(min(b, HIGHEST - 1)))).cast("int")
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ids = [c for c in plain if c not in (text, "size", "shard", "slot", "law")]
    rows = rows.withColumn("shard", shard).withColumn("__slice", F.pmod(F.xxhash64(*ids, "__key"), F.lit(slices)))
    # the running count over slices is at most shards * slices rows
    counts = rows.groupBy("shard", "__slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "__slice", before.alias("__start"))
    within = Window.partitionBy("shard", "__slice").orderBy("__key", *ids)
    numbered = rows.withColumn("__n", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), ["shard", "__slice"]).withColumn("slot", (F.col("__start") + F.col("__n") - 1).cast("bigint")).withColumn("law", F.lit("bytes")).drop("__slice", "__start", "__n", "__key")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard in its own folder, in slot order within files."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    out = histogram_shard(docs.withColumn("text_crc32", crc), shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
