"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Each source's weight is a piecewise linear schedule over training time 0 to 1. Its integral is the source's share of the
budget; the inverse of its running integral says at which time each of its words is due. Documents (and their repeats)
are put at those times and sorted by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, shielded, stage

#: Shapes of the weight over time, dealt to the sources in turn: (time, factor) knots, with mean 1 each.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def running_share(schedule, share: Column) -> Column:
    """The time at which the running integral of a schedule reaches ``share`` (0 to 1) of the whole."""
    pieces, below = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1, w0, w1, below, (t1 - t0) * (w0 + w1) / 2))
        below += pieces[-1][-1]
    out = F.lit(1.0)
    for t0, t1, w0, w1, start, area in reversed(pieces):
        # w0*x + slope*x*x/2 = rest, solved without cancellation
        rest, slope = F.greatest(share * below - start, F.lit(0.0)), (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        x = F.when(root + w0 > 0, rest * 2 / F.greatest(root + w0, F.lit(1e-300))).otherwise(0.0)
        out = F.when(share * below <= start + area, F.lit(t0) + F.least(x, F.lit(t1 - t0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=(1, 2, 3), repeats: int = 3) -> DataFrame:
    """``sizes`` (source, source_size: a row for each source) with turn, weight and target (double).

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets share all of the sizes by weight; none
    passes ``repeats`` times its source's size, and the excess is shared again by weight. With the sources in order of
    capacity per weight those that stop are the first ones, so running sums find the level in one pass. The
    table of sources, not of documents, is sorted in one task.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("double")
    table = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    table = table.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return table.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).select("source", "source_size", "turn", "weight", "target")


RESULTS = ("size", "source_size", "target", "taken", "copies", "position")


def mix(docs: DataFrame, weights=(1, 2, 3), repeats: int = 3, schedules=SCHEDULES, cut: bool = True, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, taken (words, repeats counted), copies and position.

    A size is the number of words of the text (null: 0). The words of a source are laid out in the order of md5(key),
    and the mix takes its first round(target) of them, going round again up to ``repeats`` times. With ``cut`` the last document taken is
    cut there, and only its first words count; otherwise documents are whole and one that the target falls within is
    taken if at least half of it fits. ``position`` (0 to 1) is when the first copy is due, null if nothing is taken.
    Rows are sorted by position. Repeated rows and ties each count; null keys sort last; an empty table stays empty;
    columns named like the results are replaced, and names that begin with two underscores are reserved: the result has two more, __c (the words laid out
    before the document's) and __turn (its source's number), for ``training_order``. Sources are laid out in 4096 slices each, so a hot source
    is spread over many tasks; what is broadcast holds a row for each source, or is joined where it is large.
    """
    own = list(RESULTS)
    rows = docs.drop(*own).withColumns({"size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint"), "__source": F.col(source), "__h": F.md5(F.col(key).cast("string").cast("binary"))})
    rows = rows.withColumn("__slice", F.coalesce(F.substring("__h", 1, 3), F.lit("~")))
    slices = stage(rows.groupBy("__source", "__slice").agg(F.sum("size").alias("words")), "mix-slices")
    targets = source_targets(slices.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights, repeats)
    start = F.coalesce(F.sum("words").over(Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slices.select("__source", "__slice", start.alias("__start"))
    table = stage(starts.join(targets, F.col("__source").eqNullSafe(F.col("source"))).select("__source", "__slice", "__start", "source_size", "target", F.col("turn").alias("__turn")), "mix-plan")
    discard(slices)
    within = Window.partitionBy("__source", "__slice").orderBy("__h", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__c", F.coalesce(F.sum("size").over(within), F.lit(0)))
    table = table.withColumnsRenamed({"__source": "__s", "__slice": "__l"})
    few = table.count() <= 1_000_000  # some 64 MB
    rows = rows.join(F.broadcast(table) if few else table, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__l"))).withColumn("__c", F.col("__c") + F.col("__start"))
    goal = F.round("target").cast("bigint")
    whole, rest = F.coalesce(F.try_divide(goal, F.col("source_size")).cast("bigint"), F.lit(0)), F.coalesce(F.try_mod(goal, F.col("source_size")), F.lit(0))
    extra = F.least(F.col("size"), F.greatest(rest - F.col("__c"), F.lit(0))) if cut else F.when((rest > F.col("__c")) & ((rest - F.col("__c")) * 2 >= F.col("size")), F.col("size")).otherwise(0)
    rows = rows.withColumn("taken", (whole * F.col("size") + extra).cast("bigint")).withColumn("copies", (whole + (extra > 0).cast("int")).cast("int"))
    rows = rows.withColumn("__share", F.try_divide(F.col("__c").cast("double"), goal.cast("double")))
    position = F.when(F.col("taken") > 0, _due(F.col("__share"), schedules))
    rows = rows.withColumn("position", position).withColumn("__tie", F.col("__h"))
    kept = [c for c in docs.columns if c not in own]
    return rows.orderBy(F.col("position").asc_nulls_last(), "__tie").select(*kept, *own, "__c", "__turn")


def _due(share: Column, schedules) -> Column:
    at = F.col("__turn") % len(schedules)
    out = running_share(schedules[0], share)
    for n, schedule in enumerate(schedules[1:], 1):
        out = F.when(at == n, running_share(schedule, share)).otherwise(out)
    return out


def training_order(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """A row for each copy that the mix takes, with ``copy`` (from 0; a column of that name is replaced), each at its own time, sorted by it."""
    copies = mixed.drop("copy").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.try_divide(F.col("__c") + F.col("copy") * F.col("source_size"), F.col("target"))
    due = _due(F.least(share.cast("double"), F.lit(1.0)), schedules)
    return copies.withColumn("position", due).drop("__c", "__turn").orderBy("position", "copy")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order, with the columns of ``docs``; those named like results keep their values."""
    safe, own = shielded(docs, (*RESULTS, "copy"))
    return own(training_order(mix(safe, cut=False)))


def op9_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, (turn % 3 + 1)::DOUBLE AS weight, (3 * source_size)::BIGINT AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, turn, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, turn, round(target)::BIGINT AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size END::BIGINT AS whole, CASE WHEN source_size = 0 THEN 0 ELSE least(size, greatest(goal % source_size - c, 0)) END::BIGINT AS extra,
  CASE WHEN goal > 0 THEN c::DOUBLE / goal::DOUBLE END AS share FROM c),
p AS (SELECT *, CASE turn % 3
  WHEN 0 THEN CASE WHEN share <= 1.0::DOUBLE THEN least(share * 2.0::DOUBLE / (sqrt(greatest(2.25::DOUBLE - share * 2.0::DOUBLE, 0.0::DOUBLE)) + 1.5::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END
  WHEN 1 THEN CASE WHEN share <= 1.0::DOUBLE THEN least(share * 2.0::DOUBLE / (sqrt(0.25::DOUBLE + share * 2.0::DOUBLE) + 0.5::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END
  ELSE CASE WHEN share <= 0.5::DOUBLE THEN least(share * 2.0::DOUBLE / (sqrt(0.25::DOUBLE + share * 4.0::DOUBLE) + 0.5::DOUBLE), 0.5::DOUBLE)
    WHEN share <= 1.0::DOUBLE THEN 0.5::DOUBLE + least((share - 0.5::DOUBLE) * 2.0::DOUBLE / (sqrt(greatest(2.25::DOUBLE - (share - 0.5::DOUBLE) * 4.0::DOUBLE, 0.0::DOUBLE)) + 1.5::DOUBLE), 0.5::DOUBLE) ELSE 1.0::DOUBLE END END AS due FROM k)
SELECT doc_id, size, source_size, target, whole + extra AS taken, (CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size END + CASE WHEN extra > 0 THEN 1 ELSE 0 END)::INTEGER AS copies,
  CASE WHEN whole + extra > 0 THEN round(due, 9) END AS position FROM p
"""
