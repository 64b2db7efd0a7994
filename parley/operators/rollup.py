"""Aggregation and ranking of benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population standard deviation, total and count of each metric, over the rows that have it."""
    out = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.sum(m).alias(f"{m}_total"), F.count(m).alias(f"{m}_n"))]
    return results.groupBy(*by).agg(*out)


def best(results: DataFrame, by: list[str], metric: str, order: str, what: str, largest: bool = True) -> DataFrame:
    """The ``what`` of the best row of each group, the first in ``order`` of those that tie."""
    rank = F.struct(F.col(metric) if largest else -F.col(metric), -F.col(order))
    return results.groupBy(*by).agg(F.max_by(what, rank).alias(what), (F.max if largest else F.min)(metric).alias(metric))


def ranking(results: DataFrame, metric: str, order: str, k: int | None = None) -> DataFrame:
    """Rows by rising metric, ties by ``order``, with their rank; the first ``k`` if given. The input is a table of models, not of results."""
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(metric, order)))
    return ranked.where(F.col("rank") <= k) if k else ranked


def pivot_mean(results: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    return results.groupBy(row).pivot(column, values).agg(F.avg(metric))


def shares(rows: DataFrame, group: str, part: str, amount: str) -> DataFrame:
    """Each part's total and its share of the group's."""
    sums = rows.groupBy(group, part).agg(F.sum(amount).alias("total"))
    every = F.sum("total").over(Window.partitionBy(group))
    return sums.withColumn("share", F.when(every == 0, F.lit(0.0)).otherwise(F.col("total") / F.when(every == 0, F.lit(1.0)).otherwise(every)))


def capped(rows: DataFrame, key: str, size: str, order: str, most: int = 20, least: float = 0.0) -> DataFrame:
    """The ``most`` largest rows of each key, ties by ``order``, of those with at least ``least``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(size), order))
    return rows.where(F.col(size) >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def sweep_configs(spark, **options: list) -> DataFrame:
    """All combinations of the options: a short table that the caller lists in full."""
    out = None
    for name, values in options.items():
        part = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v) for v in values])).alias(name))
        out = part if out is None else out.crossJoin(part)
    return out


def best_config(results: DataFrame, by: list[str], what: str, precision: str = "precision", f1: str = "f1") -> DataFrame:
    """The configuration of each group with the largest mean of precision and F1; the first by name of those that tie."""
    score = (F.col(precision) + F.col(f1)) / 2.0
    return results.groupBy(*by).agg(F.min_by(what, F.struct(-score, F.col(what))).alias(what), F.max(score).alias("score"))


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key with the value of its first row."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def distinct_counts(rows: DataFrame, by: list[str], what: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_distinct(what).alias("n"))


def clamped(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Settings cut to their limits; nulls stay null."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))) for c, (low, high) in limits.items()})


def subset(part, whole):
    """Whether an array has nothing that another lacks."""
    return F.size(F.array_except(part, whole)) == 0
