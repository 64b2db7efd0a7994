"""Canonical tables from the driver's data: segments, hypotheses, frames, vectors, utterances and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds_of_day(ts):
    """Seconds since midnight as a double, exact to the microsecond and the same in any time zone."""
    micros = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return micros.cast("double") / F.lit(1e6)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker segments (rec, ord, s, e, spk): a day is a recording, an event a segment of ``value`` seconds."""
    s = seconds_of_day(F.col("ts"))
    return table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("rec"), F.col("event_id").alias("ord"), s.alias("s"), (s + F.col("value")).alias("e"), F.col("event_type").alias("spk"))


def hypotheses(seg: DataFrame) -> DataFrame:
    """A deterministic disturbance of segments: some are dropped, some moved, some relabelled."""
    shift = (F.col("ord") % 5).cast("double") * F.lit(0.4)
    return seg.where("ord % 7 <> 0").select("rec", "ord", (F.col("s") + shift).alias("s"), (F.col("e") + shift).alias("e"), F.when(F.col("ord") % 11 == 0, "click").otherwise(F.col("spk")).alias("spk"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame scores (rec, ix, ord, score) of each user in the order of their events."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("user_id").alias("rec"), F.row_number().over(order).alias("ix"), F.col("event_id").alias("ord"), (F.col("value") / F.lit(500.0)).alias("score"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Model results (model, file_id, ord, price, discount, quantity)."""
    return table(spark, folder, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))
