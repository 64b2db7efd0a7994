"""How well a live service transcribes: rates of each file's responses, and their means. On a stream each micro-batch is stored under its own id, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

RATES = ("has_speech_rate", "adj_dup_rate", "trigram_repeat_rate", "ellipsis_token_rate", "short_snippet_rate")
#: Characters of transcripts a task.
EACH = 1 << 20
RESPONSES = "file string, chunk long, has_speech boolean, transcript string"


def response_rates(responses: DataFrame, short: int = 2) -> DataFrame:
    """(file, responses, has_speech_rate, total_words, adj_dup_rate, trigram_repeat_rate, ellipsis_token_rate, short_snippet_rate) of responses (file, chunk, has_speech, transcript).

    A file's text is that of its responses in the order of ``chunk``; words are taken plain and empty ones left out, but for the share of words that hold ``...``. A snippet is a transcript that isn't
    blank, short with at most ``short`` words. Repeats are counted over a file's words in rows, so no text is put together in one place. Files are dealt to as many tasks as
    the text asks for, so a task's share doesn't grow with it. Null ``has_speech`` is false.
    """
    size = responses.agg(F.sum(F.length("transcript"))).first()[0] or 0
    rows = responses.select("file", "chunk", "has_speech", "transcript").repartition(max(1, -(-size // EACH)), "file")
    said = rows.select("file", "chunk", "has_speech", F.trim(F.coalesce("transcript", F.lit(""))).alias("text")).withColumn("__raw", T.tokens(F.col("text")))
    said = said.withColumn("__w", F.filter(F.transform("__raw", T.plain), lambda t: t != ""))
    snippet = F.size("__raw") > 0
    each = said.groupBy("file").agg(
        F.count("*").alias("responses"), F.avg(F.coalesce("has_speech", F.lit(False)).cast("double")).alias("has_speech_rate"), F.sum(F.size("__w")).alias("total_words"), F.sum(F.size("__raw")).alias("__raw"),
        F.sum(F.size(F.filter("__raw", lambda t: t.contains("...")))).alias("__dots"), F.sum(snippet.cast("int")).alias("__snippets"), F.sum((snippet & (F.size("__w") <= short)).cast("int")).alias("__short"),
    )
    order = Window.partitionBy("file").orderBy("chunk", "pos")
    words = said.select("file", "chunk", F.posexplode("__w").alias("pos", "w"))
    words = words.select("file", "w", F.lag("w").over(order).alias("b"), F.lead("w").over(order).alias("x"), F.lead("w", 2).over(order).alias("y"))
    grams = words.groupBy("file", "w", "x", "y").agg(F.count("*").alias("n"), F.sum((F.col("w") == F.col("b")).cast("int")).alias("same"))
    full = F.col("y").isNotNull()
    repeats = grams.groupBy("file").agg(F.sum("same").alias("__same"), F.sum(F.when(full, F.col("n") - 1)).alias("__again"), F.sum(F.when(full, F.col("n"))).alias("__grams"))
    part = lambda a, b: F.coalesce(F.col(a), F.lit(0)).cast("double") / F.greatest(F.coalesce(b, F.lit(0)), F.lit(1))
    n = F.col("total_words")
    out = each.join(repeats, "file", "left")
    return out.select(
        "file", "responses", "has_speech_rate", "total_words", F.when(n < 2, F.lit(0.0)).otherwise(part("__same", n - 1)).alias("adj_dup_rate"), F.when(n < 6, F.lit(0.0)).otherwise(part("__again", F.col("__grams"))).alias("trigram_repeat_rate"),
        part("__dots", F.col("__raw")).alias("ellipsis_token_rate"), part("__short", F.col("__snippets")).alias("short_snippet_rate"),
    )


def summary(rates: DataFrame) -> DataFrame:
    """One row (n, avg_<rate> for each rate): means over files, 0 where there are none."""
    return rates.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in RATES])


def store_batch(batch: DataFrame, number: int, folder: str) -> None:
    """A micro-batch of responses as the files of its number, in place of those that an earlier attempt may have left."""
    batch.select("file", F.col("chunk").cast("long"), "has_speech", "transcript").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")


def evaluate(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that stores the responses of ``stream`` under ``folder``; ``stored`` reads them and ``response_rates`` scores them, during the query as after it."""
    return stream.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of all finished batches. Of responses to one chunk, which a client may have sent twice, that of the earliest batch counts."""
    rows = spark.read.schema(f"{RESPONSES}, batch long").parquet(folder)
    first = F.row_number().over(Window.partitionBy("file", "chunk").orderBy("batch", F.col("transcript").asc_nulls_last(), "has_speech"))
    return rows.withColumn("__k", first).where("__k = 1").drop("__k", "batch")
