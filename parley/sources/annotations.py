"""Readers and writers of annotation files, reports, presets and the speaker registry."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "array<struct<start:double,end:double,speaker:string,text:string,id:bigint>>"


def read_annotations(spark: SparkSession, path: str, chunk_seconds: float | None = None) -> DataFrame:
    """Segments (file, ord, s, e, spk, text, id) of JSON annotation files. A file without ``segments`` fails the job.

    With ``chunk_seconds`` the file's number times that is added to its times, which are not clipped to the chunk.
    """
    raw = spark.read.schema(f"segments {SEGMENT}").option("multiLine", True).json(path).select("segments", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    checked = F.when(F.col("segments").isNull(), F.raise_error(F.concat(F.lit("no segments in "), "file")).cast(SEGMENT)).otherwise(F.col("segments"))
    rows = raw.select("file", F.posexplode(checked).alias("ord", "x"))
    shift = F.regexp_extract("file", r"^(\d+)", 1).cast("double") * chunk_seconds if chunk_seconds else F.lit(0.0)
    return rows.select("file", "ord", (F.col("x.start") + shift).alias("s"), (F.col("x.end") + shift).alias("e"), F.col("x.speaker").alias("spk"), F.col("x.text").alias("text"), F.col("x.id").alias("id"))


def truth(rows: DataFrame, dropped: str = "SPEAKER_01") -> DataFrame:
    """Upper-case labels, without the placeholder speaker."""
    return rows.withColumn("spk", F.upper("spk")).where(F.col("spk") != dropped)


def merge_parts(rows: DataFrame) -> DataFrame:
    """Segments of all files of a part (three digits standing alone in the file name), as one list in the order of (s, e)."""
    part = F.regexp_extract("file", r"(?<!\d)(\d{3})(?!\d)", 1)
    listed = F.array_sort(F.collect_list(F.struct("s", "e", "ord", "spk", "text")))
    return rows.withColumn("part", part).where("part <> ''").groupBy("part").agg(listed.alias("segments"))


def relabel(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<string,string>")
    return rows.withColumn("spk", F.coalesce(F.try_element_at(mapping, F.col("spk")), "spk"))


def pair_by_position(left: DataFrame, right: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The i-th of the left with the i-th of the right, in the order of ``key``; what has no partner is left out, with a warning. For lists of files, which one task numbers."""
    sizes = left.count(), right.count()
    if sizes[0] != sizes[1]:
        warnings.warn(f"{sizes[0]} on the left, {sizes[1]} on the right: those over are left out", stacklevel=2)
    rank = lambda df: df.select(F.col(key), F.row_number().over(Window.orderBy(key)).alias("place"))
    both = rank(left).join(rank(right).withColumnRenamed(key, f"{key}_other"), "place")
    return both.where(F.col("place") <= limit) if limit else both


def pair_by_stem(truths: DataFrame, files: DataFrame, extensions=("mp3", "wav", "flac", "m4a")) -> DataFrame:
    """For each truth ``id`` the first file (``path``) that exists, by prefix '' then 'combined_part', and by extension."""
    names = F.array(*[F.struct(F.lit(p * len(extensions) + i).alias("rank"), F.lit(x).alias("prefix"), F.lit(f".{e}").alias("ext")) for p, x in enumerate(("", "combined_part")) for i, e in enumerate(extensions)])
    wanted = truths.withColumn("n", F.explode(names)).select("id", "n.rank", F.concat("n.prefix", "id", "n.ext").alias("name"))
    found = wanted.join(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "name")
    return truths.join(found.groupBy("id").agg(F.min_by("path", "rank").alias("path")), "id", "left")


def split_plan(durations: DataFrame, length: float) -> DataFrame:
    """(rec, part, s, e): fixed-length parts, the last one shorter."""
    parts = F.ceil(F.col("duration") / length).cast("int")
    rows = durations.where("duration > 0").select("rec", "duration", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.select("rec", "part", (F.col("part") * F.lit(float(length))).alias("s"), F.least((F.col("part") + 1) * F.lit(float(length)), "duration").alias("e"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, v at unit length), the latest of each name; zero vectors stay zero."""
    rows = spark.read.parquet(path).select("name", "v", "version")
    latest = rows.groupBy("name").agg(F.max_by("v", "version").alias("v"))
    from ..functions.vectors import unit

    return latest.withColumn("v", unit("v"))


def upsert_registry(rows: DataFrame, path: str, version: int, buckets: int = 64) -> None:
    """Put speakers (name, v) into the registry at ``path``, which has a folder for each of ``buckets`` hashes of names. Only buckets with new names are written, each anew: of a name the latest
    ``version`` stays, at one version the row given now. A write that fails leaves the buckets as they were. Null names are left out; of repeated names the largest vector counts."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket")
    new = rows.where("name is not null").groupBy("name").agg(F.max(F.col("v").cast("array<double>")).alias("v")).select("name", "v", F.lit(version).cast("bigint").alias("version"), F.lit(1).alias("__now"), bucket)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema("name string, v array<double>, version bigint, bucket int").parquet(path).where(F.col("bucket").isin(touched))
        new = new.unionByName(held.withColumn("__now", F.lit(0)))
    latest = new.groupBy("bucket", "name").agg(F.max_by(F.struct("v", "version"), F.struct("version", "__now")).alias("x"))
    latest.select("name", "x.v", "x.version", "bucket").repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(preset, key, value) of a JSON object of presets; names that start with '_' and presets that aren't objects are left out."""
    raw = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "map<string,string>")
    rows = raw.select(F.explode(top).alias("preset", "body")).where(~F.col("preset").startswith("_"))
    return rows.select("preset", F.explode(F.from_json("body", "map<string,string>")).alias("key", "value")).where(~F.col("key").startswith("_"))


REPORT_KEYS = ("timestamp", "pipelines", "dataset", "system_info")


def reload_presets(spark: SparkSession, path: str, held: DataFrame | None = None, modified: int = -1, force: bool = False) -> tuple[DataFrame | None, int]:
    """(presets, time of their file): those ``held`` while the file is no newer than ``modified`` or isn't there, else read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return held, modified
    now = files.getFileStatus(at).getModificationTime()
    if held is not None and not force and now <= modified:
        return held, modified
    return read_presets(spark, path), now


def comparison_report(results: DataFrame, kind: str, metrics: list[str], timestamp: str, system_info: dict[str, str] | None = None, dataset: dict[str, str] | None = None) -> DataFrame:
    """A document for each model of ``results`` (model, ...): comparison_type, timestamp, system_info, dataset and pipelines, a map of the model to its per_file_results and aggregated figures.

    ``aggregated`` has the mean, standard deviation, total and count of each metric over the files that have it. A file's results are one row of ``results``, without the model.
    """
    from ..operators.rollup import summary

    fields = [c for c in results.columns if c != "model"]
    figures = summary(results, ["model"], metrics)
    aggregated = F.struct(*[F.struct(*[F.col(f"{m}_{x}").alias(x) for x in ("mean", "std", "total", "n")]).alias(m) for m in metrics]).alias("aggregated")
    files = results.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("per_file_results")).join(figures, "model").select("model", "per_file_results", aggregated)
    told = lambda given: F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    body = F.map_from_arrays(F.array("model"), F.array(F.struct("per_file_results", "aggregated")))
    return files.select(F.lit(kind).alias("comparison_type"), F.lit(timestamp).alias("timestamp"), told(system_info or {"spark": results.sparkSession.version}).alias("system_info"), told(dataset or {"name": "unnamed"}).alias("dataset"), body.alias("pipelines"))


def write_report(report: DataFrame, path: str) -> None:
    """The documents of ``comparison_report``, a line of JSON each."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, required=REPORT_KEYS) -> DataFrame:
    """A stored report. It is an error if a key that is ``required`` is missing."""
    found = spark.read.json(path)
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise ValueError(f"the report lacks {', '.join(missing)}")
    return found


def unfinished(combinations: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations of a sweep that have no stored result yet."""
    return combinations.join(finished.select(*keys).distinct(), keys, "left_anti")


AUDIO = "mp3|wav|flac|m4a"


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of a folder's audio files in the order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{AUDIO.replace('|', ',')}}}").load(path)
    return files.select("path", "length").orderBy("path")


def alignment(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(path relative to the folder, speaker, is_reference): files in <speaker>/audio_chunks, or those of ``known`` (path, speaker), and the clips in speaker_references."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    root = F.lit(folder.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/")
    rest = files.select(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), root, F.lit(r"\E"))), -1).alias("path"))
    clips = rest.select("path", F.upper(F.regexp_extract("path", r"^speaker_references/([^/]+)\.mp3$", 1)).alias("speaker"), F.lit(True).alias("is_reference"))
    found = rest.select("path", F.upper(F.regexp_extract("path", rf"^([^/]+)/audio_chunks/[^/]+\.(?:{AUDIO})$", 1)).alias("speaker")) if known is None else known.select("path", "speaker")
    return found.withColumn("is_reference", F.lit(False)).union(clips).where("speaker <> ''")


def timing_report(times: DataFrame, total: float, width: int = 40) -> DataFrame:
    """(place, line): a line for each component (component, seconds), the longest first, with a bar and its share of the total. For a run's few components."""
    top = F.max("seconds").over(Window.partitionBy())
    bar = F.repeat(F.lit("█"), F.coalesce(F.floor(F.col("seconds") / F.nullif(top, F.lit(0.0)) * width), F.lit(0)).cast("int"))
    share = F.col("seconds") * 100.0 / total if total > 0 else F.lit(0.0)
    line = F.format_string(f"%-30s %-{width}s %6.2fs (%5.1f%%)", F.initcap(F.replace("component", F.lit("_"), F.lit(" "))), bar, F.col("seconds"), share)
    return times.select(F.row_number().over(Window.orderBy(F.desc("seconds"), "component")).alias("place"), line.alias("line"))
