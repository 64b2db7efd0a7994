"""Verdicts on urls by rules for hosts and paths, looked up in Bloom filter cascades.

A rule is a host and the beginning of a path, written together (``example.net/en/``). It fits urls of that host and of its subdomains whose
path begins so; of those that fit, the longest decides. A url can only be fitted by one rule of each *shape* (labels of the host, length of
the path), so it asks for one key a shape.

Whether a key is listed is read from a cascade. Its first filter holds the listed keys; the next one holds the keys of the corpus that pass the
first though they are not listed; the next one the listed keys that pass the second, and so on until nothing passes by mistake. All keys
that the corpus asks for are known beforehand, so the answer is exact for them (up to equal 128-bit hashes), and no url is joined with the lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, mix64, stage

LEVELS = "segment long, levels array<struct<size: long, probes: int, bits: binary>>"
#: Beyond so many levels two keys have equal hashes, or nearly so.
MOST_LEVELS = 64


class Level(NamedTuple):
    """A Bloom filter of ``size`` bits."""

    size: int
    probes: int
    bits: np.ndarray

    def places(self, a: np.ndarray, b: np.ndarray, number: int) -> Iterator[np.ndarray]:
        salt = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) & (2**64 - 1))
        at, step = mix64(a ^ salt), mix64(b + salt) | np.uint64(1)
        for _ in range(self.probes):
            yield at % np.uint64(self.size)
            at = at + step

    def holds(self, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
        found = np.ones(len(a), dtype=bool)
        for at in self.places(a, b, number):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def level(a: np.ndarray, b: np.ndarray, number: int, rate: float) -> Level:
    """A filter of the keys with hashes ``a`` and ``b`` that other keys pass at about ``rate``."""
    size = max(64, int(np.ceil(-len(a) * np.log(rate) / np.log(2) ** 2)))
    out = Level(size, max(1, round(-np.log2(rate))), None)
    held = np.zeros(size, dtype=bool)
    for at in out.places(a, b, number):
        held[at] = True
    return out._replace(bits=np.packbits(held, bitorder="little"))


def build(listed: tuple[np.ndarray, np.ndarray], passed: tuple[np.ndarray, np.ndarray], rate: float) -> list[Level]:
    """All levels of one segment: of its listed keys, and of those others that pass the first level."""
    levels = [level(*listed, 0, rate)]
    held, other = listed, passed
    while len(other[0]):
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys of the lists and of the corpus have equal hashes")
        levels.append(level(*other, len(levels), 0.5))
        still = levels[-1].holds(*held, len(levels) - 1)
        held, other = other, (held[0][still], held[1][still])
    return levels


def listed(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: a key that first fails at an odd level is, one that fails at an even level isn't; one that passes all is if the last is even."""
    out = np.full(len(a), len(levels) % 2 == 1)
    left = np.arange(len(a))
    for k, one in enumerate(levels):
        ok = one.holds(a[left], b[left], k)
        out[left[~ok]] = k % 2 == 1
        left = left[ok]
    return out


def _in_segments(a: np.ndarray, b: np.ndarray, segments: int, cascades: dict) -> np.ndarray:
    """Looks keys up in the cascade of their segment; a segment without one has no listed keys, or is another pass's."""
    out, of = np.zeros(len(a), dtype=bool), a.view(np.int64) % segments
    for s in np.unique(of):
        if int(s) in cascades:
            at = np.flatnonzero(of == s)
            out[at] = listed(cascades[int(s)], a[at], b[at])
    return out


def _words(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _rows(segment: int, levels: list[Level]) -> pd.DataFrame:
    return pd.DataFrame({"segment": [segment], "levels": [[{"size": x.size, "probes": x.probes, "bits": x.bits.tobytes()} for x in levels]]})


def _gathered(rows: DataFrame) -> dict[int, list[Level]]:
    return {r["segment"]: [Level(x["size"], x["probes"], np.frombuffer(x["bits"], np.uint8)) for x in r["levels"]] for r in rows.collect()}


def cascades(keys: DataFrame, universe: DataFrame, each: int = 200_000, most_bytes: int = 64 << 20) -> Iterator[tuple[int, dict[int, list[Level]]]]:
    """Cascades of ``keys`` against ``universe``, both distinct (a long, b long): the number of segments, and {segment: levels}, of ``most_bytes`` or so at a time.

    Keys are dealt to segments by hash, about ``each`` listed ones a segment, whose cascade is built by one task. A pass over the universe
    finds what passes the first levels; the rest is as small as the lists.
    """
    n, all_keys = keys.count(), universe.count()
    segments = max(1, -(-n // each))
    rate = min(0.5, n / (2**0.5 * max(all_keys, 1)))
    # the first level's bits, and some 3 more a key in the levels after it
    bits = n / segments * (-np.log2(max(rate, 1e-18)) / np.log(2) + 3) if n else 1
    at_once = max(1, int(most_bytes * 8 // max(1, bits)))
    sc = keys.sparkSession.sparkContext
    of = F.pmod("a", F.lit(segments)).cast("long")
    for first in range(0, segments, at_once):
        mine = (F.col("segment") >= first) & (F.col("segment") < first + at_once)
        here = keys.withColumn("segment", of).where(mine)
        start = sc.broadcast(_gathered(here.groupBy("segment").applyInPandas(lambda k, x: _rows(int(k[0]), [level(_words(x["a"]), _words(x["b"]), 0, rate)]), LEVELS)))
        others = universe.where(_passes(start, segments)("a", "b")).join(keys.hint("shuffle_hash"), ["a", "b"], "left_anti").withColumn("segment", of)

        def whole(k, x, y):
            return _rows(int(k[0]), build((_words(x["a"]), _words(x["b"])), (_words(y["a"]), _words(y["b"])), rate))

        yield segments, _gathered(here.groupBy("segment").cogroup(others.groupBy("segment")).applyInPandas(whole, LEVELS))


def _passes(first, segments: int):
    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_in_segments(_words(a), _words(b), segments, first.value))

    return passes


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host goes from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there to ``?``, ``#`` or the end. Both are empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    head = F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))
    return ascii_lower(host), F.substr(head, F.length(host) + F.lit(1))


def _key(labels: Column, path: Column, n: Column, length: Column) -> Column:
    return F.concat(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."), F.substr(path, F.lit(1), length))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", most_bytes: int = 64 << 20) -> DataFrame:
    """(key, url, host, path, rule, verdict) for each row of ``pages``. ``rules`` (rule string, verdict string) are hosts and beginnings of paths.

    The longest rule that fits gives the verdict, the one with more labels in its host if two are equally long, and of one rule under two verdicts
    the greater (``block`` over ``allow``). Where none fits the key is in no list, and the verdict is ``default``. Null urls and urls without ``://``
    have an empty host, which no rule fits; null rules, rules without a host and repeated rows of rules are ignored. Repeated rows of pages stay.
    There is a cascade a verdict. Lists whose cascades pass ``most_bytes`` are looked up in several passes, stored in between.
    """
    spark = pages.sparkSession
    cut = F.instr(F.concat("rule", F.lit("/")), "/")
    rules = rules.select("rule", "verdict").where("rule is not null and verdict is not null").select("verdict", F.concat(ascii_lower(F.substr("rule", F.lit(1), cut - 1)), F.substr("rule", cut)).alias("rule"), (cut - 1).alias("host_length")).where("host_length > 0")
    rules = stage(rules.select("verdict", "rule", F.size(F.split(F.substr("rule", F.lit(1), F.col("host_length")), r"\.", -1)).alias("n"), (F.length("rule") - F.col("host_length")).cast("int").alias("length")).distinct(), "url-rules")
    # shapes: labels of hosts times lengths of paths that lists have; not a row for each rule
    shapes = [(r["n"], r["length"]) for r in rules.select("n", "length").distinct().collect()]
    verdicts = sorted(r[0] for r in rules.select("verdict").distinct().collect())
    host, path = parts(F.col(url))
    out = pages.select(F.col(key), F.col(url), host.alias("host"), path.alias("path")).withColumn("__labels", F.split("host", r"\.", -1))
    if not shapes:
        return out.select(key, url, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    offered = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(length).alias("length")) for n, length in sorted(shapes)])
    fitting = F.filter(offered, lambda x: (F.size("__labels") >= x["n"]) & (F.length("path") >= x["length"]))
    keys = F.transform(fitting, lambda x: F.struct(_key(F.col("__labels"), F.col("path"), x["n"], x["length"]).alias("key"), x["n"].alias("n")))
    longest = F.reverse(F.array_sort(F.transform(keys, lambda x: F.struct(F.length(x["key"]).alias("length"), x["n"].alias("n"), x["key"].alias("key")))))
    asked = F.when(F.col("host") != "", F.transform(longest, lambda x: x["key"])).otherwise(F.array().cast("array<string>"))
    out = out.select(key, url, "host", "path", asked.alias("__keys"), F.lit(None).cast("int").alias("__place"), F.lit(None).cast("string").alias("__verdict"))
    hashed = lambda k: [F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")]
    universe = stage(out.select(F.explode("__keys").alias("k")).select(*hashed(F.col("k"))).distinct(), "url-universe")
    passes = 0
    for verdict in verdicts:
        mine = rules.where(F.col("verdict") == verdict).select(*hashed(F.col("rule"))).distinct()
        for segments, cascade in cascades(mine, universe, most_bytes=most_bytes):
            passes += 1
            if passes > len(verdicts):  # more than one broadcast a verdict: the earlier ones' work is stored first
                out = stage(out, "url-verdicts")
            found = _first_listed(spark.sparkContext.broadcast(cascade), segments)
            place = found(F.transform("__keys", lambda k: F.xxhash64(k)), F.transform("__keys", lambda k: F.xxhash64(F.lit(1), k)))
            out = out.withColumn("__found", place)
            better = F.col("__found").isNotNull() & (F.col("__place").isNull() | (F.col("__found") <= F.col("__place")))
            out = out.withColumns({"__place": F.when(better, F.col("__found")).otherwise(F.col("__place")), "__verdict": F.when(better, F.lit(verdict)).otherwise(F.col("__verdict"))})
    return out.select(key, url, "host", "path", F.get("__keys", F.col("__place")).alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def _first_listed(cascade, segments: int):
    """The place of the first key of each row's list that is listed, or null."""

    @F.pandas_udf("int")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in a], dtype=np.int64)
        if not sizes.sum():
            return pd.Series([None] * len(a), dtype="Int32")
        flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in c]).view(np.uint64) for c in (a, b)]
        hits = np.flatnonzero(_in_segments(*flat, segments, cascade.value))
        ends = np.cumsum(sizes)
        rows, first = np.unique(np.searchsorted(ends, hits, side="right"), return_index=True)
        out = pd.Series([None] * len(a), dtype="Int32")
        out.iloc[rows] = hits[first] - (ends - sizes)[rows]
        return out

    return found


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op12_url_cascade(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("url")


OP12_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rests AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
heads AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS head FROM rests),
urls AS (SELECT page_id, n, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(head, length(h) + 1) AS path FROM heads),
best AS (SELECT u.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)
"""
