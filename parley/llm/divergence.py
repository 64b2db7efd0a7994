"""How much the sources of a language differ in their words: pairs of sources, and the terms that mark a source.

Terms that many groups have are taken as dense NumPy tiles of counts, each group against each other. A rare term mostly adds what a term with no
counts at all adds, which is the same for all of them; what one side's count changes is summed by distinct counts, and only groups that
share a posting meet, for a correction. Both sums are of whole numbers and are added exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_limits, batches, release, stage

#: On lower-cased UTF-8: letters and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^a-z\x80-\xff]")
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, a int, b int, value long"
#: Counts and groups, from which a row or a table may no longer be sent to all.
MOST_GROUPS, MOST_UNITS = 200_000, 10_000


def windows(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut where no term is."""
    at = 0
    while at < len(raw):
        cut = GAP.search(raw, at + size) if at + size < len(raw) else None
        to = cut.start() if cut else len(raw)
        yield raw[at:to]
        at = to


def _counted(most: int = 250_000):
    """Counts of terms by group and of the documents that hold them: summed within a task, and given out when there are over ``most`` of them."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def given(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])], schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for table in batches(frames):
            for lang, source, text in zip(table["lang"].to_pylist(), table["source"].to_pylist(), table["text"].cast(pa.binary())):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                raw, own, size = text.as_py().lower(), set(), size - len(n)
                for part in windows(raw):
                    found = TERM.findall(part)
                    n.update(found)
                    own.update(found)
                docs.update(own)
                size += len(n)
                if size > most:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)
        release()

    return run


def scaled(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / of), three digits at a time: exact while ``of`` is below 9 * 10**15."""
    whole, rest = np.divmod(n + 1, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Tile:
    """Sums over terms for the groups of one block against those of another. ``ni``, ``nj``: the groups' N + V; ``dense``: from how many groups a term is heavy."""

    def __init__(self, ni: np.ndarray, nj: np.ndarray, first_i: int, first_j: int, dense: int):
        self.ni, self.nj, self.first, self.dense = ni, nj, (first_i, first_j), dense
        self.p0, self.q0 = scaled(np.zeros_like(ni), ni), scaled(np.zeros_like(nj), nj)
        self.f00 = apart(self.p0[:, None], self.q0[None, :])
        self.out = np.zeros((len(ni), len(nj)), dtype=np.int64)

    def add(self, sizes: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        """Terms with ``sizes`` postings each, one after another."""
        term = np.repeat(np.arange(len(sizes)), sizes)
        heavy = sizes >= self.dense
        sides = []
        for first, n in zip(self.first, (self.ni, self.nj)):
            at = np.flatnonzero((groups >= first) & (groups < first + len(n)))
            sides.append((term[at], groups[at] - first, counts[at]))
        if heavy.any():
            place = np.cumsum(heavy) - 1
            p, q = [self._dense(side, heavy, place, n) for side, n in zip(sides, (self.ni, self.nj))]
            for a in range(len(self.ni)):
                self.out[a] += apart(p[:, a, None], q).sum(axis=0)
        light = [tuple(x[~heavy[side[0]]] for x in side) for side in sides]
        self.out += int((~heavy).sum()) * self.f00
        self._one_side(light)
        self._both_sides(light)

    def _dense(self, side, heavy, place, n) -> np.ndarray:
        t, g, c = side
        out = np.zeros((int(heavy.sum()), len(n)), dtype=np.int64)
        mine = heavy[t]
        out[place[t[mine]], g[mine]] = c[mine]
        return scaled(out, n[None, :])

    def _one_side(self, light) -> None:
        """What a count on one side changes, the other side having none: once for each group and distinct count."""
        for side, (_, g, c) in enumerate(light):
            if not len(g):
                continue
            (g, c), times = np.unique(np.stack([g, c]), axis=1, return_counts=True)
            if side == 0:
                change = apart(scaled(c, self.ni[g])[:, None], self.q0[None, :]) - self.f00[g]
                np.add.at(self.out, g, change * times[:, None])
            else:
                change = apart(self.p0[:, None], scaled(c, self.nj[g])[None, :]) - self.f00[:, g]
                np.add.at(self.out.T, g, (change * times[None, :]).T)

    def _both_sides(self, light) -> None:
        """Corrections where both sides have counts: postings of one rare term meet each other."""
        (ti, gi, ci), (tj, gj, cj) = light
        begin, end = np.searchsorted(tj, ti, "left"), np.searchsorted(tj, ti, "right")
        many = end - begin
        left = np.repeat(np.arange(len(ti)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        a, b = gi[left], gj[right]
        p, q = scaled(ci[left], self.ni[a]), scaled(cj[right], self.nj[b])
        np.add.at(self.out, (a, b), apart(p, q) - apart(p, self.q0[b]) - apart(self.p0[a], q) + self.f00[a, b])


def _tiles(block: int, share: float, at_once: int = 1 << 16):
    """Partial sums of pairs of groups. Rows come sorted by unit (lang, i, j)."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units():
            for frame in frames:
                heads = list(zip(*(frame.column(c).to_pylist() for c in ("lang", "i", "j"))))
                at = 0
                for key, rows in groupby(heads):
                    n = len(list(rows))
                    yield key, frame.slice(at, n)
                    at += n

        for (lang, i, j), parts in groupby(units(), lambda x: x[0]):
            tile = None
            for _, part in parts:
                if tile is None:
                    ni, nj, of = (part.column(c)[0].as_py() for c in ("ni", "nj", "groups"))
                    tile = Tile(np.array(ni, np.int64), np.array(nj, np.int64), i * block, j * block, max(2, int(np.ceil(share * min(of, block)))))
                lists = part.column("postings")
                sizes, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
                groups, counts = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                ends = np.cumsum(sizes)
                # light terms have fewer than share * block postings, so a slice of some terms stays small
                step = max(1, at_once // max(1, len(tile.ni)))
                for low in range(0, len(sizes), step):
                    to = min(low + step, len(sizes))
                    span = slice(ends[low] - sizes[low], ends[to - 1])
                    tile.add(sizes[low:to], groups[span], counts[span])
            a, b = np.indices(tile.out.shape).reshape(2, -1)
            a, b, value = a + i * block, b + j * block, tile.out.ravel()
            mine = a != b
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, int(mine.sum())), pa.array(a[mine].astype(np.int32)), pa.array(b[mine].astype(np.int32)), pa.array(value[mine])], schema=schema)
        release()

    return run


def _sent(small: DataFrame, rows: int, most: int) -> DataFrame:
    """``small`` as a broadcast if it has no more rows than ``most``; else the join is a shuffle."""
    return F.broadcast(small) if rows <= most else small


def _share(n: str, of: str):
    """1 + floor(10**9 * (n + 1) / of) in decimals, exact."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div ({of})")


def audit(docs: DataFrame, least: int = 3, top: int = 200, block: int = 256, share: float = 0.25, salts: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each source of a language with each other one, part ``term`` has its ``top`` marking terms.

    Only ``lang``, ``source`` and ``text`` of ``docs`` are read; null ones are empty. Every row is a document. A language keeps the terms that at least ``least`` of its
    documents hold. Groups are compared in blocks of ``block``. A term is heavy that as many groups have as ``share`` of a block, or of the language's groups if these are fewer. A language without kept terms gives pairs of
    value 0 and no terms; an empty table gives nothing. The pairs are as many as the result has by definition: groups of a language squared.
    """
    spark = docs.sparkSession
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    order = Window.partitionBy("lang").orderBy("source")
    groups = stage(clean.select("lang", "source").distinct().withColumn("g", F.row_number().over(order) - 1), "audit-groups")
    n_groups = groups.count()
    sent = lambda x: _sent(x, n_groups, MOST_GROUPS)
    with batch_limits(spark):
        # tasks have summed what they read, so a term sends at most one row for each task and source, and one exchange serves both sums
        counts = clean.mapInArrow(_counted(), COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = counts.join(sent(groups), ["lang", "source"]).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("postings"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = stage(terms.where(F.col("docs") >= least).drop("docs"), "audit-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_of"), F.count("*").alias("v"))
    of_group = kept.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.g").agg(F.sum("x.n").alias("n"))
    totals = groups.join(of_group, ["lang", "g"], "left").join(of_lang, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    totals = stage(totals.select("lang", "g", "source", (F.coalesce("n", F.lit(0)) + v).alias("of"), (F.coalesce("lang_of", F.lit(0)) + v).alias("lang_of")), "audit-totals")

    held = totals.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "of"))), lambda x: x["of"]).alias("of"), F.count("*").cast("int").alias("groups"))
    blocks = lambda: F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / block).cast("int")))
    units = held.withColumn("i", blocks()).withColumn("j", blocks())
    units = units.select("lang", "groups", "i", "j", F.slice("of", F.col("i") * block + 1, block).alias("ni"), F.slice("of", F.col("j") * block + 1, block).alias("nj"))
    n_units = units.count()
    rows = kept.select("lang", "postings")
    if n_units <= MOST_UNITS:
        rows = rows.join(F.broadcast(units), "lang")
    else:
        salted = units.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("postings"), F.lit(salts)).cast("int")).join(salted, ["lang", "__salt"])
    sums = rows.select("lang", "i", "j", "groups", "ni", "nj", "postings").sortWithinPartitions("lang", "i", "j").mapInArrow(_tiles(block, share), PAIRS)
    span = lambda first, n: F.explode(F.sequence(F.col(first) * block, F.col(first) * block + F.size(n) - 1))
    zeros = units.withColumn("a", span("i", "ni")).withColumn("b", span("j", "nj")).where("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    pairs = sums.union(zeros).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("g").alias("a"), "source"), groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"))
    pairs = pairs.join(sent(names[0]), ["lang", "a"]).join(sent(names[1]), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    used = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("postings").alias("x")).select("*", "x.g", "x.n").join(sent(totals), ["lang", "g"])
    used = used.withColumn("p", _share("n", "of")).withColumn("q", _share("lang_n", "lang_of")).where("p > q")
    marks = used.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(marks.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT + count(*) AS of FROM vocab GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, v.term, v.n AS lang_n FROM groups g JOIN vocab v USING (lang)),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
filled AS (SELECT c.*, coalesce(k.n, 0)::HUGEINT AS n FROM cells c LEFT JOIN counts k USING (lang, source, term)),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 1)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source)::HUGEINT + count(*) OVER (PARTITION BY f.lang, f.source)) AS p,
  1 + (1000000000::HUGEINT * (f.lang_n + 1)) // l.of AS q FROM filled f JOIN langs l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
marks AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM marks)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows) WHERE part = 'pair' OR rank <= 200
"""
