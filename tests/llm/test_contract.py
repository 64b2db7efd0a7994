"""The registered queries on the smallest tables: names, types, numbers of rows, and what can be said of their values without the operator; and the pipeline's stages on odd rows."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import pytest

import corpus_pipeline
from parley.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_pivot_neardup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_histogram_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_collision_counting": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_curriculum_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, copies int, position double",
    "op10_warc_index_first": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op12_url_cascade": "page_id bigint, host string, path string, rule string, verdict string",
    "op13_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_query(spark, texts, name):
    df = queries.queries()[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert all(kinds.get(c.split()[0]) == c.split()[1] for c in COLUMNS[name].split(", ")), kinds
    rows = df.collect()
    if "doc_id" in kinds and name != "op4_best_fit_packing":
        assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    if "held_out" in kinds:
        n, fold = (5, 0) if name.startswith("op1_") else (7, 2)
        assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % n == fold) for r in rows)
    if name == "op1_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name == "op6_histogram_sharding":
        assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b := texts[r["doc_id"]].encode()) + 1, crc32(b), "bytes", None) and 0 <= r["shard"] < 8 for r in rows)
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(8))
    if name == "op4_best_fit_packing":
        assert {r["doc_id"] for r in rows} == set(texts) and all(0 < r["length"] <= 4096 and r["offset"] + r["length"] <= 4096 for r in rows)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "pages", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        found = con.execute(queries.oracle_sql()[name]).fetchall()
        names = [c[0] for c in con.description]
        tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        assert sorted(names) == sorted(df.columns) and Counter(tidy(r[c] for c in names) for r in rows) == Counter(map(tidy, found))


def test_score_is_the_noisy_or_of_sentences(spark):
    model = toxicity.NoisyOr(-2.0, {"bad": 3.0, "badl*": 0.5, "good": -1.0})
    docs = spark.createDataFrame([(1, "Bad bad! Good day.\nbadly"), (2, ""), (3, None)], "doc_id long, text string")
    logit = lambda z: 1 / (1 + math.exp(-z))
    want = {1: 1 - (1 - logit(1.0)) * (1 - logit(-3.0)) * (1 - logit(-1.5)), 2: logit(-2.0), 3: logit(-2.0)}
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()} == pytest.approx(want)


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns named like the results of an operator come out of each stage as they went in."""
    names = ["Score", "predicted", "n_sentences", "worst_start", "size", "target", "taken", "copies", "position", "copy", "n_removed", "component_id", "source_size"]
    docs = spark.createDataFrame([(i, f"text of number {i} " * 4 + f"and {i * i} more", "en", "s", 1, *[f"{n} {i}" for n in names]) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, function in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stage(function(spark, docs, f"file://{tmp_path}"), f"clash-{name}")
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name


def test_pipeline_stages(spark, tmp_path):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(3000))
    rows = [(i, f"document number {i} tells of matter {i * i} and nothing else at all", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, long, "en", "s1", 5), (103, long + " end", "en", "s1", 5), (104, rows[3][1], "en", None, 1), (None, "no id here", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        held, counts = table, []
        for name, function in corpus_pipeline.STAGES:
            held = corpus_pipeline.stage(function(spark, held, f"file://{tmp_path}"), f"test-{name}")
            assert name == "packing" or held.columns == docs.columns
            counts.append({r["doc_id"] for r in held.select("doc_id").collect()})
        if table is docs:
            assert counts[0] == {r[0] for r in rows} and counts[1] == counts[0] - {103, 104} and counts[2] == counts[1]
            assert counts[4] == counts[3] <= counts[2]
        else:
            assert counts == [set()] * 5
