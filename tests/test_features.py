"""Rules of the naive segmenter, peaks, label matrices, registry, report and phonemes, against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from parley.operators import intervals, sequences, speakers, words
from parley.sources import annotations


def test_best_or_unknown(spark):
    rows = [(1, "a", 0.9, 0.75), (2, "a", 0.9, 0.6), (3, "b", 0.4, 0.39), (4, "b", 0.5, None), (5, "b", 0.5, 0.4), (6, None, None, None)]
    got = speakers.best_or_unknown(spark.createDataFrame(rows, "vec_id long, best string, score double, second double"), 0.5).orderBy("vec_id").collect()
    assert [(r["speaker"], r["is_overlap"]) for r in got] == [("a", True), ("a", False), ("unknown", False), ("b", False), ("b", False), ("unknown", False)]


def test_runs_end_at_flags_and_durations(spark):
    rows = [("r", 0, 0.0, 1.0, "A", False, 0.5), ("r", 1, 1.0, 2.0, "A", False, 0.7), ("r", 2, 2.0, 3.0, "A", True, 0.9), ("r", 3, 3.0, 4.0, None, True, 0.1), ("r", 4, 4.0, 5.0, None, True, 0.3), ("q", 0, 0.0, 1.0, "A", None, 1.0)]
    df = spark.createDataFrame(rows, "rec string, ord long, s double, e double, spk string, flag boolean, sim double")
    got = [tuple(r) for r in sequences.run_lengths(df, "sim", "flag", spark.createDataFrame([("r", 9.0)], "rec string, dur double")).orderBy("rec", "s").collect()]
    assert [(*g[:-1], round(g[-1], 6)) for g in got] == [("q", "A", None, 0.0, 1.0, 1, 1.0), ("r", "A", False, 0.0, 2.0, 2, 0.6), ("r", "A", True, 2.0, 3.0, 1, 0.9), ("r", None, True, 3.0, 9.0, 2, 0.2)]


def plain_peaks(x, prominence, distance):
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        low = []
        for step in (-1, 1):
            q, least = p, x[p]
            while 0 <= q + step < len(x) and x[q + step] <= x[p]:
                q += step
                least = min(least, x[q])
            low.append(least)
        if x[p] - max(low) >= prominence:
            out.append(p)
    return out


def test_peaks_equal_a_plain_scan(spark):
    rng = random.Random(11)
    recs = {f"r{k}": [rng.choice([0.0, 0.1, 0.1, 0.3, 0.5, 0.9]) for _ in range(rng.choice([1, 2, 3, 40, 300]))] for k in range(12)} | {"flat": [0.5] * 9, "steps": [0, 1, 1, 1, 2, 2, 1, 1, 3, 3]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in recs.items() for i, v in enumerate(x)], "rec string, ix long, score double").repartition(3)
    for prominence, distance in ((0.0, 1), (0.2, 1), (0.15, 4)):
        got = {}
        for r in sequences.peaks(df, prominence, distance).collect():
            got.setdefault(r["rec"], []).append(r["ix"])
        assert {k: sorted(v) for k, v in got.items()} == {k: p for k, x in recs.items() if (p := plain_peaks(x, prominence, distance))}


def test_labels_in_one_matrix_or_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(90, 5)), [f"n{i % 7}" if i else "alone" for i in range(90)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(90), "label": label, "v": [r.tolist() for r in x]})).repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = sorted(set(label))
    for most in (20_000, 0):
        defaults = list(speakers._against_labels.__defaults__)
        monkeypatch.setattr(speakers._against_labels, "__defaults__", (2 if most == 0 else defaults[0], most))
        got = {r["vec_id"]: r["predicted"] for r in speakers.leave_one_out(df).collect()}
        for i in range(90):
            scores = {}
            for n in names:
                own = [j for j in range(90) if label[j] == n and j != i]
                if own:
                    c = x[own].sum(axis=0)
                    scores[n] = float(u[i] @ c / np.linalg.norm(c))
            assert scores[got[i]] == pytest.approx(max(scores.values()))
        got = {r["vec_id"]: r["silhouette"] for r in speakers.cosine_silhouette(df).collect()}
        far = 1 - u @ u.T
        for i in range(90):
            own = [j for j in range(90) if label[j] == label[i] and j != i]
            b = min(far[i][[j for j in range(90) if label[j] == n]].mean() for n in names if n != label[i])
            a = far[i][own].mean() if own else None
            assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))


def test_registry_upserts_touch_their_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    table = lambda rows: spark.createDataFrame(rows, "name string, v array<double>")
    annotations.upsert_registry(table([(f"s{i}", [1.0, float(i)]) for i in range(40)] + [(None, [1.0])]), path, 1, 8)
    stamp = lambda: {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in (tmp_path / "registry").glob("bucket=*")}
    before = stamp()
    annotations.upsert_registry(table([("s3", [0.0, 2.0]), ("new", [3.0, 4.0])]), path, 2, 8)
    after = stamp()
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    annotations.upsert_registry(table([("s3", [9.0, 9.0])]), path, 1, 8)  # an older version
    annotations.upsert_registry(table([]), path, 3, 8)
    rows = {r["name"]: r["v"] for r in annotations.read_registry(spark, path).collect()}
    assert len(rows) == 41 and rows["s3"] == [0.0, 1.0] and rows["new"] == pytest.approx([0.6, 0.8])
    held = stamp()
    broken = table([("s1", [1.0, 1.0])]).withColumn("v", words.F.when(words.F.rand() >= 0, words.F.raise_error(words.F.lit("no")).cast("array<double>")))
    with pytest.raises(Exception, match="no"):
        annotations.upsert_registry(broken, path, 9, 8)
    assert stamp() == held


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.0, None), ("a", "y", 3.0, 2.0), ("b", "x", 5.0, 1.0)], "model string, file string, der double, wer double")
    report = annotations.comparison_report(rows, "e2e", ["der", "wer"], "2024-01-01_00-00-00", {"os": "x"})
    annotations.write_report(report, f"file://{tmp_path}/r")
    found = annotations.read_report(spark, f"file://{tmp_path}/r")
    got = {r["pipelines"]["a"] and "a" or "b": r for r in found.collect()}
    one = got["a"]["pipelines"]["a"]
    assert (one["aggregated"]["der"]["mean"], one["aggregated"]["der"]["std"], one["aggregated"]["wer"]["n"], [f["file"] for f in one["per_file_results"]]) == (2.0, 1.0, 1, ["x", "y"])
    assert got["b"]["timestamp"] == "2024-01-01_00-00-00" and got["b"]["system_info"]["os"] == "x"
    report.drop("dataset").write.json(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="dataset"):
        annotations.read_report(spark, f"file://{tmp_path}/bad")


def test_phonemes(spark):
    entries = {"a": "AH", "ab": "AE B", "abc": "X", "c": "K", "the": "DH AH", "th": "TH"}
    dictionary = spark.createDataFrame([*entries.items(), (None, "Z"), ("", "Z"), ("C", "S")], "word string, phonemes string")
    entries["c"] = "K"  # the smaller of two
    texts = ["The abc", "abab cab", None, "  ", "zzz", "thea th!c", "ABCA"]
    rows = spark.createDataFrame([(i, t, None if i == 2 else i, i + 1, "kept") for i, t in enumerate(texts)], "id long, text string, s int, e int, more string")

    def plain(text):
        out = []
        for w in (text or "").lower().split():
            at, said = 0, []
            while at < len(w):
                n = next((n for n in range(len(w) - at, 0, -1) if w[at : at + n] in entries), 0)
                said += [entries[w[at : at + n]]] if n else []
                at += n or 1
            out += [" ".join(said)] if said else []
        return " ".join(out)

    got = words.with_phonemes(rows, dictionary, ["id"]).orderBy("id").collect()
    assert [r["phonemes"] for r in got] == [plain(t) for t in texts]
    assert [(r["s"], r["e"], r["more"]) for r in got] == [(0.0 if i == 2 else float(i), i + 1.0, "kept") for i in range(len(texts))]
    assert words.with_phonemes(rows, dictionary.limit(0), ["id"]).count() == len(texts)


def test_lookups_by_equal_keys(spark):
    regions = spark.createDataFrame([("r", 0.1 + 0.2, 1.0), ("r", 0.3, 1.0), ("r", None, 1.0)], "rec string, s double, e double")
    made = spark.createDataFrame([("r", 0.3, 1.0, "x"), ("r", None, 1.0, "y")], "rec string, s double, e double, found string")
    assert sorted((r["s"] or -1, r["found"]) for r in intervals.with_processed(regions, made).collect()) == [(-1, None), (0.3, "x"), (0.1 + 0.2, None)]
    people = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, None, "C")], "region int, idx int, spk string")
    vectors = spark.createDataFrame([(1, 1, 7, 3), (2, None, 8, 4)], "region int, idx int, cluster int, place int")
    assert sorted((r["spk"], r["cluster"]) for r in intervals.with_embeddings(people, vectors).collect()) == [("A", None), ("B", 7), ("C", None)]


def test_stages_by_name(spark):
    from parley.plans import registry

    rows = spark.createDataFrame([("r", 0, 0.0, 1.0, "A"), ("r", 1, 1.05, 2.0, "A"), ("r", 2, 2.0, 2.1, "B")], "rec string, ord long, s double, e double, spk string")
    got = registry.run([("merge_same_speaker", {"gap": 0.1}), ("min_duration", {"least": 0.5})], rows).collect()
    assert [(r["spk"], r["s"], r["e"]) for r in got] == [("A", 0.0, 2.0)]
    with pytest.raises(ValueError):
        registry.stage("merge")(lambda table: table)
    shout = lambda frames: (pdf.assign(spk=pdf["spk"] + "!") for pdf in frames)
    assert {r["spk"] for r in registry.model(rows.select("spk"), shout, "spk string").collect()} == {"A!", "B!"}


def test_distances_and_small_functions(spark):
    from parley.functions import text as T
    from parley.functions import vectors

    row = spark.range(1).select(T.rolling_prompt(T.F.lit("one two"), T.F.lit("three"), 9).alias("p")).first()
    assert row["p"] == "two three"
    made = spark.createDataFrame([("a b", "a c"), ("d", "d"), ("", "x")], "ref string, hyp string").withColumn("g", T.F.lit(1)).withColumn("n", T.F.monotonically_increasing_id())
    whole = T.joined_texts(made, ["g"], ["n"], "ref", "hyp")
    assert whole.select(T.word_errors("ref", "hyp")).first()[0] == pytest.approx(200 / 3)  # a b d against a c d x
    assert annotations.split_plan(spark.createDataFrame([("r", 25.0), ("q", 0.0)], "rec string, duration double"), 10.0).orderBy("part").select("s", "e").collect() == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0)]
    files = spark.createDataFrame([("d/combined_part001.wav",), ("d/001.flac",), ("d/002.txt",)], "path string")
    got = {r["id"]: r["path"] for r in annotations.pair_by_stem(spark.createDataFrame([("001",), ("002",)], "id string"), files).collect()}
    assert got == {"001": "d/001.flac", "002": None}
    odd = [[1.0, -2.0, 2.0], [], None, [0.0, 0.0], [1.0, float("nan")], [None, 3.0]]
    df = spark.createDataFrame([(i, v, [0.0, 2.0]) for i, v in enumerate(odd)], "i int, v array<double>, w array<double>")
    rows = df.select(vectors.l1("v", "w").alias("l1"), vectors.euclid("v", "w").alias("l2"), vectors.sound("v").alias("sound")).collect()
    assert (rows[0]["l1"], [r["sound"] for r in rows]) == (7.0, [True, False, False, False, False, True])
    pair = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "v array<double>, w array<double>").select(vectors.euclid("v", "w")).first()[0]
    assert pair == 5.0
    energies = spark.createDataFrame([([2.0, 8.0],), ([3.0],), ([0.0, 0.0],)], "e array<double>").select(vectors.energy_ratio("e")).collect()
    assert [r[0] for r in energies] == [0.25, None, 0.0]


def test_similarity_without_pairs(spark):
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(40, 4)), np.arange(40) % 6
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(40), "label": label, "v": [r.tolist() for r in x]}))
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = np.stack([x[label == k].mean(axis=0) for k in range(6)])
    row = speakers.similarity(df).first()
    assert row["intra"] == pytest.approx((unit(x) * unit(centres)[label]).sum(axis=1).mean())
    between = unit(centres) @ unit(centres).T
    assert row["inter"] == pytest.approx(between[np.triu_indices(6, 1)].mean())
    for few in (df.where("label = 2"), df.where("vec_id < 3"), df.limit(0)):
        assert tuple(speakers.similarity(few).first()) == (1.0, 0.0)


def test_presets_are_read_again_when_they_change(spark, tmp_path):
    import os

    file, path = tmp_path / "p.json", f"file://{tmp_path}/p.json"
    assert annotations.reload_presets(spark, path) == (None, -1)
    file.write_text('{"fast": {"interval": 1}}')
    held, at = annotations.reload_presets(spark, path)
    assert annotations.reload_presets(spark, path, held, at)[0] is held
    assert annotations.reload_presets(spark, path, held, at, force=True)[0] is not held
    file.write_text('{"slow": {"interval": 2}, "_x": {"y": 1}}')
    os.utime(file, (at / 1000 + 5, at / 1000 + 5))
    assert [r["preset"] for r in annotations.reload_presets(spark, path, held, at)[0].collect()] == ["slow"]


def test_pairs_by_position_warn(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "path string") for names in (["b", "a", "c"], ["y", "x"]))
    with pytest.warns(UserWarning, match="3 on the left"):
        pairs = annotations.pair_by_position(a, b, "path")
    assert sorted((r["path"], r["path_other"]) for r in pairs.collect()) == [("a", "x"), ("b", "y")]
    assert annotations.pair_by_position(a, a, "path", limit=2).count() == 2
