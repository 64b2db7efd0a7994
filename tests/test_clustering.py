"""Choosing and refining clusterings, live rules and sources against plain Python."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import clustering, speakers
from parley.sources import annotations
from parley.streaming import live


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    x = np.concatenate([centres[rng.integers(0, 4, 70)] + rng.normal(size=(70, 6)) * 0.35, np.zeros((1, 6)), np.ones((2, 6))])
    rows = [(i, [float(c) for c in v], i % 3 if i < 72 else 9, i // 25) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, v array<double>, label int, grp int")


def unit(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def components(near):
    label = list(range(len(near)))
    for _ in range(len(near)):
        for i in range(len(near)):
            label[i] = min(label[j] for j in range(len(near)) if near[i][j] or i == j)
    return [c if label.count(c) > 1 else -1 for c in label]


def rand(a, b):
    two = lambda n: n * (n - 1) / 2
    ij = sum(two(sum(1 for p in zip(a, b) if p == q)) for q in set(zip(a, b)))
    i, j = sum(two(a.count(c)) for c in set(a)), sum(two(b.count(c)) for c in set(b))
    expected, most = i * j / two(len(a)), (i + j) / 2
    return 1.0 if most == expected else (ij - expected) / (most - expected)


def test_spanning_links_keep_components_at_every_distance(spark, vectors):
    x, df = vectors
    u = unit(x)
    links = [(r["a"], r["b"], r["score"]) for r in clustering.spanning_links(df, 0.0, block=20).collect()]
    for least in (0.05, 0.51, 0.83, 0.97):
        near = np.zeros((len(x), len(x)), dtype=bool)
        for a, b, s in links:
            near[a][b] |= s >= least
            near[b][a] |= s >= least
        assert components(near) == components(u @ u.T >= least)


def test_distance_search(spark, vectors, tmp_path):
    x, df = vectors
    u, truth = unit(x), [i % 3 if i < 72 else 9 for i in range(len(x))]
    want, steps = [], np.linspace(0.103, 1.003, 4)
    for eps in steps:
        found = components(u @ u.T >= 1 - eps)
        want.append((len(set(found) - {-1}), rand(truth, found)))
    best = max((i for i in range(4) if want[i][0] >= 2), key=lambda i: (want[i][1], -i), default=None)
    got = sorted(clustering.distance_search(df, f"file://{tmp_path}/a", low=0.103, high=1.003, steps=4).collect())
    assert [r["clusters"] for r in got] == [w[0] for w in want]
    assert [r["ari"] for r in got] == pytest.approx([w[1] for w in want])
    assert [r["chosen"] for r in got] == [i == best for i in range(4)]
    got = sorted(clustering.distance_for_count(df, f"file://{tmp_path}/b", 3, 0.103, 1.003, 4).collect())
    assert [r["chosen"] for r in got].index(True) == max(range(4), key=lambda i: (-abs(want[i][0] - 3), i))


def test_euclidean_silhouette(spark, vectors):
    x, df = vectors
    label = np.array([i % 3 if i < 72 else 9 for i in range(len(x))])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() == 1:
            want[i] = 0.0
            continue
        a, b = far[i][same].sum() / (same.sum() - 1), min(far[i][label == c].mean() for c in set(label) - {label[i]})
        want[i] = (b - a) / max(a, b)
    for block in (20, 2048):
        assert {r["vec_id"]: r["silhouette"] for r in clustering.euclidean_silhouette(df, block=block).collect()} == pytest.approx(want, abs=1e-6)
    assert {r["silhouette"] for r in clustering.euclidean_silhouette(df.where("label = 1")).collect()} == {0.0}
    assert clustering.euclidean_silhouette(df.limit(0)).count() == 0


def test_refined_passes(spark, vectors):
    x, df = vectors
    u, start = unit(x), {i: i % 5 for i in range(len(x))}
    labels = spark.createDataFrame([(i // 25, i, c) for i, c in start.items()], "grp int, vec_id long, cluster int")
    want = {}
    for g in range(3):
        ids = [i for i in range(len(x)) if i // 25 == g]
        now = [start[i] for i in ids]
        for _ in range(2):
            centres = []
            for c in range(5):
                own = [u[i] for i, k in zip(ids, now) if k == c]
                centres.append(unit(np.mean(own, axis=0)[None])[0] if own else np.zeros(6))
            now = [int(np.argmax(np.round(np.stack(centres) @ u[i], 12))) for i in ids]
        want |= dict(zip(ids, now))
    assert {r["vec_id"]: r["cluster"] for r in clustering.refined(df, labels, "grp", "vec_id", 5, 2).collect()} == want
    few = clustering.refined_linkage(df.where("vec_id < 4"), "grp", "vec_id", 4).orderBy("vec_id").collect()
    assert [r["cluster"] for r in few] == [0, 1, 2, 3]


def test_online_means(spark, vectors):
    x, df = vectors
    centres, counts, want = np.array([x[3], x[5]]), [1, 1], []
    for v in x[:25]:
        at = int(((centres - v) ** 2).sum(axis=1).argmin())
        centres[at] = (centres[at] * counts[at] + v) / (counts[at] + 1)
        counts[at] += 1
        want.append("ab"[int(((centres - v) ** 2).sum(axis=1).argmin())])
    got = clustering.online_means(df.where("grp = 0"), {"a": x[3].tolist(), "b": x[5].tolist()}, "grp", "vec_id").orderBy("vec_id").collect()
    assert [r["name"] for r in got] == want


def test_best_matches_in_blocks(spark, vectors):
    x, df = vectors
    u = unit(x)
    registry = df.where("vec_id < 31").select(F.col("vec_id").alias("name"), "v")
    for block, most in ((1000, 100_000), (4, 100_000), (4, 0)):
        for r in speakers.best_matches(df, registry, "vec_id", "name", block, most).collect():
            score = u[:31] @ u[r["vec_id"]]
            assert [r["score"], r["second"]] == pytest.approx(sorted(score)[-1:-3:-1], abs=1e-9)
            assert score[r["best"]] == pytest.approx(score.max(), abs=1e-9)
    one = speakers.best_matches(df, registry.where("name = 3"), "vec_id", "name").first()
    assert one["best"] == 3 and one["second"] is None


def test_best_reference(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    sources = spark.createDataFrame([(0, 1, (a + 0.1 * b).tolist()), (0, 2, (a * 3).tolist()), (0, 3, a[:20].tolist()), (1, 4, a.tolist())], "region int, id int, v array<double>")
    references = spark.createDataFrame([(0, "B", b.tolist()), (0, "A", a[:150].tolist())], "region int, name string, v array<double>")
    got = {r["id"]: r["name"] for r in speakers.best_reference(sources, references, "region", "id").collect()}
    assert got == {1: "A", 2: "A", 3: None, 4: None}


CHUNK = "session long, ord long, s double, e double, spk string, speech boolean, reset boolean"


def test_display_hold(spark):
    rows = [(1, 0, 0.0, 0.5, None, False), (1, 1, 1.0, 1.5, "A", True), (1, 2, 2.0, 2.5, None, False), (1, 3, 3.0, 3.4, None, False), (1, 4, 3.5, 4.0, None, False), (1, 5, 5.0, 5.5, None, True), (1, 6, 6.0, 6.5, None, False)]
    df = spark.createDataFrame([(*r, False) for r in rows], CHUNK)
    got = [r["shown"] for r in live.held_display(df, 1.5).orderBy("ord").collect()]
    assert got == [None, "A", "A", "A", None, None, "A"]  # unknown speech shows nothing, and does not replace who was last known


def test_microbatch_and_reset(spark):
    rows = [(1, i, i * 0.5, i * 0.5 + 0.5, "A", True, i == 6) for i in range(10)]
    got = live.folded(spark.createDataFrame(rows, CHUNK), live.Microbatch, reset="reset").orderBy("ord").collect()
    assert [r["ord"] for r in got] == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    # the first run is at 1.0 s, then one a second, each of what was kept (1 s) and what came since
    assert [(r["begins"], r["length"], r["due"]) for r in got][:6] == [(0.0, 0.5, False), (0.0, 1.0, False), (0.0, 1.5, True), (0.5, 1.5, False), (0.5, 2.0, True), (1.5, 1.5, False)]
    assert [(r["begins"], r["length"], r["due"]) for r in got][6:] == [(0.0, 0.5, False), (0.0, 1.0, True), (0.0, 1.5, False)]
    long = live.folded(spark.createDataFrame([(1, 0, 0.0, 9.0, "A", True, False)], CHUNK), live.Microbatch, least=99.0).first()
    assert (long["begins"], long["length"], long["due"]) == (4.0, 5.0, False)


def test_labels_and_expansion(spark):
    rows = [(["A", "B"], "C", ["D"], ["E"]), (["A"], "B", ["C"], ["E"]), ([], None, [], ["E", "F", "G"]), (["A"], None, ["A"], ["A", "F"]), (["A"], "A", [], [])]
    df = spark.createDataFrame(rows, "f array<string>, c string, s array<string>, r array<string>")
    got = [r[0] for r in df.select(live.expanded_speakers(F.col("f"), F.col("c"), F.col("s"), F.col("r"))).collect()]
    assert got == [["A", "B"], ["A", "B", "C"], ["E", "F"], ["A", "F"], ["A"]]
    rows = spark.createDataFrame([(None, 0.5, 9.0), (None, 2.0, 0.1), (None, 2.0, 0.5), ("A", 0.0, 0.0)], "c string, t double, n double")
    assert [r[0] for r in rows.select(live.warm_up_label(F.col("c"), F.col("t"), F.col("n"))).collect()] == [None, None, "Unknown", "A"]
    held = spark.createDataFrame([(0.0, 5.0), (10.0, 30.0), (30.0, 41.0)], "s double, e double")
    assert [r["s"] for r in live.recent(held, 60.0).collect()] == [10.0, 30.0]
    assert [r["s"] for r in live.recent(held, 60.0, 11.0).collect()] == [30.0]


def test_live_chunks(spark):
    sound = np.array([0.5, -1.0, 2.0, 0.25], dtype="<f4")
    message = lambda **more: (json.dumps({"audio_data": base64.b64encode(sound.tobytes()).decode(), "sample_rate": 2} | more),)
    got = live.live_chunks(spark.createDataFrame([message(), message(session_id="x"), ("not json",)], "value string")).collect()
    assert [(r["session"], r["seconds"], r["samples"]) for r in got] == [("default", 2.0, sound.tolist()), ("x", 2.0, sound.tolist()), ("default", None, None)]


def test_audio_files_and_alignment(spark, tmp_path):
    for name in ("b.mp3", "a.wav", "c.txt", "ann/audio_chunks/1.mp3", "ann/audio_chunks/2.txt", "bo/other/3.mp3", "speaker_references/cy.mp3", "speaker_references/cy.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    folder = f"file://{tmp_path}"
    assert [r["path"].rsplit("/", 1)[1] for r in annotations.audio_files(spark, folder).collect()] == ["a.wav", "b.mp3"]
    clip = ("speaker_references/cy.mp3", "CY", True)
    assert sorted(map(tuple, annotations.alignment(spark, folder).collect())) == [("ann/audio_chunks/1.mp3", "ANN", False), clip]
    known = spark.createDataFrame([("z.mp3", "Z")], "path string, speaker string")
    assert sorted(map(tuple, annotations.alignment(spark, folder, known).collect())) == [clip, ("z.mp3", "Z", False)]


def test_timing_report(spark):
    rows = spark.createDataFrame([("vad", 1.0), ("text_search", 3.0), ("none", 0.0)], "component string, seconds double")
    got = [r["line"] for r in annotations.timing_report(rows, 4.0).orderBy("place").collect()]
    want = [("Text Search", 40, 3.0, 75.0), ("Vad", 13, 1.0, 25.0), ("None", 0, 0.0, 0.0)]
    assert got == [f"{n:30} {'█' * b:40} {t:6.2f}s ({p:5.1f}%)" for n, b, t, p in want]
    assert "  0.00s (  0.0%)" in annotations.timing_report(rows.where("seconds = 0"), 0.0).first()["line"]
