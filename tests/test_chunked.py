"""Folds in chunks against the plain fold of a whole recording: dense and sparse points, chunks of every width, ties, times on edges."""

import random

import numpy as np
import pandas as pd
import pytest

from parley.operators import chunked, scoring

SEG = "rec string, ord long, s double, e double, spk string"


def plain_thin(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def plain_turns(rows, shortest=0.2, tolerance=0.3):
    out, spk, end = [], None, None
    for _, ord_, s, e, k in sorted(rows, key=lambda r: (r[2], r[1])):
        if e - s < shortest:
            continue
        if spk is None:
            spk, end = k, e
        elif k == spk:
            end = max(end, e)
        elif s >= end - tolerance or e > end:
            out.append(s)
            spk, end = k, e
    return out


def spread(tasks):
    return len([r for r in tasks if r["n"]])


@pytest.mark.parametrize("width", [7.0, 50.0, 1e6])
def test_thin(spark, width):
    rng = random.Random(2)
    recs = {"dense": [round(rng.uniform(-100, 400), 2) for _ in range(3000)], "sparse": [rng.uniform(0, 5000) for _ in range(60)], "grid": [0.3 * i for i in range(1500)] * 2, "one": [7.0]}
    df = spark.createDataFrame([(k, t) for k, v in recs.items() for t in v] + [("none", None)], "rec string, ts double").repartition(4)
    for gap in (0.3, 2.0, 9.0):
        got = chunked.thin(df, gap, width).groupBy("rec").agg(chunked.F.sort_array(chunked.F.collect_list("ts")).alias("t")).collect()
        assert {r["rec"]: r["t"] for r in got} == {k: plain_thin(v, gap) for k, v in recs.items()}


@pytest.mark.parametrize("width", [5.0, 40.0, 1e6])
def test_turn_truth(spark, width):
    rng = random.Random(4)
    rows = []
    for rec, speakers, length in (("busy", "ABCDE", 4.0), ("long", "AB", 60.0), ("short", "AB", 0.3)):
        t = 0.0
        for i in range(300):
            t += rng.choice([0.0, 0.1, 0.5, 1.5, 3.0])
            rows.append((rec, i, t, t + rng.choice([0.1, 0.25, rng.uniform(0, length), length]), rng.choice(speakers)))
    df = spark.createDataFrame(rows, SEG).repartition(4)
    got = chunked.turn_truth(df, width=width).groupBy("rec").agg(chunked.F.sort_array(chunked.F.collect_list("ts")).alias("t")).collect()
    assert {r["rec"]: r["t"] for r in got} == {k: plain_turns([r for r in rows if r[0] == k]) for k in ("busy", "long", "short")}


def test_turn_summaries_over_random_chunks():
    """Every entry state leads through a summary to where the fold leads."""
    rng = random.Random(9)
    for _ in range(300):
        rows = pd.DataFrame([(i, s := rng.uniform(0, 6), s + rng.choice([0.1, 1.0, 4.0]), rng.choice("ABC")) for i in range(rng.randint(0, 8))], columns=["ord", "s", "e", "spk"])
        turns = chunked._Turns(rows, 0.2, 0.3)
        found = turns.summary()
        assert found["first"] == turns.run(None)[0]
        for spk in "ABCZ":
            end = rng.uniform(-2, 8)
            own, ways = found["held"].get("=" + spk, found["held"][""])
            after = next((x for s, e, x in ways if s >= end - 0.3 or e > end), [spk, end if own is None else max(end, own)])
            assert after == turns.run([spk, end])[0]


@pytest.mark.parametrize("width", [20.0, 300.0])
def test_matches(spark, width):
    rng = random.Random(6)
    a = {"dense": [rng.uniform(0, 500) for _ in range(1500)], "grid": [0.5 * i for i in range(400)], "far": [1.0, 9000.0], "left": [5.0]}
    b = {"dense": [rng.uniform(0, 500) for _ in range(1200)], "grid": [0.5 * i + 0.5 for i in range(300)], "far": [1.4, 9000.2], "right": [5.0]}
    frame = lambda x: spark.createDataFrame([(k, t) for k, v in x.items() for t in v], "rec string, ts double").repartition(3)
    tolerances = (0.25, 0.5, 5.0)
    got = {(r["rec"], r["tolerance"]): r["tp"] for r in chunked.matched(frame(a), frame(b), tolerances, width).collect()}
    for rec in a.keys() & b.keys():
        for t in tolerances:
            assert got[rec, t] == scoring.match_points(a[rec], b[rec], t)
    rows = {(r["rec"], r["tolerance"]): (r["tp"], r["n_pred"], r["n_ref"], r["f1_ratio"]) for r in scoring.boundary_scores(frame(a), frame(b), (0.5,)).collect()}
    assert rows["left", 0.5] == (0, 1, 0, 0.0) and rows["right", 0.5] == (0, 0, 1, 0.0) and rows["far", 0.5] == (2, 2, 2, 1.0) and len(rows) == 5


def test_one_recording_is_many_groups(spark):
    """200,000 points of one recording: each chunk is a group of its own, and the result is the plain fold's."""
    t = np.sort(np.random.default_rng(1).uniform(0, 40_000, 200_000))
    df = spark.createDataFrame(pd.DataFrame({"rec": "r", "ts": t}))
    got = np.sort([r["ts"] for r in chunked.thin(df, 1.0, 1000.0).collect()])
    assert got.tolist() == plain_thin(t.tolist(), 1.0)
    width = chunked.chunk_width(df, "ts", each=5000)
    assert 900 < width < 1100 and chunked.chunk_width(df, "ts", each=10**6) == 1e9
    assert chunked._in_chunks(df, "ts", 1000.0).select("__chunk").distinct().count() == 40


def test_greedy_by_islands(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda n: [("r", i, s := round(rng.uniform(0, 300), 1), s + rng.choice([2.0, 5.0]), "A") for i in range(n)]
    pred, ref = make(200), make(180)
    iou = lambda p, t: (min(p[3], t[3]) - max(p[2], t[2])) / (max(p[3], t[3]) - min(p[2], t[2]))
    used, n = set(), 0
    for p in pred:
        hit = next((t[1] for t in ref if t[1] not in used and min(p[3], t[3]) > max(p[2], t[2]) and iou(p, t) >= 0.5), None)
        if hit is not None:
            used.add(hit)
            n += 1
    row = scoring.iou_scores(spark.createDataFrame(pred, SEG), spark.createDataFrame(ref, SEG)).first()
    assert (row["tp"], row["fp"], row["fn"]) == (n, 200 - n, 180 - n)
    monkeypatch.setattr(chunked.greedy_pairs, "__defaults__", (1,))
    assert scoring.iou_scores(spark.createDataFrame(pred, SEG), spark.createDataFrame(ref, SEG)).first() == row
