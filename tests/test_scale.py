"""Work that grows with the rows of a dense recording and not with its pairs: each result against all pairs in plain Python, and what the plan does."""

import inspect
import random
import re

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import clustering, intervals, scoring, sequences, words
from parley.streaming import evaluation

SEG = "rec string, ord long, s double, e double, spk string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dense(seed: int, n: int = 150, speakers: str = "abc", span: int = 60) -> list[tuple]:
    """Segments on a grid of tenths, so that bounds often tie, with some of no length and unknown speakers."""
    r = random.Random(seed)
    starts = [(r.choice("xy"), k, r.randrange(10 * span) / 10, r.choice([0, 3, 5, 6, 20, 80, 200]) / 10) for k in r.sample(range(1000), n)]
    return [(rec, k, s, s + d, r.choice([*speakers, None])) for rec, k, s, d in starts]


def test_backfill_reads_no_frame_twice(spark):
    rows = dense(1)
    out = sequences.backfill(spark.createDataFrame(rows, SEG))
    assert "unboundedfollowing" not in plan(out).lower()
    for rec in "xy":
        mine = sorted((r for r in rows if r[0] == rec), key=lambda r: (r[2], r[1]))
        want = {}
        for i, r in enumerate(mine):
            want[r[1]] = next((x[4] for x in mine[i:] if x[4]), None) or next((x[4] for x in mine[i::-1] if x[4]), None)
        assert {r["ord"]: r["spk"] for r in out.where(f"rec = '{rec}'").collect()} == want


def pairs_of(rows, least=0.5):
    """(rec, s, e, a, b) of all pairs of segments of different speakers."""
    for i in rows:
        for j in rows:
            if i[0] == j[0] and i[1] < j[1] and i[4] and j[4] and i[4] != j[4] and min(i[3], j[3]) - max(i[2], j[2]) >= least:
                yield i[0], max(i[2], j[2]), min(i[3], j[3]), i[1], j[1]


def test_regions_without_pairs(spark):
    for seed, speakers in ((2, "abc"), (3, "ab"), (4, "abcdef")):
        rows = dense(seed, speakers=speakers)
        df = spark.createDataFrame(rows, SEG)
        want = sorted(map(tuple, intervals.merge(intervals.overlapping_pairs(df)).collect()))
        out = intervals.overlap_regions(df)
        assert sorted(map(tuple, out.collect())) == want
        assert "Join" not in plan(out)
        met = {(p[0], k) for p in pairs_of(rows) for k in p[3:]}
        marked = intervals.in_overlap(df)
        assert {(r["rec"], r["ord"]) for r in marked.where("overlapped").collect()} == met and marked.count() == len(rows)
        assert "Join" not in plan(marked)


def test_first_pair_at_a_point(spark):
    for seed, speakers in ((5, "abc"), (6, "ab"), (7, "abcdef")):
        rows = dense(seed, 80, speakers)
        pairs = list(pairs_of(rows))
        points = [(rec, k, k / 10) for k in range(-5, 640, 3) for rec in "xy"] + [("x", 9999, None), ("z", 1, 1.0)]
        out = intervals.first_pair_at(spark.createDataFrame(points, "rec string, ord long, t double"), spark.createDataFrame(rows, SEG), 0.5, 0.25, 0.1).collect()
        got = {(r["rec"], r["ord"]): (r["a"], r["b"]) for r in out}
        want = {}
        for rec, k, t in points:
            held = [(p[1], p[3], p[4]) for p in pairs if p[0] == rec and t is not None and p[1] - 0.25 <= t <= p[2] + 0.1]
            if held:
                want[rec, k] = min(held)[1:]
        assert got == want and len(out) == len(want)


def test_speaker_at_makes_no_pairs(spark):
    rows = dense(8)
    points = [(rec, k, k / 10, rec * 2) for k in range(-5, 700, 3) for rec in "xy"] + [("x", 9999, None, None), ("z", 1, 1.0, "q")]
    for width in (None, 7.0):
        out = intervals.speaker_at(spark.createDataFrame(points, "rec string, ord long, t double, more string"), spark.createDataFrame(rows, SEG), width=width)
        assert "Join" not in plan(out) and len(out.columns) == 5
        got = {(r["rec"], r["ord"]): (r["more"], r["spk"]) for r in out.collect()}
        for rec, k, t, more in points:
            held = [(r[1], r[4]) for r in rows if t is not None and r[0] == rec and r[2] <= t <= r[3]]
            assert got[rec, k] == (more, (max(held)[1] if held else None) or "unknown")


def test_error_has_a_row_for_a_speaker_not_a_segment(spark, monkeypatch):
    rows = dense(9, 120, "ab")
    ref, hyp = spark.createDataFrame(rows, SEG), spark.createDataFrame([(r[0], r[1], r[2] + 0.3, r[3] + 0.3, r[4]) for r in rows], SEG)
    made, real = [], scoring.elementary
    monkeypatch.setattr(scoring, "elementary", lambda a, b: made.append((a.count(), b.count())) or real(a, b))
    got = {r["rec"]: r for r in scoring.diarization_error(ref, hyp, optimal=False).collect()}
    assert max(made[0]) < len(rows)
    for rec in "xy":
        total = miss = 0
        for k in range(820):  # tenths
            at = lambda d: {r[4] for r in rows if r[0] == rec and r[4] and r[2] + d < (k + 0.5) / 10 < r[3] + d}
            a, b = at(0), at(0.3)
            total, miss = total + len(a) / 10, miss + max(len(a) - len(b), 0) / 10
        assert abs(got[rec]["total"] - total) < 1e-6 and abs(got[rec]["miss"] - miss) < 1e-6


def test_islands_overlap_what_segments_do(spark):
    rows = [r for r in dense(10) if r[4]] + [("x", 5000, 20.0, 18.5, "b")]
    df = spark.createDataFrame(rows, SEG)
    met = lambda spans: {(r["rec"], r["ord"], r["r_spk"]) for r in intervals.overlap_join(df, spans).select("rec", "ord", "r_spk").collect()}
    assert met(intervals.speaker_islands(df)) == met(df.select("rec", "s", "e", "spk")) and intervals.speaker_islands(df).count() < len(rows)


def test_overlap_labels_without_pairs(spark):
    for seed in (11, 12):
        truth, found = dense(seed, 100), [(r[0], r[1], r[2] + 0.2, r[3] + 0.2, r[4]) for r in dense(seed + 20, 100)] + [("z", 1, 0.0, 1.0, "a"), ("x", 5000, None, 1.0, "b"), ("x", 5001, 30.0, 29.0, "a")]
        want = {}
        for rec, k, s, e, _ in found:
            held = [(min(e, r[3]) - max(s, r[2]), -r[1], r[4]) for r in truth if s is not None and r[0] == rec and s < r[3] and r[2] < e]
            want[rec, k] = (max(held, key=lambda h: h[:2])[2] if held else None) or "none"
        for width in (None, 4.0):
            out = scoring.overlap_labels(spark.createDataFrame(found, SEG), spark.createDataFrame(truth, SEG), width=width)
            assert "Join" not in plan(out)
            got = out.collect()
            assert {(r["rec"], r["ord"]): r["true_spk"] for r in got} == want and len(got) == len(found)


def test_char_errors_of_long_texts(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("ab cé😀") for _ in range(r.randrange(40)))
    rows = [(word(), word()) for _ in range(60)] + [(None, "a"), ("a", None), ("", None), ("  ", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    n = F.char_length(F.trim("a"))
    plainly = F.when(n == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.levenshtein(F.trim("a"), F.trim("b")) / n)
    out = df.select(text.char_errors(F.col("a"), F.col("b")).alias("x"), plainly.alias("y"))
    assert all(x["x"] == x["y"] for x in out.collect())
    assert "levenshtein" not in plan(out.select("x")).lower()


def test_silhouette_sends_a_vector_to_few_blocks(spark):
    r = random.Random(14)
    df = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)], k % 3) for k in range(50)], "vec_id long, v array<double>, label int")
    assert inspect.signature(clustering.euclidean_silhouette).parameters["block"].default >= 16_384
    want = {x["vec_id"]: x["silhouette"] for x in clustering.euclidean_silhouette(df).collect()}
    got = {x["vec_id"]: x["silhouette"] for x in clustering.euclidean_silhouette(df, block=20, tile=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_logs_of_scores_over_one(spark):
    rows = [("x", 1, [0.5, 1.25]), ("x", 2, [0.25, 0.5]), ("x", 3, [0.75, 0.5])]
    df = spark.createDataFrame(rows, "rec string, ix long, scores array<double>")
    logs = df.withColumn("scores", F.transform("scores", lambda x: F.log(x)))
    score = lambda out: [round(r["score"], 12) for r in out.orderBy("ix").collect()]
    assert score(intervals.change_score(logs, logs=True)) == score(intervals.change_score(df, logs=False)) == [0.0, 1.0, 0.5]


def test_distance_search_looks_at_a_link_once(spark, tmp_path, monkeypatch):
    r, steps = random.Random(15), [0.05 * k for k in range(1, 40)]
    near = lambda c: [x + r.gauss(0, 0.3) for x in c]
    centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(k * 7 - 200, near(r.choice(centres)) if k % 3 else [r.gauss(0, 1) for _ in range(5)]) for k in range(70)] + [(900, [0.0] * 5), (901, [float("nan")] * 5), (902, rows_of := [1.0] * 5), (903, rows_of)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    size = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    cosines = {(i, j): sum(x * y for x, y in zip(a, b)) / size(a) / size(b) for i, a in rows for j, b in rows if i != j}
    want = {}
    for k, e in enumerate(steps):
        label, links = {i: i for i, _ in rows}, [p for p, c in cosines.items() if c >= 1.0 - e]
        while any(label[i] > label[j] for i, j in links):
            for i, j in links:
                label[i] = min(label[i], label[j])
        linked = {i for p in links for i in p}
        want |= {(k, i): c if i in linked else -1 for i, c in label.items()}
    sent, real = [], clustering.graph_components
    monkeypatch.setattr(clustering, "graph_components", lambda links, nodes, *more: sent.append(nodes.count()) or real(links, nodes, *more))
    made, spans, parts = [], clustering.spanning_links, clustering.nested_components
    for k, (block, tile, most) in enumerate(((16_384, 1 << 21, 65_536), (20, 64, 65_536), (20, 64, 0), (16_384, 300, 40))):
        monkeypatch.setattr(clustering, "spanning_links", lambda *a, **b: made.append(out := spans(*a, **b, block=block, tile=tile)) or out)
        monkeypatch.setattr(clustering, "nested_components", lambda *a: parts(*a, most=most))
        out = clustering.distance_clusterings(df, steps, f"file://{tmp_path}/{k}").collect()
        assert len(out) == len(want) and {(x["step"], x["vec_id"]): x["cluster"] for x in out} == want
    assert made[0].count() < len(rows) and sent and max(sent) <= len(rows)  # no node or link for each distance
    assert inspect.signature(spans).parameters["block"].default >= 16_384


def test_forests_of_blocks_are_joined(spark, monkeypatch):
    r = random.Random(33)
    plain = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, [float("nan")] * 4]
    # cosines a billionth above and below a level, nearer than single precision tells apart
    turn = lambda c, k: [c * 10**k, (1 - c * c) ** 0.5 * 10**k, 0.0, 0.0]
    vectors = [v for v in plain for _ in range(3)] + [[1.0, 0.0, 0.0, 0.0], turn(0.9 + 1e-9, 0), turn(0.9 - 1e-9, 3), turn(-0.5 - 1e-9, 1)]
    rows = [(k * 5 - 100, v) for k, v in enumerate(r.sample(vectors, len(vectors)))]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    size = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    cosines = {(i, j): 1.0 if a == b and any(x * x > 0 for x in a) else sum(x * y for x, y in zip(a, b)) / size(a) / size(b) for i, a in rows for j, b in rows if i < j}

    def components(links):
        label = {i: i for i, _ in rows}
        while any(label[i] != label[j] for i, j in links):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label

    dealt, real = [], clustering.cells
    monkeypatch.setattr(clustering, "cells", lambda rows, *more: dealt.append(rows.count()) or real(rows, *more))
    levels = [0.9, 0.6, 0.0, -0.5]
    for block, fan, most in ((8, 8, 1 << 20), (4, 2, 40), (1000, 8, 1 << 20)):
        for given in (levels, None):
            links = clustering.spanning_links(df, -0.5, block=block, levels=given, fan=fan, most=most).collect()
            for x in levels:
                assert components([(s["a"], s["b"]) for s in links if s["score"] >= x]) == components([p for p, c in cosines.items() if c >= x])
            assert most == 40 or len(links) < len(rows)  # not a forest for each pair of blocks
    assert set(dealt) == {len({str(v) for v in vectors})}  # equal vectors are compared once


def test_overlap_texts_without_a_table_of_pairs(spark, monkeypatch):
    rows = dense(16, 90) + [("x", 2000, 0.0, 55.0, "a"), ("x", 2001, None, 1.0, "a"), ("y", 2002, 30.0, 29.0, "a"), ("x", 2003, 900.0, 901.0, "a"), (None, 2004, 1.0, 2.0, "a"), ("y", None, 5.0, 9.0, "b"), ("x", 2005, 4.0, 5.0, "c"), ("x", 2005, 50.0, 51.0, "c")]
    others = dense(17, 90)
    want = {(r[0], r[1]): [] for r in rows}
    for rec, k, s, e, _ in rows:
        want[rec, k] += [(o[1], o[4]) for o in others if rec == o[0] and s is not None and s < o[3] and o[2] < e]
    want = {k: (len(v), " ".join(s for _, s in sorted(v, key=lambda x: x[0]) if s) or None) for k, v in want.items()}
    met, real = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b: met.append(a.count()) or real(a, b))
    df = spark.createDataFrame(rows, SEG)
    for width in (None, 25.0, 7.0):
        out = intervals.overlap_texts(df, spark.createDataFrame(others, SEG), width).collect()
        assert {(r["rec"], r["ord"]): (r["n"], r["text"]) for r in out} == want and len(out) == len(want)
    assert met[0] == 2 and met[1] == 3  # those that share their ord, and the one that is longer than a chunk


def test_greedy_matching_without_pairs(spark, monkeypatch):
    for seed in (18, 19, 20):
        pred = [r for r in dense(seed, 150, span=20)] + [("x", 5000, 1.0, 1.0, "a"), ("x", 5001, None, 2.0, "a"), ("x", 5002, 7.0, 6.0, "a")]
        ref = [(r[0], r[1], r[2] + 0.1 * (k % 3), r[3] + 0.1 * (k % 2), r[4]) for k, r in enumerate(dense(seed, 140, span=20))] + dense(seed + 10, 60, span=20)  # some share their ord
        df = spark.createDataFrame(pred, SEG), spark.createDataFrame(ref, SEG)
        for least in (0.5, 0.2, 0.0):
            want = {}
            for rec in "xy":
                pairs = [(p[1], t[1]) for p in pred for t in ref if rec == p[0] == t[0] and p[2] is not None and p[2] < t[3] and t[2] < p[3] and min(p[3], t[3]) - max(p[2], t[2]) >= least * (max(p[3], t[3]) - min(p[2], t[2]))]
                done, used = set(), set()
                for p, t in sorted(pairs):
                    if p not in done and t not in used:
                        done.add(p), used.add(t)
                want[rec] = len(done)
            out = scoring.iou_scores(*df, least)
            assert {r["rec"]: r["tp"] for r in out.collect()} == want
    assert "r_ord" not in plan(out)


def test_rates_are_dealt_out_by_the_text(spark, monkeypatch):
    r, rows = random.Random(21), []
    for k in range(300):
        rows.append((f"f{k % 9}", k, k % 2 == 0, " ".join(r.choice(["a", "b", "B.", "c...", "--"]) for _ in range(r.randrange(5))) if k % 7 else None))
    rows += [("short", 1, True, "one"), ("short", 2, True, "..."), ("short", 3, None, "One one")]
    df = spark.createDataFrame(rows, evaluation.RESPONSES)
    monkeypatch.setattr(evaluation, "EACH", 100)
    out = evaluation.response_rates(df)
    chars = sum(len(x[3] or "") for x in rows)
    assert out.rdd.getNumPartitions() == -(-chars // 100)  # by the text, not by a setting
    got = {x["file"]: x for x in out.collect()}
    for file in {x[0] for x in rows}:
        words = [w for x in sorted(rows, key=lambda x: x[1]) if x[0] == file for t in (x[3] or "").split() if (w := t.lower().strip(".-"))]
        grams = list(zip(words, words[1:], words[2:]))
        assert got[file]["total_words"] == len(words)
        assert abs(got[file]["adj_dup_rate"] - (sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0)) < 1e-12
        assert abs(got[file]["trigram_repeat_rate"] - ((len(grams) - len(set(grams))) / len(grams) if len(words) >= 6 else 0)) < 1e-12


def test_phonemes_without_rows_of_words(spark, monkeypatch):
    r = random.Random(24)
    word = lambda: "".join(r.choice("abcé\U0001f600") for _ in range(r.randrange(1, 9)))
    entries = {word()[: r.randrange(1, 5)]: r.choice(["X", "Y Z", "", None]) for _ in range(60)}
    rows = [(k, None if k % 9 == 0 else "\u00a0 ".join([word().upper() if k % 4 else word() for _ in range(r.randrange(30))]) + r.choice(["", " ", "\t\n\x0b"]), 0, 1) for k in range(80)] + [(None, "abc ab", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, s int, e int")
    dictionary = spark.createDataFrame(list(entries.items()), "word string, phonemes string")

    def plain(word):
        at, said = 0, []
        while at < len(word):
            n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in entries), 0)
            said += [entries[word[at : at + n]]] if n else []
            at += n or 1
        return [" ".join(x for x in said if x is not None)] if said else []

    want = {k: " ".join(x for w in re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower()) for x in plain(w)) for k, t, *_ in rows}
    monkeypatch.setattr(words, "EACH", 300)
    sent = words.with_phonemes(df, dictionary, ["id"])
    assert "Exchange" not in plan(sent)  # texts are read where they lie
    assert {x["id"]: x["phonemes"] for x in sent.collect()} == want
    for limits in ({"most": 3}, {"most_chars": 20}):
        got = {x["id"]: x["phonemes"] for x in words.with_phonemes(df, dictionary, ["id"], **limits).collect()}
        assert len(got) == len(want) and all(got[k] == want[k] for k in want if k is not None)
