"""Operators on whole texts against brute force, on small tables with nulls, empty and long texts, copies, ties and odd columns."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import common, jaccard, lm, repeats, toxicity
from parley.llm.common import unpack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rid string, body string, copy string, spans string, bucket string, part string, n_removed string"


def texts() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120), make(40)
    rows: list[tuple] = [(i, make(rng.randint(1, 90))) for i in range(60)]
    rows += [(60 + i, base) for i in range(8)]
    for i in range(30):  # near copies, some of them only linked through others
        w = base.split()
        for j in rng.sample(range(len(w)), rng.randint(1, 3)):
            w[j] = rng.choice(words)
        rows.append((70 + i, " ".join(w)))
    rows += [(110 + i, f"{make(30)} {passage} {make(30)}") for i in range(20)]
    rows += [(140, None), (141, ""), (142, " \t\n"), (143, "one two"), (144, "One  TWO"), (145, "é ß É ß é"), (146, "x" * 300), (147, "x" * 120), (148, make(5000)), (149, "ab " * 400), (None, base), (None, None), (3, rows[3][1]), (150, "Ünïcode " * 30), (151, "ünïcode " * 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "x", "y", "z", "c", "p", "b", "q", "r") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows, percent=80):
    sets, root = brute_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("percent", [80, 60])
def test_jaccard_join(docs, percent):
    got = jaccard.jaccard_join(docs, percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(texts(), percent))


def test_a_group_of_near_copies_that_often_do_not_link(spark):
    """Copies with up to nine words changed, some cut short: only their differences from a pivot tell which link."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(110)]
    rows = []
    for i in range(160):
        w = list(base)
        for j in rng.sample(range(len(w)), rng.randint(0, 9)):
            w[j] = rng.choice(words[:4]) if i % 3 else f"x{i}"
        rows.append((i, " ".join(w[: len(w) - rng.choice([0, 0, 0, 5, 18, 30])])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert 20 < len({c for _, _, c in want}) < 140
    assert Counter(map(tuple, jaccard.jaccard_join(table).collect())) == Counter(want)


def test_jaccard_join_of_nothing(docs):
    assert jaccard.jaccard_join(docs.limit(0)).collect() == []
    assert jaccard.one_of_each(docs.where("text is null")).count() == 2


def test_one_of_each_keeps_clean_documents(docs):
    rows = brute_components(texts())
    kept = Counter(r["doc_id"] for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter(d for d, _, c in rows if d is None or d == c)


def brute_removal(rows, length=50):
    data = [(d, (t or "").encode()) for d, t in rows]
    first: dict = {}
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["body"]).hexdigest()) for r in repeats.remove_repeats(docs).collect()]
    assert Counter(got) == Counter(brute_removal(texts()))


def test_other_columns_pass_through(docs):
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    assert {(r["copy"], r["spans"], r["bucket"], r["part"], r["n_removed"], r["body"]) for r in out.collect()} == {("c", "p", "b", "q", "r", "z")}
    assert [c for c in repeats.remove_repeats(docs).columns if c in ("copy", "spans", "n_removed")] == ["copy", "spans", "n_removed"]
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_repeats_of_nothing(docs):
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
    kept = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs.where("doc_id >= 140 and doc_id <= 148")).collect()}
    assert kept[140] is None and kept[146] == "x" * 300 and kept[147] == ""


def test_interval_tree_gives_maximal_groups():
    lcp = np.array([0, 3, 5, 5, 2, 0, 4])
    assert sorted(repeats.intervals(lcp)) == sorted([(5, 3, 1, 3), (3, 2, 0, 3), (2, 0, 0, 4), (4, 0, 5, 6)])


def test_occurrences_are_grouped_in_slices_of_bounded_memory():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 9000, 40_000).astype(np.uint64)
    h[:5000] = 77  # one gram fills more than a slice
    met = [h[part] for part in repeats.slices(h, 1000)]
    some, times = np.unique(h, return_counts=True)
    assert sorted(np.concatenate(met).tolist()) == np.repeat(some[times > 1], times[times > 1]).tolist()
    assert sum(len(np.unique(x)) for x in met) == (times > 1).sum()
    assert max(len(x) for x in met if len(np.unique(x)) > 1) <= 1000 and len(met) < 60
    assert [p.tolist() for p in repeats.slices(h[:0])] == []
    n, rows = 20_000, rng.integers(97, 99, (20_000, repeats.CONTEXT)).astype(np.uint8)
    sides = np.tile(np.array([[repeats.LEFT, repeats.LENGTH]], np.uint8), (n, 1))
    tracemalloc.start()
    spans = repeats.Spans(1000)
    for t, order, group, _ in repeats.repeat_groups(np.sort(h[:n]), np.arange(n), np.zeros(n, np.int64), sides, rows):
        spans.add(order[group >= 0], np.full((group >= 0).sum(), -t), np.full((group >= 0).sum(), repeats.LENGTH - t))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 700 * n
    # twelve times the text of 0.5 GB has more buckets, not larger ones
    assert 1 << repeats.bucket_bits(10_000_000_000 * 3 // 8, repeats.BUCKET) >= 1024


def test_packed_columns_are_unpacked_without_copies_of_rows():
    column = pa.chunked_array([pa.array([b"", b"12345678", None], pa.binary()), pa.array([b"x" * 8, b"87654321" * 2, b"y"], pa.binary()).slice(1, 1)])
    assert unpack(column, np.uint64).tolist() == np.frombuffer(b"12345678" + b"87654321" * 2, np.uint64).tolist()
    assert unpack(pa.chunked_array([], pa.binary()), np.int64).tolist() == [] and unpack(pa.array([b"ab"], pa.binary()), np.uint8).tolist() == [97, 98]


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(2)
    for alphabet in (2, 26):
        body = rng.integers(0, alphabet, 3000, dtype=np.uint8)
        at, _ = repeats.anchors(body, np.array([1000, 1030, 3000]))
        for low, high in ((0, 1000), (1030, 3000)):
            for i in range(low, high - 49):
                assert ((at >= i) & (at <= i + 31)).any()


def test_language_model(spark, docs):
    held = lm.F.coalesce(lm.fold("doc_id", 7) == 2, lm.F.lit(False))
    for most in (40, 1_000_000):
        model, rare = lm.fit(docs.where(~held), most_words=most)
        got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(docs, model, rare).collect())
        words = [((d, [*(t or "").encode().lower().split(), None])) for d, t in texts()]
        count = Counter(w for d, ws in words if not (d is not None and crc32(str(d).encode()) % 7 == 2) for w in ws)
        n, v = sum(count.values()), len(count)
        want = Counter((d, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in words)
        assert got == want


def test_score_is_the_same_for_any_number_of_words_broadcast(docs):
    held = lm.F.coalesce(lm.fold("doc_id", 7) == 2, lm.F.lit(False))
    got = []
    for most in (0, 40, 1_000_000):
        model, rare = lm.fit(docs.where(~held), most_words=most)
        got.append(sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm.score(docs, model, rare).collect()))
    assert got[0] == got[1] == got[2]


def test_all_bigrams_are_kept_in_a_filter_of_any_size(docs):
    got = []
    for most in (192 << 20, 100):
        model, rare = lm.fit(docs, most_words=40, most_bytes=most)
        got.append(sorted((str(r["doc_id"]), round(r["score"], 6)) for r in lm.score(docs, model, rare).collect()))
        if model.segments is None:
            hashes, _ = lm.token_hashes([t for _, t in texts()])
            assert (model.levels(hashes) > 0).all()
    assert model.segments is not None and got[0] == got[1]


def test_little_is_stored_where_bigrams_are_dealt_to_segments(docs, monkeypatch):
    rng = np.random.default_rng(6)
    for bits in (8, 10):
        keys = np.unique(rng.integers(0, 1 << 56, 40_000, dtype=np.uint64) << np.uint64(8))
        for bucket, part in enumerate(np.split(keys, np.searchsorted(keys, lm._edges(bits)))):
            assert (lm.unsqueezed(lm.squeezed(part), len(part), bucket, bits) == part).all()
    keys = np.unique(rng.integers(0, 1 << 56, 600_000, dtype=np.uint64) << np.uint64(8))
    assert sum(len(lm.squeezed(x)) for x in np.split(keys, np.searchsorted(keys, lm._edges(8)))) < 5.5 * len(keys)  # a key by itself is 8 bytes
    staged, one = [], lm.stage
    monkeypatch.setattr(lm, "stage", lambda df, label, *a, **k: staged.append((label, df.columns)) or one(df, label, *a, **k))
    monkeypatch.setattr(lm, "UNIT", 3000)
    model, rare = lm.fit(docs, most_words=40, most_bytes=100)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm.score(docs, model, rare).collect())
    assert model.segments is not None and all("bigrams" not in columns for _, columns in staged)
    model, rare = lm.fit(docs, most_words=40)
    assert model.segments is None and got == sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in lm.score(docs, model, rare).collect())


def test_filter_returns_counts():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 5000, dtype=np.uint64) >> np.uint64(8) << np.uint64(8)
    counts = rng.integers(1, 5000, 5000)
    level = np.searchsorted(lm.LEVELS, counts, side="right")
    held, wrong = lm.segment(keys, counts)
    one = lm.Filter(np.full(256, 8 * len(held)), np.zeros(256, dtype=np.int64), held, 8)
    assert (one.levels(keys) >= level).all() and (one.levels(keys) == level).mean() > 0.99
    other = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    assert (one.levels(other) > 0).mean() < 2 * wrong < 0.01


def bigram_model(rows, model):
    """Plain counts of words and bigrams, and P(w | v) by the formula, with the model's mean counts of levels, weight and false hits."""
    words = [[None, *(t or "").encode().lower().split(), None] for t in rows]
    one = Counter(w for ws in words for w in ws[1:])
    two = Counter(b for ws in words for b in zip(ws, ws[1:]))
    n, n1 = sum(one.values()), sum(c == 1 for c in one.values())

    def probability(v, w):
        base = max(one[w], 1) / (n + n1 + 1)
        if not one[v]:
            return base
        level = int(np.searchsorted(lm.LEVELS, two[v, w], side="right"))
        seen = min(model.mean[level], one[v], one[w])
        return (seen + model.after * base) / (one[v] + model.after + model.wrong * len(one))

    assert model.after == pytest.approx(len(two) / len(one)) and model.v == len(one)
    return one, n1, probability


def test_score_equals_a_plain_bigram_model(docs):
    held = lm.F.coalesce(lm.fold("doc_id", 7) == 2, lm.F.lit(False))
    model, rare = lm.fit(docs.where(~held), most_words=40)
    train = [t for d, t in texts() if not (d is not None and crc32(str(d).encode()) % 7 == 2)]
    _, _, probability = bigram_model(train, model)
    want = sorted((str(d), sum(math.log10(probability(v, w)) for v, w in zip(ws, ws[1:]))) for d, ws in ((d, [None, *(t or "").encode().lower().split(), None]) for d, t in texts()))
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.score(docs, model, rare).collect())
    apart = [g[1] - w[1] for g, w in zip(got, want)]
    assert [g[0] for g in got] == [w[0] for w in want]
    # a false hit (one absent bigram in 256) can only raise a score
    assert min(apart) > -1e-6 and np.mean(np.abs(apart) < 1e-6) > 0.3
    assert sum(apart) < 0.01 * sum(len((t or "").split()) + 1 for _, t in texts())


def test_probabilities_add_up_to_one(docs):
    model, _ = lm.fit(docs)
    one, n1, probability = bigram_model([t for _, t in texts()], model)
    names = sorted(w for w in one if w is not None)
    hashes = np.append(lm.token_hashes([" ".join(w.decode() for w in names)])[0][:-1], lm.END)
    counts = np.array([*(one[w] for w in names), one[None]])
    for v in (None, *(w for w, _ in one.most_common(4) if w is not None), *random.Random(1).sample(names, 20)):
        before = hashes[len(names) if v is None else names.index(v)]
        level = model.filter.levels(lm.bigram_keys(hashes, np.full(len(hashes), before)))
        total = model.probability(counts, np.full(len(hashes), one[v]), level).sum() + (n1 + 1) * model.probability(np.zeros(1, int), np.array([one[v]]), np.zeros(1, int))[0]
        assert 0.8 < total < 1.25  # levels are a factor of 1.5 wide
    assert model.unigram(counts).sum() + (n1 + 1) * model.unigram(np.zeros(1))[0] == pytest.approx(1)


def test_word_hashes():
    rows = [None, "", " ", "a", "A b\tc\x0bd", "é ß É", "one two one", " lead", "x" * 700_000 + " y", "trail ", "y\x85z y z\xa0y", "b"]
    hashes, sizes = common.word_hashes(rows)
    want = [(t or "").encode().lower().split() for t in rows]
    names: dict = {}
    assert sizes.tolist() == [len(w) for w in want]
    assert all(names.setdefault(w, h) == h for w, h in zip((w for ws in want for w in ws), hashes.tolist())) and len(set(names.values())) == len(names)
    assert [len(x) for x in common.word_hashes([])] == [0, 0]


def test_language_model_of_nothing(docs):
    model, rare = lm.fit(docs.limit(0))
    assert [r["n_known"] for r in lm.score(docs.limit(3), model, rare).collect()] == [0, 0, 0]
    assert lm.score(docs.limit(0), model, rare).collect() == []


def labelled(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        parts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), f"you {rng.choice(['grumpling', 'grumplette', 'snotface'])} {rng.choice(words)}")
        rows.append((i, ". ".join(parts), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "a b", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(None, 1, 1), (9000, 0, None), (9001, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: b for i, _, b in rows}


def test_toxicity_is_learned_and_located(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 903 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in truth and crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    found = toxicity.offending_sentences(docs, model).collect()
    assert np.mean(["grumpl" in r["sentence"] or "snotface" in r["sentence"] for r in found]) > 0.95
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 740 < kept.count() < 770


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark)
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic is null")):
        assert toxicity.score(docs, toxicity.fit(docs, few)).where("score > 0.1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).collect() == []


def test_long_lists_are_pruned_by_parity(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 2)
    assert Counter(map(tuple, jaccard.jaccard_join(docs, 80).collect())) == Counter(brute_components(texts()))
    a, b = np.arange(1000, dtype=np.uint64) << np.uint64(20), np.arange(37, 1020, dtype=np.uint64) << np.uint64(20)
    apart = np.bitwise_count(np.frombuffer(jaccard.parity(a), np.uint8) ^ np.frombuffer(jaccard.parity(b), np.uint8)).sum()
    assert 0 < apart <= 57


def test_long_texts_with_a_common_part_are_told_apart_by_their_parities(spark, monkeypatch):
    rng = random.Random(31)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    common = words(500)
    rows = [(i, f"{common} {words(1200)}") for i in range(5)]  # too few for the common part to be frequent
    rows += [(5, rows[3][1] + " and more")]
    met, compared = [], jaccard.compared
    monkeypatch.setattr(jaccard, "compared", lambda docs, reps, pairs, *a: met.append(pairs.count()) or compared(docs, reps, pairs, *a))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows))
    assert sum(met) <= 3  # all ten pairs of the five different texts share shingles, and no two of them can link


def test_parities_of_any_length_never_tell_more_than_the_difference():
    rng = np.random.default_rng(5)
    every = np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64))
    marks = lambda s: jaccard.sketch(s) or jaccard.parity(s)
    assert jaccard.sketch(every[:512]) is None and len(jaccard.sketch(every[:513])) == 128
    for n, m, first in ((400, 700, 0), (2000, 2100, 30), (8000, 9000, 0), (600, 5000, 500), (3000, 3000, 6000)):
        a, b = every[:n], every[first : first + m]
        assert jaccard.parted(marks(a), marks(b)) <= len(np.setxor1d(a, b))
    assert jaccard.parted(marks(every[:3000]), marks(every[6000:9000])) > (3000 + 3000) // 9  # enough to rule a link out


def test_a_worker_keeps_what_it_has_made_for_its_own_operator_only():
    common.kept("words", dict)["a"] = 1
    assert list(common.batches(iter([]), keep="words")) == [] and common.kept("words", dict) == {"a": 1}
    assert list(common.batches(iter([]))) == [] and not common.KEPT
