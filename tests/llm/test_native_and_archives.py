import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import mixing, packing, sharding, warc
from parley.llm.common import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, slot string, weight string, turn string"


def documents(spark):
    rows = [(i, f"Word{i % 7} and\tmore\nwords " * (1 + i % 5), "en", f"s{i % 4}", 1, "x", "y", "w", "t") for i in range(200)]
    rows += [(i, "the same text", "en", "hot", 1, "x", "y", "w", "t") for i in range(200, 300)]
    odd = [(300, None, None, None, None), (301, "", "en", None, 0), (None, "a b c", "en", "s1", 5), (5, "again", "en", "s1", 5), (302, "long " * 30_000, "en", "s2", 5)]
    rows += [(*r, "", "", "", "") for r in [*odd, *[(303, "é ß " * 10, "de", "", 5)] * 2]]
    return spark.createDataFrame(rows, DOCS)


def test_shards(spark):
    docs = documents(spark)
    rows = sharding.histogram_shard(docs, 8).collect()
    assert len(rows) == docs.count()
    where, slots, held = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        where[r["text"] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_splitters_are_near_equal(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) || id as text")
    held = Counter()
    for r in sharding.histogram_shard(docs, 8).collect():
        held[r["shard"]] += r["size"]
    assert max(held.values()) - min(held.values()) < 200
    ordered = sharding.histogram_shard(docs, 3, order="doc_id").collect()
    spans = [[r["doc_id"] for r in ordered if r["shard"] == s] for s in range(3)]
    assert max(spans[0]) < min(spans[1]) and max(spans[1]) < min(spans[2])


def test_shards_of_nothing(spark):
    assert sharding.histogram_shard(documents(spark).limit(0), 8).collect() == []
    assert mixing.mix(documents(spark).limit(0)).collect() == []


def water(sizes, weights, repeats=3):
    target, left, free = {}, float(sum(sizes.values())), dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > repeats * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("cut", [True, False])
def test_mix_meets_targets(spark, cut):
    docs = documents(spark)
    rows = mixing.mix(docs, cut=cut).collect()
    assert len(rows) == docs.count()
    sizes, taken, targets, longest = Counter(), Counter(), {}, Counter()
    for r in rows:
        n = len((r["text"] or "").encode().split())
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n and (cut or n == 0 or r["taken"] % n == 0)
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= (0.5 if cut else longest[s])


def test_schedule_inverse(spark):
    for schedule in mixing.SCHEDULES:
        got = spark.range(11).select((mixing.running_share(schedule, mixing.F.col("id") / 10.0)).alias("t")).collect()
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, *np.array(schedule).T)
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
        for i, r in enumerate(got):
            assert r["t"] == pytest.approx(np.interp(i / 10 * area[-1], area, grid), abs=1e-3)


def test_training_order_repeats_documents(spark):
    order = mixing.training_order(mixing.mix(documents(spark))).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert len({(r["doc_id"], r["text"], r["copy"]) for r in order}) <= len(order)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_packing_is_best_fit_decreasing(histogram):
    free, placed = [], Counter()
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [x for x in free if x >= length]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - length)
            else:
                free.append(40 - length)
    bins = defaultdict(list)
    for length, rank, first, offset, each in (plan := packing.best_fit_decreasing(histogram, 40)):
        until = min([p[1] for p in plan if p[0] == length and p[1] > rank], default=histogram[length])
        for r in range(until - rank):
            bins[first + r // each].append((offset + r % each * length, length))
            placed[length] += 1
    assert placed == Counter(histogram)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(40 - sum(n for _, n in p) for p in bins.values()) == sorted(free)


def test_pieces_and_sequences(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, docs = Tokenizer.from_file(path), documents(spark)
    pieces = packing.stage(packing.tokenize(docs, path, keep_ids=True), "test-pieces")
    rows = packing.pack(pieces).collect()
    want = Counter()
    for d in docs.collect():
        ids = np.array(model.encode(d["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(d["doc_id"], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends, places = Counter(), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        for offset, length in sorted(parts):
            assert offset == ends[id(parts)]
            ends[id(parts)] += length
        assert ends[id(parts)] <= 4096
    assert {(r["sequence_id"], r["length"], len(r["ids"]) // 4) for r in packing.sequences(packing.pack(pieces)).collect()} == {(s, ends[id(p)], ends[id(p)]) for s, p in places.items()}
    assert packing.pack_documents(docs.limit(0), path).collect() == []


def test_word_ids_equal_the_tokenizer():
    """Letters with odd case, marks, blanks of all kinds, controls and what special tokens are made of."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, words, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(8)
    pool = list("abzABZ019.,;:!?-'\"()[]<>|_ \n\t\r") + ["İ", "ı", "ſ", "Σ", "ς", "ß", "ẞ", "é", "e\u0301", "\u0307", "\u00a0", "\u2003", "\u200b", "\x00", "\x07", "\x85", "\u2028", "漢", "字", "д", "Ж", "ǅ", "ﬁ", "’", "—", "<|", "|>", "</s>", "the", "Word"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(words.text(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 9}</p>") for i in range(60)] + [(60, None, None), (61, "a b\r\nc", ""), (None, "", "<p>1</p>"), (62, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "warc-test")
    index = warc.write_warc(warc.roles(pages), folder)
    got = {r["page_id"]: r for r in warc.read_warc(index, folder, gap=50, span=500).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        body = (html or "").encode()
        last = max(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        r = got[page]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["payload_bytes"] == len(body)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == last else ("revisit", last))
        assert page != last or r["payload"] == body
    some = warc.read_warc(index.where("page_id in (3, 40, 62)"), folder).collect()
    assert {r["page_id"] for r in some} == {3, 40, 62}
    assert warc.read_warc(warc.write_warc(warc.roles(pages.limit(0)), folder), folder).collect() == []
