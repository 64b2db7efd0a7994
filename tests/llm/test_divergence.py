"""The audit of sources against sums in plain Python: heavy and rare terms, blocks of groups, joins without broadcasts, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import divergence

ROWS = "doc_id long, text string, lang string, source string, value long, rank string"


def plain(rows, least=3, top=200):
    seen, n, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for k, (_, text, lang, source, *_) in enumerate(rows):
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            seen[lang, t].add(k)
            n[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (of, t), docs in seen.items() if of == lang and len(docs) >= least), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def p(counts, kept=kept):
            of = sum(counts[t] for t in kept) + len(kept)
            return [1 + 10**9 * (counts[t] + 1) // of for t in kept]

        q, own = p(whole), {s: p(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(own[s], own[o])), o) for o in sources if o != s]
            marks = [((a - b) ** 2 // b, t) for a, b, t in zip(own[s], q, kept) if a > b and n[lang, s][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", marks, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents():
    random.seed(12)
    common, rare = [f"Common{chr(97 + i)}" for i in range(20)], [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)]
    rows = []
    for i in range(700):
        lang, source = random.choice(["en", "en", "de", None, ""]), random.choice(["hot"] * 4 + [f"s{k}" for k in range(9)])
        words = random.choices(common, k=8) + random.choices(rare[: 40 if source == "hot" else 300], k=random.randint(0, 6))
        rows.append((i, " ".join(words) + random.choice([" x1y2z", "-9'", "ß,ÄÖ", "\x00\t"]), lang, source, 5, "clash"))
    rows += [(900, None, "en", "s1", 0, ""), (901, "", "en", "only empty", 0, ""), (None, "Commona commona", "en", None, 0, ""), (902, "word " * 300_000 + "x" * 3_000_000, "en", "s2", 0, ""), (903, None, "xx", None, 0, ""), (904, "lonely terms", "yy", "a", 0, ""), (905, "lonely terms", "yy", "b", 0, "")]
    rows += [(7, "the same row again", "en", "s1", 0, "")] * 4
    return rows


@pytest.mark.parametrize("options, broadcast", [({}, True), ({"block": 3, "share": 0.6}, True), ({"block": 4, "salts": 3}, False)])
def test_audit_equals_plain(spark, monkeypatch, options, broadcast):
    if not broadcast:
        monkeypatch.setattr(divergence, "MOST_UNITS", 0)
        monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    rows = documents()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = divergence.audit(spark.createDataFrame(rows, ROWS).repartition(3), top=7 if options else 200, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, top=7 if options else 200)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], ROWS)).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    of = np.concatenate([rng.integers(1, 9 * 10**15, 500), rng.integers(1, 10**6, 500), [1, 9 * 10**15 - 1]])
    n = np.minimum(of - 1, rng.integers(0, 9 * 10**15, len(of)))
    assert divergence.scaled(n, of).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, of)]


def test_tile_is_the_same_for_any_bound():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 6, 400)
    groups = np.concatenate([np.sort(rng.choice(9, s, replace=False)) for s in sizes])
    counts = rng.integers(1, 50, len(groups))
    n = np.bincount(groups, counts, minlength=9).astype(np.int64) + 400
    sums = []
    for dense in (1, 3, 100):
        tile = divergence.Tile(n[:5], n[3:], 0, 3, dense)
        tile.add(sizes, groups, counts)
        sums.append(tile.out)
    assert (sums[0] == sums[1]).all() and (sums[0] == sums[2]).all()


def test_windows_cut_between_terms():
    raw = b"abc def  ghi " * 50 + b"z" * 400
    for size in (1, 7, 100, 10_000):
        found = list(divergence.windows(raw, size))
        assert b"".join(found) == raw and [t for w in found for t in divergence.TERM.findall(w)] == divergence.TERM.findall(raw)
