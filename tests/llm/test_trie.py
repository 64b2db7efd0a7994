"""The prefix trie against a plain dictionary of prefixes: copies in many blocks, shared beginnings, odd rows; parts of a scan."""

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import pytest

from parley.llm import trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ROWS = "conv_id long, turn long, role string, text string, h string, key int"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    h = {c: crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def plain_trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in plain_rebuilt(rows).items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((str(min(m)), len(p), str(min(members[p[:-1]]) if p else None), len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def found(df):
    return sorted((str(r[0]), r[1], str(r[2]), *r[3:]) for r in (tuple(r[n] for n in NAMES) for r in df.collect()))


def conversations():
    random.seed(8)
    rows = []
    for c in range(900):
        if c % 3 == 0:  # a third are copies
            turns = ["hello there", "good day", "what is it", "this", "and that", "so long", "bye"]
        elif c % 3 == 1:  # with a common beginning
            turns = ["hello there", "good day", "what is it", "this", "and that", "so long", *[f"x{random.randint(0, 40)}" for _ in range(random.randint(0, 4))]]
        else:
            turns = [random.choice(["", "é", "a" * 50, "b"]) for _ in range(random.randint(1, 8))]
        rows += [(c, i, "user" if i % 2 == 0 else None, t or None, "clash", 1) for i, t in enumerate(turns)]
    rows += [(950, i, "user", f"long {i}", "", 1) for i in range(3000)] + [(1_000_000, i, "user", f"long {i}", "", 1) for i in range(2500)]
    rows += [(None, 1, "user", "nobody's", "", 1), (2001, None, None, None, None, None), (2001, None, None, None, None, None), (2002, 5, "a", "tie", "", 1), (2002, 5, "a", "tie too", "", 1), (-7, 1, "u", "v", "", 1), (3000, None, "later", "null first", "", 1), (3000, 0, "u", "v", "", 1)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns_each", [50_000, 100])
def test_trie_equals_plain(spark, turns_each):
    rows = conversations()
    got = found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, ROWS)), turns_each=turns_each, most_parts=500_000 if turns_each > 100 else 0))
    assert got == plain_trie(rows)


def test_small_tables(spark):
    table = spark.createDataFrame([(1, 0, "a", "b", "", 1)], ROWS)
    assert found(trie.prefix_trie(trie.rebuilt(table.limit(0)))) == []
    for rows in ([(102, 0, "a", "b", "", 1)], [(100, 0, "a", "b", "", 1), (103, 0, "x", "y", "", 1), (103, 0, "x", "y", "", 1)]):
        assert found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, ROWS)))) == plain_trie(rows)


def test_shared_turns():
    key = lambda s: "".join(c * trie.WIDTH for c in s)
    for a, b, n in (("", "", 0), ("ab", "ab", 2), ("ab", "abc", 2), ("abx", "aby", 2), ("x", "y", 0), ("abcdefgh", "abcdexgh", 5)):
        assert trie.shared(key(a), key(b)) == n


def test_long_lists_of_ids_are_chunked(spark):
    rows = [(c, 0, "u", "same", "", 1) for c in range(100, 30_000) if crc32(str(c).encode()) % 6 == 0]
    got = found(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, ROWS))))
    assert got == plain_trie(rows) and got[0][3] == len(rows)
