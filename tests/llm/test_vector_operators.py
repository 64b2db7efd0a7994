"""Operators on embeddings against brute force."""

import numpy as np
import pytest

from parley.llm import ann, neardup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string"


def vectors():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 64))
    x[300:420] = x[300] + 0.03 * rng.standard_normal((120, 64))  # a group of near copies
    for i in range(420, 700, 2):  # pairs close to the threshold
        a = x[i] / np.linalg.norm(x[i])
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        c = rng.uniform(0.94, 0.97)
        x[i + 1] = 3 * (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b))
    rows = [(i, [float(np.float32(t)) for t in r], 0, "a", "b") for i, r in enumerate(x)]
    odd = [(900, None, 0, "", ""), (901, [0.0] * 64, 0, "", ""), (902, [float("nan")] + [1.0] * 63, 0, "", ""), (903, [float("inf")] * 64, 0, "", ""), (904, [None] + [1.0] * 63, None, None, None), (905, [1.0, 2.0], 0, "", ""), (906, [], 0, "", ""), (920, rows[20][1], 0, "", ""), (None, rows[0][1], 0, "", "")]
    return rows + odd


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def sound():
    good = [(i, e) for i, e, *_ in vectors() if i is not None and e and len(e) == 64 and None not in e and np.isfinite(e).all() and any(e)]
    return np.array([i for i, _ in good]), np.array([e for _, e in good], dtype=np.float64)


def test_near_duplicates(table):
    ids, x = sound()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(table).collect()}
    assert len(got) == len(vectors())
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.97 * linked.sum()
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    same = np.mean([got[i]["component_id"] == ids[label[k]] for k, i in enumerate(ids)])
    assert same > 0.97
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert sum(r["kept"] for r in got.values()) == sum(k == r["component_id"] for k, r in got.items() if k is not None)


def test_near_duplicates_in_tiles(table, monkeypatch):
    whole = {tuple(r) for r in neardup.near_duplicates(table).collect()}
    links = neardup.links
    monkeypatch.setattr(neardup, "links", lambda d, n, p, c: links(d, n, p, c, tile=16, bucket_rows=64))
    assert {tuple(r) for r in neardup.near_duplicates(table).collect()} == whole


def test_near_duplicates_of_nothing(table):
    assert neardup.near_duplicates(table.limit(0)).collect() == []
    assert [r["n_links"] for r in neardup.near_duplicates(table.where("vec_id = 901")).collect()] == [0]
    assert [r["n_links"] for r in neardup.near_duplicates(table.where("vec_id in (20, 920)")).collect()] == [1, 1]


@pytest.mark.parametrize("noise", [0.5, 0.25, 0.01])
def test_near_duplicates_with_a_common_direction(spark, noise):
    """Cosines of about 0.8 and of 0.94 to each other, with pairs of near copies; and copies only."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(64)
    x = x / np.linalg.norm(x) + noise / 8 * rng.standard_normal((600, 64))
    x[1:200:2] = x[:200:2] + 0.01 * rng.standard_normal((100, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(rows).collect()}
    found = np.array([got[i] for i in range(600)])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.9 * linked.sum()


@pytest.mark.parametrize("sample", [4096, 64])
def test_nearest(table, sample):
    ids, x = sound()
    rows = ann.nearest(table, ann.F.col("vec_id") % 20 == 0, 20, sample=sample).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        score = x @ x[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(score[list(ids).index(m[1])], abs=1e-9) for m in mine)
        hits += len({m[1] for m in mine} & set(ids[order]))
    assert hits >= 0.9 * 20 * len(queries)


def test_nearest_with_few_candidates(table):
    few = table.where("vec_id in (20, 40, 7, 901, 920)")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few, ann.F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got)[0][2] == 920 and len(got) == 9
    assert ann.nearest(table.limit(0), ann.F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(table.where("vec_id = 20"), ann.F.col("vec_id") % 20 == 0).collect() == []
