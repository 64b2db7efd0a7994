"""Components, k-means and linkages against NumPy and brute force."""

import numpy as np
import pandas as pd
import pytest

from parley.operators import reduction


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "v": [r.tolist() for r in x], **more})).repartition(3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    return rng.normal(size=(400, 12)) * np.array([9, 5, 3, 2, 1, 1, 1, 0.5, 0.5, 0.2, 0.1, 0.1]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + rng.normal(size=12) * 4


def test_components_equal_numpy(spark, cloud):
    odd = spark.createDataFrame([(1000, None), (1001, [1.0, float("nan"), *[0.0] * 10]), (1002, [])], "vec_id long, v array<double>")
    found, placed = reduction.principal_components(frame(spark, cloud).union(odd), 4, more=4, passes=12)
    values, vectors = np.linalg.eigh(np.cov(cloud.T))
    rows = found.orderBy("component").collect()
    assert [r["variance"] for r in rows] == pytest.approx(values[::-1][:4], rel=1e-6)
    assert [r["share"] for r in rows] == pytest.approx(values[::-1][:4] / values.sum(), rel=1e-6)
    want = vectors[:, ::-1][:, :4].T
    for r, w in zip(rows, want):
        assert max(r["direction"], key=abs) > 0 and abs(np.dot(r["direction"], w)) == pytest.approx(1, abs=1e-5)
    got = {r["vec_id"]: r["coordinates"] for r in placed.collect()}
    centred = (cloud - cloud.mean(axis=0)) @ np.array([r["direction"] for r in rows]).T
    assert set(got) == set(range(400)) and all(np.allclose(got[i], centred[i], atol=1e-6) for i in got)


def test_components_of_next_to_nothing(spark, cloud):
    found, placed = reduction.principal_components(frame(spark, cloud[:1]), 3)
    assert found.count() == 0 and placed.count() == 1
    found, _ = reduction.principal_components(frame(spark, np.ones((5, 3))), 2)
    assert [round(r["variance"], 9) for r in found.collect()] == [0.0, 0.0]
    assert reduction.principal_components(frame(spark, cloud).limit(0), 2)[0].count() == 0


def plain_kmeans(x, k, rng):
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(50):
        at = reduction._far(x, centres).argmin(axis=1)
        centres = np.stack([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(k)])
    return reduction._far(x, centres).min(axis=1).sum()


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(30, 5)) + rng.normal(size=5) * 6 for _ in range(9)])
    labels, cost = reduction.kmeans(frame(spark, x), 9, passes=15)
    first = {r["vec_id"]: r["cluster"] for r in labels.collect()}
    assert cost <= min(plain_kmeans(x, 9, np.random.default_rng(s)) for s in range(10)) + 1e-6
    at = np.array([first[i] for i in range(len(x))])
    assert cost == pytest.approx(sum(((x[at == c] - x[at == c].mean(axis=0)) ** 2).sum() for c in range(9)), rel=1e-6)
    again = {r["vec_id"]: r["cluster"] for r in reduction.kmeans(frame(spark, x).repartition(5), 9, passes=15)[0].collect()}
    assert first == again
    few = reduction.kmeans(frame(spark, np.array([[0.0, 1.0]] * 4 + [[5.0, 5.0]])), 3, restarts=2)
    assert few[1] == pytest.approx(0) and {r["vec_id"]: r["cluster"] for r in few[0].collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}
    assert reduction.kmeans(frame(spark, x).limit(0), 3)[0].count() == 0


def brute(x, kind, clusters):
    """Joins the two nearest clusters, by the definition of the distance of clusters."""
    groups = [[i] for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def far(a, b):
        if kind == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        d = 1 - u[a] @ u[b].T
        return d.mean() if kind == "average" else d.max()

    while len(groups) > clusters:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    out = np.zeros(len(x), dtype=int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out.tolist()


@pytest.mark.parametrize("kind", ["average", "complete", "ward"])
def test_linkages_equal_brute_force(spark, kind):
    x = np.random.default_rng(3).normal(size=(60, 4))
    df = frame(spark, x, grp=[i // 30 for i in range(60)])
    for clusters in (1, 4, 30, 99):
        got = {r["vec_id"]: r["cluster"] for r in reduction.linkage(df, "grp", "vec_id", clusters, kind).collect()}
        assert [got[i] for i in range(60)] == brute(x[:30], kind, clusters) + brute(x[30:], kind, clusters)
    with pytest.raises(ValueError):
        reduction.linkage(df, "grp", "vec_id", 2, "single")
