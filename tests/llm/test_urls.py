"""Url verdicts: against a plain loop over the rules, in one pass and in many; odd rows; the cascade itself."""

import random
import re

import numpy as np
import pytest

from parley.llm import urls

RULES = "rule string, verdict string"


def plain(url, rules, default="allow"):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest)[0][len(host) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        if rule is None or verdict is None:
            continue
        h, slash, p = rule.partition("/")
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(h + slash + p), h.count("."), verdict, h + slash + p))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.fixture(scope="module")
def web():
    random.seed(4)
    names = ["a", "b", "news", "x1", "shop", "é"]
    host = lambda: ".".join(random.choices(names, k=random.randint(0, 3)) + [random.choice(["com", "net", "ORG"])])
    path = lambda: "".join("/" + x for x in random.choices(["en", "de", "p", "En"], k=random.randint(0, 3))) + random.choice(["", "/"])
    pages = [f"{random.choice(['http', 'HTTPS'])}://{host()}{path()}{random.choice(['', '?q=/a', '#/x'])}" for _ in range(1500)]
    pages += ["http://net", "http://net/", "net/x", "://a.net/", "http:///en", "a://b://net/", "http://.net/", "http://net./", "http://a.net:80/", "x", "http://" + "a." * 3000 + "com/" + "p/" * 30000, "http://a.com/\nline"]
    rules = [(host() + path(), random.choice(["allow", "block"])) for _ in range(300)]
    rules += [("net/", "block"), ("net/", "allow"), ("NET/", "block"), ("/en", "block"), ("", "block"), (None, "block"), ("com", None), ("a.net", "block")]
    return pages, rules


@pytest.mark.parametrize("most_bytes, each", [(64 << 20, 200_000), (64, 20)])
def test_verdicts_equal_plain_loop(spark, web, monkeypatch, most_bytes, each):
    pages, rules = web
    if each < 200_000:  # many segments, few a pass
        monkeypatch.setattr(urls.cascades, "__defaults__", (each, most_bytes))
        most_bytes *= 4
    rows = [(i, u, "clash", 7) for i, u in enumerate(pages)] + [(None, "http://a.com/", "", 1), (3, pages[3], "", 2), (9000, None, None, None), (9001, "", "", 0)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    got = urls.judge(table, spark.createDataFrame(rules, RULES), most_bytes=most_bytes).collect()
    assert sorted(((r["page_id"], *map(str, (r["host"], r["path"], r["rule"], r["verdict"]))) for r in got), key=str) == sorted(((r[0], *map(str, plain(r[1], rules))) for r in rows), key=str)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://A.com/b")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(pages, none, default="block").collect()] == [(1, "http://A.com/b", "a.com", "/b", None, "block")]
    assert urls.judge(pages.limit(0), spark.createDataFrame(list(urls.RULES), RULES)).collect() == []


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 60_000), dtype=np.uint64)
    n = 2000
    rate = n / (2**0.5 * (len(a) - n))
    first = urls.level(a[:n], b[:n], 0, rate)
    passed = np.flatnonzero(first.holds(a[n:], b[n:], 0)) + n
    assert 0 < len(passed) < 2 * n
    levels = urls.build((a[:n], b[:n]), (a[passed], b[passed]), rate)
    assert len(levels) > 3 and (urls.listed(levels, a, b) == (np.arange(len(a)) < n)).all()
    with pytest.raises(ValueError):
        urls.build((a[:n], b[:n]), (a[:1], b[:1]), rate)
