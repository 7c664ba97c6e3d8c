"""Top-k search and URL rules against brute force."""

import math

import numpy as np
import pytest

from procscope.llm import pivots, url_rules

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, is_query=lambda i: i % 10 == 0):
    ok = [
        (i, np.array([math.floor(float(np.float32(x)) * 1024) for x in v], object))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.concatenate([v, np.zeros(dim - len(v), object)])) for i, v in ok]
    out = set()
    for i, q in ok:
        if is_query(i):
            s = sorted((-int((q * v).sum()), j) for j, v in ok if j != i)[:k]
            out |= {(i, r, j, -x) for r, (x, j) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_top_k(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.2, 8) * scale).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # many alike
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (None, [0.1] * 8),
             (2003, [float("inf")] + [0.0] * 7), (2010, [0.3, 0.4]), (2020, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = pivots.top_k(df, "vec_id % 10 = 0", 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 5)


def test_top_k_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], VECTORS)
    assert [tuple(r) for r in pivots.top_k(few, "vec_id = 0", 10).collect()] == [(0, 1, 1, 524288)]
    assert pivots.top_k(few.limit(0), "vec_id = 0").count() == 0
    assert pivots.top_k(few.where("vec_id = 0"), "vec_id = 0").count() == 0
    twice = few.unionByName(few)
    got = pivots.top_k(twice, "vec_id = 0", 10).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 1)]


RULES = [
    url_rules.Rule("com/", "allow", True),
    url_rules.Rule("example.com/en/", "block", True),
    url_rules.Rule("www.example.com/en/", "allow", True),
    url_rules.Rule("net/es/", "block", True),
    url_rules.Rule("/ads/", "block", False),
    url_rules.Rule("^track=*x^", "block", False),
    url_rules.Rule("/ads/ok^", "allow", False),
    url_rules.Rule("ning", "block", False),  # no whole token
]
CASES = [
    ("http://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block", None),
    ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow", None),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow", None),
    ("http://a.net/es", "a.net", "/es", None, "allow", None),
    ("http://a.net/es/#x", "a.net", "/es/", "net/es/", "block", None),
    ("http://a.net/ES/", "a.net", "/ES/", None, "allow", None),
    ("http://a.org/Ads/x", "a.org", "/Ads/x", None, "block", "/ads/"),
    ("http://a.org/ads/ok?z", "a.org", "/ads/ok", None, "allow", "/ads/ok^"),
    ("http://a.org/?track=1x", "a.org", "/", None, "block", "^track=*x^"),
    ("http://a.org?u=b://c/d", "a.org", "", None, "allow", None),
    ("http://com", "com", "", None, "allow", None),
    ("ftp://morning.org#x", "morning.org", "", None, "block", "ning"),
    ("://net/es/", "net", "/es/", "net/es/", "block", None),
    ("no scheme.com/", "", "", None, "allow", None),
    ("", "", "", None, "allow", None),
    (None, "", "", None, "allow", None),
]


@pytest.mark.parametrize("limit", [0, 100])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    rows = [(i, c[0], "<html>", "x") for i, c in enumerate(CASES * 2)]
    rows.append((None, CASES[0][0], None, None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_rules.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.page_id % len(CASES)] if r.page_id is not None else CASES[0]
        assert (r.host, r.path, r.rule, r.verdict, r.pattern) == want[1:], want
    assert url_rules.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, []).collect()} == {"allow"}


def test_rules_are_indexed_by_their_rarest_token(spark):
    tokens = spark.createDataFrame(
        [("u", "example"), ("u", "com"), ("v", "com"), ("v", "en"), ("w", "en"), ("w", "com")],
        "_url string, _token string",
    )
    index = url_rules.indexed(url_rules.rule_table(spark, RULES), tokens)
    got = {r.rule: r._token for r in index.collect()}
    assert got["example.com/en/"] == "example" and got["com/"] == "com" and got["ning"] == ""
