"""Lookups by index against the plain way: search lists, many rules, rules as rows."""

from __future__ import annotations

import json
import random

import pytest
from test_random_captures import frame, random_capture

from procscope.operators import fleet, rules, text_index
from procscope.operators.rules import RuleError

RECORD = (
    "named_struct('severity', s, 'score', n, 'subject', named_struct('comm', c, 'exe', e, 'cmdline', l),"
    " 'lineage', array(c), 'lineage_detail', array(named_struct('comm', c, 'exe', e, 'cmdline', l)),"
    " 'signals', array(named_struct('id', g, 'detail', 'd', 'cmdline', l)), 'attack', array('T1'),"
    " 'yara', CAST(NULL AS ARRAY<STRUCT<target: STRING, outcome: STRING, rules: ARRAY<STRING>>>))"
)


def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENT", 16)
    rng = random.Random(3)
    rows = [
        (k, f"host-{k % 3}", rng.choice(["HIGH", "LOW"]), k, rng.choice(["sh", "Nginx", "é%_'x"]),
         f"/usr/bin/p{k % 7}", rng.choice(["a b c", "curl x|sh", ""]), rng.choice(["setcap", "suid_create"]))
        for k in range(90)
    ]
    d = spark.createDataFrame(
        rows, "id long, host string, s string, n long, c string, e string, l string, g string"
    ).selectExpr("id", "host", f"{RECORD} AS record")
    index = text_index.SearchIndex(spark, str(tmp_path))
    index.add(d.filter("id < 40"), 0)
    index.add(d.filter("id >= 40 AND id < 70"), 1)
    index.add(d.filter("id >= 70"), 2)
    index.add(d.filter("id >= 40 AND id < 70"), 1)  # runs again
    for q in ("setcap", "NGINX host-1", "é%_'x", "p3 high", "sh", "x|sh /usr", "zzzz", "", "b", "bin/p6 suid_create t1"):
        want = sorted((r.id, r.host) for r in fleet.search(d, q).collect())
        assert sorted((r.id, r.host) for r in index.search(q).collect()) == want, q
    longest = index.lists().agg({"n": "max"}).first()[0]
    assert longest <= 16


def test_looked_up_rules_equal_the_projection(spark, monkeypatch):
    matches = [
        {"event": "exec", "filename_equals": "/bin/sh"}, {"event": "exec", "comm_equals": "nginx"},
        {"event": "exec", "filename_prefix": "/usr/", "in_container": False}, {"event": "exec", "filename_prefix": ""},
        {"event": "exec", "filename_contains": "sbin"}, {"event": "file_open", "filename_contains": "/e"},
        {"event": "cred_change", "uid": 0, "to_root": True}, {"event": "cred_change", "euid": 1000},
        {"event": "fork", "to_root": False}, {"event": "file_mode", "gained_suid": True}, {"event": "module"},
        {"event": "exec", "filename_equals": "/bin/sh", "comm_equals": "sh", "in_container": True},
        {"event": "exec", "filename_contains": ""},
    ]
    given = [rules.parse_rule({"name": f"r{k}", "score": k, "match": m}) for k, m in enumerate(matches)]
    cap = frame(spark, random_capture(5, n=200))
    plain = sorted(map(str, rules.match_signals(cap, given).collect()))
    assert len({r.split("id='")[1][:4] for r in plain}) > 8
    monkeypatch.setattr(rules, "IN_PLAN", 0)
    assert sorted(map(str, rules.match_signals(cap, given).collect())) == plain


def test_rules_as_rows_are_refused_as_files_are(spark):
    good = {"name": "a", "score": 1, "match": {"event": "exec"}}
    raw = [
        good, good | {"within": "30s"}, good | {"within": "soon"}, good | {"within": "5 m"}, good | {"scope": "x"},
        good | {"scope": "same_lineage"}, good | {"name": ""}, {"name": "a", "match": {"event": "exec"}},
        good | {"zz": 1, "yy": 2}, {"name": "a", "score": 1}, good | {"sequence": [{"event": "exec"}]},
        {"name": "a", "score": 1, "sequence": []}, good | {"match": {"uid": 0}}, good | {"match": {"event": "exec", "x": 1}},
        {"name": "a", "score": 1, "sequence": [{"event": "exec"}, {"event": "sock_listen"}]},
        {"name": "a", "score": 1, "sequence": [{"event": "exec"}, {"event": "fork"}], "attack": ["T1"]},
    ]
    texts = [json.dumps(r) for r in raw]
    d = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "[1]", "no json", None])], "k int, rule string")
    got = {r.k: r.error for r in rules.check_rules(d).collect()}
    for k, r in enumerate(raw):
        if got[k] is None:
            assert rules.parse_rule(r)
        else:
            with pytest.raises(RuleError, match=got[k].replace("(", ".").replace(")", ".")):
                rules.parse_rule(r)
    assert sum(v is None for v in got.values()) == 5 and got[len(raw)] == "not a rule"


def test_lists_come_from_slices_of_texts(spark, monkeypatch):
    """Grams are listed a slice at a time, for texts of any length, and no plan has a row per gram of a text."""
    monkeypatch.setattr(text_index, "SEGMENT", 8)
    monkeypatch.setattr(text_index, "SLICE", 64)
    rng = random.Random(4)
    texts = {k: "".join(rng.choice("abé ") for _ in range(rng.choice([0, 2, 3, 5, 30, 200]))) for k in range(50)}
    d = spark.createDataFrame(list(texts.items()), "id long, hay string").repartition(3)
    lists = text_index._lists(d, 8)
    plan = lists._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = {}
    for r in lists.collect():
        assert r.n == len(r.places) <= 8 and sorted(set(r.places)) == r.places
        for p in r.places:
            pair = (r.segment * 8 + p + text_index.ZERO, bytes(r.gram))
            assert pair not in got
            got[pair] = r.segment
    raw = {k: t.encode() for k, t in texts.items()}
    assert set(got) == {(k, t[j : j + 3]) for k, t in raw.items() for j in range(len(t) - 2)}
