"""Exact numbers and edge cases."""

from __future__ import annotations

import random

import pytest

from procscope import schema as S
from procscope.functions import events as X
from procscope.functions import text as T
from procscope.operators import alerts, content, filters, fleet, graph, rules, scan, score
from procscope.operators import baseline as B
from procscope.sources import capture as src

SECOND = 1_000_000_000


def one(spark, expr):
    return spark.range(1).selectExpr(f"{expr} AS v").first().v


@pytest.mark.parametrize(
    "given,want",
    [
        (["mysql", "-phunter2"], ["mysql", "-p<redacted>"]),
        (["mysql", "-p", "sec"], ["mysql", "-p", "<redacted>"]),
        (["mysql", "-p", "-u"], ["mysql", "-p", "-u"]),
        (["psql", "-p", "5432"], ["psql", "-p", "5432"]),
        (["openssl", "-passin", "pass:abc"], ["openssl", "-passin", "pass:<redacted>"]),
        (["x", "--Password=a=b", "--token", "z", "y"], ["x", "--Password=<redacted>", "--token", "<redacted>", "y"]),
        (["x", "-password", "z"], ["x", "-password", "<redacted>"]),
        (["c", "Authorization: Bearer x"], ["c", "Authorization:<redacted>"]),
        (["c", "'Cookie: a"], ["c", "'Cookie:<redacted>"]),
        (["c", "/etc/cookie: a"], ["c", "/etc/cookie: a"]),
        (["g", "https://u:p@h/x@y"], ["g", "https://u:<redacted>@h/x@y"]),
        (["g", "http://h:80/p"], ["g", "http://h:80/p"]),
        (["g", "file:x", "pass:"], ["g", "file:x", "pass:"]),
        ([], []),
    ],
)
def test_redaction(spark, given, want):
    d = spark.createDataFrame([(given,)], "argv array<string>")
    assert d.selectExpr(f"{T.redact_argv()} AS v").first().v == want


@pytest.mark.parametrize(
    "path,want",
    [
        ("/system.slice/docker-" + "ab12" * 16 + ".scope", "docker:ab12ab12ab12"),
        ("/k/cri-containerd-abcdef012345.scope", "containerd:abcdef012345"),
        ("/machine.slice/libpod-0123456789abcdef.scope", "podman:0123456789ab"),
        ("/kubepods/pod1/" + "0f" * 32, "container:0f0f0f0f0f0f"),
        ("/docker-nothexatall.scope", ""),
        ("init.scope", ""),
    ],
)
def test_container_label(spark, path, want):
    assert one(spark, T.container_label(f"'{path}'")) == want


def test_cmdline_cuts_at_a_character(spark):
    text = one(spark, T.cmdline("array(repeat('é', 150))"))
    assert text == "é" * 100 + "..."
    assert one(spark, T.cmdline("array('a', 'b')")) == "a b"


def test_capability_text(spark):
    assert one(spark, X.cap_text("2097152L")) == "CAP_SYS_ADMIN"
    assert one(spark, X.cap_text(f"{1 << 21 | 1 << 5}L")) == "CAP_SYS_ADMIN,+1"
    assert one(spark, X.cap_text(f"{1 << 5 | 1 << 3}L")) == "2 unnamed"


def test_unknown_severity_is_an_error():
    with pytest.raises(ValueError):
        X.parse_severity("loud")


def scored(spark, signals, comm="bash", container=""):
    rows = [
        ("h", 1, 7, 7, 0, True, comm, container, i, s, ts * SECOND) for i, s, ts in signals
    ]
    d = spark.createDataFrame(
        rows,
        "host string, seq long, s_pid long, s_start long, depth int, known boolean, comm string,"
        " container string, id string, score long, ts_ns long",
    )
    r = score.score_evals(d).first()
    return r.base, r.chain, r.total, r.severity


def test_score_goldens(spark):
    same = [("cred_config_write", 35, 0), ("persistence_write", 30, 0)]
    assert scored(spark, same)[:2] == (35, 0)
    three = [("a", 35, 0), ("b", 40, 0), ("c", 50, 0)]
    assert scored(spark, three) == (125, 50, 100, "CRITICAL")
    pair = [("a", 40, 0), ("b", 30, 2)]
    assert scored(spark, pair) == (70, 20, 90, "CRITICAL")
    far = [("a", 40, 0), ("b", 30, 75 * 60)]
    assert scored(spark, far)[:2] == (30, 0)
    assert scored(spark, [("a", 40, 0), ("b", 30, 600)])[1] == 20
    assert scored(spark, [("a", 40, 0), ("b", 30, 601)])[1] == 0
    assert scored(spark, [("a", 50, 0)], comm="nginx", container="docker:x")[2] == 72


def test_closure_reaches_every_node_and_survives_cycles(spark):
    chain = spark.range(1, 101).selectExpr(
        "'h' AS host", "id AS pid", "0L AS start", "id - 1 AS apid", "0L AS astart", "-1L AS vf",
        f"{scan.END}L AS vt",
    )
    seeds = spark.sql("SELECT 'h' AS host, 100L AS pid, 0L AS start")
    def size(links, **kw):
        return graph.closure(links, seeds, **kw).selectExpr("max(depth) AS d", "count(1) AS n").first()

    assert size(chain) == (100, 101)
    assert size(chain, max_nodes=64) == (63, 64)
    loop = chain.selectExpr("host", "pid", "start", "pid % 100 + 1 AS apid", "astart", "vf", "vt")
    assert size(loop) == (99, 100)
    short = chain.selectExpr("host", "pid", "start", "if(pid = 98, 100, pid - 1) AS apid", "astart", "vf", "vt")
    assert size(short) == (2, 3)


def test_snapshot_takes_the_exact_key(spark):
    snap = spark.createDataFrame(
        [("h", 5, 1_000_000_000, 1, "a"), ("h", 6, 1_000_000_000, 5, "b"), ("h", 1, 0, 0, "init")],
        "host string, pid long, start long, ppid long, comm string",
    ).selectExpr("*", "'' AS exe", "'' AS trusted", "CAST(array() AS ARRAY<STRING>) AS argv",
                 "0L AS uid", "0L AS euid")
    cap = spark.createDataFrame(
        [("h", 1, S.CRED, 5, 1_009_000_000, 0, 0), ("h", 2, S.CRED, 6, 1_090_000_000, 0, 0)],
        "host string, seq long, type int, tgid long, start_boottime long, child_pid long,"
        " child_start_boottime long",
    )
    got = {r.pid: (r.exact_start, r.adopted) for r in graph.reconcile(snap, cap).collect()}
    assert got == {5: (1_009_000_000, True), 6: (1_000_000_000, False), 1: (0, False)}
    _, links = graph.snapshot_as_state(snap, cap)
    assert {(r.pid, r.parent.pid, r.parent.start) for r in links.collect()} == {
        (5, 1, 0), (6, 5, 1_009_000_000),
    }


def test_numbered_matches_row_number(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randrange(5)}", e) for e in range(500)]
    d = spark.createDataFrame(rows, "k string, e long")
    got = scan.numbered(d, ["k"], ["e"], "e DIV 32")
    want = d.selectExpr("*", "CAST(row_number() OVER (PARTITION BY k ORDER BY e) AS BIGINT) AS rn")
    assert got.exceptAll(want).count() == 0


def test_collapse_runs_across_chunks(spark):
    values = [1, 1, 2, 2, 2, 1, 1, 3, 3, 3, 3, 3, 1]
    d = spark.createDataFrame(list(enumerate(values)), "seq long, v long").selectExpr("'k' AS k", "*")
    for size in (1, 3, 100):
        got = scan.collapse_runs(d, ["k"], "v", size=size)
        rows = [tuple(x) for x in got.select("valid_from", "valid_to", "v").orderBy("valid_from").collect()]
        assert rows == [(0, 2, 1), (2, 5, 2), (5, 7, 1), (7, 12, 3), (12, scan.END, 1)]


def test_confidence(spark):
    entries = spark.createDataFrame(
        [("a", "/x", 8, 0, 100), ("b", "/x", 1, 5, 5), ("c", "/x", 10_000, 5, 6)], S.BASELINE_ENTRY
    )
    header = spark.createDataFrame([(1000, 100)], "learned_at_ms long, window_ns long")

    def conf(at):
        return {r.signal: r.confidence for r in B.weights(B.Baseline(entries, header, at)).collect()}

    day = 86_400_000
    now = conf(1000)
    assert now["a"] == pytest.approx(1.0)
    assert now["b"] < 0.16
    assert now["c"] < 0.51
    assert conf(1000 + 52 * day)["a"] == pytest.approx(0.5)
    assert conf(1000 + 90 * day)["a"] == 0


def test_expired_baseline_changes_nothing(spark):
    entries = spark.createDataFrame([("a", "/x", 99, 0, 100)], S.BASELINE_ENTRY)
    header = spark.createDataFrame([(1000, 100)], "learned_at_ms long, window_ns long")
    d = spark.createDataFrame([("h", "a", "/x", 40)], "host string, id string, sexe string, score long")
    old = B.adjust(d, B.Baseline(entries, header, 1000 + 100 * 86_400_000)).first()
    assert (old.score, old.evidence_note) == (40, None)
    fresh = B.adjust(d, B.Baseline(entries, header, None)).first()
    assert fresh.score == 4
    assert fresh.evidence_note == " [baseline: seen 99x, confidence 100%]"


def test_baseline_of_the_first_format_loads(spark, tmp_path):
    f = tmp_path / "b.json"
    f.write_text('{"version":1,"entries":[{"signal":"a","exe":"/x","count":9}]}')
    b = B.load(spark, str(f), 5)
    r = B.weights(b).first()
    assert (r.first_ns, r.last_ns) == (0, 0)
    assert r.confidence == pytest.approx(0.5)
    assert "age unknown" in B.summary(b).first().summary


@pytest.mark.parametrize(
    "bad",
    [
        {"name": "r", "score": 1},
        {"name": "r", "score": 1, "match": {"event": "exec"}, "sequence": [{"event": "exec"}]},
        {"name": "r", "score": 1, "match": {"event": "sock_listen"}},
        {"name": "r", "score": 1, "match": {"event": "exec", "colour": 1}},
        {"name": "r", "score": 1, "within": "soon", "sequence": [{"event": "exec"}]},
        {"name": "r", "score": 1, "match": {"event": "exec"}, "extra": 1},
    ],
)
def test_bad_rules_are_refused(bad):
    with pytest.raises(rules.RuleError, match="r"):
        rules.parse_rule(bad)


def test_rules_load_from_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(
        "name: n\nid: X-1\nscore: 55\nattack: [T1068]\nscope: same_lineage\nwithin: 30s\n"
        "sequence:\n  - event: cred_change\n    to_root: true\n  - event: file_mode\n"
    )
    (tmp_path / "note.txt").write_text("ignored")
    r = rules.load_rules(str(tmp_path))
    assert [x.within_ns for x in r] == [30 * SECOND]
    assert tuple(rules.listing(spark, r).first()) == ("X-1", "n", 55, "sequence[2]", "T1068")


def brute_lockout(rows):
    state, out = {}, []
    for a, ts, o, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        fails, first, until = state.get(a, (0, 0, 0))
        if until > ts:
            out.append((a, ts, o, until - ts, False))
            continue
        if ok:
            state.pop(a, None)
            out.append((a, ts, o, 0, False))
            continue
        if fails == 0 or ts - first > 300:
            fails, first, until = 0, ts, 0
        fails += 1
        lock = fails >= 5
        state[a] = (fails, first, ts + 900 if lock else until)
        out.append((a, ts, o, 0, lock))
    return sorted(out)


def test_lockout(spark):
    r = random.Random(5)
    rows, ts = [], 0
    for o in range(800):
        ts += r.choice([0, 1, 20, 80, 1200]) if r.random() < 0.5 else 0
        rows.append((r.choice(["a", "a", "b"]), ts, o, r.random() < 0.1))
    d = spark.createDataFrame(rows, "address string, ts long, ord long, ok boolean")
    got = alerts.lockout(d).select("address", "ts", "ord", "locked_for", "locks")
    assert sorted(tuple(x) for x in got.collect()) == brute_lockout(rows)


def test_throttle(spark):
    r = random.Random(6)
    rows, ts = [], 0
    for o in range(400):
        ts += r.choice([0, 0, 1, 7, 70])
        rows.append(("s", ts, o))
    d = spark.createDataFrame(rows, "sink string, at long, ord long")
    sent, held = alerts.throttle(d, 3, 0)
    want, late, opened, n, suppressed = [], [], 0, 0, 0
    for _, at, o in rows:
        if at - opened >= 60:
            if suppressed:
                late.append((at, suppressed))
            opened, n, suppressed = at, 0, 0
        if n >= 3:
            suppressed += 1
            want.append((o, False))
        else:
            n += 1
            want.append((o, True))
    assert sorted((x.ord, x.delivered) for x in sent.collect()) == want
    assert sorted((x.sent_at, x.suppressed) for x in held.collect()) == late
    assert alerts.throttle(d, 0, 0)[0].filter("NOT delivered").count() == 0


def test_root_key_write_is_dropped_unless_asked_for(spark):
    o = spark.createDataFrame([("h", 1, "/root/.ssh/id_rsa", 2)], "host string, seq long, path string, f_mode long")
    assert filters.select_opens(o, filters.default_watches(spark)).count() == 0
    assert filters.select_opens(o, filters.default_watches(spark, root_key_writes=True)).count() == 1


def test_content_outcomes(spark):
    t = spark.createDataFrame([(x,) for x in "abcdefg"], "target string")
    bodies = [
        ("a", b"xx EVIL yy"), ("b", b"plain"), ("c", b""), ("e", b"\xff\xfe\x80EVIL\x00"),
        ("f", bytes.fromhex("170f7a")), ("g", b"z" * 65_534 + b"EVIL" + b"\xc3\xa9t\xc3\xa9"),
    ]
    c = spark.createDataFrame(bodies, "target string, body binary")
    s = spark.createDataFrame(
        [("r1", "literal", "EVIL"), ("r2", "regex", "E.IL"), ("r3", "hex", "45 56 49 4c"), ("r4", "hex", "70"),
         ("r5", "hex", "0f7a"), ("r6", "regex", "zz+EVIL?é"), ("r7", "regex", "(pl|x)ain"),
         ("r8", "regex", "[0-9]lain"), ("r9", "regex", "plains?")],
        "rule string, kind string, pattern string",
    )
    for limit in (content.SIGNATURE_BYTES, 50):
        got = {r.target: (r.outcome, r.rules) for r in content.identify(t, c, s, limit).collect()}
        assert got == {
            "a": ("matched", ["r1", "r2", "r3"]), "b": ("matched", ["r4", "r7", "r9"]),
            "c": ("raced", None), "d": ("raced", None), "e": ("matched", ["r1", "r2", "r3"]),
            "f": ("matched", ["r5"]), "g": ("matched", ["r1", "r2", "r3", "r6"]),
        }


def test_signatures_with_escapes_masks_and_quotes(spark):
    """What is sure of a pattern is never more than any match of it holds."""
    bodies = {"e": b"zzABCDEzz", "p": b"xx\x4d\x01\x5a\x90yy", "q": b"a.b|c(d", "l": b"abcdef"}
    c = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "target string, body binary")
    hits = {
        r"\x41BCDE": "e", r"\0101BCDE": "e", r"\u0041BCDE": "e", "ABCDE": "e", r"A\QBCD\EE": "e", r"[[A-C]x]BCDE": "e",
        r"z\x41B[\x43]DE": "e", r"\Qa.b|c(d\E": "q", "ab*?cdef": "l", "abx*+cdef": "l", "abc{1,2}?def": "l",
        "(?i)ABCDEF": "l", r"ab\wdef": "l",
    }
    rows = [(k, "regex", k) for k in hits]
    masks = {"4D ?? 5A": "p", "4d??5a90": "p", "4? 0? 5A 9?": "p", "?D 01 ?A": "p", "4D 5A 90": None, "?? ?? ?? ?? 7A": "e",
             "4D 01 5B": None, "41 42 43 44 ?6": None}
    rows += [(k, "hex", k) for k in masks]
    rows += [("short", "literal", "zz"), ("one", "literal", "|"), ("none", "literal", "zy")]
    s = spark.createDataFrame(rows, "rule string, kind string, pattern string")
    t = c.select("target")
    got = {}
    for r in content.identify(t, c, s).collect():
        for rule in r.rules or []:
            got.setdefault(rule, set()).add(r.target)
    want = {k: {v} for k, v in (hits | masks).items() if v} | {"short": {"e"}, "one": {"q"}}
    want["(?i)ABCDEF"] = {"l"}
    assert {k: v for k, v in got.items()} == want
    bad = spark.createDataFrame([("odd", "hex", "4D 5")], s.schema)
    with pytest.raises(Exception, match="odd"):
        content.identify(t, c, bad).collect()


def test_signatures_of_one_magic_number(spark):
    """A thousand signatures begin alike; a body meets those whose rarest bytes it holds only."""
    head = b"MZ\x90\x00"
    bodies = [(str(k), bytearray(b"xx" + head + b"%06d" % k + b"tail")) for k in range(40)]
    c = spark.createDataFrame(bodies, "target string, body binary")
    rows = [(f"s{k}", "hex", (head + b"%06d" % k).hex()) for k in range(1000)]
    s = spark.createDataFrame(rows, "rule string, kind string, pattern string")
    out = content.identify(c.select("target"), c, s).collect()
    assert {r.target: r.rules for r in out} == {str(k): [f"s{k}"] for k in range(40)}


def test_common_grams_of_signatures_yield_no_row_a_body(spark, monkeypatch):
    """What is written about bodies grows with those that hold a rare gram, not with common ones."""
    common = bytes(range(65, 91))
    bodies = [(f"t{k}", bytearray(common * 3 + b"-%d-" % k)) for k in range(300)]
    bodies += [("hit", bytearray(b"xx" + common + b"#rare#yy")), ("cut", bytearray(b"#ra")), ("rest", bytearray(b"re#"))]
    c = spark.createDataFrame(bodies, "target string, body binary")
    s = spark.createDataFrame([("r", "hex", (common + b"#rare#").hex())], "rule string, kind string, pattern string")
    written, real = {}, content.materialize

    def counting(df, label):
        out = real(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(content, "materialize", counting)
    out = {r.target: r.rules for r in content.identify(c.select("target"), c, s).collect()}
    assert {t for t, rules in out.items() if rules} == {"hit"} and len(out) == 303
    assert written["body-grams"] == 1


def test_lockout_of_one_busy_address_in_small_chunks(spark):
    rng = random.Random(12)
    rows, ts = [], 0
    for k in range(500):
        ts += rng.choice([0, 0, 1, 20, 100, 400, 1000])
        rows.append(("a" if rng.random() < 0.8 else "b", ts, k, rng.random() < 0.15))
    d = spark.createDataFrame(rows, "address string, ts long, ord long, ok boolean")
    got = alerts.lockout(d, 16).select("address", "ts", "ord", "locked_for", "locks")
    assert sorted(tuple(x) for x in got.collect()) == brute_lockout(rows)


def test_retention_ceiling(spark):
    rows = [(i, i // 4) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, received long")
    got = sorted(r.id for r in fleet.retain(d, 10, 0, 10).collect())
    assert got == list(range(30, 40))


def test_capture_file_keeps_line_order(spark, tmp_path):
    f = tmp_path / "c.ndjson"
    lines = [
        f'{{"ts_ns":{n},"type":2,"tgid":1,"ppid":0,"start_boottime":{n}}}' for n in range(50)
    ]
    f.write_text("\n".join(lines[:20]) + "\n\nnot json\n" + "\n".join(lines[20:]) + "\n")
    events, bad = src.read_capture(spark, str(f), "h")
    rows = events.orderBy("seq").collect()
    assert [r.ts_ns for r in rows] == list(range(50))
    assert [r.value for r in bad.collect()] == ["not json"]
    assert rows[0].comm == "" and rows[0].argv == [] and rows[0].uid == 0


def test_capture_round_trip_through_files(spark, tmp_path):
    from test_random_captures import frame, random_capture

    d = frame(spark, random_capture(51, n=60))
    src.write_capture(d, str(tmp_path / "out"))
    back, bad = src.parse_lines(
        spark.read.text(str(tmp_path / "out")).selectExpr(
            "host", "monotonically_increasing_id() AS seq", "value"
        )
    )
    cols = [c for c in d.columns if c != "seq"]
    assert bad.count() == 0
    assert back.select(*cols).exceptAll(d.select(*cols)).count() == 0


def test_captures_of_many_hosts_in_one_plan(spark, tmp_path):
    """Two hundred folders, some with several files, one with names that sort by text; no host is split up."""
    want = {}
    for h in range(200):
        d = tmp_path / f"host=h%2F{h}"
        d.mkdir()
        n = 0
        for part in range(1 + h % 3):
            rows = []
            for k in range(1 + (h + part) % 5):
                n += 1
                rows.append(f'{{"ts_ns":{n},"type":2,"tgid":1,"ppid":0,"start_boottime":{h}}}')
            (d / f"part-{part}.ndjson").write_text("\n".join([*rows, "", "broken"]) + "\n")
        want[f"h/{h}"] = (n, 1 + h % 3)
    events, bad = src.read_captures(spark, str(tmp_path))
    got = {}
    for r in events.orderBy("host", "seq").collect():
        got.setdefault(r.host, []).append(r.ts_ns)
    assert {h: (v == list(range(1, len(v) + 1)), len(v)) for h, v in got.items()} == {
        h: (True, n) for h, (n, _) in want.items()
    }
    assert {r.host: r["count"] for r in bad.groupBy("host").count().collect()} == {h: b for h, (_, b) in want.items()}
