"""Plans against the sequential interpreter, on random captures with awkward shapes."""

from __future__ import annotations

import random

import pytest
from sequential import Interpreter

from procscope import schema as S
from procscope.operators import baseline as B
from procscope.operators import detect, rules
from procscope.plans.replay import replay
from procscope.sources.capture import fill_defaults
from procscope.streaming.live import LiveDetection

FIELDS = [
    "host", "seq", "ts_ns", "type", "tgid", "ppid", "start_boottime", "uid", "euid", "old_euid", "comm",
    "filename", "container", "exe_trusted", "child_pid", "child_start_boottime", "file_mode",
    "target_pid", "aux",
]
EXES = [("/bin/sh", "sh", ""), ("/usr/sbin/nginx", "nginx", "nginx"), ("/tmp/x", "x", ""),
        ("/usr/bin/sudo", "sudo", "sudo"), ("/usr/bin/node", "node", ""), ("/bin/empty", "", "")]
NAMES = ["nginx", "", "bash", "kworker/1", "sshd"]


def random_capture(seed: int, n: int = 400, procs: int = 12, hot: float = 0.4):
    """Events of few processes, one of them very busy: forks that repeat, move a child to another
    parent or close a cycle, names that start empty, containers that appear late, equal times."""
    r = random.Random(seed)
    keys = [(10 + k % 5, k) for k in range(procs)]
    out, ts = [], 0
    for seq in range(1, n + 1):
        ts += r.choice([0, 1, 1, 30, 200]) * 1_000_000_000
        pid, start = keys[0] if r.random() < hot else r.choice(keys)
        t = r.choice([1, 1, 3, 3, 4, 4, 5, 5, 5, 6, 8, 8, 10, 12, 2])
        exe, comm, trusted = r.choice(EXES)
        child = r.choice(keys)
        e = dict.fromkeys(FIELDS, 0) | {
            "host": "h", "seq": seq, "ts_ns": ts, "type": t, "tgid": pid, "start_boottime": start,
            "uid": r.choice([0, 1000]), "euid": r.choice([0, 1000]), "old_euid": r.choice([0, 42]),
            "comm": comm if t == 1 else r.choice(NAMES), "filename": "", "exe_trusted": "",
            "container": r.choice(["", "", "", "", "docker:a"]),
        }
        if t == 1:
            e |= {"filename": exe, "exe_trusted": trusted}
        elif t == 3:
            e |= {"child_pid": child[0], "child_start_boottime": child[1]}
        elif t == 5:
            e |= {
                "file_mode": r.choice([1, 2]),
                "filename": r.choice(
                    ["/etc/cron.d/a", "/etc/x", "/proc/sys/kernel/core_pattern", "/etc/shadow"]
                ),
            }
            if e["file_mode"] == 2 and e["filename"] == "/etc/shadow":
                e["filename"] = "/etc/x"
        elif t == 8:
            e |= {"aux": r.choice([1, 2]), "target_pid": r.choice(keys)[0]}
        out.append(e)
    return out


def frame(spark, events):
    d = spark.createDataFrame(
        [tuple(e[f] for f in FIELDS) for e in events],
        "host string, seq long, ts_ns long, type int, tgid long, ppid long, start_boottime long,"
        " uid long, euid long, old_euid long, comm string, filename string, container string,"
        " exe_trusted string, child_pid long, child_start_boottime long, file_mode long,"
        " target_pid long, aux long",
    )
    missing = [f for f in S.EVENT_STRUCT.fields if f.name not in FIELDS]
    d = d.selectExpr("*", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in missing])
    return fill_defaults(d)


def expected(events, **kw):
    it = Interpreter(**kw)
    return sorted(x for x in map(it.step, events) if x)


def got(incidents):
    return sorted(
        tuple(r)
        for r in incidents.select(
            "host", "seq", "pid", "start", "base", "chain", "total", "rank"
        ).collect()
    )


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, 16), (3, 7)])
def test_replay_equals_interpreter(spark, seed, chunk):
    events = random_capture(seed)
    r = replay(frame(spark, events), detect.Settings(chunk=chunk), "info")
    assert got(r.incidents) == expected(events)


def test_replay_with_baseline(spark):
    events = random_capture(11)
    entries = [("suid_create", "/bin/sh", 9, 1, 10), ("credential_store_read", "/tmp/x", 3, 1, 4)]
    b = B.Baseline(
        spark.createDataFrame(entries, S.BASELINE_ENTRY),
        spark.createDataFrame([(10, 100, 20)], "events_observed long, learned_at_ms long, window_ns long"),
        None,
    )
    factors = {(r.signal, r.exe): r.factor for r in B.weights(b).collect()}
    assert 0.1 < factors[("suid_create", "/bin/sh")] < 1
    r = replay(frame(spark, events), detect.Settings(chunk=16), "info", baseline=b)
    assert got(r.incidents) == expected(events, baseline=factors)


SECOND = 1_000_000_000
RULES = [
    ("lin", 55, "same_lineage", 600 * SECOND,
     [lambda e: e["type"] == 4 and e["old_euid"] != 0 and e["euid"] == 0, lambda e: e["type"] == 6]),
    ("three", 33, "same_process", 300 * SECOND,
     [lambda e: e["type"] == 1, lambda e: e["type"] in (1,), lambda e: e["type"] == 5]),
    ("match", 12, "same_process", 0, [lambda e: e["type"] == 1 and e["container"] != ""]),
]
SPARK_RULES = [
    rules.parse_rule(
        {"name": "lin", "score": 55, "scope": "same_lineage", "within": "600s",
         "sequence": [{"event": "cred_change", "to_root": True}, {"event": "file_mode"}]}
    ),
    rules.parse_rule(
        {"name": "three", "score": 33, "within": "5m",
         "sequence": [{"event": "exec"}, {"event": "exec"}, {"event": "file_open"}]}
    ),
    rules.parse_rule(
        {"name": "match", "score": 12, "match": {"event": "exec", "in_container": True}}
    ),
]


@pytest.mark.parametrize("seed,chunk", [(21, None), (22, 9)])
def test_replay_with_rules(spark, seed, chunk):
    events = random_capture(seed, n=300)
    r = replay(
        frame(spark, events), detect.Settings(chunk=chunk), "info", ruleset=SPARK_RULES
    )
    assert got(r.incidents) == expected(events, rules=RULES)


def test_stream_equals_replay(spark, tmp_path):
    """Batches cut anywhere give the incidents of one replay; a batch run twice changes nothing."""
    events = random_capture(31, n=240)
    d = frame(spark, events).persist()
    job = LiveDetection(spark, str(tmp_path), detect.Settings(chunk=16), "info")
    cuts = [0, 60, 61, 180, 240]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        job.batch(d.filter(f"seq > {a} AND seq <= {b}"), n)
        if n == 1:
            job.batch(d.filter(f"seq > {a} AND seq <= {b}"), n)
    assert got(job.incidents()) == expected(events)


def test_stream_of_tables_too_large_to_broadcast(spark, tmp_path):
    """Every join is dealt by key, and every exchange is cut into partitions by its own sizes."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in small}
    events = random_capture(32, n=400, procs=60, hot=0.1)
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        job = LiveDetection(spark, str(tmp_path), detect.Settings(), "info")
        for n, (lo, hi) in enumerate([(0, 200), (200, 400)]):
            job.batch(frame(spark, events[lo:hi]), n)
        assert got(job.incidents()) == expected(events)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_floor_is_a_filter(spark):
    """A pass per floor and one pass with a filter agree."""
    events = random_capture(41, n=250)
    r = replay(frame(spark, events), detect.Settings(chunk=None), "info")
    every = got(r.incidents)
    for floor in range(5):
        assert [x for x in every if x[-1] >= floor] == expected(events, floor=floor)


def test_nameless_snapshot_process_takes_its_name_from_the_capture(spark):
    """A snapshot process without a name forks as a daemon; its child's shell is still found."""
    snap = spark.sql(
        "SELECT 'h' AS host, 5L AS pid, 1000L AS start, 1L AS ppid, '' AS comm, '' AS exe, '' AS trusted,"
        " CAST(array() AS ARRAY<STRING>) AS argv, 0L AS uid, 0L AS euid"
    )
    base = dict(random_capture(1)[0], container="", uid=0, euid=0)
    fork = base | {
        "seq": 1, "ts_ns": 10, "type": 3, "tgid": 5, "start_boottime": 1000, "comm": "nginx",
        "child_pid": 6, "child_start_boottime": 2000,
    }
    shell = base | {
        "seq": 2, "ts_ns": 20, "type": 1, "tgid": 6, "start_boottime": 2000, "comm": "sh",
        "filename": "/bin/sh", "child_pid": 0, "child_start_boottime": 0,
    }
    cap = frame(spark, [fork, shell])
    for chunk in (None, 1):
        r = replay(cap, detect.Settings(chunk=chunk), "info", snapshot=snap)
        assert [s.id for s in r.signals.collect()] == ["shell_from_network_daemon"]
        assert r.incidents.count() == 1


def test_stream_with_snapshot_and_baseline_equals_replay(spark, tmp_path):
    """Snapshot processes are first named in different batches, some under another start."""
    events = [e | {"start_boottime": e["start_boottime"] + 50_000_000 * (e["tgid"] % 2)} for e in random_capture(31)]
    snap = spark.createDataFrame(
        [("h", 10 + k % 5, k + 3, 10 + (k + 1) % 5, "nginx" if k % 3 else "") for k in range(6)],
        "host string, pid long, start long, ppid long, comm string",
    ).selectExpr("*", "'/x' AS exe", "'' AS trusted", "CAST(array() AS ARRAY<STRING>) AS argv",
                 "0L AS uid", "0L AS euid")
    entries = [("suid_create", "/bin/sh", 9, 1, 10), ("credential_store_read", "/tmp/x", 3, 1, 4)]
    base = B.Baseline(
        spark.createDataFrame(entries, S.BASELINE_ENTRY),
        spark.createDataFrame([(10, 100, 20)], "events_observed long, learned_at_ms long, window_ns long"),
        None,
    )
    settings = detect.Settings(chunk=64)
    want = got(replay(frame(spark, events), settings, "info", base, snapshot=snap).incidents)
    job = LiveDetection(spark, str(tmp_path), settings, "info", snapshot=snap, baseline=base)
    for n, (lo, hi) in enumerate([(0, 90), (90, 250), (250, 400)]):
        job.batch(frame(spark, events[lo:hi]), n)
    assert got(job.incidents()) == want
    assert job.state.read("states", 0) is None and job.state.read("states", 1) is not None
