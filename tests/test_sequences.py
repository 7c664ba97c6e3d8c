"""Sequence rules against a fold over rows: hot scopes, disordered times, steps that overlap, batches."""

from __future__ import annotations

import random

import pytest
from test_random_captures import RULES, SPARK_RULES, expected, frame, got, random_capture

from procscope.operators import detect, rules
from procscope.operators.scan import next_rows
from procscope.streaming.live import LiveDetection

EVENTS = ["exec", "exec_anon", "file_open", "module"]


def rule(n: int, within: str) -> rules.Rule:
    steps = [{"event": EVENTS[k % len(EVENTS)]} for k in range(n)]
    return rules.parse_rule({"name": "r", "score": 1, "within": within, "sequence": steps})


def fold(rows, n, within, held=None):
    """(completions, attempts in flight) of rows (pid, seq, ts, steps), in order of seq."""
    state, out = dict(held or {}), []
    for pid, seq, ts, steps in sorted(rows, key=lambda x: x[1]):
        step, first = state.get(pid, (0, 0))
        if step and ts - first > within:
            step = 0
        if step and steps >> step & 1:
            step += 1
            if step == n:
                out.append((pid, seq))
                step = 0
        elif steps & 1:
            step, first = 1, ts
        state[pid] = (step, first)
    return sorted(out), {k: v for k, v in state.items() if v[0]}


def random_rows(seed, n, count=300, pids=3):
    rng = random.Random(seed)
    rows, ts = [], 0
    for seq in range(count):
        ts += rng.choice([0, 1, 2, 9])
        late = rng.choice([0, 0, 0, 40]) if seed % 2 else 0  # times may fall back
        pid = 1 if rng.random() < 0.6 else rng.randint(1, pids)
        rows.append((pid, seq, (ts - late) * 10**9, rng.randrange(1, 1 << n)))
    return rows


def steps(spark, rows):
    d = spark.createDataFrame(rows, "pid long, seq long, ts_ns long, steps int")
    return d.selectExpr("'h' AS host", "pid", "0L AS start", "seq", "ts_ns", "steps")


@pytest.mark.parametrize("seed,n,chunk", [(2, 3, 16), (3, 3, 7), (4, 2, None), (5, 4, 25)])
def test_scan_equals_fold_in_batches(spark, seed, n, chunk):
    rows = random_rows(seed, n)
    r = rule(n, "15s")
    want, _ = fold(rows, n, r.within_ns)
    done, _ = rules.sequence_scan(steps(spark, rows), r, chunk)
    assert sorted((x.pid, x.seq) for x in done.collect()) == want
    hits, held = [], None
    for part in (rows[:90], rows[90:91], rows[91:]):
        done, held = rules.sequence_scan(steps(spark, part), r, chunk, held)
        hits += [(x.pid, x.seq) for x in done.collect()]
    assert sorted(hits) == want
    left = {(x.pid, x.step, x.first_ts) for x in held.collect()}
    # An attempt whose window has closed may be gone or not yet noticed as such.
    full = fold(rows, n, r.within_ns)[1]
    assert left <= {(pid, *v) for pid, v in full.items()}


def test_one_step_is_every_row(spark):
    rows = random_rows(8, 1, 20)
    done, left = rules.sequence_scan(steps(spark, rows), rule(1, "5s"), 4)
    assert done.count() == 20 and left.count() == 0


def test_next_rows(spark):
    rng = random.Random(4)
    rows = [(k, s, rng.randrange(50), rng.random() < 0.2) for k in "ab" for s in range(60)]
    d = spark.createDataFrame(rows, "k string, seq long, v long, hit boolean")
    out = next_rows(d, ["k"], {"n": "hit"}, "struct(seq)", "v", size=7).collect()
    assert len(out) == len(rows)
    for r in out:
        later = [(s, v, h) for k, s, v, h in rows if k == r.k and s > r.seq]
        nxt = next((s for s, _, h in later if h), None)
        assert (r.n.seq if r.n else None) == nxt
        peak = [v for s, v, _ in later if nxt is None or s <= nxt]
        assert r.n_peak == (max(peak) if peak else None)


def test_stream_with_rules_equals_replay(spark, tmp_path):
    """Steps of one sequence in different batches; a batch that runs twice changes nothing."""
    events = random_capture(22, n=260)
    d = frame(spark, events).persist()
    job = LiveDetection(spark, str(tmp_path), detect.Settings(chunk=16), "info", ruleset=SPARK_RULES)
    cuts = [0, 90, 93, 260]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        job.batch(d.filter(f"seq > {a} AND seq <= {b}"), n)
        if n == 1:
            job.batch(d.filter(f"seq > {a} AND seq <= {b}"), n)
    assert got(job.incidents()) == expected(events, rules=RULES)
