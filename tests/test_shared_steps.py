"""Steps that every query over incidents shares: each reads and deals its rows once."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from test_random_captures import SPARK_RULES, frame, random_capture

from procscope.catalog import base, streams
from procscope.functions import text
from procscope.operators import detect, graph, records, score
from procscope.plans.replay import replay
from procscope.session import materialize, scratch_path


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_expands_the_lineages_of_incidents_only(spark):
    r = replay(frame(spark, random_capture(5, n=300)), detect.Settings(host_mnt_ns=1), "info")
    r.incidents = materialize(r.incidents, "incidents")
    ev = records.evidence(r)
    assert "RepartitionByExpression" not in _plan(ev)  # no state of a node is looked up
    inc = r.incidents.selectExpr("host", "pid AS s_pid", "start AS s_start", "seq")
    keep = r.on_file.filter("id IS NOT NULL").join(inc, ["host", "s_pid", "s_start", "seq"], "left_semi")
    cols = ["host", "seq", "s_pid", "s_start", "depth", "first_so", "id", "score", "ts_ns", "spid", "sstart"]
    want = sorted(map(str, keep.select(*cols).collect()))
    got = ev.withColumnsRenamed({"pid": "s_pid", "start": "s_start"}).select(*cols).collect()
    assert want and sorted(map(str, got)) == want


def test_columns_of_incidents_reach_their_records(spark):
    r = replay(frame(spark, random_capture(6, n=300)), detect.Settings(host_mnt_ns=1), "info")
    inc = materialize(r.incidents.selectExpr("*", "seq * 7 AS id"), "incidents")
    got = records.records(dataclasses.replace(r, incidents=inc), carry=("id",)).collect()
    assert len(got) == inc.count() > 0 and all(g.id == g.seq * 7 for g in got)


def test_lookups_are_dealt_once_and_chunks_of_lookups_alone_carry_on(spark):
    states = spark.createDataFrame(
        [("h", 1, 1, 0, 0, "exec", "a", "/a", "", 5), ("h", 1, 1, 9, 0, "cred", "b", None, "c1", 6),
         ("h", 1, 1, 41, 0, "exec", "", "/z", "", 7), ("h", 1, 1, 43, 0, "parent", "n", None, "", 7)],
        "host string, pid long, start long, seq long, sub int, kind string, comm string, exe string,"
        " container string, uid long",
    )
    seqs = [0, 8, 9, 20, 21, 33, 40, 41, 42, 43, 44, 90]
    rows = [("h", p, 1, s, f"x{s}") for s in seqs for p in (1, 2)]
    asked = spark.createDataFrame(rows, "host string, pid long, start long, seq long, mark string")
    out = graph.state_asof(asked, states, ("comm", "exe", "container", "uid"), 4)
    assert _plan(out).count("Union") == 1
    got = {(r.pid, r.seq): (r.known, r.comm, r.exe, r.container, r.uid, r.mark) for r in out.collect()}
    assert len(got) == len(rows)
    for s in seqs:
        assert got[2, s] == (False, "", "", "", 0, f"x{s}")
        comm = "a" if s < 41 else "" if s < 43 else "n"
        want = (True, comm, "/a" if s < 41 else "/z", "" if s < 9 else "c1", 5 if s < 9 else 6 if s < 41 else 7)
        assert got[1, s] == (*want, f"x{s}"), s


def test_scores_come_from_periods_not_from_a_look_up_per_evaluation_and_node(spark):
    """As scored from lineage rows, with chunks that cut processes and flags that come and go."""
    for seed, size in ((7, None), (8, 3)):
        settings = detect.Settings(host_mnt_ns=1, chunk=size)
        r = replay(frame(spark, random_capture(seed, n=400)), settings, "info")
        every = r.signals.selectExpr("host", "bpid AS pid", "bstart AS start", "seq").distinct()
        scored, on_file = score.score_candidates(
            every, r.improving, r.reach, r.states, None, settings.lookup, flags=r.flags
        )
        assert "RepartitionByExpression" not in _plan(scored)  # no state of a node is looked up
        want = score.score_evals(on_file)
        assert want.count() > 50 and want.filter("mult > 1").count() > 0
        got = scored.select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parts_of_a_feed_are_written_by_all_tasks_and_are_one_micro_batch_each(spark):
    seen = {}

    def step(df, n):
        files = df.selectExpr("input_file_name() AS f").distinct().count()
        seen[n] = (sorted(r.id for r in df.collect()), files)

    folder = scratch_path(spark, "feed-checkpoint")

    def start(rows):
        out = rows.writeStream.foreachBatch(step).option("checkpointLocation", folder)
        return out.trigger(availableNow=True).start()

    part = "CASE WHEN id < 40 THEN 0 WHEN id < 80 THEN 2 ELSE 3 END"  # nothing in the second
    streams._feed(base.Inputs(spark, ""), spark.range(0, 100, 1, 10), part, 4, "feed", start)
    assert [seen[n][0] for n in range(4)] == [[*range(40)], [], [*range(40, 80)], [*range(80, 100)]]
    assert [seen[n][1] for n in (0, 2, 3)] == [4, 4, 2]


def test_commands_of_signals_come_from_the_lineage_or_the_process_a_rule_names(spark):
    """No row of evidence is dealt by the process it fired on, and texts meet what is on file only."""
    capture = frame(spark, random_capture(3, n=400)).withColumn("argv", F.expr("array('run', 'p' || tgid)"))
    r = replay(capture, detect.Settings(host_mnt_ns=1), "info", ruleset=SPARK_RULES)
    r.incidents = materialize(r.incidents, "incidents")
    assert not r.improving.filter("spid <> bpid OR sstart <> bstart").isEmpty()
    recs, ev = records.records(r), records.evidence(r)
    outer = [line for line in _plan(recs).splitlines() if "Join LeftOuter" in line]
    assert outer and not any("spid" in line for line in outer)
    fired = ["host", "spid", "sstart", "seq"]
    asked = ev.selectExpr("host", "spid AS pid", "sstart AS start", "seq").distinct()
    known = graph.state_asof(asked, r.states, records.FULL).selectExpr(
        "host", "pid AS spid", "start AS sstart", "seq", f"{text.cmdline()} AS cmd"
    )
    cols = ["host", "seq", "id", "spid", "detail", "score", "cmd"]
    want = ev.join(known, fired).select(*cols)
    got = recs.selectExpr("host", "seq", "explode(record.signals) AS s").selectExpr(
        "host", "seq", "s.id", "s.pid AS spid", "s.detail", "s.score", "s.cmdline AS cmd"
    )
    want, got = sorted(map(tuple, want.collect())), sorted(map(tuple, got.collect()))
    assert got == want and any(w[-1] for w in want)
