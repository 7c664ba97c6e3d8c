"""Streaming queries (K1, K2, K3, K5, K6, K7, G2): each runs a file stream to completion."""

from __future__ import annotations


from pyspark.sql import functions as F

from procscope import schema as S
from procscope.catalog.base import EXTRA, Inputs, query
from procscope.catalog.engine import INCIDENT_COLS, MATCH_RULES, RSCORE, RULED, SEQUENCES
from procscope.catalog.fleet import WALK, WALK_SQL
from procscope.catalog.oracle_base import sql
from procscope.catalog.rows import OPENS, raw_open
from procscope.operators import records
from procscope.session import materialize, scratch_path
from procscope.streaming import live


def _arrived(i: Inputs, df, path: str):
    """A stream of what is new in ``path`` once all tasks have added ``df`` to it. It stops when that is
    done, so the files of ``df`` are one micro-batch, however many they are."""
    df.write.mode("append").parquet(path)
    return i.spark.readStream.schema(df.schema).parquet(path)


def _feed(i: Inputs, df, part: str, n: int, label: str, start) -> None:
    """``df`` as ``n`` micro-batches, in the order of ``part``, of the stream that ``start`` runs."""
    path = scratch_path(i.spark, label)
    for k in range(n):
        start(_arrived(i, df.filter(f"({part}) = {k}"), path)).awaitTermination()


def _live(i: Inputs, floor: str = "low", **kw) -> live.LiveDetection:
    top = i.cap.agg(F.max("ts_ns")).first()[0] + 1
    job = live.LiveDetection(
        i.spark, scratch_path(i.spark, "live"), i.settings, floor, **kw
    )
    _feed(i, i.cap, f"ts_ns * 3 DIV {top}", 3, "live-in", job.start)
    return job


@query(
    "k1_live_detection",
    sql("SELECT host, seq, pid, start, base, chain, total, severity FROM inc WHERE rank >= 1"),
)
def k1(i: Inputs):
    return _live(i).incidents().select(
        "host", "seq", "pid", "start", "base", "chain", "total", "severity"
    )


@query("k1b_live_with_sequences", sql(f"SELECT {INCIDENT_COLS} FROM rinc", {**RULED, **RSCORE}))
def k1b(i: Inputs):
    """Steps of a sequence lie in different batches; the result is that of one replay."""
    job = _live(i, "info", ruleset=[SEQUENCES["lineage"], MATCH_RULES[0]])
    return job.incidents().select(*INCIDENT_COLS.split(", "))


@query("k2_late_rows", sql("SELECT host, seq FROM cap WHERE seq % 50 = 0 AND ts_ns < (SELECT (max(ts_ns) + 1) // 2 FROM cap)"
       " AND seq <= (SELECT max(c.seq) FROM cap c WHERE c.host = cap.host AND c.ts_ns < (SELECT (max(ts_ns) + 1) // 2 FROM cap) AND c.seq % 50 <> 0)"))  # fmt: skip
def k2(i: Inputs):
    """Every fiftieth row of the first half arrives after the rest of it."""
    half = (i.cap.agg(F.max("ts_ns")).first()[0] + 1) // 2
    part = f"CASE WHEN ts_ns >= {half} THEN 2 WHEN seq % 50 = 0 THEN 1 ELSE 0 END"
    job = live.LiveDetection(i.spark, scratch_path(i.spark, "late"), i.settings, "low")
    _feed(i, i.cap, part, 3, "late-in", job.start)
    return job.late().select("host", "seq")


RETAIN = 300
GONE = """
SELECT x.host, x.pid, x.start FROM (SELECT host, pid, start, max(ts_ns) AS exited FROM cap WHERE type = 2
 GROUP BY ALL) x JOIN (SELECT host, max(ts_ns) AS now FROM cap GROUP BY ALL) m ON m.host = x.host
WHERE now - exited > 300000000000"""


@query("k3_state_expiry", sql("SELECT host, pid, start FROM gone", {"gone": GONE}))
def k3(i: Inputs):
    """Exited processes that a stream with retention no longer keeps after its last batch."""
    job = _live(i, retain_secs=RETAIN)
    kept = job.state.read("exits", 2).select(*S.KEY)
    exits = i.cap.filter(f"type = {S.EXIT}").selectExpr(
        "host", "tgid AS pid", "start_boottime AS start"
    )
    return exits.distinct().join(kept, S.KEY, "left_anti").select("host", "pid", "start")


@query(
    "g02_retention",
    sql(
        "SELECT e.host, e.pid, e.start, e.ppid FROM edge e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE"
        " g.host = e.host AND g.pid = e.pid AND g.start = e.start) AND NOT EXISTS (SELECT 1 FROM gone g"
        " WHERE g.host = e.host AND g.pid = e.ppid AND g.start = e.pstart)",
        {"gone": GONE},
    ),
)
def g02(i: Inputs):
    """Parent links left after removing processes that exited long ago."""
    from procscope.operators import graph

    exits = i.cap.filter(f"type = {S.EXIT}").groupBy(
        "host", F.expr("tgid AS pid"), F.expr("start_boottime AS start")
    ).agg(F.expr("max(ts_ns) AS exited"))
    mark = i.cap.groupBy("host").agg(F.expr("max(ts_ns) AS ts_ns"))
    gone = live.expired(exits, mark, RETAIN * 1_000_000_000)
    return live.without(graph.edges(i.cap), gone, "edges").selectExpr(
        *S.KEY, "parent.pid AS ppid"
    )


@query(
    "g02b_eviction",
    sql(
        """SELECT host, pid, start FROM (SELECT n.*, row_number() OVER (PARTITION BY n.host ORDER BY
 exited IS NULL, exited, n.start, n.pid) AS r, count(*) OVER (PARTITION BY n.host) AS total
FROM (SELECT t.host, t.pid, t.start, x.exited FROM (SELECT DISTINCT host, pid, start FROM touch WHERE start > 1) t
 LEFT JOIN (SELECT host, pid, start, max(ts_ns) AS exited FROM cap WHERE type = 2 GROUP BY ALL) x
 ON x.host = t.host AND x.pid = t.pid AND x.start = t.start) n) WHERE r <= total - 10"""
    ),
)
def g02b(i: Inputs):
    exits = i.cap.filter(f"type = {S.EXIT}").groupBy(
        "host", F.expr("tgid AS pid"), F.expr("start_boottime AS start")
    ).agg(F.expr("max(ts_ns) AS exited"))
    nodes = i.states.filter("start > 1").select(*S.KEY).distinct().join(exits, S.KEY, "left")
    return live.evict(nodes.selectExpr(*S.KEY, "start AS started", "exited"), 10)


@query(
    "k5_alert_stream",
    WALK_SQL.format(
        ctes=sql(
            "SELECT * FROM secs JOIN fired",
            {k: v.replace("host AS sink", "'all' AS sink") for k, v in WALK.items()},
        )[len("WITH RECURSIVE ") :].rsplit("\nSELECT * FROM secs", 1)[0]
    ).replace(
        "SELECT id, sink, opened, row_number() OVER (PARTITION BY sink, opened ORDER BY sec, ord) <= 1"
        " AS delivered\nFROM placed",
        "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sink, opened ORDER BY sec, ord) AS r"
        " FROM placed) WHERE r <= 1",
    ),
)
def k5(i: Inputs):
    rows = i.stored.select("id", "host", "received", "record")
    top = rows.agg(F.max("received")).first()[0] + 1
    job = live.AlertStream(i.spark, scratch_path(i.spark, "alerts"), "medium", 1, 0)
    _feed(i, rows, f"received * 3 DIV {top}", 3, "alerts-in", job.start)
    return job.delivered().select("id")


@query(
    "k6_changing_watch_list",
    sql(
        "SELECT host, seq, path FROM raw_open WHERE (f_mode & 2) <> 0 AND ((path LIKE '/etc/cron%')"
        " OR (seq >= (SELECT (max(seq) + 1) // 2 FROM raw_open) AND path LIKE '/home/u3/.ssh/%'))",
        OPENS,
    ),
)
def k6(i: Inputs):
    """A home directory appears between two micro-batches."""
    o = raw_open(i)
    half = (o.agg(F.max("seq")).first()[0] + 1) // 2
    watches = scratch_path(i.spark, "watches")
    i.spark.createDataFrame([("/etc/cron", 1)], "prefix string, flags int").write.parquet(watches)
    out, state = scratch_path(i.spark, "opens"), scratch_path(i.spark, "opens-state")
    src = scratch_path(i.spark, "opens-in")
    first = _arrived(i, o.filter(f"seq < {half}"), src)
    live.watched_opens(first, watches, out, state).awaitTermination()
    i.spark.createDataFrame([("/home/u3/.ssh/", 1)], "prefix string, flags int").write.mode(
        "append"
    ).parquet(watches)
    second = _arrived(i, o.filter(f"seq >= {half}"), src)
    live.watched_opens(second, watches, out, state).awaitTermination()
    return i.spark.read.parquet(out).select("host", "seq", "path")


@query(
    "k7_ingest_stream",
    sql(
        "SELECT s.host, (SELECT count(*) FROM stored t WHERE t.host = s.host) AS incidents,"
        " coalesce((SELECT sum(id) FROM stored t WHERE t.host = s.host), 0)::BIGINT AS ids,"
        " max(received) AS last_heartbeat, arg_max(events, seq) AS events, min(received) AS first_seen,"
        " arg_max(sensors_active, seq) FILTER (sensors_total > 0) AS sensors_active"
        " FROM beats s GROUP BY ALL",
        EXTRA,
    ),
)
def k7(i: Inputs):
    # Heartbeats come from the whole capture; each part would count them again.
    beats = materialize(i.beats, "beats").selectExpr(
        "host", "kernel", "ip", "received",
        "to_json(struct(schema, ts, uptime_secs, agent_version, events, drops, decode_panics,"
        " sensors_verified, attestation_misses, sensors_active, sensors_total)) AS value",
    )
    inc = i.stored.selectExpr("host", "kernel", "ip", "received", f"{records.slim()} AS value")
    lines = beats.unionByName(inc)
    top = lines.agg(F.max("received")).first()[0] + 1
    job = live.FleetIngest(i.spark, scratch_path(i.spark, "fleet"))
    _feed(i, lines, f"received * 3 DIV {top}", 3, "feed", job.start)
    n = job.incidents().groupBy("host").agg(
        F.expr("count(1) AS incidents"), F.expr("sum(id) AS ids")
    )
    return job.hosts(2).join(n, "host", "left").selectExpr(
        "host", "coalesce(incidents, 0L) AS incidents", "coalesce(ids, 0L) AS ids", "last_heartbeat", "events", "first_seen",
        "sensors_active",
    )


