"""Registry of queries and the inputs they share, all derived from the given tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procscope.operators import detect, graph, records
from procscope.operators.scan import numbered
from procscope.plans.replay import Replay, replay
from procscope.session import materialize
from procscope.sources import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with the SQL that must agree."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_cache: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = Inputs(spark, sf_dir)
    return _cache[key]


class Inputs:
    """Tables of one scale factor. Derived tables are written once per application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """(e, u): event and user number."""
        return self.table("events").selectExpr("event_id AS e", "user_id AS u")

    @cached_property
    def cap(self) -> DataFrame:
        return synth.capture(self.spark, self.dir)

    @cached_property
    def settings(self) -> detect.Settings:
        return detect.Settings(host_mnt_ns=synth.HOST_MNT_NS)

    @cached_property
    def states(self) -> DataFrame:
        return materialize(graph.state_rows(self.cap), "states")

    @cached_property
    def acting(self) -> DataFrame:
        """Processes that did something besides forking."""
        return self.cap.filter("type <> 3").selectExpr(
            "host", "tgid AS pid", "start_boottime AS start"
        ).distinct()

    @cached_property
    def reach(self) -> DataFrame:
        return graph.closure(graph.edge_intervals(graph.edges(self.cap)), self.acting)

    @cached_property
    def signals(self) -> DataFrame:
        return materialize(
            detect.signals(self.cap, self.settings, self.states, self.reach), "all-signals"
        )

    @cached_property
    def run(self) -> Replay:
        """Replay of the whole capture at the lowest floor."""
        r = replay(self.cap, self.settings, "info")
        r.incidents = materialize(r.incidents, "incidents")
        return r

    @cached_property
    def records(self) -> DataFrame:
        return self.stored.select("host", "seq", "severity", "score", "record")

    @cached_property
    def stored(self) -> DataFrame:
        """Incidents as a fleet store holds them: numbered by arrival. They are numbered before they have
        a record, so that no record is sorted or written twice."""
        inc = self.run.incidents.selectExpr("*", "1 AS one")
        order = ["ts_ns", "host", "seq"]
        inc = numbered(inc, ["one"], order, "ts_ns DIV 1000000000", "id").drop("one")
        inc = materialize(inc, "numbered-incidents")
        d = records.records(dataclasses.replace(self.run, incidents=inc), carry=("id",))
        return materialize(
            d.selectExpr(
                "id", "host", "seq", "record.ts_ns DIV 1000000000 AS received", "severity", "score",
                "record", "concat('6.', id % 4) AS kernel", "'' AS ip",
            ),
            "stored",
        )

    @cached_property
    def beats(self) -> DataFrame:
        """A heartbeat per host and minute of activity; some hosts stop early, some never report."""
        m = self.cap.groupBy("host", F.expr("ts_ns DIV 60000000000 AS minute")).agg(
            F.expr("max(seq) AS events")
        )
        top = m.agg(F.max("minute").alias("top"))
        h = "CAST(substring(host, 6) AS BIGINT)"
        keep = (
            f"CASE {h} % 4 WHEN 0 THEN true WHEN 1 THEN minute <= top - 5"
            f" WHEN 2 THEN minute <= top - 20 ELSE false END"
        )
        return m.crossJoin(F.broadcast(top)).filter(keep).selectExpr(
            "host", "minute * 60 AS received", "minute AS seq", "'procscope.heartbeat/v1' AS schema",
            "minute * 60 AS ts", "minute * 60 AS uptime_secs",
            "concat('1.', minute % 3) AS agent_version", "events", "minute % 7 AS drops",
            "0L AS decode_panics",
            "CASE host WHEN 'host-5' THEN false WHEN 'host-6' THEN NULL ELSE true END"
            " AS sensors_verified",
            "minute % 2 AS attestation_misses",
            "CASE WHEN minute % 5 = 0 THEN 0L ELSE 5 + minute % 7 END AS sensors_active",
            "CASE WHEN minute % 5 = 0 THEN 0L ELSE 11L END AS sensors_total",
            "CASE WHEN minute % 3 = 0 THEN '' ELSE concat('6.', minute % 4) END AS kernel",
            "CASE WHEN minute % 2 = 0 THEN '' ELSE concat('10.0.0.', minute % 9) END AS ip",
        )

    @cached_property
    def now(self) -> int:
        top = self.cap.agg(F.expr("max(ts_ns DIV 60000000000)")).first()[0]
        return (top + 1) * 60

    @cached_property
    def triage_log(self) -> DataFrame:
        acts = (
            "array(CASE WHEN id % 3 = 0 THEN named_struct('n', 1L, 'h', host, 'by', 'ana',"
            " 'note', CAST(NULL AS STRING), 'resolved', true, 'expect', false) END,"
            " CASE WHEN id % 5 = 0 THEN named_struct('n', 2L, 'h', host, 'by', 'bo',"
            " 'note', if(id % 10 = 0, '', concat('n', id)),"
            " 'resolved', CAST(NULL AS BOOLEAN), 'expect', false) END,"
            " CASE WHEN id % 15 = 0 THEN named_struct('n', 3L, 'h', host, 'by', 'cy',"
            " 'note', CAST(NULL AS STRING), 'resolved', false, 'expect', false) END,"
            " CASE WHEN id % 7 = 0 THEN named_struct('n', 4L, 'h', host, 'by', 'di',"
            " 'note', CAST(NULL AS STRING), 'resolved', CAST(NULL AS BOOLEAN), 'expect', true) END,"
            " CASE WHEN id % 11 = 0 THEN named_struct('n', 5L, 'h', 'host-x', 'by', 'eve',"
            " 'note', 'lost', 'resolved', true, 'expect', false) END)"
        )
        return self.stored.selectExpr(
            "id", "received", f"explode(array_compact({acts})) AS a"
        ).selectExpr(
            "id * 10 + a.n AS seq", "a.h AS host", "id", "a.by AS by",
            "received + 10 * a.n AS at", "a.note AS note", "a.resolved AS resolved",
            "a.expect AS expect",
        )

    @cached_property
    def triaged(self) -> DataFrame:
        from procscope.operators import fleet

        return materialize(fleet.triage(self.stored, self.triage_log)[0], "triaged")


LOG_SQL = """
SELECT id * 10 + 1 AS seq, host, id, 'ana' AS by, received + 10 AS at, NULL::VARCHAR AS note,
       true AS resolved, false AS expect FROM stored WHERE id % 3 = 0
UNION ALL SELECT id * 10 + 2, host, id, 'bo', received + 20,
       CASE WHEN id % 10 = 0 THEN '' ELSE 'n' || id END, NULL, false FROM stored WHERE id % 5 = 0
UNION ALL SELECT id * 10 + 3, host, id, 'cy', received + 30, NULL, false, false
       FROM stored WHERE id % 15 = 0
UNION ALL SELECT id * 10 + 4, host, id, 'di', received + 40, NULL, NULL, true
       FROM stored WHERE id % 7 = 0
UNION ALL SELECT id * 10 + 5, 'host-x', id, 'eve', received + 50, 'lost', true, false
       FROM stored WHERE id % 11 = 0"""
TRIAGED_SQL = """
SELECT s.*,
  coalesce((SELECT arg_max(l.resolved, l.seq) FROM triage_log l WHERE l.host = s.host AND l.id = s.id
            AND l.resolved IS NOT NULL), false) AS resolved,
  coalesce((SELECT arg_max(l.by, l.seq) FROM triage_log l WHERE l.host = s.host AND l.id = s.id), '')
    AS resolved_by,
  coalesce((SELECT arg_max(l.at, l.seq) FROM triage_log l WHERE l.host = s.host AND l.id = s.id), 0)
    AS resolved_at,
  coalesce((SELECT arg_max(l.note, l.seq) FROM triage_log l WHERE l.host = s.host AND l.id = s.id
            AND l.note IS NOT NULL), '') AS note
FROM stored s"""
BEATS_SQL = """
SELECT * FROM (
SELECT m.host, minute * 60 AS received, minute AS seq, minute * 60 AS uptime_secs,
  '1.' || (minute % 3) AS agent_version, events, minute % 7 AS drops,
  CASE m.host WHEN 'host-5' THEN false WHEN 'host-6' THEN NULL ELSE true END AS sensors_verified,
  minute % 2 AS attestation_misses,
  CASE WHEN minute % 5 = 0 THEN 0 ELSE 5 + minute % 7 END AS sensors_active,
  CASE WHEN minute % 5 = 0 THEN 0 ELSE 11 END AS sensors_total,
  CASE WHEN minute % 3 = 0 THEN '' ELSE '6.' || (minute % 4) END AS kernel,
  CASE WHEN minute % 2 = 0 THEN '' ELSE '10.0.0.' || (minute % 9) END AS ip, minute,
  substring(m.host, 6)::BIGINT % 4 AS q, (SELECT max(ts_ns // 60000000000) FROM cap) AS top
FROM (SELECT host, ts_ns // 60000000000 AS minute, max(seq) AS events FROM cap GROUP BY ALL) m)
WHERE q = 0 OR (q = 1 AND minute <= top - 5) OR (q = 2 AND minute <= top - 20)"""
NOW_SQL = "((SELECT max(ts_ns // 60000000000) FROM cap) + 1) * 60"
EXTRA = {"triage_log": LOG_SQL, "triaged": TRIAGED_SQL, "beats": BEATS_SQL}
