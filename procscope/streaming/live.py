"""Live detection, ingest and alerting as Structured Streaming jobs.

Each micro-batch runs the same plans as a replay, with what earlier batches left behind as an extra
input. State lives in parquet tables under the job's folder, one version per batch: batch *n* reads
version *n - 1* and writes version *n*, so a batch that is run again gives the same result and the
loss of any executor costs a recomputation, never state. A busy host is spread over the cluster by
the same chunked plans as in batch; no operator keeps a host in one task.
"""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procscope import schema as S
from procscope.functions import events as X
from procscope.operators import alerts as A
from procscope.operators import detect, filters, fleet, graph, score
from procscope.operators.scan import numbered
from procscope.operators.text_index import SearchIndex
from procscope.plans.replay import Prior, replay
from procscope.session import materialize, release
from procscope.sources import capture as src

STATE_TABLES = ("states", "edges", "improving", "reported", "exits", "mark", "named", "in_flight")


class Versions:
    """Versioned parquet tables in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str, batch: int) -> str:
        return os.path.join(self.root, name, f"v={batch}")

    def read(self, name: str, batch: int) -> DataFrame | None:
        """Table as of ``batch``, None before the first one."""
        if batch < 0:
            return None
        path = self.path(name, batch)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            return None
        return self.spark.read.parquet(path)

    def drop(self, name: str, batch: int) -> None:
        """Remove a version that no batch reads any more."""
        if batch >= 0:
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name, batch))
            p.getFileSystem(conf).delete(p, True)

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        path = self.path(name, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def compact_states(states: DataFrame) -> DataFrame:
    """The rows of each process that still decide its state: newest exec, first name since then,
    newest credentials, newest container. At most four per process, found by partial aggregation."""
    execs = states.filter("kind = 'exec'").groupBy(*S.KEY).agg(F.expr("max(seq) AS era"))
    d = states.join(execs, S.KEY, "left").selectExpr("*", "coalesce(era, -2L) AS since")
    o = "seq * 4 + sub"
    keep = d.groupBy(*S.KEY).agg(
        F.expr(
            "array_distinct(array_compact(array("
            f"max(CASE WHEN kind = 'exec' THEN {o} END),"
            f" min(CASE WHEN comm <> '' AND seq >= since THEN {o} END),"
            f" max(CASE WHEN kind <> 'parent' THEN {o} END),"
            f" max(CASE WHEN container <> '' THEN {o} END),"
            f" max({o})))) AS keep"
        )
    )
    return d.drop("era", "since").join(keep, S.KEY).filter(
        f"array_contains(keep, {o})"
    ).drop("keep")


def compact_edges(edges: DataFrame) -> DataFrame:
    """The newest parent of each process; later events see no other."""
    newest = edges.groupBy(*S.KEY).agg(F.expr("max_by(struct(parent, seq), seq) AS e"))
    return newest.select(*S.KEY, "e.parent", "e.seq")


class LiveDetection:
    """Incremental replay of a stream of events.

    ``retain_secs`` drops exited processes, and everything known about them, that long after their
    exit (event time); None keeps all, which makes the stream equal to a replay. Rows older than the
    newest arrival number already processed for their host are late: they go to a side table and are
    never dropped silently. Sequence rules go on with the attempts that earlier batches left in flight, one a
    scope at most. ``snapshot`` holds the processes known before the stream began, ``baseline``
    what is usual.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        settings: detect.Settings = detect.Settings(),
        floor: str = "medium",
        ruleset=None,
        retain_secs: int | None = None,
        snapshot: DataFrame | None = None,
        baseline=None,
    ):
        self.spark, self.folder = spark, folder
        self.snapshot, self.baseline = snapshot, baseline
        self.settings, self.floor, self.ruleset = settings, floor, ruleset
        self.retain_ns = None if retain_secs is None else retain_secs * 1_000_000_000
        self.state = Versions(spark, os.path.join(folder, "state"))
        self.out = Versions(spark, os.path.join(folder, "out"))

    def batch(self, events: DataFrame, n: int) -> None:
        prev = {t: self.state.read(t, n - 1) for t in STATE_TABLES}
        arrived = events = materialize(events, "batch")
        if prev["mark"] is not None:
            m = prev["mark"].selectExpr("host", "seq AS done")
            d = events.join(m, "host", "left")
            late = d.filter("seq <= done").drop("done")
            events = materialize(d.filter("done IS NULL OR seq > done").drop("done"), "in-order")
        else:
            late = events.limit(0)
        self.out.write("late", n, late)
        naming = None
        if self.snapshot is not None:
            # The first event that names a pid may come in any batch, so the snapshot's rows are made
            # anew from all first namings so far and the stored ones give way.
            named = graph.first_namings(events)
            if prev["named"] is not None:
                named = prev["named"].unionByName(named).groupBy("host", "pid").agg(
                    F.expr("min_by(seen_start, seq) AS seen_start"), F.expr("min(seq) AS seq")
                )
            named = self.state.write("named", n, named)
            naming = named.selectExpr(
                "host", "seq", f"{S.EXEC} AS type", "pid AS tgid", "seen_start AS start_boottime",
                "0L AS child_pid", "0L AS child_start_boottime",
            )
            for t in ("states", "edges"):
                prev[t] = None if prev[t] is None else prev[t].filter("seq >= 0")
        r = replay(
            events, self.settings, self.floor, self.baseline, self.ruleset, self.snapshot,
            Prior(
                prev["states"], prev["edges"], prev["improving"], prev["reported"], prev["in_flight"],
                resumes=True,
            ), naming,
        )
        inc = self.out.write("incidents", n, r.incidents)

        exits = events.filter(f"type = {S.EXIT}").selectExpr(
            "host", "tgid AS pid", "start_boottime AS start", "ts_ns AS exited"
        )
        if prev["exits"] is not None:
            exits = prev["exits"].unionByName(exits)
        exits = exits.groupBy(*S.KEY).agg(F.expr("max(exited) AS exited"))
        reported = inc.select(*S.KEY, "rank")
        if prev["reported"] is not None:
            reported = prev["reported"].unionByName(reported)
        reported = reported.groupBy(*S.KEY).agg(F.expr("max(rank) AS rank"))
        mark = events.groupBy("host").agg(F.expr("max(seq) AS seq"), F.expr("max(ts_ns) AS ts_ns"))
        if prev["mark"] is not None:
            mark = prev["mark"].unionByName(mark).groupBy("host").agg(
                F.expr("max(seq) AS seq"), F.expr("max(ts_ns) AS ts_ns")
            )
        mark = self.state.write("mark", n, mark)
        tables = {
            "states": compact_states(r.states),
            "edges": compact_edges(r.edges),
            "improving": r.improving.select(
                "host", "bpid", "bstart", "id", "score", "so", "ts_ns", "spid", "sstart"
            ),
            "reported": reported,
            "exits": exits,
        }
        if r.in_flight is not None:
            tables["in_flight"] = r.in_flight
        if self.retain_ns is not None:
            gone = expired(exits, mark, self.retain_ns)
            tables = {t: without(df, gone, t) for t, df in tables.items()}
        for t, df in tables.items():
            self.state.write(t, n, df)
        # Batch n may run again and reads n - 1; what lies before is read by none.
        for t in STATE_TABLES:
            self.state.drop(t, n - 2)
        release(arrived, events, r.reach, r.signals, r.improving, r.flags)

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame of capture rows."""
        return (
            events.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
            .option("checkpointLocation", os.path.join(self.folder, "checkpoint"))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def incidents(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "out", "incidents"))

    def late(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "out", "late"))


def expired(exits: DataFrame, mark: DataFrame, retain_ns: int) -> DataFrame:
    """Processes whose exit lies more than the retention before their host's newest event."""
    return (
        exits.join(mark.selectExpr("host", "ts_ns AS now"), "host")
        .filter(f"now - exited > {retain_ns}L")
        .select(*S.KEY)
    )


def without(df: DataFrame, gone: DataFrame, table: str) -> DataFrame:
    """Drop what belongs to removed processes; children of one lose their parent link."""
    if table == "improving":
        k = gone.selectExpr("host", "pid AS bpid", "start AS bstart")
        return df.join(k, ["host", "bpid", "bstart"], "left_anti")
    df = df.join(gone, S.KEY, "left_anti")
    if table == "edges":
        k = gone.selectExpr("host", "struct(pid, start) AS parent")
        df = df.join(k, ["host", "parent"], "left_anti")
    return df


def evict(nodes: DataFrame, limit: int) -> DataFrame:
    """Processes to drop so that every host keeps at most ``limit``: longest dead first, then the
    oldest. ``nodes``: (host, pid, start, started, exited?).

    Ranks are counted per (host, second) and only the border second is ranked row by row.
    """
    order = "coalesce(exited, 9000000000000000000 + started DIV 1000000000)"
    d = nodes.selectExpr("*", f"{order} AS o", f"{order} DIV 1000000000 AS b")
    per = d.groupBy("host", "b").agg(F.expr("count(1) AS n"))
    w = "OVER (PARTITION BY host ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    per = per.selectExpr(
        "host", "b", f"coalesce(sum(n) {w}, 0) AS before",
        f"sum(n) OVER (PARTITION BY host) - {limit} AS excess",
    ).filter("before < excess")
    d = d.join(per, ["host", "b"]).selectExpr(
        "*", "row_number() OVER (PARTITION BY host, b ORDER BY o, started, pid) AS r"
    )
    return d.filter("before + r <= excess").select(*S.KEY)


# --- ingest and alerts ---------------------------------------------------------------------------


class FleetIngest:
    """Mixed incident/heartbeat lines into the fleet tables.

    ``lines``: streaming (host, kernel, ip, received, value). With ``index`` every batch of incidents
    is also added to that search index.
    """

    def __init__(self, spark: SparkSession, folder: str, index: SearchIndex | None = None):
        self.spark, self.folder, self.index = spark, folder, index
        self.out = Versions(spark, folder)

    def batch(self, lines: DataFrame, n: int) -> None:
        inc, beats = src.demux(materialize(lines, "lines"))
        # Ids follow arrival: batch first, then position within it.
        inc = inc.selectExpr(
            "host", "kernel", "ip", "received", "coalesce(record.severity, 'INFO') AS severity",
            "coalesce(record.score, 0L) AS score", "record", "1 AS one",
            "xxhash64(host, to_json(record)) AS h",
        )
        order = ["received", "record.ts_ns", "host", "h"]
        inc = numbered(inc, ["one"], order, "received", "id").drop("one", "h")
        last = self.out.read("last_id", n - 1)
        before = 0 if last is None else last.first().id  # one row
        inc = self.out.write("incidents", n, inc.withColumn("id", F.col("id") + before))
        if self.index is not None:
            self.index.add(inc, n)
        top = inc.agg(F.expr(f"coalesce(max(id), {before}L) AS id"))
        self.out.write("last_id", n, top)
        prev = self.out.read("hosts", n - 1)
        cols = [
            "host", "kernel", "ip", "received", "agent_version", "uptime_secs", "events", "drops",
            "decode_panics", "sensors_verified", "attestation_misses", "sensors_active",
            "sensors_total",
        ]
        # The running state is the newest value of each field, kept as one synthetic heartbeat.
        rows = beats.selectExpr(*cols, "received AS seq", "received AS first_seen")
        if prev is not None:
            rows = prev.selectExpr(
                *[c if c != "received" else "last_heartbeat AS received" for c in cols],
                "-1L AS seq", "first_seen",
            ).unionByName(rows)
        state = fleet.host_state(rows)
        first = rows.groupBy("host").agg(F.expr("min(first_seen) AS f"))
        state = state.join(first, "host").withColumn("first_seen", F.col("f")).drop("f")
        self.out.write("hosts", n, state)
        for name in ("hosts", "last_id"):  # batch n may run again and reads n - 1
            self.out.drop(name, n - 2)

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        return (
            lines.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
            .option("checkpointLocation", os.path.join(self.folder, "checkpoint"))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def incidents(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "incidents"))

    def hosts(self, batch: int) -> DataFrame:
        return self.out.read("hosts", batch)


class AlertStream:
    """Floor, throttle and write alert rows; each sink's open window carries over between batches.

    ``incidents``: streaming (id, host, received, record); ``sinks``: (sink, floor), every alert goes
    to each sink whose floor it reaches. Without, there is one sink, ``all``, at ``floor``.
    """

    def __init__(
        self, spark, folder: str, floor: str = "medium", per_window: int = 0, start: int = 0,
        sinks: list[tuple[str, str]] | None = None,
    ):
        self.spark, self.folder = spark, folder
        self.sinks, self.per_window, self.start_at = sinks or [("all", floor)], per_window, start
        self.out = Versions(spark, folder)

    def batch(self, incidents: DataFrame, n: int) -> None:
        cols = ["sink", "at", "ord", "id", "host", "severity", "score", "summary", "webhook", "syslog"]
        rows = None
        for sink, floor in self.sinks:  # configured, so few
            part = A.alerts(incidents, floor).selectExpr(
                f"{X.quote(sink)} AS sink", "received AS at", "id AS ord", "*"
            ).select(*cols)
            rows = part if rows is None else rows.unionByName(part)
        rows = rows.withColumn("opened", F.lit(None).cast("long"))
        seen = self.out.read("open", n - 1)
        if seen is not None:
            # Alerts of a sink's open window take part again, to count against its cap, and say
            # when it opened.
            rows = seen.select(*cols, "opened").unionByName(rows)
        rows = materialize(rows, "alerts")
        start = rows.groupBy("sink").agg(
            F.expr(f"coalesce(min(opened), {self.start_at}L) AS start")
        )
        rows = rows.drop("opened").join(start, "sink")
        sent, held = A.throttle(rows, self.per_window, "start")
        sent = materialize(sent.drop("start"), "sent")
        fresh = sent
        if seen is not None:
            fresh = sent.join(seen.select("sink", "id"), ["sink", "id"], "left_anti")
        self.out.write("delivered", n, fresh.filter("delivered").select(*cols))
        self.out.write("summaries", n, held)
        newest = sent.groupBy("sink").agg(F.expr("max(opened) AS w"))
        still = sent.join(newest, "sink").filter("opened = w").drop("w", "delivered")
        self.out.write("open", n, still)
        self.out.drop("open", n - 2)

    def start(self, incidents: DataFrame, **trigger) -> StreamingQuery:
        return (
            incidents.writeStream.foreachBatch(lambda df, n: self.batch(df, n))
            .option("checkpointLocation", os.path.join(self.folder, "checkpoint"))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def delivered(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "delivered"))

    def summaries(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, "summaries"))


# --- row-wise streams ----------------------------------------------------------------------------


def watched_opens(opens: DataFrame, watches_path: str, sink_path: str, checkpoint: str) -> StreamingQuery:
    """File opens against a watch list that changes: it is read again for every micro-batch."""

    def step(df: DataFrame, n: int) -> None:
        watches = df.sparkSession.read.parquet(watches_path)
        filters.select_opens(df, watches).write.mode("overwrite").parquet(
            os.path.join(sink_path, f"batch={n}")
        )

    return (
        opens.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_time(capture: DataFrame, boot_epoch_us: str = "0") -> DataFrame:
    """Add a timestamp for watermarks. Logic never uses it: arrival order is the truth."""
    return capture.selectExpr(
        "*", f"timestamp_micros(ts_ns DIV 1000 + {boot_epoch_us}) AS event_time"
    )


def row_signals(capture: DataFrame, settings: detect.Settings = detect.Settings()) -> DataFrame:
    """The detectors that need only the event, usable on a stream as is."""
    return detect.detect_rows(capture, settings)


__all__ = [
    "AlertStream", "FleetIngest", "LiveDetection", "Versions", "compact_states", "event_time",
    "evict", "expired", "row_signals", "score", "watched_opens", "without",
]
