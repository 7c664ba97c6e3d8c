"""Fleet roll-ups over stored incidents and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.functions import events as X
from procscope.functions import text as T
from procscope.operators.scan import chunk_of, last_known, over

# Fixed values.
HEARTBEAT_SECS = 60
STALE_SECS = 3 * HEARTBEAT_SECS
SILENT_SECS = 10 * HEARTBEAT_SECS
DARK = "status IN ('blind', 'silent', 'stale')"


def newest(df: DataFrame, keys: list[str], order: list[str], n: int, chunk: str) -> DataFrame:
    """The ``n`` newest rows per key. ``chunk`` cuts a key into pieces ranked on their own first, so
    at most ``n`` rows per piece meet in one task."""
    desc = ", ".join(f"{c} DESC" for c in order)
    local = over([*keys, "_chunk"], desc)
    d = df.selectExpr("*", f"{chunk} AS _chunk").selectExpr("*", f"row_number() {local} AS _n")
    d = d.filter(f"_n <= {n}").drop("_n", "_chunk")
    whole = f"OVER ({'PARTITION BY ' + ', '.join(keys) if keys else ''} ORDER BY {desc})"
    return d.selectExpr("*", f"row_number() {whole} AS _n").filter(f"_n <= {n}").drop("_n")


def newest_per_host(incidents: DataFrame, n: int) -> DataFrame:
    return newest(incidents, ["host"], ["id"], n, chunk_of("id"))


def retain(
    incidents: DataFrame, now: int, days: int, ceiling: int | None = None
) -> DataFrame:
    """Age limit first (0 days keeps every age), then the newest ``ceiling`` rows if one is given.

    The cut-off of the ceiling is found from counts per second, so nothing is sorted as a whole:
    seconds that fit entirely stay, and only the second on the border is ranked.
    """
    d = incidents if days <= 0 else incidents.filter(F.col("received") >= now - days * 86_400)
    if ceiling is None:
        return d
    # Two levels, so that no task holds all seconds of the history: days, then the seconds of each.
    per = d.groupBy("received").agg(F.expr("count(1) AS n"))
    per = per.selectExpr("*", "received DIV 86400 AS day")
    days_ = per.groupBy("day").agg(F.expr("sum(n) AS total")).selectExpr(
        "day", "coalesce(sum(total) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1"
        " PRECEDING), 0L) AS later",
    )
    per = per.join(days_.filter(f"later < {ceiling}"), "day").selectExpr(
        "received", "n",
        "later + sum(n) OVER (PARTITION BY day ORDER BY received DESC"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS above",
    ).filter(f"above < {ceiling}")
    d = d.join(per, "received")
    whole = d.filter(f"above + n <= {ceiling}")
    border = d.filter(f"above + n > {ceiling}").orderBy(F.desc("id"))
    border = border.selectExpr("*", f"row_number() {over(['received'], 'id DESC')} AS _r")
    border = border.filter(f"_r <= {ceiling} - above").drop("_r")
    return whole.unionByName(border).select(*incidents.columns)


def triage(incidents: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a triage log (seq, host, id, by, at, note?, resolved?) to incidents.

    Note and state move on their own: null leaves a field, an empty note clears it. Who touched an
    incident last is kept either way. Folded with ``max_by`` per incident, partially on the map
    side. Returns (incidents with triage columns, log rows that name no incident).
    """
    fold = log.groupBy("host", "id").agg(
        F.expr("max_by(note, CASE WHEN note IS NOT NULL THEN seq END) AS l_note"),
        F.expr("max_by(resolved, CASE WHEN resolved IS NOT NULL THEN seq END) AS l_resolved"),
        F.expr("max_by(by, seq) AS l_by"),
        F.expr("max_by(at, seq) AS l_at"),
    )
    cols = [c for c in incidents.columns if c not in ("resolved", "resolved_by", "resolved_at", "note")]
    had = {c: c in incidents.columns for c in ("resolved", "resolved_by", "resolved_at", "note")}

    def old(c: str, empty: str) -> str:
        return c if had[c] else empty

    out = incidents.join(fold, ["host", "id"], "left").selectExpr(
        *cols,
        f"coalesce(l_resolved, {old('resolved', 'false')}) AS resolved",
        f"coalesce(l_by, {old('resolved_by', chr(39) * 2)}) AS resolved_by",
        f"coalesce(l_at, {old('resolved_at', '0L')}) AS resolved_at",
        f"coalesce(l_note, {old('note', chr(39) * 2)}) AS note",
    )
    rejected = log.join(incidents.select("host", "id"), ["host", "id"], "left_anti")
    return out, rejected


def host_state(beats: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Latest state per host from heartbeats (host, kernel, ip, received, seq, …).

    The newest heartbeat wins, except that one without coverage (total 0) keeps the previous counts
    and empty kernel or address keep the previous ones. Partial aggregation makes a host with very
    many heartbeats a few rows before the shuffle.
    """
    o = "struct(received, seq)"

    def last(c: str, when: str = "true") -> str:
        return f"max_by({c}, CASE WHEN {when} THEN {o} END) AS {c}"

    cols = [
        "agent_version", "uptime_secs", "events", "drops", "decode_panics", "sensors_verified",
        "attestation_misses",
    ]
    s = beats.groupBy("host").agg(
        F.expr("min(received) AS first_seen"),
        F.expr("max(received) AS last_heartbeat"),
        *[F.expr(last(c)) for c in cols],
        *[F.expr(last(c, "sensors_total > 0")) for c in ("sensors_active", "sensors_total")],
        *[F.expr(last(c, f"{c} <> ''")) for c in ("kernel", "ip")],
    )
    s = s.withColumn("last_seen", F.col("last_heartbeat"))
    if incidents is not None:
        seen = incidents.groupBy("host").agg(
            F.expr("max(received) AS i_seen"),
            F.expr("max_by(kernel, CASE WHEN kernel <> '' THEN id END) AS i_kernel"),
            F.expr("max_by(ip, CASE WHEN ip <> '' THEN id END) AS i_ip"),
        )
        s = s.join(seen, "host", "full").selectExpr(
            "host", "coalesce(first_seen, 0L) AS first_seen",
            "greatest(coalesce(last_seen, 0L), coalesce(i_seen, 0L)) AS last_seen",
            "coalesce(last_heartbeat, 0L) AS last_heartbeat", *cols[:5], "sensors_verified",
            "attestation_misses", "sensors_active", "sensors_total",
            "coalesce(kernel, i_kernel) AS kernel", "coalesce(ip, i_ip) AS ip",
        )
    zero = ["uptime_secs", "events", "drops", "decode_panics", "attestation_misses",
            "sensors_active", "sensors_total"]
    return s.selectExpr(
        "host", "first_seen", "last_seen", "last_heartbeat",
        *[f"coalesce({c}, 0L) AS {c}" for c in zero],
        *[f"coalesce({c}, '') AS {c}" for c in ("agent_version", "kernel", "ip")],
        "sensors_verified",
    )


def liveness(now: int) -> str:
    """Derived when read. A host whose sensors see nothing is blind however often it reports."""
    age = f"greatest({now}L - last_heartbeat, 0L)"
    return (
        "CASE WHEN sensors_verified <=> false THEN 'blind' WHEN last_heartbeat = 0 THEN 'unknown'"
        f" WHEN {age} <= {STALE_SECS} THEN 'live' WHEN {age} <= {SILENT_SECS} THEN 'stale'"
        " ELSE 'silent' END"
    )


def summary(incidents: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """One row per host: worst open incident, band, counts by severity, liveness, coverage."""
    n = incidents.filter("NOT resolved").groupBy("host", "severity").agg(
        F.expr("count(1) AS n"), F.expr("max(score) AS top")
    )
    # At most five severities per host.
    n = n.groupBy("host").agg(
        F.expr("max(top) AS score"),
        F.expr("sum(n) AS n"),
        F.expr("map_from_entries(sort_array(collect_list(struct(severity, n)))) AS counts"),
    )
    return state.join(n, "host", "full").selectExpr(
        "host", "coalesce(score, 0L) AS score", f"{X.host_band('coalesce(score, 0L)')} AS band",
        "coalesce(n, 0L) AS n", "coalesce(counts, map()) AS counts", "last_seen", "kernel", "ip",
        f"{liveness(now)} AS status", "last_heartbeat", "agent_version", "uptime_secs",
        "attestation_misses", "events", "drops", "sensors_active", "sensors_total",
    )


def ranked(fleet: DataFrame) -> DataFrame:
    """Worst first; at equal score a host that has gone dark outranks a healthy one."""
    return fleet.orderBy(F.desc("score"), F.expr(f"{DARK}").desc(), "host")


def kpis(fleet: DataFrame) -> DataFrame:
    return fleet.agg(
        F.expr("count(1) AS hosts"),
        F.expr(f"count_if(score >= 50 OR {DARK}) AS need_attention"),
        F.expr(f"count_if(score = 0 AND NOT {DARK}) AS healthy"),
        F.expr("coalesce(sum(n), 0L) AS open_incidents"),
        F.expr("coalesce(max(score), 0L) AS worst"),
        F.expr("count_if(status = 'blind') AS blind"),
        F.expr(f"count_if({DARK}) AS dark"),
        F.expr("coalesce(sum(drops), 0L) AS drops"),
    )


def when_ms() -> str:
    return "coalesce(record.ts, received * 1000L)"


def recent(incidents: DataFrame, n: int) -> DataFrame:
    """Newest incidents across the fleet, by event time where one is known."""
    return (
        incidents.selectExpr("*", f"{when_ms()} AS at_ms")
        .orderBy(F.desc("at_ms"), F.desc("id"))
        .limit(n)
    )


def audit(incidents: DataFrame, n: int) -> DataFrame:
    return (
        incidents.filter("resolved")
        .selectExpr(
            "host", "id", "severity", "score", "resolved_by", "resolved_at", "note",
            "coalesce(record.subject.comm, '') AS subject",
        )
        .orderBy(F.desc("resolved_at"), F.desc("id"))
        .limit(n)
    )


def of_host(incidents: DataFrame, host: str) -> DataFrame:
    return incidents.filter(F.col("host") == host).orderBy(F.desc("id"))


def search(incidents: DataFrame, query: str) -> DataFrame:
    """Incidents whose text contains every whitespace-separated term."""
    return incidents.filter(T.matches_all(T.haystack(), query))


def sensor_coverage(attach: DataFrame) -> DataFrame:
    """Sensors that can see events, per host: attached, less the LSM hooks of an inactive LSM."""
    c = attach.groupBy("host").agg(
        F.expr(
            "count_if(attached AND NOT (is_lsm AND coalesce(lsm_active = false, false)))"
            " AS sensors_active"
        ),
        F.expr("count(1) AS sensors_total"),
    )
    return c.selectExpr("*", "sensors_total > 0 AND sensors_active < sensors_total AS partial")


def attestation(rounds: DataFrame, execs: DataFrame) -> DataFrame:
    """Did each round's canary show up as an exec before the next round? The last round is still
    open. Adds the running miss count.

    ``rounds``: (host, round, pid, round_ts); ``execs``: (host, pid, ts).
    """
    r = rounds.selectExpr("*", f"lead(round_ts) {over(['host'], 'round')} AS next_ts")
    # Each exec looks at the newest round of its pid only; a round comes before an exec of its time.
    both = r.selectExpr(
        "host", "pid", "round_ts * 2 AS o", "struct(round, next_ts) AS begun",
        "CAST(NULL AS BIGINT) AS ts",
    ).unionByName(
        execs.selectExpr("host", "pid", "ts * 2 + 1 AS o", "CAST(ts AS BIGINT) AS ts"),
        allowMissingColumns=True,
    )
    hits = (
        last_known(both, ["host", "pid"], "o", {"open": "begun"})
        .filter("ts IS NOT NULL AND ts < open.next_ts")
        .selectExpr("host", "open.round AS round")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    d = r.join(hits, ["host", "round"], "left").selectExpr(
        "host", "round", "pid", "round_ts",
        "CASE WHEN next_ts IS NULL THEN NULL ELSE coalesce(hit, false) END AS observed",
    )
    run = over(["host"], "round", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return d.selectExpr("*", f"count_if(observed = false) {run} AS misses")
