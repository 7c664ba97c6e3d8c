"""Alert rows, delivery throttling and failure lockout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.functions import events as X
from procscope.functions import text as T
from procscope.operators.scan import last_known, next_rows, numbered, over, reachable
from procscope.session import materialize

# Fixed values.
WINDOW_SECS = 60
MAX_FAILURES = 5
FAILURE_WINDOW = 300
LOCKOUT = 900


def alerts(incidents: DataFrame, floor: str = "medium", source: str = "procscope") -> DataFrame:
    """What a sink receives for each incident at or above the floor: fields, one-line summary,
    webhook body and syslog line."""
    d = incidents.selectExpr("host", "id", "received", *T.alert_fields())
    d = d.filter(f"{X.severity_rank('severity')} >= {X.parse_severity(floor)}")
    d = d.selectExpr("*", f"{T.alert_summary()} AS summary")
    body = (
        f"to_json(named_struct('text', summary, 'source', {X.quote(source)}, 'host', host,"
        " 'severity', severity, 'score', score, 'subject', subject, 'cmdline', cmdline,"
        " 'attack', attack))"
    )
    return d.selectExpr(
        "*", f"{body} AS webhook", f"{T.syslog_priority()} AS priority",
        f"concat('<', {T.syslog_priority()}, '>{source}: ', summary) AS syslog",
    )


def throttle_windows(alerts_: DataFrame, start: str) -> DataFrame:
    """Delivery windows: the first opens at ``start`` (an expression, constant for a sink), the next
    at the first alert 60 s or more after the current one opened.

    Where windows open depends only on which seconds have alerts. A second that follows a pause of
    60 s or more opens one in any case. From any other second the next opening, if this one opened,
    lies in the next two minutes, so an equality join finds it; the openings that a sure one leads
    to are then found by doubling the length of the jump, in as many rounds as the logarithm of the
    longest chain. No step is sequential, and no sink is kept in one task. Returns (sink, second,
    n, opened).
    """
    d = alerts_.selectExpr("sink", "at AS second", f"CAST({start} AS BIGINT) AS start")
    per = materialize(
        d.groupBy("sink", "second").agg(F.expr("count(1) AS n"), F.expr("min(start) AS start")),
        "alert-seconds",
    )
    # The first window is a node of its own; alerts before its end are in it.
    nodes = per.filter("second > start").selectExpr("sink", "second")
    first = per.selectExpr("sink", "start AS second").distinct()
    nodes = materialize(nodes.unionByName(first).distinct(), "alert-nodes")
    minutes = nodes.groupBy("sink", F.expr("second DIV 60 AS minute")).agg(
        F.expr("array_sort(collect_set(second)) AS seconds")  # at most 60
    )
    after = nodes.selectExpr(
        "sink", "second", "explode(array(1L, 2L)) AS k"
    ).selectExpr("sink", "second", f"second DIV {WINDOW_SECS} + k AS minute").join(minutes, ["sink", "minute"])
    jump = after.groupBy("sink", "second").agg(
        F.expr(f"min(array_min(filter(seconds, s -> s >= second + {WINDOW_SECS}))) AS nxt")
    )
    jump = materialize(jump.filter("nxt IS NOT NULL"), "alert-jump")
    back = nodes.selectExpr(
        "sink", "second", "explode(array(0L, 1L)) AS k"
    ).selectExpr("sink", "second", f"second DIV {WINDOW_SECS} - k AS minute")
    near = back.join(minutes, ["sink", "minute"]).filter(
        f"exists(seconds, s -> s < second AND s > second - {WINDOW_SECS})"
    )
    sure = nodes.join(near.select("sink", "second").distinct(), ["sink", "second"], "left_anti")
    opened = materialize(sure.unionByName(first).distinct(), "alert-opened")
    while not jump.isEmpty():
        more = opened.join(jump, ["sink", "second"]).selectExpr("sink", "nxt AS second")
        opened = materialize(opened.unionByName(more).distinct(), "alert-opened")
        far = jump.selectExpr("sink", "second AS nxt", "nxt AS far")
        jump = materialize(
            jump.join(far, ["sink", "nxt"]).selectExpr("sink", "second", "far AS nxt"), "alert-jump"
        )
    marks = opened.selectExpr("sink", "second", "CAST(NULL AS BIGINT) AS n", "second AS mark")
    rows = per.filter("second > start").selectExpr(
        "sink", "second", "n", "CAST(NULL AS BIGINT) AS mark"
    )
    # Openings sort before the alerts of their second.
    both = marks.unionByName(rows).selectExpr("*", "second * 2 + int(n IS NOT NULL) AS o")
    placed = last_known(both, ["sink"], "o", {"opened": "mark"}, 2 * 86_400).filter("n IS NOT NULL")
    early = per.filter("second <= start").selectExpr("sink", "second", "n", "start AS opened")
    return placed.select("sink", "second", "n", "opened").unionByName(early)


def throttle(alerts_: DataFrame, per_window: int, start: int | str) -> tuple[DataFrame, DataFrame]:
    """(alerts with ``delivered``, one summary row per window that held some back).

    ``alerts_``: (sink, at, ord, …) with ``ord`` the arrival order among equal ``at``. 0 means no cap.
    A summary is sent when the next window opens. ``start`` may be an expression over ``alerts_``.
    """
    w = materialize(throttle_windows(alerts_, str(start)), "alert-windows")
    key = ["sink", "opened"]
    before = f"coalesce(sum(n) {over(key, 'second', 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0L)"
    w = w.selectExpr("*", f"{before} AS earlier")
    d = alerts_.join(
        w.selectExpr("sink", "second AS at", "opened", "earlier"), ["sink", "at"]
    )
    # Only seconds that straddle the cap need ranking.
    cap = per_window if per_window > 0 else (1 << 62)
    inside = d.filter(f"earlier < {cap}L")
    inside = inside.selectExpr(
        "*", f"row_number() {over(['sink', 'at'], 'ord')} + earlier <= {cap}L AS delivered"
    )
    full = d.filter(f"earlier >= {cap}L").selectExpr("*", "false AS delivered")
    out = inside.unionByName(full).drop("earlier")
    total = w.groupBy(*key).agg(F.expr("sum(n) AS n"))
    nxt = total.selectExpr("*", f"lead(opened) {over(['sink'], 'opened')} AS sent_at")
    held = nxt.filter(f"n > {cap}L AND sent_at IS NOT NULL").selectExpr(
        "sink", "sent_at", f"n - {cap}L AS suppressed", "'MEDIUM' AS severity", "0L AS score",
        f"concat(n - {cap}L, ' further alert(s) suppressed by the rate limit') AS subject",
    )
    return out, held


def lockout(attempts: DataFrame, chunk: int | None = None) -> DataFrame:
    """Verdict per authentication attempt (address, ts, ord, ok): ``locked_for`` seconds if it was
    refused outright, ``locks`` if this failure started a lockout.

    Five failures within 300 s of the first lock an address for 900 s; success clears it; a refused
    attempt counts for nothing.

    Any failure may be the first of a count, and what becomes of it follows from the rows after it: the
    fourth failure from there, the next success, the first failure after the window and, if it locks,
    the first one after the lockout. Equality joins and chunked windows find them for all failures at
    once, so each knows where the next count would begin. The counts that really happen are those
    that an address's first failure leads to, found by doubling jumps; a failure after a pause longer than
    the lockout surely begins one. An address is walked through by no task, however busy it is.
    """
    key, minute = ["address"], "ts DIV 60"
    rows = numbered(attempts.select("address", "ts", "ord", "ok"), key, ["ts", "ord"], minute, "rn")
    rows = next_rows(rows, key, {"fail": "NOT ok"}, "rn", seq="rn", size=chunk)
    rows = next_rows(rows, key, {"clear": "ok"}, "struct(rn, fail)", seq="rn", size=chunk)
    rows = materialize(rows, "attempts")
    fails = materialize(numbered(rows.filter("NOT ok"), key, ["rn"], minute, "nth"), "failures")
    fifth = fails.selectExpr("address", f"nth - {MAX_FAILURES - 1} AS nth", "rn AS rn5", "ts AS ts5")
    counts = fails.join(fifth, [*key, "nth"], "left").selectExpr(
        "address", "rn", "ts", "clear", "rn5",
        f"coalesce(ts5 - ts <= {FAILURE_WINDOW} AND (clear IS NULL OR clear.rn > rn5), false) AS locks",
        f"ts5 + {LOCKOUT} AS until",
    )
    counts = materialize(counts.selectExpr("*", f"if(locks, until, ts + {FAILURE_WINDOW + 1}) AS since"), "counts")
    # The first failure at or after a moment, looked up once for each moment.
    seconds = fails.groupBy("address", "ts").agg(F.min("rn").alias("rn"))
    asked = counts.selectExpr("address", "since * 2 AS o", "CAST(NULL AS BIGINT) AS rn").distinct()
    line = asked.unionByName(seconds.selectExpr("address", "ts * 2 + 1 AS o", "rn"))
    later = next_rows(line, key, {"then": "rn IS NOT NULL"}, "rn", seq="o", size=chunk)
    later = later.filter("rn IS NULL").selectExpr("address", "o DIV 2 AS since", "then")
    before = rows.selectExpr("address", "rn + 1 AS rn", "ts AS before")
    counts = counts.join(later, [*key, "since"], "left").join(before, [*key, "rn"], "left")
    counts = materialize(
        counts.selectExpr(
            "address", "rn", "rn5", "locks", "until", f"ts - before > {LOCKOUT} AS sure",
            "if(NOT locks AND clear IS NOT NULL AND (then IS NULL OR clear.rn < then), clear.fail, then) AS nxt",
        ),
        "counts-ends",
    )
    sure = counts.filter("sure").select("address", "rn")
    roots = sure.unionByName(counts.groupBy("address").agg(F.min("rn").alias("rn")))
    jump = counts.filter("nxt IS NOT NULL").join(
        sure.withColumnRenamed("rn", "nxt"), [*key, "nxt"], "left_anti"
    )
    begun = reachable(roots, jump, key, "rn", "counts-begun")
    locks = counts.filter("locks").join(begun, [*key, "rn"]).selectExpr("address", "rn5 AS rn", "until", "locks")
    marked = rows.select("address", "ts", "ord", "ok", "rn").join(locks, [*key, "rn"], "left")
    return last_known(marked, key, "rn", {"closed": "until"}, chunk).selectExpr(
        "address", "ts", "ord", "ok",
        "if(locks IS NULL, greatest(coalesce(closed, 0L) - ts, 0L), 0L) AS locked_for",
        "coalesce(locks, false) AS locks",
    )
