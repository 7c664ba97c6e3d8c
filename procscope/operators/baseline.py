"""Learned normal behaviour: which (signal, program) pairs a host shows anyway."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.operators import graph

# Fixed values.
FORMAT_VERSION = 2
KNOWN_FACTOR = 0.1
SUPPORT_FULL = 8.0
BURST_RECURRENCE = 0.5
FRESH_DAYS = 14.0
STALE_DAYS = 90.0
STRONG = 0.75
MS_PER_DAY = 86_400_000.0


@dataclass
class Baseline:
    """``entries``: (signal, exe, count, first_ns, last_ns), plus ``host`` for a fleet baseline.

    ``header``: one row per host or one row, with (version, events_observed, learned_at_ms,
    window_ns). ``evaluate_at_ms`` is the moment age is measured against; None means the learning
    time itself.
    """

    entries: DataFrame
    header: DataFrame
    evaluate_at_ms: int | None = None


def age_days(at_ms: int | None) -> str:
    if at_ms is None:
        return "CASE WHEN learned_at_ms = 0 THEN NULL ELSE 0.0D END"
    return (
        "CASE WHEN learned_at_ms = 0 THEN NULL"
        f" ELSE greatest({at_ms}L - learned_at_ms, 0L) / {MS_PER_DAY}D END"
    )


def freshness(age: str) -> str:
    return (
        f"CASE WHEN {age} IS NULL OR {age} <= {FRESH_DAYS}D THEN 1.0D"
        f" WHEN {age} >= {STALE_DAYS}D THEN 0.0D"
        f" ELSE 1.0D - ({age} - {FRESH_DAYS}D) / {STALE_DAYS - FRESH_DAYS}D END"
    )


def evidence(count: str, first: str, last: str, window: str) -> str:
    """Support times recurrence, before age."""
    support = f"least(greatest(log1p(CAST({count} AS DOUBLE)) / {math.log1p(SUPPORT_FULL)!r}D, 0.0D), 1.0D)"
    spread = (
        f"CASE WHEN {window} = 0 THEN 0.0D ELSE"
        f" least(CAST(greatest({last} - {first}, 0L) AS DOUBLE) / CAST({window} AS DOUBLE), 1.0D) END"
    )
    return f"({support} * ({BURST_RECURRENCE}D + {1 - BURST_RECURRENCE}D * {spread}))"


def _keys(b: Baseline) -> list[str]:
    return ["host"] if "host" in b.entries.columns else []


def weights(b: Baseline) -> DataFrame:
    """Entries with ``confidence`` and ``factor``, the share of its score a known pair keeps."""
    h = b.header.selectExpr(*_keys(b), "window_ns", f"{age_days(b.evaluate_at_ms)} AS age")
    h = h.selectExpr("*", f"{freshness('age')} AS fresh")
    # The header is one row (``load`` sees to that), or one row per host.
    d = b.entries.join(h, _keys(b)) if _keys(b) else b.entries.crossJoin(F.broadcast(h))
    d = d.selectExpr(
        *b.entries.columns,
        f"{evidence('count', 'first_ns', 'last_ns', 'window_ns')} * fresh AS confidence",
    )
    return d.selectExpr("*", f"1.0D - confidence * {1 - KNOWN_FACTOR}D AS factor")


def adjust(on_file: DataFrame, b: Baseline) -> DataFrame:
    """Reduce the score of signals whose (id, program) pair is known. Adds ``evidence_note``.

    The join is left to Catalyst and AQE: a single host's baseline is small and gets broadcast, a
    fleet's is shuffled.
    """
    w = weights(b).selectExpr(
        *_keys(b), "signal AS id", "exe AS sexe", "count AS b_count", "confidence", "factor"
    )
    return on_file.join(w, _keys(b) + ["id", "sexe"], "left").selectExpr(
        *[c for c in on_file.columns if c != "score"],
        "CASE WHEN factor < 1.0D THEN CAST(round(score * factor) AS BIGINT) ELSE score END AS score",
        "CASE WHEN factor < 1.0D THEN concat(' [baseline: seen ', b_count, 'x, confidence ',"
        " CAST(CAST(rint(confidence * 100) AS BIGINT) AS STRING), '%]') END AS evidence_note",
    )


def learn(
    capture: DataFrame,
    signals: DataFrame,
    states: DataFrame,
    learned_at_ms: int,
    per_host: bool = False,
    chunk: int | None = None,
) -> Baseline:
    """Evidence for every (signal, program) pair of a clean capture.

    Every event widens the learning window, not only those that signal. Counting is a plain
    aggregate with map-side partials, so a pair that makes up most of the capture is no hot spot.
    """
    host = ["host"] if per_host else []
    looked = graph.state_asof(
        signals.selectExpr("host", "pid", "start", "seq", "id", "ts_ns"), states, ("exe",), chunk
    )
    entries = (
        looked.filter("exe <> ''")
        .groupBy(*host, F.col("id").alias("signal"), "exe")
        .agg(
            F.expr("count(1) AS count"),
            F.expr("min(ts_ns) AS first_ns"),
            F.expr("max(ts_ns) AS last_ns"),
        )
    )
    header = (
        capture.groupBy(*host)
        .agg(
            F.expr("count(1) AS events_observed"),
            F.expr("coalesce(max(nullif(ts_ns, 0)) - min(nullif(ts_ns, 0)), 0L) AS window_ns"),
        )
        .selectExpr(
            *host, f"{FORMAT_VERSION} AS version", "events_observed",
            f"{learned_at_ms}L AS learned_at_ms", "window_ns",
        )
    )
    return Baseline(entries, header, learned_at_ms)


def human_duration(secs: str) -> str:
    """Days and hours with one decimal, minutes and seconds without."""
    return (
        f"CASE WHEN {secs} >= 86400 THEN concat(format_number({secs} / 86400, '0.0'), 'd')"
        f" WHEN {secs} >= 3600 THEN concat(format_number({secs} / 3600, '0.0'), 'h')"
        f" WHEN {secs} >= 60 THEN concat(format_number({secs} / 60, '0'), 'm')"
        f" ELSE concat(format_number({secs}, '0'), 's') END"
    )


def summary(b: Baseline) -> DataFrame:
    """What a baseline is worth: patterns, strong patterns, window, age and one line of text."""
    counts = weights(b).groupBy(*_keys(b)).agg(
        F.expr("count(1) AS patterns"),
        F.expr(f"count_if(confidence >= {STRONG}D) AS strong"),
    )
    h = b.header.selectExpr(
        *_keys(b), "window_ns", "events_observed", f"{age_days(b.evaluate_at_ms)} AS age"
    )
    h = h.selectExpr("*", f"{freshness('age')} AS fresh")
    d = h.join(counts, _keys(b), "left") if _keys(b) else h.crossJoin(F.broadcast(counts))
    d = d.selectExpr(
        *h.columns, "coalesce(patterns, 0L) AS patterns", "coalesce(strong, 0L) AS strong"
    )
    window = human_duration("(window_ns DIV 1000000000)")
    text = (
        "concat(patterns, ' patterns (', strong, ' strong)',"
        f" CASE WHEN window_ns > 0 THEN concat(', ', {window}, ' learning window') ELSE '' END,"
        " CASE WHEN age IS NULL THEN ', age unknown (v1 format -- re-learn)'"
        f" WHEN age >= {STALE_DAYS}D THEN concat(', learned ', format_number(age, '0'),"
        f" 'd ago: EXPIRED past {STALE_DAYS:.0f}d, suppressing nothing -- re-learn')"
        " WHEN fresh < 1.0D THEN concat(', learned ', format_number(age, '0'), 'd ago (',"
        " format_number(fresh * 100, '0'), '% strength)')"
        " ELSE concat(', learned ', format_number(age, '0'), 'd ago') END)"
    )
    return d.selectExpr(
        *_keys(b), "events_observed", "patterns", "strong", "window_ns", "age AS age_days",
        "fresh AS freshness", f"{text} AS summary",
    )


# --- pairs an operator marked as expected ---------------------------------------------------------


def teach(
    incidents: DataFrame, triage: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Merge the (signal, program) pairs of incidents marked expected into ``known``.

    ``triage``: (host, id, by, at, expect). A pair's program is the incident subject's; an incident
    without one teaches nothing. Marking an incident again counts again.
    """
    marks = triage.filter("expect").select("host", "id", "by", "at", "seq")
    pairs = (
        incidents.filter("record.subject.exe <> ''")
        .selectExpr("host", "id", "record.subject.exe AS exe", "explode(record.signals) AS s")
        .join(marks, ["host", "id"])
        .selectExpr(
            "host", "s.id AS signal", "exe", "1L AS count",
            "coalesce(s.ts_ns, 0L) AS first_ns", "coalesce(s.ts_ns, 0L) AS last_ns",
            "by AS added_by", "at AS added_at", "seq AS added_seq",
        )
    )
    if known is not None:
        pairs = pairs.unionByName(known.selectExpr("*", "-1L AS added_seq"))
    return pairs.groupBy("host", "signal", "exe").agg(
        F.expr("sum(count) AS count"),
        F.expr("coalesce(min(nullif(first_ns, 0)), 0L) AS first_ns"),
        F.expr("max(last_ns) AS last_ns"),
        F.expr("min_by(added_by, added_seq) AS added_by"),
        F.expr("min_by(added_at, added_seq) AS added_at"),
    )


def export(expected: DataFrame, learned_at_ms: int) -> Baseline:
    """Per-host baseline made of the taught pairs; hosts without any have none."""
    header = expected.groupBy("host").agg(
        F.expr(f"{FORMAT_VERSION} AS version"),
        F.expr("sum(count) AS events_observed"),
        F.expr(f"{learned_at_ms}L AS learned_at_ms"),
        F.expr(
            "greatest(max(last_ns) - coalesce(min(nullif(first_ns, 0)), 0L), 0L) AS window_ns"
        ),
    )
    entries = expected.select("host", "signal", "exe", "count", "first_ns", "last_ns")
    return Baseline(entries, header, learned_at_ms)


# --- files --------------------------------------------------------------------------------------


def save(b: Baseline, path: str) -> None:
    """JSON lines: a header for each host (or one in all), and a line for each entry. Entries are
    spread by host and sorted, never gathered into one row."""
    k = _keys(b)
    head = b.header.selectExpr(
        *k, f"{FORMAT_VERSION} AS version", "events_observed", "learned_at_ms", "window_ns"
    )
    entries = b.entries.select(*k, "signal", "exe", "count", "first_ns", "last_ns")
    entries = entries.repartition(*(k or ["signal"]), "exe")
    entries = entries.sortWithinPartitions(*k, "signal", "exe")
    head.unionByName(entries, allowMissingColumns=True).write.mode("overwrite").json(path)


def load(spark, path: str, evaluate_at_ms: int | None, per_host: bool = False) -> Baseline:
    """Read baseline files: with entries as lines, or as one list in the header. Fields a first
    version lacks read as unknown (0)."""
    schema = type(S.BASELINE_FILE)([*S.BASELINE_FILE.fields, *S.BASELINE_ENTRY.fields])
    if per_host:
        schema = type(schema)([type(schema.fields[0])("host", "string")] + list(schema.fields))
    k = ["host"] if per_host else []
    d = spark.read.schema(schema).json(path, multiLine=False)
    header = d.filter("signal IS NULL").selectExpr(
        *k, "version", "coalesce(events_observed, 0L) AS events_observed",
        "coalesce(learned_at_ms, 0L) AS learned_at_ms", "coalesce(window_ns, 0L) AS window_ns",
    )
    line = "array(struct(signal, exe, count, first_ns, last_ns))"
    listed = f"explode(if(signal IS NULL, entries, {line})) AS e"
    entries = d.selectExpr(*k, listed).selectExpr(
        *k, "e.signal AS signal", "e.exe AS exe", "e.count AS count",
        "coalesce(e.first_ns, 0L) AS first_ns", "coalesce(e.last_ns, 0L) AS last_ns",
    )
    if not per_host:
        # Several files merge into what the largest of them says.
        header = header.agg(*[F.max(c).alias(c) for c in header.columns])
        entries = entries.groupBy("signal", "exe").agg(
            F.max("count").alias("count"),
            F.min("first_ns").alias("first_ns"),
            F.max("last_ns").alias("last_ns"),
        )
    return Baseline(entries, header, evaluate_at_ms)
