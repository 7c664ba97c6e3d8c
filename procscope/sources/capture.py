"""Reading and writing captures, incident files and the mixed incident/heartbeat feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from procscope import schema as S
from procscope.functions import events as X
from procscope.functions import text as TX
from procscope.operators.scan import numbered

CORRUPT = "_corrupt_record"


def fill_defaults(d: DataFrame) -> DataFrame:
    """Give every optional field its default where it is absent, and redact command lines."""
    keep = [c for c in d.columns if c not in S.EVENT_STRUCT.fieldNames()]
    out = list(keep)
    for name, typ, default in S.CAPTURE_FIELDS:
        if default is None:
            out.append(name)
            continue
        sql = {str: "''", int: "0", bool: "false", list: "array()"}[type(default)]
        value = f"CAST(coalesce({name}, {sql}) AS {typ.simpleString()})"
        if name == "argv":
            value = TX.redact_argv(value)
        out.append(f"{value} AS {name}")
    return d.selectExpr(*out)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) from ``(host, seq, value)``. Blank lines are neither.

    A line is malformed when it is not JSON of the expected types or lacks a required field.
    """
    struct = T.StructType(list(S.EVENT_STRUCT.fields) + [T.StructField(CORRUPT, T.StringType())])
    d = lines.filter("trim(value) <> ''").selectExpr(
        "host", "seq", "value",
        f"from_json(value, {X.quote(struct.simpleString())}, map('mode', 'PERMISSIVE',"
        f" 'columnNameOfCorruptRecord', '{CORRUPT}')) AS e",
    )
    bad = f"e IS NULL OR e.{CORRUPT} IS NOT NULL OR " + " OR ".join(
        f"e.{c} IS NULL" for c in S.REQUIRED
    )
    good = d.filter(f"NOT ({bad})").selectExpr(
        "host", "seq", *[f"e.{c} AS {c}" for c in S.EVENT_STRUCT.fieldNames()]
    )
    return fill_defaults(good), d.filter(bad).select("host", "seq", "value")


def read_capture(spark: SparkSession, path: str, host: str) -> tuple[DataFrame, DataFrame]:
    """One host's NDJSON capture file.

    A line's place is (split offset, place in the split), which any reader of the split recomputes
    alike; lines are then counted per split to give a dense arrival number, so a file of any size
    is read and numbered in parallel.
    """
    raw = spark.read.text(path).selectExpr(
        f"{X.quote(host)} AS host", "value",
        # A split of b bytes has fewer than 64 b lines, so offsets keep splits apart.
        "_metadata.file_block_start * 64 + (monotonically_increasing_id() & 8589934591L) AS place",
    )
    lines = numbered(raw, ["host"], ["place"], "place DIV 8589934592", "seq")
    return parse_lines(lines.select("host", "seq", "value"))


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The captures of many hosts in one plan: NDJSON files in folders ``host=<name>``.

    A host's files follow each other by name; its lines are numbered through all of them, in parallel, as
    in ``read_capture``. Returns (events, malformed lines) with ``host`` and ``seq``.
    """
    raw = spark.read.schema("value string, host string").text(path).selectExpr(
        "host", "value", "_metadata.file_path AS file",
        "_metadata.file_block_start * 64 + (monotonically_increasing_id() & 8589934591L) AS place",
    )
    lines = numbered(raw, ["host"], ["file", "place"], "struct(file, place DIV 8589934592 AS part)", "seq")
    return parse_lines(lines.select("host", "seq", "value"))


def to_lines(capture: DataFrame) -> DataFrame:
    """One JSON object per event, zero and empty fields left out, command lines redacted."""
    parts = []
    for name, typ, default in S.CAPTURE_FIELDS:
        if default is None or name == "socket_stdio":
            value = name
        elif name == "argv":
            value = f"CASE WHEN size(argv) > 0 THEN {TX.redact_argv()} END"
        elif isinstance(typ, T.BooleanType):
            value = f"CASE WHEN {name} THEN true END"
        elif isinstance(typ, T.StringType):
            value = f"nullif({name}, '')"
        else:
            value = f"nullif({name}, 0)"
        parts.append(f"'{name}', {value}")
    return capture.selectExpr(
        "host", "seq", f"to_json(named_struct({', '.join(parts)})) AS value"
    )


def write_capture(capture: DataFrame, path: str) -> None:
    """Capture files, one folder per host, rows in arrival order inside a file.

    Rows are range-partitioned by (host, seq), so a host with most of the events is spread over
    many files whose names sort in arrival order.
    """
    (
        to_lines(capture)
        .repartitionByRange("host", "seq")
        .sortWithinPartitions("host", "seq")
        .select("host", "value")
        .write.partitionBy("host")
        .text(path)
    )


def decode_wire(raw: DataFrame) -> DataFrame:
    """Sensor rows to events: flag bits, argument bytes and the container behind a cgroup path.

    ``flags``, ``argv_raw`` and ``cgroup_name`` become the fields they encode; other columns pass.
    """
    bits = {
        "truncated": 0,
        "degraded_path": 1,
        "denied": 2,
        "would_deny": 3,
        "escape_target": 4,
        "socket_stdio": 5,
    }
    rest = [c for c in raw.columns if c not in ("flags", "argv_raw", "cgroup_name", *bits)]
    rest = [c for c in rest if c not in ("argv", "container")]
    return raw.selectExpr(
        *rest,
        *[f"({X.has_bits('flags', 1 << b)}) AS {n}" for n, b in bits.items()],
        f"{TX.redact_argv(TX.argv_of())} AS argv",
        f"{TX.container_label('cgroup_name')} AS container",
    )


def demux(lines: DataFrame, heartbeat_tag: str = S.HEARTBEAT_TAG) -> tuple[DataFrame, DataFrame]:
    """Split a mixed feed on its schema tag into (incidents, heartbeats).

    Input columns other than ``value`` pass through. Lines that are not JSON are dropped; anything
    that is not a heartbeat is an incident.
    """
    extra = [c for c in lines.columns if c != "value"]
    d = lines.filter("trim(value) <> '' AND try_parse_json(value) IS NOT NULL").selectExpr(
        *extra, "value", "get_json_object(value, '$.schema') AS tag"
    )
    is_beat = f"coalesce(tag = {X.quote(heartbeat_tag)}, false)"
    inc = d.filter(f"NOT {is_beat}").selectExpr(
        *extra, f"from_json(value, {X.quote(S.INCIDENT_RECORD.simpleString())}) AS record"
    )
    beats = d.filter(is_beat).selectExpr(
        *extra, f"from_json(value, {X.quote(S.HEARTBEAT.simpleString())}) AS b"
    )
    zero = ("attestation_misses", "sensors_active", "sensors_total")
    cols = [
        f"coalesce(b.{f}, 0L) AS {f}" if f in zero else f"b.{f} AS {f}"
        for f in S.HEARTBEAT.fieldNames()
        if f != "schema"
    ]
    return inc, beats.selectExpr(*extra, *cols)


def write_incidents(json_rows: DataFrame, path: str) -> None:
    """Incident NDJSON; ``json_rows`` has one ``value`` per incident."""
    json_rows.select("value").write.mode("append").text(path)
