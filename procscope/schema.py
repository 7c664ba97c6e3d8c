"""Explicit schemas. Nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity of a process: a pid alone is reused within seconds on a busy host. Most selective column
# first: sorts compare a fixed-size prefix of the first key, and a host name would tie on most rows.
KEY = ["pid", "start", "host"]

U64 = T.DecimalType(20, 0)

# Event type codes and names.
EVENT_NAMES = {
    1: "exec",
    2: "exit",
    3: "fork",
    4: "cred_change",
    5: "file_open",
    6: "file_mode",
    7: "setcap",
    8: "ptrace",
    9: "exec_anon",
    10: "module",
    11: "sock_connect",
    12: "sock_listen",
}
EXEC, EXIT, FORK, CRED, OPEN, MODE, SETCAP, PTRACE, ANON, MODULE, CONNECT, LISTEN = range(1, 13)

_LONG = T.LongType()
_STR = T.StringType()
_BOOL = T.BooleanType()

# (name, type, default); None marks a field every event must carry.
CAPTURE_FIELDS: list[tuple[str, T.DataType, object]] = [
    ("ts_ns", _LONG, None),
    ("type", T.IntegerType(), None),
    ("tgid", _LONG, None),
    ("ppid", _LONG, None),
    ("start_boottime", _LONG, None),
    ("uid", _LONG, 0),
    ("gid", _LONG, 0),
    ("euid", _LONG, 0),
    ("egid", _LONG, 0),
    ("cgroup_id", U64, 0),
    ("comm", _STR, ""),
    ("filename", _STR, ""),
    ("argv", T.ArrayType(_STR), []),
    ("truncated", _BOOL, False),
    ("escape_target", _BOOL, False),
    ("socket_stdio", _BOOL, False),
    ("denied", _BOOL, False),
    ("would_deny", _BOOL, False),
    ("exit_code", _LONG, 0),
    ("child_pid", _LONG, 0),
    ("child_start_boottime", _LONG, 0),
    ("old_uid", _LONG, 0),
    ("old_gid", _LONG, 0),
    ("old_euid", _LONG, 0),
    ("old_egid", _LONG, 0),
    ("cap_effective", _LONG, 0),
    ("old_cap_effective", _LONG, 0),
    ("file_mode", _LONG, 0),
    ("old_file_mode", _LONG, 0),
    ("watch_id", _LONG, 0),
    ("mnt_ns", _LONG, 0),
    ("pid_ns", _LONG, 0),
    ("net_ns", _LONG, 0),
    ("degraded_path", _BOOL, False),
    ("target_pid", _LONG, 0),
    ("aux", _LONG, 0),
    ("container", _STR, ""),
    ("exe_ino", U64, 0),
    ("exe_dev", _LONG, 0),
    ("exe_trusted", _STR, ""),
]
REQUIRED = [n for n, _, d in CAPTURE_FIELDS if d is None]

EVENT_STRUCT = T.StructType([T.StructField(n, t) for n, t, _ in CAPTURE_FIELDS])
CAPTURE = T.StructType(
    [T.StructField("host", _STR), T.StructField("seq", _LONG)] + list(EVENT_STRUCT.fields)
)


def default_of(name: str) -> Column:
    for n, t, d in CAPTURE_FIELDS:
        if n == name:
            if isinstance(t, T.ArrayType):
                return F.array().cast(t)
            return F.lit(d if d is not None else 0).cast(t)
    raise KeyError(name)


BASELINE_ENTRY = T.StructType(
    [
        T.StructField("signal", _STR),
        T.StructField("exe", _STR),
        T.StructField("count", _LONG),
        T.StructField("first_ns", _LONG),
        T.StructField("last_ns", _LONG),
    ]
)
BASELINE_FILE = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("events_observed", _LONG),
        T.StructField("learned_at_ms", _LONG),
        T.StructField("window_ns", _LONG),
        T.StructField("entries", T.ArrayType(BASELINE_ENTRY)),
    ]
)

HEARTBEAT = T.StructType(
    [
        T.StructField("schema", _STR),
        T.StructField("ts", _LONG),
        T.StructField("uptime_secs", _LONG),
        T.StructField("agent_version", _STR),
        T.StructField("events", _LONG),
        T.StructField("drops", _LONG),
        T.StructField("decode_panics", _LONG),
        T.StructField("sensors_verified", _BOOL),
        T.StructField("attestation_misses", _LONG),
        T.StructField("sensors_active", _LONG),
        T.StructField("sensors_total", _LONG),
    ]
)

SIGNAL_RECORD = T.StructType(
    [
        T.StructField("id", _STR),
        T.StructField("score", _LONG),
        T.StructField("detail", _STR),
        T.StructField("attack", T.ArrayType(_STR)),
        T.StructField("ts_ns", _LONG),
        T.StructField("ts", _LONG),
        T.StructField("pid", _LONG),
        T.StructField("cmdline", _STR),
    ]
)
LINEAGE_RECORD = T.StructType(
    [
        T.StructField("pid", _LONG),
        T.StructField("comm", _STR),
        T.StructField("exe", _STR),
        T.StructField("cmdline", _STR),
    ]
)
SCAN_RECORD = T.StructType(
    [
        T.StructField("signal", _STR),
        T.StructField("target", _STR),
        T.StructField("outcome", _STR),
        T.StructField("rules", T.ArrayType(_STR)),
        T.StructField("reason", _STR),
    ]
)
INCIDENT_RECORD = T.StructType(
    [
        T.StructField("schema", _STR),
        T.StructField("ts_ns", _LONG),
        T.StructField("ts", _LONG),
        T.StructField("severity", _STR),
        T.StructField("score", _LONG),
        T.StructField(
            "score_breakdown",
            T.StructType(
                [
                    T.StructField("base", _LONG),
                    T.StructField("chain_bonus", _LONG),
                    T.StructField("context_mult", T.DoubleType()),
                    T.StructField("context_note", _STR),
                ]
            ),
        ),
        T.StructField(
            "subject",
            T.StructType(
                [
                    T.StructField("pid", _LONG),
                    T.StructField("start_boottime", _LONG),
                    T.StructField("comm", _STR),
                    T.StructField("exe", _STR),
                    T.StructField("uid", _LONG),
                    T.StructField("cmdline", _STR),
                ]
            ),
        ),
        T.StructField("lineage", T.ArrayType(_STR)),
        T.StructField("lineage_detail", T.ArrayType(LINEAGE_RECORD)),
        T.StructField("attack", T.ArrayType(_STR)),
        T.StructField("signals", T.ArrayType(SIGNAL_RECORD)),
        T.StructField("yara", T.ArrayType(SCAN_RECORD)),
    ]
)
INCIDENT_TAG = "procscope.incident/v1"
HEARTBEAT_TAG = "procscope.heartbeat/v1"
