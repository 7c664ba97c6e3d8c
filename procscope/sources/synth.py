"""Capture derived from the ``events`` table by integer arithmetic.

A user is one login session; every six of its events form one process that forks, execs and acts.
Numbering is done with ``numbered`` so that one very busy user or host does not land on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.operators.scan import numbered
from procscope.session import materialize

HOST_MNT_NS = 4026531841

# The programs a generated process can run, by kind.
KINDS = [
    "/usr/bin/sudo", "/bin/sh", "/tmp/x", "/usr/bin/python3.11", "/usr/sbin/nginx",
    "/usr/bin/chmod", "/bin/bash", "/usr/sbin/sshd", "/usr/bin/php8.2", "/usr/bin/node",
    "/usr/sbin/modprobe", "/usr/bin/vim",
]
SESSION_COMMS = ["nginx", "bash", "sshd", "kworker/0:1"]
WRITE_PATHS = [
    "/etc/ld.so.preload", "/root/.ssh/authorized_keys", "/etc/cron.d/job", "/etc/sudoers.d/x",
    "/etc/pam.d/sshd", "/etc/passwd", "/proc/sys/kernel/core_pattern", "/etc/profile.d/a.sh",
]
READ_PATHS = ["/etc/shadow", "/root/.ssh/id_rsa", "/etc/gshadow"]
TYPE_OF_K = [4, 4, 5, 5, 6, 7, 8, 8, 9, 10, 11, 12, 2]


def _pick(options: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


_landed: dict[tuple[str, str], DataFrame] = {}


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture table of ``sf_dir``, derived and written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
            F.col("event_id").alias("e"), F.col("user_id").alias("u")
        )
        _landed[key] = materialize(capture_from(ev), "capture")
    return _landed[key]


def capture_from(ev: DataFrame) -> DataFrame:
    u, g, s, k = F.col("u"), F.col("g"), F.col("s"), F.col("k")
    # Written out in between: later columns repeat these expressions many times over.
    d = materialize(
        numbered(ev, ["u"], ["e"], "e DIV 1048576", "rn"), "session-rank"
    )
    r = F.col("rn") - 1
    d = d.withColumn("r", r).withColumn("g", F.floor(r / 6).cast("long")).withColumn("s", r % 6)
    d = d.withColumn("reexec", (u % 3 == 1) & (s >= 3))
    d = d.withColumn("x", (u + 3 * g + F.when(F.col("reexec"), 5).otherwise(0)) % 12)
    d = d.withColumn("px", (u + 3 * (g - 1) + 12 + F.when(u % 3 == 1, 5).otherwise(0)) % 12)
    d = d.withColumn("k", (5 * u + 7 * g + 3 * s) % 13)
    d = d.withColumn("host", F.concat(F.lit("host-"), (u % 8).cast("string")))
    d = d.withColumn("t", 90 * F.col("r") + u % 60 + 1)
    second = F.lit(1_000_000_000)

    ppid = 1_000_000 + 50 * u + g % 7
    pstart = (540 * g + u % 60 + 1) * second
    prev = g - 1
    root = g % 5 == 0
    qpid = F.when(root, 500_000 + u).otherwise(1_000_000 + 50 * u + prev % 7)
    qstart = F.when(root, F.lit(1)).otherwise((540 * prev + u % 60 + 1) * second)
    fork = s == 0
    etype = (
        F.when(fork, S.FORK)
        .when((s == 1) | ((s == 3) & (u % 3 == 1)), S.EXEC)
        .otherwise(_pick(TYPE_OF_K, k))
    )
    d = materialize(d.withColumn("type", etype.cast("int")), "session-step")
    ty = F.col("type")
    kind = _pick(KINDS, F.col("x"))
    base = F.substring_index(kind, "/", -1)
    pbase = F.substring_index(_pick(KINDS, F.col("px")), "/", -1)
    is_exec = ty == S.EXEC
    filename = (
        F.when(is_exec, kind)
        .when((ty == S.OPEN) & (k == 2), _pick(WRITE_PATHS, (u + g) % 8))
        .when((ty == S.OPEN) & (k == 3), _pick(READ_PATHS, (u + g + s) % 3))
        .when(ty == S.MODE, "/tmp/.x")
        .when(ty == S.SETCAP, "ping")
        .when(ty == S.ANON, "memfd:p")
        .when(ty == S.MODULE, "dummy")
        .when(ty == S.CONNECT, "docker.sock")
        .otherwise("")
    )
    cred = ty == S.CRED
    aux = (
        F.when((ty == S.PTRACE) & (k == 6), 2)
        .when(ty == S.PTRACE, 1)
        .when(ty == S.ANON, 1 + g % 3)
        .when(ty == S.MODULE, 2)
        .when(ty == S.LISTEN, 8000 + u)
        .otherwise(0)
    )
    cols = {
        "ts_ns": F.col("t") * second,
        "type": ty,
        "tgid": F.when(fork, qpid).otherwise(ppid),
        "ppid": F.lit(0),
        "start_boottime": F.when(fork, qstart).otherwise(pstart),
        "uid": F.when(cred & (k == 1), 0).otherwise(1000),
        "euid": F.when(cred, 0).otherwise(1000),
        "old_euid": F.when(cred & (k == 0), 1000).when(cred, 42).otherwise(0),
        "comm": F.when(~fork, base).when(root, _pick(SESSION_COMMS, u % 4)).otherwise(pbase),
        "filename": filename,
        "argv": F.when(
            is_exec, F.array(kind, F.concat(F.lit("arg"), g.cast("string")))
        ).otherwise(F.array().cast("array<string>")),
        "child_pid": F.when(fork, ppid).otherwise(0),
        "child_start_boottime": F.when(fork, pstart).otherwise(0),
        "cap_effective": F.when(cred, 1 << 21).otherwise(0),
        "file_mode": F.when((ty == S.OPEN) & (k == 2), 2)
        .when(ty == S.OPEN, 1)
        .when(ty == S.MODE, 35309)
        .otherwise(0),
        "old_file_mode": F.when(ty == S.MODE, 33261).otherwise(0),
        "aux": aux,
        "target_pid": F.when((ty == S.PTRACE) & (g % 2 == 0), qpid)
        .when(ty == S.PTRACE, 1)
        .otherwise(0),
        "container": F.when(
            u % 5 == 0, F.concat(F.lit("docker:abc123def"), (100 + u % 900).cast("string"))
        ).otherwise(""),
        "exe_trusted": F.when(
            is_exec & (u % 3 != 0) & F.col("x").isin(0, 4, 7, 9), base
        ).otherwise(""),
        "socket_stdio": is_exec & (u % 7 == 0),
        "mnt_ns": F.when(is_exec & (u % 11 == 0), HOST_MNT_NS)
        .when(is_exec, 4026532000 + u)
        .otherwise(0),
    }
    # Arrival order inside a host: (ts, event id). Seconds bucket the count.
    d = numbered(d, ["host"], ["e"], "t", "seq")
    out = [F.col("host"), F.col("seq")]
    for name, typ, _ in S.CAPTURE_FIELDS:
        out.append((cols[name] if name in cols else S.default_of(name)).cast(typ).alias(name))
    return d.select(*out)


def host_config(spark: SparkSession) -> DataFrame:
    """Mount namespace of every host in the derived capture."""
    return spark.range(8).select(
        F.concat(F.lit("host-"), F.col("id").cast("string")).alias("host"),
        F.lit(HOST_MNT_NS).cast("long").alias("host_mnt_ns"),
    )
