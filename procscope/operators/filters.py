"""Selection of raw sensor rows: which of them become events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.functions import events as X

WRITE, READ, DENY_IN_NS = 1, 2, 4

# Watched path prefixes and the directions they opt in to.
STATIC_WATCHES = [
    ("/etc/ld.so.preload", WRITE),
    ("/etc/cron", WRITE),
    ("/etc/systemd/", WRITE),
    ("/usr/lib/systemd/", WRITE),
    ("/lib/systemd/", WRITE),
    ("/etc/sudoers", WRITE),
    ("/etc/shadow", WRITE | READ),
    ("/etc/gshadow", WRITE | READ),
    ("/etc/passwd", WRITE),
    ("/root/.ssh/", WRITE),
    ("/etc/pam.", WRITE),
    ("/etc/ld.so.conf", WRITE),
    ("/etc/profile", WRITE),
    ("/etc/bash.bashrc", WRITE),
    ("/etc/environment", WRITE),
    ("/etc/update-motd.d/", WRITE),
    ("/etc/ssh/ssh_host_", READ),
    ("/root/.ssh/id_", READ),
    ("/proc/sys/kernel/core_pattern", WRITE | DENY_IN_NS),
    ("/proc/sys/kernel/modprobe", WRITE | DENY_IN_NS),
    ("/proc/sys/kernel/poweroff_cmd", WRITE | DENY_IN_NS),
    ("/sys/kernel/uevent_helper", WRITE | DENY_IN_NS),
    ("/proc/sys/fs/binfmt_misc/register", WRITE | DENY_IN_NS),
]
RUNTIME_SOCKETS = ["docker.sock", "containerd.sock", "podman.sock", "crio.sock"]
CAPABILITY_XATTR = "security.capability"
INET_FAMILIES = ["AF_INET", "AF_INET6"]


def default_watches(spark, homes: DataFrame | None = None, root_key_writes: bool = False) -> DataFrame:
    """(prefix, flags), plus ``host`` when ``homes`` (host, home) is given.

    ``root_key_writes`` also watches writes to root's private keys. By default a write there matches
    the longer, read-only entry and is not selected.
    """
    rows = [
        (p, f | WRITE if root_key_writes and p == "/root/.ssh/id_" else f)
        for p, f in STATIC_WATCHES
    ]
    static = spark.createDataFrame(rows, "prefix string, flags int")
    if homes is None:
        return static
    per_home = homes.selectExpr(
        "host", "explode(array(named_struct('prefix', concat(home, '/.ssh/'), 'flags', 1),"
        " named_struct('prefix', concat(home, '/.ssh/id_'), 'flags', 3))) AS w",
    ).selectExpr("host", "w.prefix AS prefix", "w.flags AS flags")
    hosts = homes.select("host").distinct()
    return hosts.crossJoin(F.broadcast(static)).unionByName(per_home)


def watch_flags(opens: DataFrame, watches: DataFrame) -> DataFrame:
    """Flags of the longest watched prefix of each path (0 when none).

    A path is looked up under each of the prefix lengths that occur in the watch table, as equality
    joins on (prefix): the probe side grows by the number of distinct lengths, never by the number
    of watches, and no pair of path and watch is enumerated.
    """
    host = ["host"] if "host" in watches.columns else []
    lengths = [
        r[0]
        for r in watches.selectExpr(f"char_length(prefix) AS n")
        .distinct()
        .orderBy(F.desc("n"))
        .collect()  # one integer per length in use
    ]
    tries = ", ".join(
        f"CASE WHEN char_length(path) >= {n} THEN left(path, {n}) END" for n in lengths
    )
    # Only distinct paths are expanded; popular files are looked up once.
    paths = opens.select(*host, "path").distinct()
    probes = paths.selectExpr(*host, "path", f"explode(array_compact(array({tries}))) AS prefix")
    best = (
        probes.join(watches.select(*host, "prefix", "flags"), host + ["prefix"])
        .groupBy(*host, "path")
        .agg(F.expr("max_by(flags, char_length(prefix)) AS w_flags"))
    )
    return opens.join(best, host + ["path"], "left").selectExpr(
        *[f"{c}" for c in opens.columns], "w_flags"
    )


def select_opens(
    opens: DataFrame,
    watches: DataFrame,
    watched_ids: DataFrame | None = None,
    escape_ids: DataFrame | None = None,
    mode: str = "off",
    hosts: DataFrame | None = None,
) -> DataFrame:
    """File opens worth an event: watched in the direction of the open, or a write to an escape hatch.

    The longest matching prefix decides before its direction is looked at. Without a path match a
    watched file's identity counts. ``mode`` (off, audit, on) adds what enforcement would have done;
    anything unknown allows. Adds ``watch_id``, ``escape_target``, ``denied`` and ``would_deny``.
    """
    d = watch_flags(opens, watches)
    if watched_ids is not None:
        w = watched_ids.selectExpr("host", "dev", "ino", "flags AS id_flags")
        d = d.join(w, ["host", "dev", "ino"], "left")
    else:
        d = d.withColumn("id_flags", F.lit(None).cast("int"))
    if escape_ids is not None:
        e = escape_ids.selectExpr("host", "dev", "ino", "true AS hatch_id").distinct()
        d = d.join(e, ["host", "dev", "ino"], "left")
    else:
        d = d.withColumn("hatch_id", F.lit(None).cast("boolean"))
    if hosts is not None:
        d = d.join(hosts.select("host", "host_mnt_ns"), "host", "left")
    else:
        d = d.withColumn("host_mnt_ns", F.lit(0).cast("long"))
    wr = X.opened_for_write("f_mode")
    flags = "coalesce(w_flags, id_flags, 0)"
    d = d.selectExpr(
        *opens.columns,
        f"CASE WHEN {flags} & if({wr}, {WRITE}, {READ}) <> 0 THEN {flags} ELSE 0 END AS watch_id",
        f"{wr} AND coalesce(hatch_id, false) AS escape_target",
        "host_mnt_ns",
    )
    d = d.filter("watch_id <> 0 OR escape_target")
    mnt = "coalesce(mnt_ns, 0)" if "mnt_ns" in opens.columns else "0"
    verdict = (
        f"(escape_target AND coalesce(host_mnt_ns, 0) <> 0 AND {mnt} <> 0"
        f" AND {mnt} <> host_mnt_ns)"
    )
    return d.selectExpr(
        *opens.columns, "watch_id", "escape_target",
        f"{verdict} AND {'true' if mode == 'on' else 'false'} AS denied",
        f"{verdict} AND {'true' if mode == 'audit' else 'false'} AS would_deny",
    )


S_IFMT, S_IFREG = 0o170000, 0o100000


def select_modes(rows: DataFrame) -> DataFrame:
    """chmod rows (``created`` false) that gain setuid/setgid on a regular file, and files created
    with the bit already set, which have no old mode."""
    fmt = f"(if(created, new_mode, inode_mode) & {S_IFMT}L)"
    regular = f"if(created, {fmt} IN (0, {S_IFREG}), {fmt} = {S_IFREG})"
    old = "if(created, 0L, inode_mode)"
    return rows.filter(regular).selectExpr(
        *rows.columns, f"{old} AS old_file_mode", "new_mode AS file_mode"
    ).filter(f"{X.gained_bits()} <> 'none'")


def select_xattrs(rows: DataFrame) -> DataFrame:
    return rows.filter(f"left(name, {len(CAPABILITY_XATTR)}) = '{CAPABILITY_XATTR}'")


def select_ptraces(rows: DataFrame) -> DataFrame:
    """Attaches, and reads of another user's process; never a process looking at itself."""
    return rows.filter(
        f"target <> tgid AND ({X.is_attach('mode')} OR tracer_euid <> target_euid)"
    )


def select_connects(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("bound_name").isin(RUNTIME_SOCKETS))


def select_listens(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("family").isin(INET_FAMILIES))


def select_creds(rows: DataFrame) -> DataFrame:
    return rows.filter(
        " OR ".join(f"old_{c} <> new_{c}" for c in ("uid", "gid", "euid", "egid", "cap"))
    )


def select_tasks(rows: DataFrame) -> DataFrame:
    """Process-level forks and exits; the low byte of a raw exit status is dropped."""
    return rows.filter("pid = tgid").selectExpr(
        *rows.columns,
        "CASE WHEN kind = 'exit' THEN shiftright(CAST(raw_exit AS BIGINT), 8) ELSE 0L END"
        " AS exit_code",
    )


def select_fileless(rows: DataFrame) -> DataFrame:
    """Executions of something that is not an ordinary file: memfd 1, anonymous inode 2, unlinked 3."""
    return rows.selectExpr(
        *rows.columns,
        "CASE WHEN startswith(dentry_name, 'memfd:') THEN 1 WHEN sb_kind = 'anon_inodefs' THEN 2"
        " WHEN nlink = 0 THEN 3 END AS aux",
    ).filter("aux IS NOT NULL")


def socket_stdio(execs: DataFrame, fds: DataFrame) -> DataFrame:
    """Add whether a standard descriptor of the new program is a network socket."""
    hit = (
        fds.filter(F.col("fd").isin(0, 1, 2))
        .groupBy("host", "seq")
        .agg(F.bool_or(F.col("is_socket") & F.col("family").isin(INET_FAMILIES)).alias("hit"))
    )
    return execs.join(hit, ["host", "seq"], "left").selectExpr(
        *execs.columns, "coalesce(hit, false) AS socket_stdio"
    )


def at_least(df: DataFrame, floor: str, column: str = "severity") -> DataFrame:
    """Severity floor; an unknown floor name is an error."""
    return df.filter(f"{X.severity_rank(column)} >= {X.parse_severity(floor)}")
