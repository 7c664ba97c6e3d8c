"""Point-in-time sweep of host inventories against what packages own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.functions import events as X
from procscope.functions import text as T

# --- Fixed values ------------------------------------------------------------------------------
SUID_ROOTS = ["/usr", "/opt", "/srv", "/var", "/home", "/root", "/tmp"]
IMAGE_STORES = [
    "/var/lib/docker", "/var/lib/containerd", "/var/lib/containers", "/var/lib/lxc",
    "/var/lib/lxd", "/var/lib/machines", "/var/lib/snapd", "/snap",
]
USER_IMAGE_STORE = "/.local/share/containers/"
PERSISTENCE_DIRS = [
    "/etc/cron.d", "/etc/cron.daily", "/etc/cron.hourly", "/etc/cron.weekly",
    "/etc/cron.monthly", "/etc/systemd/system", "/usr/local/lib/systemd/system", "/etc/pam.d",
    "/etc/profile.d", "/etc/ld.so.conf.d", "/etc/update-motd.d", "/etc/sudoers.d",
    "/etc/init.d",
]
UNIT_DIRS = ["/etc/systemd/system", "/usr/local/lib/systemd/system"]
HATCH_DEFAULTS = [
    ("/proc/sys/kernel/modprobe", "/sbin/modprobe"),
    ("/proc/sys/kernel/poweroff_cmd", "/sbin/poweroff"),
    ("/proc/sys/kernel/core_pattern", "core"),
]
CHECKS = [
    "setuid binaries", "persistence", "running processes", "kernel modules", "escape hatches",
    "ssh authorized keys",
]
# -----------------------------------------------------------------------------------------------
DAY = 86_400


def manifest_paths(lines: DataFrame) -> DataFrame:
    """Owned paths (host, source, path) from raw manifest lines (host, source, file, line_no, line).

    dpkg lists hold one path per line. pacman files hold sections: only ``%FILES%`` counts, its
    paths are relative and directories end in a slash. A section header reaches forward to the next
    one of the same small file.
    """
    dpkg = lines.filter("source = 'dpkg' AND line <> ''").selectExpr("host", "source", "line AS path")
    w = (
        "OVER (PARTITION BY host, file ORDER BY line_no"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    pac = (
        lines.filter("source = 'pacman'")
        .selectExpr("*", f"last(CASE WHEN startswith(line, '%') THEN trim(line) END, true) {w} AS sec")
        .filter("sec = '%FILES%' AND NOT startswith(line, '%') AND line <> '' AND NOT endswith(line, '/')")
        .selectExpr("host", "source", "concat('/', line) AS path")
    )
    has_dpkg = dpkg.select("host").distinct()
    return dpkg.unionByName(pac.join(has_dpkg, "host", "left_anti")).distinct()


def _under(path: str, roots: list[str]) -> str:
    return X.any_of([f"startswith({path}, {X.quote(r + '/')})" for r in roots])


def skipped_stores(files: DataFrame) -> DataFrame:
    """(host, stores): image stores that hold files of a host; what is in them is not examined."""
    arms = " ".join(
        f"WHEN path = {X.quote(s)} OR startswith(path, {X.quote(s + '/')}) THEN {X.quote(s)}" for s in IMAGE_STORES
    )
    store = f"CASE {arms} WHEN contains(path, '{USER_IMAGE_STORE}') THEN {X.quote(USER_IMAGE_STORE)} END"
    found = files.selectExpr("host", f"{store} AS store").filter("store IS NOT NULL")
    return found.groupBy("host").agg(F.expr("array_sort(collect_set(store)) AS stores"))  # a few names


def setuid_files(files: DataFrame) -> DataFrame:
    """Setuid/setgid files under the roots that matter, image stores excluded."""
    stores = X.any_of(
        [f"path = {X.quote(s)} OR startswith(path, {X.quote(s + '/')})" for s in IMAGE_STORES]
        + [f"contains(path, '{USER_IMAGE_STORE}')"]
    )
    return files.filter(
        f"NOT is_symlink AND (mode & 3072L) <> 0 AND {_under('path', SUID_ROOTS)} AND NOT {stores}"
    )


def unowned_setuid(files: DataFrame, manifest: DataFrame) -> DataFrame:
    d = setuid_files(files).join(manifest.select("host", "path"), ["host", "path"], "left_anti")
    return d.selectExpr(
        "host", "path",
        f"concat(path, ' mode ', lpad({X.octal('mode')}, 4, '0'), ' uid ', uid) AS item",
    )


def unowned_persistence(
    files: DataFrame, manifest: DataFrame, pam_generated: DataFrame, now: int
) -> DataFrame:
    """Files in places the system runs things from that neither a package nor the host's own tools
    explain: a unit link is explained by /dev/null or a packaged target, a ``common-*`` PAM file by
    the generator's own record of it."""
    d = files.filter(_under("path", PERSISTENCE_DIRS)).join(
        manifest.select("host", "path"), ["host", "path"], "left_anti"
    )
    owned_target = manifest.selectExpr("host", "path AS link_target", "true AS packaged").distinct()
    pam = pam_generated.selectExpr(
        "host", "concat('/etc/pam.d/common-', name) AS path", "true AS generated"
    ).distinct()
    d = d.join(owned_target, ["host", "link_target"], "left").join(pam, ["host", "path"], "left")
    link = (
        f"is_symlink AND {X.starts_any('path', UNIT_DIRS)}"
        " AND (link_target = '/dev/null' OR coalesce(packaged, false))"
    )
    return d.filter(f"NOT ({link}) AND NOT coalesce(generated, false)").selectExpr(
        "host", "path",
        f"concat(path, ' (', CASE WHEN mtime IS NULL OR mtime > {now} THEN 'age unknown'"
        f" ELSE concat(({now} - mtime) DIV {DAY}, 'd old') END, ')') AS item",
    )


def deleted_executables(procs: DataFrame) -> DataFrame:
    return procs.filter("endswith(exe, ' (deleted)') OR contains(exe, 'memfd:')").selectExpr(
        "host", "pid",
        "concat('pid ', pid, ' ', exe, ' [', trim(replace(cmdline, '\\u0000', ' ')), ']')"
        " AS item",
    )


def fileless_modules(loaded: DataFrame, module_files: DataFrame) -> DataFrame:
    """Loaded modules without a file; ``-`` and ``_`` are the same, extensions do not count."""
    have = module_files.selectExpr(
        "host", "replace(split_part(file_name, '.', 1), '-', '_') AS stem"
    ).distinct()
    return (
        loaded.selectExpr("host", "name", "replace(name, '-', '_') AS stem")
        .join(have, ["host", "stem"], "left_anti")
        .selectExpr("host", "name AS item")
    )


def armed_hatches(values: DataFrame) -> DataFrame:
    """Escape hatches that name a program other than the kernel's default."""
    v = "trim(value)"
    default = X.any_of(
        [f"(path = {X.quote(p)} AND {v} = {X.quote(d)})" for p, d in HATCH_DEFAULTS]
    )
    return values.filter(
        f"NOT {default} AND {v} <> '' AND (startswith({v}, '|') OR contains({v}, '/'))"
    ).selectExpr("host", f"concat(path, ' = ', {v}) AS item")


def login_keys(lines: DataFrame, now: int) -> DataFrame:
    """Every key that can log in, and every line that looks like one but is ignored."""
    d = lines.filter("trim(line) <> '' AND NOT startswith(trim(line), '#')").selectExpr(
        "host", "path", "trim(line) AS line", f"{T.key_line('trim(line)')} AS k",
        f"CASE WHEN mtime IS NULL OR mtime > {now} THEN '?'"
        f" ELSE concat(({now} - mtime) DIV {DAY}, 'd') END AS age",
    )
    return d.selectExpr(
        "host", "path", "k.parsed AS parsed", "k.options AS options", "k.type AS type",
        "k.comment AS comment",
        "CASE WHEN k.parsed THEN concat(path, ' — ', k.type, ' ',"
        " if(k.comment = '', '(no comment)', k.comment),"
        " if(k.options = '', '', concat(' [', k.options, ']')), ' (file ', age, ' old)')"
        " ELSE concat(path, ' — line OpenSSH will ignore: ', line) END AS item",
    )


def _check(
    hosts: DataFrame,
    name: str,
    total: DataFrame,
    found: DataFrame,
    bad: str,
    clear: str,
    some: str,
    unknown: str,
    knows: str = "total IS NOT NULL",
) -> DataFrame:
    """One row per host, with the number of findings; the findings stay rows of their own."""
    counted = found.groupBy("host").agg(F.expr("count(1) AS found"))
    d = hosts.join(total, "host", "left").join(counted, "host", "left")
    d = d.selectExpr("*", f"coalesce({knows}, false) AS ok", "coalesce(found, 0L) AS n")
    return d.selectExpr(
        "host", f"'{name}' AS check",
        f"CASE WHEN NOT ok THEN 'unknown' WHEN n > 0 THEN '{bad}' ELSE 'clear' END AS status",
        f"CASE WHEN NOT ok THEN {unknown} WHEN n > 0 THEN {some} ELSE {clear} END AS summary",
        "if(ok, n, 0L) AS n",
    )


def sweep(
    hosts: DataFrame,
    files: DataFrame,
    manifest: DataFrame,
    pam_generated: DataFrame,
    procs: DataFrame,
    loaded: DataFrame,
    module_files: DataFrame,
    hatch_values: DataFrame,
    key_lines: DataFrame,
    now: int,
) -> tuple[DataFrame, DataFrame]:
    """All six checks for every host: (host, check, status, summary, n), and what they found as rows
    (host, check, item). A check without an authority to compare against is unknown, never clear, and
    lists nothing."""

    def count(df: DataFrame, expr: str = "count(1)") -> DataFrame:
        return df.groupBy("host").agg(F.expr(f"{expr} AS total"))

    owned = manifest.groupBy("host").agg(F.expr("count(1) AS owned"))
    with_owner = hosts.join(owned, "host", "left").join(skipped_stores(files), "host", "left")
    skipped = "if(stores IS NULL, '', concat('; not examined: ', array_join(stores, ', ')))"
    no_manifest = "'nothing says which package owns what'"
    total = "coalesce(total, 0)"
    trees = module_files.select("host").distinct().withColumn("tree", F.lit(True))
    parsed = login_keys(key_lines, now)
    judged = manifest.select("host").distinct()
    found = [
        unowned_setuid(files, manifest).join(judged, "host", "left_semi"),
        unowned_persistence(files, manifest, pam_generated, now).join(judged, "host", "left_semi"),
        deleted_executables(procs),
        fileless_modules(loaded, module_files).join(trees, "host", "left_semi"),
        armed_hatches(hatch_values),
        parsed,
    ]
    suid = _check(
        with_owner, CHECKS[0], count(setuid_files(files)), found[0],
        "suspect",
        f"concat('privileged files: ', {total}, ', each from a package', {skipped})",
        f"concat('privileged files: ', {total}, ', without a package: ', n, {skipped})",
        no_manifest, "owned > 0",
    )
    persistence = _check(
        with_owner, CHECKS[1], count(files.filter(_under("path", PERSISTENCE_DIRS))),
        found[1], "notice",
        f"concat('start-up entries in {len(PERSISTENCE_DIRS)} folders: ', {total}, ', each explained')",
        f"concat('start-up entries: ', {total}, ', unexplained: ', n)",
        no_manifest, "owned > 0",
    )
    running = _check(
        hosts, CHECKS[2], count(procs), found[2], "suspect",
        "concat('processes: ', total, ', each with its program in place')",
        "concat('processes: ', total, ', with a program that is gone or has no file: ', n)",
        "'no process list'",
    )
    modules = _check(
        hosts.join(trees, "host", "left"), CHECKS[3], count(loaded),
        found[3], "suspect",
        "concat('kernel modules: ', total, ', each with a file')",
        "concat('kernel modules: ', total, ', without a file: ', n)",
        "'no list of modules, or no tree to compare it with'", "tree AND total IS NOT NULL",
    )
    hatches = _check(
        hosts, CHECKS[4], count(hatch_values), found[4], "notice",
        "concat('escape hatches: ', total, ', no program set')",
        "concat('escape hatches: ', total, ', with a program set: ', n)",
        "'no escape hatch could be read'",
    )
    key_count = parsed.groupBy("host").agg(
        F.expr("count_if(parsed) AS n_keys"), F.expr("count_if(NOT parsed) AS n_odd")
    )
    keys = _check(
        hosts.join(key_count, "host", "left"), CHECKS[5],
        count(key_lines, "count(DISTINCT path)"), found[5], "notice",
        f"concat('key files: ', {total}, ', all empty')",
        f"concat('key files: ', {total}, ', keys: ', n_keys,"
        " if(n_odd > 0, concat(', lines that are no key: ', n_odd), ''))",
        "''", "true",
    )
    out = suid
    for d in (persistence, running, modules, hatches, keys):
        out = out.unionByName(d)
    items = None
    for check, d in zip(CHECKS, found, strict=True):
        d = d.selectExpr("host", f"'{check}' AS check", "item")
        items = d if items is None else items.unionByName(d)
    return out, items


def needs_attention(findings: DataFrame) -> DataFrame:
    return findings.groupBy("host").agg(
        F.expr("bool_or(status = 'suspect') AS needs_attention"),
        F.expr("count_if(status = 'suspect') AS suspect"),
        F.expr("count_if(status = 'notice') AS notice"),
        F.expr("count_if(status = 'unknown') AS unknown"),
    )
