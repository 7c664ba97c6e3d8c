"""Fleet, inventory and alert queries (B20, B22, C10, D12, D13, F8-F14, G3, G5, G6, H, I, L6, L7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procscope.catalog.base import EXTRA, NOW_SQL, Inputs, query
from procscope.catalog.oracle_base import sql
from procscope.functions import text as T
from procscope.operators import alerts, baseline, fleet, inventory, text_index
from procscope.session import scratch_path


def _e(text: str):
    return F.expr(text)


# The record fields the checks need, straight from the engine tables.
STORED = {
    **EXTRA,
    "sub": """
SELECT s.id, s.host, s.seq, s.received, s.severity, s.score, s.rank, p.acomm AS comm, p.aexe AS exe,
 (SELECT max(c.filename || ' ' || c.arg1) FROM cap c WHERE c.host = s.host AND c.type = 1
   AND c.pid = s.pid AND c.start = s.start AND c.seq = (SELECT max(seq) FROM cap d WHERE d.host = s.host
   AND d.type = 1 AND d.pid = s.pid AND d.start = s.start AND d.seq <= s.seq)) AS cmdline
FROM stored s JOIN path p ON p.host = s.host AND p.seq = s.seq AND p.depth = 0""",
    "pairs": """
SELECT s.id, s.host, s.seq, f.id AS signal, f.ts_ns, f.score AS sscore, f.detail
FROM stored s JOIN filed f ON f.host = s.host AND f.seq = s.seq""",
}
SUMMARY_SQL = (
    "severity || ' ' || score || '/100 on ' || host || ' — ' || comm ||"
    " CASE WHEN cmdline IS NOT NULL THEN ': ' || cmdline ELSE '' END"
)


@query(
    "b20_alert_rows",
    sql(
        f"SELECT id, severity, {SUMMARY_SQL} AS summary, CASE severity WHEN 'CRITICAL' THEN 34 WHEN 'HIGH'"
        " THEN 35 WHEN 'MEDIUM' THEN 36 ELSE 37 END::BIGINT AS priority FROM sub WHERE rank >= 1",
        STORED,
    ),
)
def b20(i: Inputs):
    return alerts.alerts(i.stored, "low").selectExpr(
        "id", "severity", "regexp_replace(summary, ' \\\\[[^\\\\[]*\\\\]$', '') AS summary",
        "CAST(priority AS BIGINT) AS priority",
    )


@query(
    "b22_haystack",
    sql(
        "SELECT s.id, lower(s.host || ' ' || s.severity || ' ' || s.score || ' ' || s.comm) AS head,"
        " (SELECT count(*) FROM pairs p WHERE p.id = s.id AND contains(p.signal, 'setcap')) > 0"
        " AS has_setcap FROM sub s",
        STORED,
    ),
)
def b22(i: Inputs):
    return i.stored.selectExpr("id", "record", f"{T.haystack()} AS hay").selectExpr(
        "id", "regexp_extract(hay, '^([^ ]* [^ ]* [^ ]* [^ ]*)', 1) AS head",
        "contains(hay, 'setcap') AS has_setcap",
    )


@query(
    "c10_search",
    sql(
        "SELECT id, host FROM sub s WHERE severity = 'CRITICAL' AND EXISTS (SELECT 1 FROM pairs p"
        " WHERE p.id = s.id AND p.signal = 'setcap')",
        STORED,
    ),
)
def c10(i: Inputs):
    return fleet.search(i.stored, " Critical  SETCAP ").select("id", "host")


@query(
    "c10b_indexed_search",
    sql(
        "SELECT 1 AS q, id, host FROM sub s WHERE severity = 'CRITICAL' AND EXISTS (SELECT 1 FROM pairs p"
        " WHERE p.id = s.id AND p.signal = 'setcap') UNION ALL SELECT 2, id, host FROM sub s WHERE EXISTS"
        " (SELECT 1 FROM pairs p WHERE p.id = s.id AND p.signal = 'suid_create')"
        " UNION ALL SELECT 3, id, host FROM sub WHERE host = 'host-3'",
        STORED,
    ),
)
def c10b(i: Inputs):
    """Posting lists that grow with three batches of arrivals."""
    index = text_index.SearchIndex(i.spark, scratch_path(i.spark, "search"))
    top = i.stored.agg(F.max("id")).first()[0] + 1
    for k in range(3):
        index.add(i.stored.filter(f"id * 3 DIV {top} = {k}"), k)
    asked = (" Critical  SETCAP ", "suid_create", "host-3")
    out = [index.search(q).selectExpr(f"{k} AS q", "id", "host") for k, q in enumerate(asked, 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- inventory -----------------------------------------------------------------------------------

NOW = 20_000_000
FILES_SQL = """
SELECT 'host-' || (user_id % 8) AS host, event_id AS e,
 CASE event_id % 10 WHEN 0 THEN '/usr/bin/p' || event_id WHEN 1 THEN '/opt/a' || event_id
  WHEN 2 THEN '/var/lib/docker/overlay2/x' || event_id
  WHEN 3 THEN '/home/u/.local/share/containers/x' || event_id WHEN 4 THEN '/etc/cron.d/j' || event_id
  WHEN 5 THEN '/etc/systemd/system/s' || event_id || '.service'
  WHEN 6 THEN '/etc/pam.d/common-n' || event_id % 400 WHEN 7 THEN '/etc/profile.d/q' || event_id
  WHEN 8 THEN '/tmp/z' || event_id ELSE '/boot/x' || event_id END AS path,
 CASE event_id % 4 WHEN 0 THEN 35309 WHEN 1 THEN 33261 WHEN 2 THEN 34285 ELSE 33188 END AS mode,
 user_id AS uid, event_id % 10 = 5 AND event_id % 3 <> 0 AS is_symlink,
 CASE WHEN event_id % 10 <> 5 OR event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '/dev/null'
  ELSE '/usr/lib/systemd/system/s' || (event_id % 50) END AS link_target,
 event_id * 37 % 10000000 AS mtime FROM events"""
INV = {
    "files0": FILES_SQL,
    "files": "SELECT host, path, min(e) AS e, min(mode) AS mode, min(uid) AS uid,"
    " bool_or(is_symlink) AS is_symlink, max(link_target) AS link_target, min(mtime) AS mtime"
    " FROM files0 GROUP BY ALL",
    "manifest": "SELECT host, path FROM files WHERE e % 2 = 0 AND host <> 'host-7' UNION"
    " SELECT DISTINCT host, '/usr/lib/systemd/system/s' || n FROM files, range(0, 50, 2) t(n)"
    " WHERE host <> 'host-7'",
    "setuid": """
SELECT *, path || ' mode ' || lpad(printf('%o', mode & 4095), 4, '0') || ' uid ' || uid AS item FROM files
WHERE NOT is_symlink AND (mode & 3072) <> 0 AND regexp_matches(path, '^/(usr|opt|srv|var|home|root|tmp)/')
 AND path NOT LIKE '/var/lib/docker/%' AND path NOT LIKE '%/.local/share/containers/%'""",
    "persist": "SELECT * FROM files WHERE regexp_matches(path,"
    " '^/etc/(cron[.]d|systemd/system|pam[.]d|profile[.]d)/')",
    "strange": f"""
SELECT host, path, path || ' (' || ({NOW} - mtime) // 86400 || 'd old)' AS item FROM persist p
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.host = p.host AND m.path = p.path)
 AND NOT (is_symlink AND (link_target = '/dev/null' OR EXISTS (SELECT 1 FROM manifest m
   WHERE m.host = p.host AND m.path = p.link_target)))
 AND NOT (path LIKE '/etc/pam.d/common-n%' AND try_cast(substring(path, 20) AS BIGINT) % 2 = 0)""",
    "alien": "SELECT * FROM setuid s WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.host = s.host"
    " AND m.path = s.path)",
    "mods": "SELECT DISTINCT 'host-' || (user_id % 8) AS host, 'mod_' || (user_id % 40) AS name,"
    " user_id % 40 AS n FROM events",
    "procs": "SELECT 'host-' || (user_id % 8) AS host, event_id AS pid, CASE WHEN event_id % 9 = 0 THEN"
    " '/usr/bin/a (deleted)' WHEN event_id % 11 = 0 THEN '/memfd:x' ELSE '/bin/b' END AS exe FROM events",
    "hatch": """
SELECT DISTINCT 'host-' || (user_id % 8) AS host, p.path, CASE WHEN user_id % 8 < 4 THEN p.def ELSE p.alt END
 AS value FROM events, (VALUES ('/proc/sys/kernel/modprobe', '/sbin/modprobe', '/tmp/m'),
 ('/proc/sys/kernel/core_pattern', 'core', '|/usr/lib/systemd/systemd-coredump'),
 ('/sys/kernel/uevent_helper', '', 'x')) p(path, def, alt)""",
}


class Inventory:
    """Inventory tables derived from the event numbers."""

    def __init__(self, i: Inputs):
        ev = i.events.selectExpr("concat('host-', u % 8) AS host", "e", "u")
        paths = (
            "CASE e % 10 WHEN 0 THEN concat('/usr/bin/p', e) WHEN 1 THEN concat('/opt/a', e)"
            " WHEN 2 THEN concat('/var/lib/docker/overlay2/x', e)"
            " WHEN 3 THEN concat('/home/u/.local/share/containers/x', e)"
            " WHEN 4 THEN concat('/etc/cron.d/j', e)"
            " WHEN 5 THEN concat('/etc/systemd/system/s', e, '.service')"
            " WHEN 6 THEN concat('/etc/pam.d/common-n', e % 400)"
            " WHEN 7 THEN concat('/etc/profile.d/q', e) WHEN 8 THEN concat('/tmp/z', e)"
            " ELSE concat('/boot/x', e) END"
        )
        raw = ev.selectExpr(
            "host", "e", f"{paths} AS path",
            "CASE e % 4 WHEN 0 THEN 35309L WHEN 1 THEN 33261L WHEN 2 THEN 34285L ELSE 33188L END"
            " AS mode",
            "u AS uid", "e % 10 = 5 AND e % 3 <> 0 AS is_symlink",
            "CASE WHEN e % 10 <> 5 OR e % 3 = 0 THEN '' WHEN e % 3 = 1 THEN '/dev/null'"
            " ELSE concat('/usr/lib/systemd/system/s', e % 50) END AS link_target",
            "e * 37 % 10000000 AS mtime",
        )
        self.files = raw.groupBy("host", "path").agg(
            _e("min(e) AS e"), _e("min(mode) AS mode"), _e("min(uid) AS uid"),
            _e("bool_or(is_symlink) AS is_symlink"), _e("max(link_target) AS link_target"),
            _e("min(mtime) AS mtime"),
        )
        self.hosts = ev.select("host").distinct()
        units = self.hosts.selectExpr("host", "explode(sequence(0, 48, 2)) AS n").selectExpr(
            "host", "0L AS line_no", "concat('/usr/lib/systemd/system/s', n) AS line"
        )
        listed = self.files.filter("e % 2 = 0").selectExpr("host", "e AS line_no", "path AS line")
        lines = listed.unionByName(units).filter("host <> 'host-7'").selectExpr(
            "host", "'dpkg' AS source", "'all.list' AS file", "line_no", "line"
        )
        self.manifest = inventory.manifest_paths(lines)
        self.pam = self.hosts.selectExpr(
            "host", "explode(sequence(0, 398, 2)) AS n"
        ).selectExpr("host", "concat('n', n) AS name")
        mods = ev.selectExpr("host", "concat('mod_', u % 40) AS name", "u % 40 AS n").distinct()
        self.loaded = mods.select("host", "name")
        self.module_files = mods.filter("n % 7 <> 0").selectExpr(
            "host", "concat(replace(name, '_', '-'), '.ko.xz') AS file_name"
        )
        self.procs = ev.selectExpr(
            "host", "e AS pid", "CASE WHEN e % 9 = 0 THEN '/usr/bin/a (deleted)' WHEN e % 11 = 0"
            " THEN '/memfd:x' ELSE '/bin/b' END AS exe", "concat('cmd', '\\u0000', e) AS cmdline",
        )
        self.hatches = self.hosts.selectExpr(
            "host", "CAST(substring(host, 6) AS INT) AS n",
            "inline(array(named_struct('path', '/proc/sys/kernel/modprobe', 'd', '/sbin/modprobe',"
            " 'a', '/tmp/m'), named_struct('path', '/proc/sys/kernel/core_pattern', 'd', 'core',"
            " 'a', '|/usr/lib/systemd/systemd-coredump'), named_struct('path',"
            " '/sys/kernel/uevent_helper', 'd', '', 'a', 'x')))",
        ).selectExpr("host", "path", "if(n < 4, d, a) AS value")
        self.keys = ev.filter("e % 3 = 0").selectExpr(
            "host", "concat('/home/u', u % 5, '/.ssh/authorized_keys') AS path",
            "CASE e % 4 WHEN 0 THEN concat('ssh-rsa AAAA', e, ' c', e) WHEN 1 THEN '# note'"
            " WHEN 2 THEN concat('junk', e) ELSE concat('no-pty ssh-ed25519 BBBB', e) END AS line",
            "e * 37 % 10000000 AS mtime",
        )

    def sweep(self):
        return inventory.sweep(
            self.hosts, self.files, self.manifest, self.pam, self.procs, self.loaded,
            self.module_files, self.hatches, self.keys, NOW,
        )


@query(
    "d12_inventory_antijoins",
    sql(
        "SELECT 'setuid' AS what, host, item FROM alien UNION ALL SELECT 'persistence', host, item"
        " FROM strange UNION ALL SELECT 'module', host, name FROM mods WHERE n % 7 = 0",
        INV,
    ),
)
def d12(i: Inputs):
    v = Inventory(i)
    a = inventory.unowned_setuid(v.files, v.manifest).selectExpr("'setuid' AS what", "host", "item")
    b = inventory.unowned_persistence(v.files, v.manifest, v.pam, NOW).selectExpr(
        "'persistence' AS what", "host", "item"
    )
    c = inventory.fileless_modules(v.loaded, v.module_files).selectExpr(
        "'module' AS what", "host", "item"
    )
    return a.unionByName(b).unionByName(c)


COUNTS_SQL = """
SELECT h.host, k.chk AS "check", CASE
 WHEN k.chk IN ('setuid binaries', 'persistence') AND h.host = 'host-7' THEN 'unknown'
 WHEN k.chk = 'setuid binaries' THEN CASE WHEN (SELECT count(*) FROM alien a WHERE a.host = h.host) > 0
   THEN 'suspect' ELSE 'clear' END
 WHEN k.chk = 'persistence' THEN CASE WHEN (SELECT count(*) FROM strange a WHERE a.host = h.host) > 0
   THEN 'notice' ELSE 'clear' END
 WHEN k.chk = 'running processes' THEN CASE WHEN (SELECT count(*) FROM procs a WHERE a.host = h.host
   AND exe <> '/bin/b') > 0 THEN 'suspect' ELSE 'clear' END
 WHEN k.chk = 'kernel modules' AND NOT EXISTS (SELECT 1 FROM mods a WHERE a.host = h.host AND n % 7 <> 0)
   THEN 'unknown'
 WHEN k.chk = 'kernel modules' THEN CASE WHEN (SELECT count(*) FROM mods a WHERE a.host = h.host
   AND n % 7 = 0) > 0 THEN 'suspect' ELSE 'clear' END
 WHEN k.chk = 'escape hatches' THEN CASE WHEN substring(h.host, 6)::INT >= 4 THEN 'notice' ELSE 'clear' END
 ELSE 'notice' END AS status,
 CASE k.chk
 WHEN 'setuid binaries' THEN CASE WHEN h.host = 'host-7' THEN 0 ELSE (SELECT count(*) FROM alien a WHERE a.host = h.host) END
 WHEN 'persistence' THEN CASE WHEN h.host = 'host-7' THEN 0 ELSE (SELECT count(*) FROM strange a WHERE a.host = h.host) END
 WHEN 'running processes' THEN (SELECT count(*) FROM procs a WHERE a.host = h.host AND exe <> '/bin/b')
 WHEN 'kernel modules' THEN CASE WHEN EXISTS (SELECT 1 FROM mods a WHERE a.host = h.host AND n % 7 <> 0)
   THEN (SELECT count(*) FROM mods a WHERE a.host = h.host AND n % 7 = 0) ELSE 0 END
 WHEN 'escape hatches' THEN CASE WHEN substring(h.host, 6)::INT >= 4 THEN 2 ELSE 0 END
 ELSE (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 1
   AND 'host-' || (user_id % 8) = h.host) END AS n
FROM (SELECT DISTINCT host FROM files) h, (VALUES ('setuid binaries'), ('persistence'),
 ('running processes'), ('kernel modules'), ('escape hatches'), ('ssh authorized keys')) k(chk)"""


@query("f13_sweep_report", sql(COUNTS_SQL, INV))
def f13(i: Inputs):
    findings, items = Inventory(i).sweep()
    # The count on the report and the rows behind it must be the same thing.
    n = items.groupBy("host", "check").agg(_e("count(1) AS listed"))
    return findings.join(n, ["host", "check"], "left").selectExpr(
        "host", "`check`", "status", "if(n = coalesce(listed, 0L), n, -1L) AS n"
    )


@query(
    "l6_sweep",
    sql(
        "SELECT host, bool_or(status = 'suspect') AS needs_attention, count(*) FILTER (status = 'suspect')"
        " AS suspect, count(*) FILTER (status = 'notice') AS notice, count(*) FILTER (status = 'unknown')"
        " AS unknown FROM findings GROUP BY ALL",
        {**INV, "findings": COUNTS_SQL},
    ),
)
def l6(i: Inputs):
    return inventory.needs_attention(Inventory(i).sweep()[0])


@query(
    "d13_attestation",
    sql(
        """SELECT host, round, pid, round_ts, observed, count(*) FILTER (observed = false) OVER
 (PARTITION BY host ORDER BY round) AS misses FROM (
 SELECT r.host, round, r.pid, round_ts, CASE WHEN next_ts IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM cap c
  WHERE c.host = r.host AND c.type = 1 AND c.pid = r.pid AND c.ts_ns >= round_ts AND c.ts_ns < next_ts) END
  AS observed FROM rounds r)""",
        {
            "rounds": """
SELECT *, lead(round_ts) OVER (PARTITION BY host ORDER BY round) AS next_ts FROM (
 SELECT host, ts_ns // 300000000000 AS round, min(pid) AS pid, (ts_ns // 300000000000) * 300000000000
  + CASE WHEN (ts_ns // 300000000000) % 4 = 0 THEN 150000000000 ELSE 0 END AS round_ts
 FROM cap WHERE type = 1 GROUP BY ALL)"""
        },
    ),
)
def d13(i: Inputs):
    ex = i.cap.filter("type = 1").selectExpr("host", "tgid AS pid", "ts_ns AS ts")
    rounds = ex.groupBy("host", _e("ts DIV 300000000000 AS round")).agg(
        _e("min(pid) AS pid")
    ).selectExpr(
        "host", "round", "pid",
        "round * 300000000000 + if(round % 4 = 0, 150000000000, 0) AS round_ts",
    )
    return fleet.attestation(rounds, ex)


# --- fleet ---------------------------------------------------------------------------------------

LIVE_SQL = (
    "CASE WHEN sensors_verified = false THEN 'blind' WHEN coalesce(last_heartbeat, 0) = 0 THEN 'unknown'"
    f" WHEN {NOW_SQL} - last_heartbeat <= 180 THEN 'live' WHEN {NOW_SQL} - last_heartbeat <= 600"
    " THEN 'stale' ELSE 'silent' END"
)
FLEET = {
    **EXTRA,
    "state": """
SELECT b.host, min(received) AS first_seen, max(received) AS last_heartbeat,
 arg_max(sensors_verified, seq) AS sv0, arg_max(agent_version, seq) AS agent_version,
 arg_max(events, seq) AS events, arg_max(drops, seq) AS drops,
 arg_max(attestation_misses, seq) AS attestation_misses,
 arg_max(sensors_active, seq) FILTER (sensors_total > 0) AS sensors_active,
 arg_max(sensors_total, seq) FILTER (sensors_total > 0) AS sensors_total,
 arg_max(kernel, seq) FILTER (kernel <> '') AS bkernel, arg_max(ip, seq) FILTER (ip <> '') AS bip,
 CASE b.host WHEN 'host-5' THEN false WHEN 'host-6' THEN NULL ELSE true END AS sensors_verified
FROM beats b GROUP BY ALL""",
    "summ": f"""
SELECT host, coalesce(score, 0) AS score, coalesce(n, 0) AS n, {LIVE_SQL} AS status,
 coalesce(drops, 0) AS drops, coalesce(last_heartbeat, 0) AS last_heartbeat,
 coalesce(sensors_active, 0) AS sensors_active, coalesce(sensors_total, 0) AS sensors_total,
 coalesce(bkernel, 'none') AS bkernel FROM
 (SELECT host, max(score) FILTER (NOT resolved) AS score, count(*) FILTER (NOT resolved) AS n
  FROM triaged GROUP BY ALL) t FULL JOIN state USING (host)""",
}
BAND_SQL = (
    "CASE WHEN score = 0 THEN 'OK' WHEN score < 25 THEN 'INFO' WHEN score < 50 THEN 'LOW' WHEN score < 75"
    " THEN 'MEDIUM' WHEN score < 90 THEN 'HIGH' ELSE 'CRITICAL' END"
)


def _state(i: Inputs):
    return fleet.host_state(i.beats, i.triaged)


def _summary(i: Inputs):
    return fleet.summary(i.triaged, _state(i), i.now)


@query(
    "f08_fleet_summary",
    sql(
        f"SELECT host, score, {BAND_SQL} AS band, n, status, drops, last_heartbeat, sensors_active,"
        " sensors_total FROM summ",
        FLEET,
    ),
)
def f08(i: Inputs):
    return _summary(i).select(
        "host", "score", "band", "n", "status", "drops", "last_heartbeat", "sensors_active",
        "sensors_total",
    )


@query(
    "f08b_severity_counts",
    sql("SELECT host, severity, count(*) AS n FROM triaged WHERE NOT resolved GROUP BY ALL", FLEET),
)
def f08b(i: Inputs):
    return _summary(i).selectExpr("host", "explode(counts) AS (severity, n)")


@query(
    "f09_fleet_kpis",
    sql(
        "SELECT count(*) AS hosts, count(*) FILTER (score >= 50 OR status IN ('blind','silent','stale'))"
        " AS need_attention, count(*) FILTER (score = 0 AND status NOT IN ('blind','silent','stale')) AS healthy,"
        " sum(n)::BIGINT AS open_incidents, max(score) AS worst, count(*) FILTER (status = 'blind') AS blind,"
        " count(*) FILTER (status IN ('blind','silent','stale')) AS dark, sum(drops)::BIGINT AS drops FROM summ",
        FLEET,
    ),
)
def f09(i: Inputs):
    return fleet.kpis(_summary(i))


TAUGHT = {
    **STORED,
    "taught": """
SELECT p.host, p.signal, s.exe, count(*) AS count, min(p.ts_ns) AS first_ns, max(p.ts_ns) AS last_ns
FROM pairs p JOIN sub s ON s.id = p.id JOIN triage_log l ON l.host = p.host AND l.id = p.id AND l.expect
WHERE s.exe <> '' GROUP BY ALL""",
}


@query("f10_teach_expected", sql("SELECT * FROM taught", TAUGHT))
def f10(i: Inputs):
    return baseline.teach(i.stored, i.triage_log).select(
        "host", "signal", "exe", "count", "first_ns", "last_ns"
    )


@query(
    "f11_host_baseline",
    sql(
        "SELECT host, sum(count)::BIGINT AS events_observed, max(last_ns) - min(first_ns) AS window_ns,"
        " count(*) AS entries FROM taught GROUP BY ALL",
        TAUGHT,
    ),
)
def f11(i: Inputs):
    b = baseline.export(baseline.teach(i.stored, i.triage_log), 1_700_000_000_000)
    n = b.entries.groupBy("host").agg(_e("count(1) AS entries"))
    return b.header.join(n, "host").select("host", "events_observed", "window_ns", "entries")


@query(
    "f14_sensor_coverage",
    """SELECT host, count(*) FILTER (attached AND NOT (is_lsm AND h % 3 = 0)) AS sensors_active,
 count(*) AS sensors_total, count(*) FILTER (attached AND NOT (is_lsm AND h % 3 = 0)) < count(*) AS partial
FROM (SELECT DISTINCT 'host-' || (user_id % 8) AS host, user_id % 8 AS h, user_id % 11 AS s,
 user_id % 11 > 4 AS is_lsm, (user_id % 11 + user_id % 8) % 9 <> 0 AS attached FROM events) GROUP BY ALL""",
)
def f14(i: Inputs):
    d = i.events.selectExpr(
        "concat('host-', u % 8) AS host", "u % 8 AS h", "concat('s', u % 11) AS sensor",
        "u % 11 > 4 AS is_lsm", "(u % 11 + u % 8) % 9 <> 0 AS attached",
        "CASE WHEN u % 8 % 3 = 0 THEN false WHEN u % 8 % 3 = 1 THEN true END AS lsm_active",
    ).distinct()
    return fleet.sensor_coverage(d)


@query(
    "g03_newest_per_host",
    sql(
        "SELECT host, id FROM (SELECT host, id, row_number() OVER (PARTITION BY host ORDER BY id DESC) AS n"
        " FROM stored) WHERE n <= 20"
    ),
)
def g03(i: Inputs):
    return fleet.newest_per_host(i.stored, 20).select("host", "id")


RECENT_COLS = "id, host, received, severity, score"


@query(
    "h02_recent",
    sql(f"SELECT {RECENT_COLS} FROM stored ORDER BY received * 1000 DESC, id DESC LIMIT 200"),
)
def h02(i: Inputs):
    return fleet.recent(i.stored, 200).select(*RECENT_COLS.split(", "))


@query(
    "h03_fleet_order",
    sql(
        "SELECT host, row_number() OVER (ORDER BY score DESC, status IN ('blind','silent','stale') DESC, host)"
        " AS place FROM summ",
        FLEET,
    ),
)
def h03(i: Inputs):
    place = "ROW_NUMBER() OVER (ORDER BY score DESC, dark DESC, host)"
    # One row per host.
    d = fleet.ranked(_summary(i)).selectExpr("host", "score", f"{fleet.DARK} AS dark")
    return d.selectExpr("host", f"CAST({place} AS BIGINT) AS place")


@query(
    "h04_audit",
    sql(
        "SELECT t.host, t.id, t.severity, t.score, t.resolved_by, t.resolved_at, t.note, s.comm AS subject"
        " FROM triaged t JOIN sub s ON s.id = t.id WHERE t.resolved"
        " ORDER BY t.resolved_at DESC, t.id DESC LIMIT 200",
        STORED,
    ),
)
def h04(i: Inputs):
    return fleet.audit(i.triaged, 200)


@query(
    "h05_host_incidents",
    sql(
        "SELECT id, received, severity, score, resolved, resolved_by, resolved_at, note FROM triaged"
        " WHERE host = 'host-3' ORDER BY id DESC",
        EXTRA,
    ),
)
def h05(i: Inputs):
    return fleet.of_host(i.triaged, "host-3").select(
        "id", "received", "severity", "score", "resolved", "resolved_by", "resolved_at", "note"
    )


@query(
    "i03_triage_merge",
    sql("SELECT host, id, resolved, resolved_by, resolved_at, note FROM triaged", EXTRA),
)
def i03(i: Inputs):
    return fleet.triage(i.stored, i.triage_log)[0].select(
        "host", "id", "resolved", "resolved_by", "resolved_at", "note"
    )


@query(
    "i03b_triage_rejected",
    sql("SELECT host, id, \"by\" FROM triage_log WHERE host = 'host-x'", EXTRA),
)
def i03b(i: Inputs):
    return fleet.triage(i.stored, i.triage_log)[1].select("host", "id", "by")


@query(
    "i04_retention",
    sql(
        f"SELECT host, id FROM stored WHERE received >= {NOW_SQL} - 86400"
        " ORDER BY received DESC, id DESC LIMIT 100"
    ),
)
def i04(i: Inputs):
    return fleet.retain(i.stored, i.now, 1, 100).select("host", "id")


@query(
    "i05_heartbeat_merge",
    sql(
        "SELECT host, first_seen, last_heartbeat, agent_version, events, drops, attestation_misses,"
        " sensors_active, sensors_total, bkernel AS kernel, bip AS ip, sensors_verified FROM state",
        FLEET,
    ),
)
def i05(i: Inputs):
    return fleet.host_state(i.beats).select(
        "host", "first_seen", "last_heartbeat", "agent_version", "events", "drops",
        "attestation_misses", "sensors_active", "sensors_total", "kernel", "ip", "sensors_verified",
    )


@query(
    "k4_liveness",
    sql(f"SELECT host, {LIVE_SQL} AS status FROM state", FLEET),
)
def k4(i: Inputs):
    return fleet.host_state(i.beats).selectExpr("host", f"{fleet.liveness(i.now)} AS status")


@query(
    "l7_fleet_view",
    sql(f"SELECT host, score, {BAND_SQL} AS band, status, n FROM summ", FLEET),
)
def l7(i: Inputs):
    return fleet.ranked(_summary(i)).select("host", "score", "band", "status", "n")


# --- alerts --------------------------------------------------------------------------------------

WALK = {
    # Windows by recursion over the distinct alert seconds of each sink.
    "secs": "SELECT DISTINCT host AS sink, received AS sec FROM stored WHERE rank >= 2",
    "fired": "SELECT id, host AS sink, received AS sec, id AS ord FROM stored WHERE rank >= 2",
}
WALK_SQL = """
WITH RECURSIVE {ctes}, opens(sink, opened) AS (
 SELECT DISTINCT sink, 0::BIGINT FROM secs
 UNION ALL SELECT o.sink, (SELECT min(sec) FROM secs s WHERE s.sink = o.sink AND s.sec >= o.opened + 60)
 FROM opens o WHERE EXISTS (SELECT 1 FROM secs s WHERE s.sink = o.sink AND s.sec >= o.opened + 60)),
placed AS (SELECT f.*, (SELECT max(opened) FROM opens o WHERE o.sink = f.sink AND o.opened <= f.sec) AS opened
 FROM fired f)
SELECT id, sink, opened, row_number() OVER (PARTITION BY sink, opened ORDER BY sec, ord) <= 1 AS delivered
FROM placed"""


def _walk_sql() -> str:
    head = sql("SELECT * FROM secs JOIN fired", WALK)
    return WALK_SQL.format(ctes=head[len("WITH RECURSIVE ") : head.rindex("\nSELECT * FROM secs")])


@query("g05_alert_throttle", _walk_sql())
def g05(i: Inputs):
    a = i.stored.filter("severity IN ('MEDIUM', 'HIGH', 'CRITICAL')").selectExpr(
        "id", "host AS sink", "received AS at", "id AS ord"
    )
    return alerts.throttle(a, 1, 0)[0].select("id", "sink", "opened", "delivered")


LOCKOUT_SQL = """
WITH RECURSIVE a AS (
 SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts, ord) AS rn FROM (
  SELECT '10.0.0.' || (user_id % 16) AS address, event_id // 2 AS ts, event_id AS ord, event_id % 37 = 0 AS ok
  FROM events)),
w(address, rn, ts, ord, ok, fails, opened, until, locked_for, locks) AS (
 SELECT DISTINCT address, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false
 FROM a
 UNION ALL
 SELECT address, rn, ts, ord, ok,
  CASE WHEN until > ts THEN fails WHEN ok THEN 0 WHEN anew THEN 1 ELSE fails + 1 END,
  CASE WHEN until <= ts AND NOT ok AND anew THEN ts ELSE opened END,
  CASE WHEN until > ts THEN until WHEN ok THEN 0 WHEN anew THEN 0 WHEN fails + 1 >= 5 THEN ts + 900 ELSE until END,
  CASE WHEN until > ts THEN until - ts ELSE 0 END,
  until <= ts AND NOT ok AND NOT anew AND fails + 1 >= 5
 FROM (SELECT a.address, a.rn, a.ts, a.ord, a.ok, w.fails, w.opened, w.until,
   (w.fails = 0 OR a.ts - w.opened > 300) AS anew
  FROM w JOIN a ON a.address = w.address AND a.rn = w.rn + 1))
SELECT address, ts, ord, ok, locked_for, locks FROM w WHERE rn > 0"""


@query("g06_failure_lockout", LOCKOUT_SQL)
def g06(i: Inputs):
    d = i.events.selectExpr(
        "concat('10.0.0.', u % 16) AS address", "e DIV 2 AS ts", "e AS ord", "e % 37 = 0 AS ok"
    )
    return alerts.lockout(d)
