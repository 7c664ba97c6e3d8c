"""Sources, row expressions and raw-sensor filters (A, B, C)."""

from __future__ import annotations

from procscope.catalog.base import EXTRA, Inputs, query
from procscope.catalog.oracle_base import sql
from procscope.functions import events as X
from procscope.functions import text as T
from procscope.operators import baseline as B
from procscope.operators import filters as C
from procscope.operators import graph, records
from procscope.session import scratch_path
from procscope.sources import capture as src

CORE = "host, seq, ts_ns, type, pid, start, comm, filename, uid, euid, container"
CORE_SPARK = [
    "host", "seq", "ts_ns", "CAST(type AS BIGINT) AS type", "tgid AS pid",
    "start_boottime AS start", "comm", "filename", "uid", "euid", "container",
]


@query("a0_capture", sql(f"SELECT {CORE} FROM cap"))
def a0(i: Inputs):
    return i.cap.selectExpr(*CORE_SPARK)


def _with_noise(i: Inputs):
    """Capture lines with a blank and a broken line after every tenth and thirteenth event."""
    lines = src.to_lines(i.cap)
    return lines.selectExpr(
        "host", "seq",
        "explode(array_compact(array(value, if(seq % 10 = 0, '  ', NULL),"
        " if(seq % 13 = 0, '{\"ts_ns\": oops', NULL),"
        " if(seq % 17 = 0, '{\"ts_ns\":1}', NULL)))) AS value",
    )


@query(
    "a1_capture_scan",
    sql(
        "SELECT host, count(*) AS events, sum(ts_ns // 1000000000)::BIGINT AS secs,"
        " (count(*) FILTER (seq % 13 = 0) + count(*) FILTER (seq % 17 = 0)) AS bad"
        " FROM cap GROUP BY host"
    ),
)
def a1(i: Inputs):
    path = scratch_path(i.spark, "capture-files")
    lines = _with_noise(i)
    lines.repartitionByRange("host", "seq").sortWithinPartitions("host", "seq").select(
        "host", "value"
    ).write.partitionBy("host").text(path)
    good, bad = src.read_captures(i.spark, path)
    g = good.selectExpr("host", "ts_ns DIV 1000000000 AS s").groupBy("host").agg(
        _e("count(1) AS events"), _e("CAST(sum(s) AS BIGINT) AS secs")
    )
    b = bad.groupBy("host").agg(_e("count(1) AS bad"))
    return g.join(b, "host", "left").selectExpr("host", "events", "secs", "coalesce(bad, 0L) AS bad")


def _e(text: str):
    from pyspark.sql import functions as F

    return F.expr(text)


@query(
    "a2_default_filling",
    sql(
        "SELECT host, seq, uid, euid, comm, filename, container, old_euid, cap_effective, file_mode,"
        " aux, target_pid, mnt_ns, socket_stdio FROM cap"
    ),
)
def a2(i: Inputs):
    good, _ = src.parse_lines(src.to_lines(i.cap))
    return good.select(
        "host", "seq", "uid", "euid", "comm", "filename", "container", "old_euid",
        "cap_effective", "file_mode", "aux", "target_pid", "mnt_ns", "socket_stdio",
    )


def _wire(i: Inputs):
    return i.events.selectExpr(
        "concat('host-', u % 8) AS host", "e AS seq", "CAST(e % 64 AS INT) AS flags",
        "concat('/bin/tool', u, '\\u0000\\u0000-n\\u0000', e) AS argv_raw",
        "CASE e % 6 WHEN 0 THEN concat('/system.slice/docker-', lpad(hex(e), 64, '0'), '.scope')"
        " WHEN 1 THEN concat('/kubepods/cri-containerd-', lpad(lower(hex(e)), 20, 'a'))"
        " WHEN 2 THEN concat('/machine.slice/libpod-', lpad(hex(u), 12, '0'), '.scope/x')"
        " WHEN 3 THEN concat('/kubepods/pod', u, '/', lpad(lower(hex(e)), 64, 'f'))"
        " WHEN 4 THEN concat('/user.slice/crio-', u) ELSE 'init.scope' END AS cgroup_name",
    )


@query(
    "a3_wire_flags",
    "SELECT 'host-' || (user_id % 8) AS host, event_id AS seq, (event_id & 1) <> 0 AS truncated,"
    " (event_id & 2) <> 0 AS degraded_path, (event_id & 4) <> 0 AS denied,"
    " (event_id & 8) <> 0 AS would_deny, (event_id & 16) <> 0 AS escape_target,"
    " (event_id & 32) <> 0 AS socket_stdio FROM events",
)
def a3(i: Inputs):
    return src.decode_wire(_wire(i)).select(
        "host", "seq", "truncated", "degraded_path", "denied", "would_deny", "escape_target",
        "socket_stdio",
    )


@query(
    "a4_argv_split",
    "SELECT event_id AS seq, 3::BIGINT AS n, '/bin/tool' || user_id || '|-n|' || event_id AS argv"
    " FROM events",
)
def a4(i: Inputs):
    return _wire(i).selectExpr("seq", f"{T.argv_of()} AS a").selectExpr(
        "seq", "CAST(size(a) AS BIGINT) AS n", "array_join(a, '|') AS argv"
    )


def snapshot(i: Inputs):
    """Processes alive before the capture: each session root, with a tick-truncated start."""
    return i.events.selectExpr("u").distinct().selectExpr(
        "concat('host-', u % 8) AS host", "500000 + u AS pid",
        "if(u % 2 = 0, 0L, 30000000L) AS start", "if(u % 3 = 0, 1L, 500000 + u - 3 * 8) AS ppid",
        "concat('root', u % 5) AS comm", "concat('/sbin/root', u % 5) AS exe",
        "CAST(array() AS ARRAY<STRING>) AS argv", "u % 4 AS uid", "u % 3 AS euid",
        "'' AS trusted",
    )


SNAPSHOT_SQL = """
SELECT DISTINCT 'host-' || (user_id % 8) AS host, 500000 + user_id AS pid, user_id AS u,
 CASE WHEN user_id % 2 = 0 THEN 0 ELSE 30000000 END AS start,
 CASE WHEN user_id % 3 = 0 THEN 1 ELSE 500000 + user_id - 24 END AS ppid,
 'root' || (user_id % 5) AS comm FROM events"""
SNAP = {"snap": SNAPSHOT_SQL}


@query(
    "a5_snapshot_source",
    sql(
        "SELECT s.host, s.pid, s.start, s.comm, s.u % 4 AS uid, s.u % 3 AS euid FROM snap s", SNAP
    ),
)
def a5(i: Inputs):
    rows, _ = graph.snapshot_as_state(snapshot(i), i.cap)
    names = graph.reconcile(snapshot(i), i.cap).selectExpr(
        "host", "pid", "exact_start", "start AS scanned"
    )
    return rows.join(
        names.withColumnRenamed("exact_start", "start"), ["host", "pid", "start"]
    ).selectExpr("host", "pid", "scanned AS start", "comm", "uid", "euid")


@query(
    "a6_capture_sink",
    sql(
        "SELECT host, seq, type, CASE WHEN filename = '' THEN NULL ELSE filename END AS filename,"
        " CASE WHEN file_mode = 0 THEN NULL ELSE file_mode END AS file_mode,"
        " CASE WHEN container = '' THEN NULL ELSE container END AS container FROM cap"
    ),
)
def a6(i: Inputs):
    return src.to_lines(i.cap).selectExpr(
        "host", "seq", "CAST(get_json_object(value, '$.type') AS BIGINT) AS type",
        "get_json_object(value, '$.filename') AS filename",
        "CAST(get_json_object(value, '$.file_mode') AS BIGINT) AS file_mode",
        "get_json_object(value, '$.container') AS container",
    )


@query(
    "a7_incident_sink",
    sql(
        """SELECT i.host, i.seq, i.severity, i.total AS score, i.base, i.chain AS chain_bonus,
 round(i.mult, 4) AS context_mult,
 CASE WHEN rooted AND boxed THEN 'lineage rooted at a network daemon; inside a container'
      WHEN rooted THEN 'lineage rooted at a network daemon' WHEN boxed THEN 'inside a container' END
   AS context_note,
 (SELECT string_agg(acomm || '(' || apid || ')', ' > ' ORDER BY depth DESC) FROM path p
  WHERE p.host = i.host AND p.seq = i.seq AND p.known) AS lineage,
 (SELECT string_agg(f.id || ':' || f.score || ':' || f.detail, ' | ' ORDER BY f.ts_ns, f.depth,
    (SELECT min(s.seq * 1024 + s.ord) FROM sig s WHERE s.host = f.host AND s.pid = f.apid
      AND s.start = f.astart AND s.id = f.id))
  FROM filed f WHERE f.host = i.host AND f.seq = i.seq) AS signals
FROM inc i"""
    ),
)
def a7(i: Inputs):
    path = scratch_path(i.spark, "incident-file")
    src.write_incidents(i.records.selectExpr(f"{records.slim()} AS value"), path)
    # Read the file back as a consumer would.
    lines = i.spark.read.text(path)
    from procscope import schema as S

    d = lines.selectExpr(f"from_json(value, {X.quote(S.INCIDENT_RECORD.simpleString())}) AS r")
    key = i.records.selectExpr(
        "host", "seq", "record.subject.pid AS pid", "record.subject.start_boottime AS start",
        "record.ts_ns AS ts_ns", "score AS sc", "to_json(record.signals.id) AS ids",
    )
    d = d.selectExpr(
        "r.subject.pid AS pid", "r.subject.start_boottime AS start", "r.ts_ns AS ts_ns",
        "r.score AS sc", "to_json(r.signals.id) AS ids", "r",
    )
    return d.join(key, ["pid", "start", "ts_ns", "sc", "ids"]).selectExpr(
        "host", "seq", "r.severity AS severity", "r.score AS score",
        "r.score_breakdown.base AS base", "r.score_breakdown.chain_bonus AS chain_bonus",
        "round(r.score_breakdown.context_mult, 4) AS context_mult",
        "r.score_breakdown.context_note AS context_note",
        "array_join(r.lineage, ' > ') AS lineage",
        "array_join(transform(r.signals, s -> concat(s.id, ':', s.score, ':', s.detail)), ' | ')"
        " AS signals",
    )


@query(
    "a8_feed_demux",
    sql(
        "SELECT 'incident' AS kind, host, count(*) AS n, sum(score)::BIGINT AS v FROM stored"
        " GROUP BY host UNION ALL SELECT 'heartbeat', host, count(*), sum(events)::BIGINT"
        " FROM beats GROUP BY host",
        EXTRA,
    ),
)
def a8(i: Inputs):
    beats = i.beats.selectExpr(
        "host", "to_json(struct(schema, ts, uptime_secs, agent_version, events, drops,"
        " decode_panics, sensors_verified, attestation_misses, sensors_active, sensors_total))"
        " AS value",
    )
    feed = i.stored.selectExpr("host", f"{records.slim()} AS value").unionByName(beats)
    junk = i.stored.selectExpr("host", "'{broken' AS value")
    inc, hb = src.demux(feed.unionByName(junk))
    a = inc.groupBy("host").agg(_e("count(1) AS n"), _e("sum(record.score) AS v"))
    b = hb.groupBy("host").agg(_e("count(1) AS n"), _e("sum(events) AS v"))
    return a.selectExpr("'incident' AS kind", "host", "n", "v").unionByName(
        b.selectExpr("'heartbeat' AS kind", "host", "n", "v")
    )


EXE_AT = """
SELECT s.id AS signal, x.exe, s.ts_ns, s.host FROM sig s
ASOF JOIN execs x ON x.host = s.host AND x.pid = s.pid AND x.start = s.start AND s.seq >= x.seq
WHERE x.exe <> ''"""
LEARNED = {"exe_at": EXE_AT}


@query(
    "a9_baseline_file",
    sql(
        "SELECT signal, exe, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,"
        " (SELECT max(ts_ns) - min(ts_ns) FROM cap) AS window_ns,"
        " (SELECT count(*) FROM cap) AS events_observed FROM exe_at GROUP BY ALL",
        LEARNED,
    ),
)
def a9(i: Inputs):
    b = B.learn(i.cap, i.signals, i.states, 1_700_000_000_000)
    path = scratch_path(i.spark, "baseline")
    B.save(b, path)
    back = B.load(i.spark, path, None)
    return back.entries.crossJoin(back.header).select(
        "signal", "exe", "count", "first_ns", "last_ns", "window_ns", "events_observed"
    )


# --- B ------------------------------------------------------------------------------------------

NAMES_SQL = (
    "CASE type WHEN 1 THEN 'exec' WHEN 2 THEN 'exit' WHEN 3 THEN 'fork' WHEN 4 THEN 'cred_change'"
    " WHEN 5 THEN 'file_open' WHEN 6 THEN 'file_mode' WHEN 7 THEN 'setcap' WHEN 8 THEN 'ptrace'"
    " WHEN 9 THEN 'exec_anon' WHEN 10 THEN 'module' WHEN 11 THEN 'sock_connect'"
    " WHEN 12 THEN 'sock_listen' END"
)


@query("b01_event_names", sql(f"SELECT {NAMES_SQL} AS event, count(*) AS n FROM cap GROUP BY 1"))
def b01(i: Inputs):
    return i.cap.groupBy(_e(f"{X.event_name()} AS event")).agg(_e("count(1) AS n"))


@query(
    "b02_gained_bits",
    "SELECT event_id AS seq, CASE WHEN (event_id & 2048) <> 0 AND (user_id & 4) = 0 AND"
    " (event_id & 1024) <> 0 AND (user_id & 2) = 0 THEN 'SUID+SGID'"
    " WHEN (event_id & 2048) <> 0 AND (user_id & 4) = 0 THEN 'SUID'"
    " WHEN (event_id & 1024) <> 0 AND (user_id & 2) = 0 THEN 'SGID' ELSE 'none' END AS gained"
    " FROM events",
)
def b02(i: Inputs):
    # New bits come from the event number, old ones from the user number.
    return i.events.selectExpr(
        "e AS seq", f"{X.gained_bits('(e & 3072)', '((u & 4) * 512 | (u & 2) * 512)')} AS gained"
    )


@query(
    "b03_decoded_fields",
    sql(
        "SELECT host, seq, type = 5 AND (file_mode & 2) <> 0 AS write,"
        " type = 8 AND (aux & 2) <> 0 AS attach,"
        " CASE WHEN type = 9 THEN ['memfd','anon-inode','deleted-file'][aux] ELSE '' END AS source,"
        " CASE WHEN type = 10 THEN 'finit_module' ELSE '' END AS origin FROM cap"
    ),
)
def b03(i: Inputs):
    return i.cap.selectExpr(
        "host", "seq", f"type = 5 AND {X.opened_for_write()} AS write",
        f"type = 8 AND {X.is_attach()} AS attach",
        f"CASE WHEN type = 9 THEN {X.exec_source()} ELSE '' END AS source",
        f"CASE WHEN type = 10 THEN {X.module_origin()} ELSE '' END AS origin",
    )


_CAPS = (
    "list_filter([CASE WHEN (m & 1) <> 0 THEN 'CAP_CHOWN' END, CASE WHEN (m & 2) <> 0 THEN"
    " 'CAP_DAC_OVERRIDE' END, CASE WHEN (m & 4) <> 0 THEN 'CAP_DAC_READ_SEARCH' END,"
    " CASE WHEN (m & 64) <> 0 THEN 'CAP_SETGID' END, CASE WHEN (m & 128) <> 0 THEN 'CAP_SETUID' END,"
    " CASE WHEN (m & 256) <> 0 THEN 'CAP_SETPCAP' END, CASE WHEN (m & 4096) <> 0 THEN"
    " 'CAP_NET_ADMIN' END, CASE WHEN (m & 65536) <> 0 THEN 'CAP_SYS_MODULE' END,"
    " CASE WHEN (m & 524288) <> 0 THEN 'CAP_SYS_PTRACE' END, CASE WHEN (m & 2097152) <> 0 THEN"
    " 'CAP_SYS_ADMIN' END, CASE WHEN (m & 274877906944) <> 0 THEN 'CAP_PERFMON' END,"
    " CASE WHEN (m & 549755813888) <> 0 THEN 'CAP_BPF' END], lambda x: x IS NOT NULL)"
)


@query(
    "b04_capability_names",
    f"WITH m AS (SELECT event_id AS seq, (event_id * 7919 * 31 + user_id) % 1099511627776 AS m"
    f" FROM events), n AS (SELECT *, {_CAPS} AS c FROM m)"
    " SELECT seq, array_to_string(c, ',') AS names, CASE WHEN len(c) = 0 THEN bit_count(m) ||"
    " ' unnamed' WHEN bit_count(m) = len(c) THEN array_to_string(c, ',')"
    " ELSE array_to_string(c, ',') || ',+' || (bit_count(m) - len(c)) END AS text FROM n",
)
def b04(i: Inputs):
    d = i.events.selectExpr("e AS seq", "(e * 7919 * 31 + u) % 1099511627776 AS m")
    return d.selectExpr("seq", f"array_join({X.cap_names('m')}, ',') AS names", f"{X.cap_text('m')} AS text")


@query(
    "b05_dangerous_caps",
    "SELECT event_id AS seq, (event_id * 65537 * 8 & ~(user_id * 65536) & 549758500868) AS gained"
    " FROM events",
)
def b05(i: Inputs):
    return i.events.selectExpr(
        "e AS seq", f"{X.dangerous_caps_gained('(e * 65537 * 8)', '(u * 65536)')} AS gained"
    )


@query(
    "b06_container_label",
    """SELECT event_id AS seq, CASE event_id % 6
 WHEN 0 THEN 'docker:' || left(lpad(printf('%X', event_id), 64, '0'), 12)
 WHEN 1 THEN 'containerd:' || left(lpad(printf('%x', event_id), 20, 'a'), 12)
 WHEN 2 THEN 'podman:' || lpad(printf('%X', user_id), 12, '0')
 WHEN 3 THEN 'container:' || left(lpad(printf('%x', event_id), 64, 'f'), 12)
 ELSE '' END AS container FROM events""",
)
def b06(i: Inputs):
    return src.decode_wire(_wire(i)).select("seq", "container")


@query(
    "b07_namespace_inode",
    "SELECT event_id AS seq, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 4026531840 + user_id END AS inode"
    " FROM events",
)
def b07(i: Inputs):
    link = (
        "CASE WHEN e % 4 = 3 THEN concat('mnt:', u) ELSE concat('mnt:[', 4026531840 + u, ']') END"
    )
    return i.events.selectExpr("e AS seq", f"{T.ns_inode(link)} AS inode")


@query(
    "b08_argv_redaction",
    """SELECT event_id AS seq, CASE event_id % 8
 WHEN 0 THEN 'curl|--token=<redacted>|x' WHEN 1 THEN 'app|--password|<redacted>|-v'
 WHEN 2 THEN '/usr/bin/mysql|-p<redacted>|db' WHEN 3 THEN 'psql|-p|' || user_id
 WHEN 4 THEN 'curl|-H|Authorization:<redacted>' WHEN 5 THEN 'openssl|-passin|pass:<redacted>'
 WHEN 6 THEN 'git|https://u:<redacted>@h/' || event_id ELSE 'mysql|-p|-u|root' END AS argv
FROM events""",
)
def b08(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq",
        "CASE e % 8 WHEN 0 THEN array('curl', concat('--token=', e), 'x')"
        " WHEN 1 THEN array('app', '--password', CAST(e AS STRING), '-v')"
        " WHEN 2 THEN array('/usr/bin/mysql', concat('-p', e), 'db')"
        " WHEN 3 THEN array('psql', '-p', CAST(u AS STRING))"
        " WHEN 4 THEN array('curl', '-H', concat('Authorization: Bearer ', e))"
        " WHEN 5 THEN array('openssl', '-passin', concat('pass:', e))"
        " WHEN 6 THEN array('git', concat('https://u:', u, '@h/', e))"
        " ELSE array('mysql', '-p', '-u', 'root') END AS argv",
    )
    return d.selectExpr("seq", f"array_join({T.redact_argv()}, '|') AS argv")


@query(
    "b09_program_kinds",
    sql(
        "SELECT host, seq, split_part(filename, '/', -1) AS base,"
        " split_part(filename, '/', -1) IN ('sh','bash') AS shell,"
        " split_part(filename, '/', -1) IN ('python3.11','php8.2','node') AS interpreter"
        " FROM cap WHERE type = 1"
    ),
)
def b09(i: Inputs):
    return i.cap.filter("type = 1").selectExpr(
        "host", "seq", f"{X.basename('filename')} AS base", f"{X.is_shell()} AS shell",
        f"{X.is_interpreter()} AS interpreter",
    )


@query(
    "b10_watch_label",
    sql(
        """SELECT filename, count(*) AS n, CASE WHEN filename = '/etc/ld.so.preload' THEN
 'ld.so.preload (linker hijack)' WHEN filename LIKE '%/.ssh/authorized_keys%' THEN 'authorized_keys'
 WHEN filename LIKE '%/root/.ssh/%' THEN 'root SSH keys' WHEN filename LIKE '%/etc/cron%' THEN 'cron'
 WHEN filename LIKE '%/etc/sudoers%' THEN 'sudoers' WHEN filename LIKE '%/etc/shadow%' THEN 'shadow'
 WHEN filename LIKE '%/etc/passwd%' THEN 'passwd' WHEN filename LIKE '%/etc/pam.%' THEN
 'PAM (authentication)' WHEN filename LIKE '%/etc/profile%' THEN 'login shell script'
 ELSE 'watched path' END AS label FROM cap WHERE type = 5 GROUP BY ALL"""
    ),
)
def b10(i: Inputs):
    return i.cap.filter("type = 5").groupBy("filename").agg(_e("count(1) AS n")).selectExpr(
        "filename", "n", f"{X.watch_label()} AS label"
    )


@query(
    "b11_path_predicates",
    sql(
        "SELECT filename, count(*) AS n, filename = '/proc/sys/kernel/core_pattern' AS hatch,"
        " filename LIKE '/etc/profile%' AS login, filename LIKE '/tmp/%' AS volatile"
        " FROM cap WHERE filename <> '' GROUP BY ALL"
    ),
)
def b11(i: Inputs):
    return i.cap.filter("filename <> ''").groupBy("filename").agg(_e("count(1) AS n")).selectExpr(
        "filename", "n", f"{X.is_kernel_hatch()} AS hatch", f"{X.runs_at_login()} AS login",
        f"{X.in_volatile_dir()} AS volatile",
    )


@query(
    "b12_roles",
    sql(
        "SELECT comm, exe_trusted, count(*) AS n, exe_trusted IN ('sudo','sshd') AS reader,"
        " exe_trusted IN ('nginx','node') AS daemon,"
        " comm IN ('nginx','node') AS named FROM cap WHERE type = 1 GROUP BY ALL"
    ),
)
def b12(i: Inputs):
    return i.cap.filter("type = 1").groupBy("comm", "exe_trusted").agg(_e("count(1) AS n")).selectExpr(
        "comm", "exe_trusted", "n", f"{X.is_credential_reader('exe_trusted')} AS reader",
        f"{X.is_network_daemon('exe_trusted')} AS daemon", f"{X.looks_like_daemon()} AS named",
    )


TECHNIQUE_SQL = (
    "CASE t WHEN 'T1003' THEN 'OS Credential Dumping' WHEN 'T1003.008' THEN"
    " '/etc/passwd and /etc/shadow' WHEN 'T1036' THEN 'Masquerading' WHEN 'T1055.008' THEN"
    " 'Ptrace System Calls' WHEN 'T1068' THEN 'Exploitation for Privilege Escalation'"
    " WHEN 'T1098' THEN 'Account Manipulation' WHEN 'T1543' THEN 'Create or Modify System Process'"
    " WHEN 'T1547.006' THEN 'Kernel Modules and Extensions' WHEN 'T1548' THEN"
    " 'Abuse Elevation Control Mechanism' WHEN 'T1548.001' THEN 'Setuid and Setgid'"
    " WHEN 'T1552' THEN 'Unsecured Credentials' WHEN 'T1611' THEN 'Escape to Host'"
    " WHEN 'T1620' THEN 'Reflective Code Loading' ELSE 'Unknown Technique' END"
)
ATTACK_SQL = (
    "CASE id WHEN 'suid_create' THEN ['T1548.001'] WHEN 'fileless_exec' THEN ['T1620']"
    " WHEN 'privilege_escalation' THEN ['T1068'] WHEN 'setcap' THEN ['T1548']"
    " WHEN 'ptrace_attach' THEN ['T1055.008'] WHEN 'cross_uid_proc_read' THEN ['T1003','T1552']"
    " WHEN 'ssh_private_key_read' THEN ['T1003.008','T1552.004']"
    " WHEN 'credential_store_read' THEN ['T1003.008','T1552.004']"
    " WHEN 'kernel_escape_hatch_write' THEN ['T1611','T1543']"
    " WHEN 'module_autoload' THEN ['T1547.006'] WHEN 'module_load' THEN ['T1547.006']"
    " WHEN 'namespace_escape' THEN ['T1611'] WHEN 'exec_from_tmp' THEN ['T1036']"
    " WHEN 'shell_from_network_daemon' THEN ['T1059.004']"
    " WHEN 'interpreter_from_network_daemon' THEN ['T1059']"
    " WHEN 'socket_backed_shell' THEN ['T1059.004','T1571'] WHEN 'unexpected_listener' THEN ['T1571']"
    " WHEN 'runtime_socket_access' THEN ['T1611'] ELSE ['T1543','T1098'] END"
)


@query(
    "b13_technique_names",
    sql(
        f"SELECT t, {TECHNIQUE_SQL} AS name, count(*) AS n"
        f" FROM (SELECT unnest({ATTACK_SQL}) AS t FROM sig) GROUP BY ALL"
    ),
)
def b13(i: Inputs):
    return i.signals.selectExpr("explode(attack) AS t").groupBy("t").agg(_e("count(1) AS n")).selectExpr(
        "t", f"{X.technique_name('t')} AS name", "n"
    )


@query(
    "b14_severity",
    "SELECT event_id AS seq, CASE WHEN v < 25 THEN 'INFO' WHEN v < 50 THEN 'LOW' WHEN v < 75 THEN"
    " 'MEDIUM' WHEN v < 90 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, CASE WHEN v = 0 THEN 'OK'"
    " WHEN v < 25 THEN 'INFO' WHEN v < 50 THEN 'LOW' WHEN v < 75 THEN 'MEDIUM' WHEN v < 90 THEN"
    " 'HIGH' ELSE 'CRITICAL' END AS band, (CASE WHEN v < 25 THEN 0 WHEN v < 50 THEN 1 WHEN v < 75"
    " THEN 2 WHEN v < 90 THEN 3 ELSE 4 END)::BIGINT AS rank"
    " FROM (SELECT event_id, event_id % 101 AS v FROM events)",
)
def b14(i: Inputs):
    d = i.events.selectExpr("e AS seq", "e % 101 AS v")
    return d.selectExpr(
        "seq", f"{X.severity_of_score('v')} AS severity", f"{X.host_band('v')} AS band",
        f"CAST({X.severity_rank(X.severity_of_score('v'))} AS BIGINT) AS rank",
    )


@query(
    "b15_cmdline",
    "SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE"
    " text[1:(SELECT max(n) FROM range(50, 201) r(n) WHERE strlen(d.text[1:n]) <= 200)] || '...' END"
    " AS cmdline FROM documents d",
)
def b15(i: Inputs):
    return i.table("documents").selectExpr("doc_id", f"{T.cmdline('array(text)')} AS cmdline")


@query(
    "b16_clock",
    sql(
        "SELECT host, seq, strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S.') ||"
        " lpad((ts_ns // 1000000 % 1000)::VARCHAR, 3, '0') AS clock,"
        " 1700000000000 + ts_ns // 1000000 AS wall_ms FROM cap"
    ),
)
def b16(i: Inputs):
    return i.cap.selectExpr(
        "host", "seq", f"{X.clock_text('ts_ns')} AS clock",
        f"{X.wall_ms('ts_ns', '1700000000000L')} AS wall_ms",
    )


DETAIL_SQL = """CASE type
 WHEN 1 THEN 'exec ' || filename || ' ' || arg1
 WHEN 2 THEN 'exit code=0' WHEN 3 THEN 'fork -> pid ' || child_pid
 WHEN 4 THEN 'cred uid 0:' || old_euid || ' -> ' || uid || ':' || euid || ' +caps CAP_SYS_ADMIN'
 WHEN 5 THEN (CASE WHEN (file_mode & 2) <> 0 THEN 'open[write] ' ELSE 'open[read] ' END) || filename
   || '  <' || (CASE WHEN filename = '/etc/ld.so.preload' THEN 'ld.so.preload (linker hijack)'
   WHEN filename LIKE '%/.ssh/authorized_keys' THEN 'authorized_keys'
   WHEN filename LIKE '/root/.ssh/%' THEN 'root SSH keys' WHEN filename LIKE '/etc/cron%' THEN 'cron'
   WHEN filename LIKE '/etc/sudoers%' THEN 'sudoers' WHEN filename = '/etc/shadow' THEN 'shadow'
   WHEN filename = '/etc/passwd' THEN 'passwd' WHEN filename LIKE '/etc/pam.%' THEN
   'PAM (authentication)' WHEN filename LIKE '/etc/profile%' THEN 'login shell script'
   ELSE 'watched path' END) || '>'
 WHEN 6 THEN 'SUID-CREATE /tmp/.x gained SUID (0755 -> 04755)'
 WHEN 7 THEN 'SETCAP file capabilities set on ping'
 WHEN 8 THEN (CASE WHEN (aux & 2) <> 0 THEN 'PTRACE[ATTACH] -> pid ' ELSE 'PTRACE[read] -> pid ' END)
   || target_pid || ' ()'
 WHEN 9 THEN 'FILELESS-EXEC from ' || ['memfd','anon-inode','deleted-file'][aux] || ' memfd:p'
 WHEN 10 THEN 'MODULE-LOAD dummy (via finit_module)' WHEN 11 THEN 'SOCKET-CONNECT docker.sock'
 WHEN 12 THEN 'LISTEN port ' || aux END"""


@query("b17_event_detail", sql(f"SELECT host, seq, {DETAIL_SQL} AS detail FROM cap"))
def b17(i: Inputs):
    return i.cap.selectExpr("host", "seq", f"{X.event_detail()} AS detail")


@query(
    "b18_durations",
    "SELECT event_id AS seq, CASE WHEN v < 60 THEN v || 's ago' WHEN v < 3600 THEN v // 60 || 'm ago'"
    " WHEN v < 86400 THEN v // 3600 || 'h ago' ELSE v // 86400 || 'd ago' END AS ago,"
    " CASE WHEN v >= 86400 THEN printf('%.1fd', v / 86400) WHEN v >= 3600 THEN"
    " printf('%.1fh', v / 3600) WHEN v >= 60 THEN printf('%.0fm', v / 60) ELSE v || 's' END AS human,"
    " CASE WHEN v < 60 THEN '+' || printf('%.2fs', v + 0.25) ELSE '+' || ((v + 30) // 60) || 'm' END"
    " AS offset_text FROM (SELECT event_id, 1 + event_id * 17 % 100000 AS v FROM events)",
)
def b18(i: Inputs):
    d = i.events.selectExpr("e AS seq", "1 + e * 17 % 100000 AS v")
    return d.selectExpr(
        "seq", f"{T.ago('v')} AS ago", f"{B.human_duration('v')} AS human",
        f"{T.offset('(v * 1000000000 + if(v < 60, 250000000, 0))')} AS offset_text",
    )


@query(
    "b19_device_encoding",
    "SELECT event_id AS seq, ((user_id % 4096) << 20) | (event_id & 1048575) AS dev FROM events",
)
def b19(i: Inputs):
    return i.events.selectExpr("e AS seq", f"{T.kernel_dev('u % 4096', 'e')} AS dev")


@query(
    "b21_key_lines",
    """SELECT event_id AS seq, event_id % 5 IN (0, 1, 3) AS parsed,
 CASE WHEN event_id % 5 = 1 THEN 'command="/bin/c' || user_id || '",no-pty' ELSE '' END AS options,
 CASE event_id % 5 WHEN 0 THEN 'ssh-rsa' WHEN 1 THEN 'ssh-ed25519' WHEN 3 THEN 'ecdsa-sha2-nistp256'
   ELSE '' END AS type,
 CASE event_id % 5 WHEN 0 THEN 'u' || user_id || '@h' ELSE '' END AS comment FROM events""",
)
def b21(i: Inputs):
    line = (
        "CASE e % 5 WHEN 0 THEN concat('ssh-rsa AAAA', e, ' u', u, '@h')"
        " WHEN 1 THEN concat('command=\"/bin/c', u, '\",no-pty ssh-ed25519  BBBB', e)"
        " WHEN 2 THEN concat('', e) WHEN 3 THEN concat('ecdsa-sha2-nistp256 CC', e)"
        " ELSE 'ssh-rsa' END"
    )
    return i.events.selectExpr("e AS seq", f"{line} AS l").selectExpr(
        "seq", f"{T.key_line('l')} AS k"
    ).selectExpr("seq", "k.parsed AS parsed", "k.options AS options", "k.type AS type", "k.comment AS comment")


# --- C ------------------------------------------------------------------------------------------

RAW_OPEN_SQL = """
SELECT 'host-' || (user_id % 8) AS host, event_id AS seq,
 ['/etc/shadow','/etc/shadow-','/root/.ssh/id_rsa','/root/.ssh/known','/home/u' || (user_id % 9) ||
  '/.ssh/id_ed','/home/u' || (user_id % 9) || '/.ssh/authorized_keys','/etc/ssh/ssh_host_rsa',
  '/mnt/p/core_pattern','/proc/sys/kernel/core_pattern','/etc/cron.d/j','/var/log/x',
  '/etc/ld.so.conf'][event_id % 12 + 1] AS path,
 (event_id // 12 % 2) + 1 AS f_mode, event_id % 12 AS dev, event_id % 12 + 100 AS ino,
 CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 < 3 THEN 4026531841 ELSE 4026532000 + user_id END
   AS mnt_ns FROM events"""
WATCH_SQL = (
    "(VALUES ('/etc/ld.so.preload',1),('/etc/cron',1),('/etc/systemd/',1),('/usr/lib/systemd/',1),"
    "('/lib/systemd/',1),('/etc/sudoers',1),('/etc/shadow',3),('/etc/gshadow',3),('/etc/passwd',1),"
    "('/root/.ssh/',1),('/etc/pam.',1),('/etc/ld.so.conf',1),('/etc/profile',1),"
    "('/etc/bash.bashrc',1),('/etc/environment',1),('/etc/update-motd.d/',1),"
    "('/etc/ssh/ssh_host_',2),('/root/.ssh/id_',2),('/proc/sys/kernel/core_pattern',5),"
    "('/proc/sys/kernel/modprobe',5),('/proc/sys/kernel/poweroff_cmd',5),"
    "('/sys/kernel/uevent_helper',5),('/proc/sys/fs/binfmt_misc/register',5)) w(prefix, flags)"
)
OPENS = {
    "raw_open": RAW_OPEN_SQL,
    "watch_all": "SELECT h.host, prefix, flags FROM (SELECT DISTINCT host FROM raw_open) h, "
    + WATCH_SQL
    + " UNION ALL SELECT host, '/home/u' || n || '/.ssh/', 1 FROM (SELECT DISTINCT host FROM raw_open),"
    " range(9) t(n) UNION ALL SELECT host, '/home/u' || n || '/.ssh/id_', 3"
    " FROM (SELECT DISTINCT host FROM raw_open), range(9) t(n)",
    "flagged": "SELECT o.*, (SELECT w.flags FROM watch_all w WHERE w.host = o.host"
    " AND starts_with(o.path, w.prefix) ORDER BY length(w.prefix) DESC LIMIT 1) AS pf,"
    " CASE WHEN o.ino = 110 THEN 3 END AS idf, o.ino = 107 AND o.dev = 7 AS hatch FROM raw_open o",
    "picked": "SELECT *, CASE WHEN coalesce(pf, idf, 0) & (CASE WHEN f_mode & 2 <> 0 THEN 1 ELSE 2 END)"
    " <> 0 THEN coalesce(pf, idf, 0) ELSE 0 END AS watch_id,"
    " (f_mode & 2) <> 0 AND hatch AS escape_target FROM flagged",
}


def raw_open(i: Inputs):
    paths = (
        "array('/etc/shadow', '/etc/shadow-', '/root/.ssh/id_rsa', '/root/.ssh/known',"
        " concat('/home/u', u % 9, '/.ssh/id_ed'), concat('/home/u', u % 9,"
        " '/.ssh/authorized_keys'), '/etc/ssh/ssh_host_rsa', '/mnt/p/core_pattern',"
        " '/proc/sys/kernel/core_pattern', '/etc/cron.d/j', '/var/log/x', '/etc/ld.so.conf')"
    )
    return i.events.selectExpr(
        "concat('host-', u % 8) AS host", "e AS seq", f"get({paths}, CAST(e % 12 AS INT)) AS path",
        "e DIV 12 % 2 + 1 AS f_mode", "e % 12 AS dev", "e % 12 + 100 AS ino",
        "CASE WHEN e % 7 = 0 THEN 0 WHEN e % 7 < 3 THEN 4026531841 ELSE 4026532000 + u END AS mnt_ns",
    )


def _opens(i: Inputs, mode: str = "off"):
    o = raw_open(i)
    homes = o.select("host").distinct().selectExpr(
        "host", "explode(sequence(0, 8)) AS n"
    ).selectExpr("host", "concat('/home/u', n) AS home")
    ids = o.filter("ino = 110").selectExpr("host", "dev", "ino", "3 AS flags").distinct()
    hatches = o.filter("ino = 107").select("host", "dev", "ino").distinct()
    hosts = o.select("host").distinct().selectExpr("host", "4026531841L AS host_mnt_ns")
    return C.select_opens(
        o, C.default_watches(i.spark, homes), ids, hatches, mode, hosts
    )


@query(
    "c1_watched_paths",
    sql(
        "SELECT host, seq, path, coalesce(pf, 0)::BIGINT AS flags FROM flagged",
        OPENS,
    ),
)
def c1(i: Inputs):
    o = raw_open(i)
    homes = o.select("host").distinct().selectExpr(
        "host", "explode(sequence(0, 8)) AS n"
    ).selectExpr("host", "concat('/home/u', n) AS home")
    return C.watch_flags(o, C.default_watches(i.spark, homes)).selectExpr(
        "host", "seq", "path", "CAST(coalesce(w_flags, 0) AS BIGINT) AS flags"
    )


@query(
    "c2_identity_fallback",
    sql(
        "SELECT host, seq, path, watch_id::BIGINT AS watch_id FROM picked"
        " WHERE watch_id <> 0 OR escape_target",
        OPENS,
    ),
)
def c2(i: Inputs):
    return _opens(i).selectExpr("host", "seq", "path", "CAST(watch_id AS BIGINT) AS watch_id")


@query(
    "c3_escape_identity",
    sql("SELECT host, seq, path FROM picked WHERE escape_target", OPENS),
)
def c3(i: Inputs):
    return _opens(i).filter("escape_target").select("host", "seq", "path")


MODES_SQL = (
    "SELECT event_id AS seq, event_id % 3 = 0 AS created,"
    " CASE WHEN event_id % 5 = 0 THEN 16877 WHEN event_id % 5 = 1 THEN 35309 ELSE 33261 END AS inode_mode,"
    " CASE event_id % 4 WHEN 0 THEN 2541 WHEN 1 THEN 35309 WHEN 2 THEN 493 ELSE 33261 + 1024 END"
    " AS new_mode FROM events"
)


@query(
    "c4_setuid_transitions",
    f"SELECT seq, file_mode, old_file_mode FROM (SELECT seq, created, inode_mode, new_mode AS file_mode,"
    " CASE WHEN created THEN 0 ELSE inode_mode END AS old_file_mode"
    f" FROM ({MODES_SQL})) WHERE (((file_mode & 2048) <> 0 AND (old_file_mode & 2048) = 0)"
    " OR ((file_mode & 1024) <> 0 AND (old_file_mode & 1024) = 0))"
    " AND CASE WHEN created THEN (file_mode & 61440) IN (0, 32768) ELSE (inode_mode & 61440) = 32768 END",
)
def c4(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq", "e % 3 = 0 AS created",
        "CASE WHEN e % 5 = 0 THEN 16877L WHEN e % 5 = 1 THEN 35309L ELSE 33261L END AS inode_mode",
        "CASE e % 4 WHEN 0 THEN 2541L WHEN 1 THEN 35309L WHEN 2 THEN 493L ELSE 33261L + 1024 END"
        " AS new_mode",
    )
    return C.select_modes(d).select("seq", "file_mode", "old_file_mode")


@query(
    "c5_capability_xattr",
    "SELECT event_id AS seq FROM events WHERE event_id % 4 = 2",
)
def c5(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq",
        "get(array('user.mime', 'security.selinux', 'security.capability', 'security.cap'),"
        " CAST(e % 4 AS INT)) AS name",
    )
    return C.select_xattrs(d).select("seq")


@query(
    "c6_ptrace",
    "SELECT event_id AS seq FROM events WHERE user_id <> event_id % 50 AND"
    " ((event_id % 4 & 2) <> 0 OR user_id % 3 <> event_id % 3)",
)
def c6(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq", "u AS tgid", "e % 50 AS target", "e % 4 AS mode", "u % 3 AS tracer_euid",
        "e % 3 AS target_euid",
    )
    return C.select_ptraces(d).select("seq")


@query(
    "c7_sockets",
    "SELECT 'connect' AS what, event_id AS seq FROM events WHERE event_id % 6 < 4 UNION ALL"
    " SELECT 'listen', event_id FROM events WHERE event_id % 3 < 2",
)
def c7(i: Inputs):
    names = (
        "array('docker.sock', 'containerd.sock', 'podman.sock', 'crio.sock', 'docker.sock.bak',"
        " 'x.sock')"
    )
    a = i.events.selectExpr("e AS seq", f"get({names}, CAST(e % 6 AS INT)) AS bound_name")
    b = i.events.selectExpr(
        "e AS seq", "get(array('AF_INET', 'AF_INET6', 'AF_UNIX'), CAST(e % 3 AS INT)) AS family"
    )
    return C.select_connects(a).selectExpr("'connect' AS what", "seq").unionByName(
        C.select_listens(b).selectExpr("'listen' AS what", "seq")
    )


@query(
    "c8_enforcement",
    sql(
        "SELECT host, seq, escape_target AND mnt_ns <> 0 AND mnt_ns <> 4026531841 AS would_deny,"
        " false AS denied FROM picked WHERE watch_id <> 0 OR escape_target",
        OPENS,
    ),
)
def c8(i: Inputs):
    return _opens(i, "audit").select("host", "seq", "would_deny", "denied")


@query("c9_severity_floor", sql("SELECT host, seq, severity FROM inc WHERE rank >= 2"))
def c9(i: Inputs):
    return C.at_least(i.run.incidents, "medium").select("host", "seq", "severity")


@query(
    "c11_credential_changes",
    "SELECT event_id AS seq FROM events WHERE event_id % 3 <> user_id % 3 OR event_id % 2 <> user_id % 2",
)
def c11(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq", "e % 3 AS old_uid", "u % 3 AS new_uid", "0L AS old_gid", "0L AS new_gid",
        "e % 2 AS old_euid", "u % 2 AS new_euid", "0L AS old_egid", "0L AS new_egid",
        "0L AS old_cap", "0L AS new_cap",
    )
    return C.select_creds(d).select("seq")


@query(
    "c12_process_level",
    "SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN (user_id * 256 + 9) >> 8 ELSE 0 END"
    " AS exit_code FROM events WHERE event_id % 5 <> 0",
)
def c12(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq", "u AS tgid", "if(e % 5 = 0, u + 1, u) AS pid",
        "if(e % 2 = 0, 'exit', 'fork') AS kind", "u * 256 + 9 AS raw_exit",
    )
    return C.select_tasks(d).select("seq", "exit_code")


@query(
    "c13_fileless",
    "SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 1 WHEN user_id % 3 = 0 THEN 2 ELSE 3 END"
    "::BIGINT AS aux FROM events WHERE event_id % 4 = 0 OR user_id % 3 = 0 OR event_id % 5 = 0",
)
def c13(i: Inputs):
    d = i.events.selectExpr(
        "e AS seq", "if(e % 4 = 0, concat('memfd:', e), 'x') AS dentry_name",
        "if(u % 3 = 0, 'anon_inodefs', 'ext4') AS sb_kind", "e % 5 AS nlink",
    )
    return C.select_fileless(d).selectExpr("seq", "CAST(aux AS BIGINT) AS aux")


@query(
    "c14_socket_stdio",
    "SELECT 'host-' || (user_id % 8) AS host, event_id AS seq,"
    " event_id % 4 < 3 AND event_id % 5 < 2 AND user_id % 2 = 0 AS socket_stdio FROM events",
)
def c14(i: Inputs):
    ev = i.events.selectExpr("concat('host-', u % 8) AS host", "e AS seq", "u")
    fds = ev.selectExpr(
        "host", "seq", "explode(array(named_struct('fd', seq % 4, 's', u % 2 = 0,"
        " 'f', get(array('AF_INET', 'AF_INET6', 'AF_UNIX', 'AF_NETLINK', ''), CAST(seq % 5 AS INT))),"
        " named_struct('fd', 9L, 's', true, 'f', 'AF_INET'))) AS x",
    ).selectExpr("host", "seq", "x.fd AS fd", "x.s AS is_socket", "x.f AS family")
    return C.socket_stdio(ev.select("host", "seq"), fds)
