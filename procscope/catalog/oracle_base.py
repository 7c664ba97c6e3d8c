"""SQL the checks share, written for an engine that knows nothing of the Spark plans: recursion
instead of doubling, as-of joins instead of filled windows, ``NOT EXISTS`` instead of running maxima."""

from __future__ import annotations

import re

HOST_NS = 4026531841

CTES: dict[str, str] = {}

CTES["ev0"] = """
SELECT event_id AS e, user_id AS u,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r
FROM events"""

CTES["ev1"] = """
SELECT *, r // 6 AS g, r % 6 AS s, (5 * u + 7 * (r // 6) + 3 * (r % 6)) % 13 AS k,
       (u + 3 * (r // 6) + CASE WHEN u % 3 = 1 AND r % 6 >= 3 THEN 5 ELSE 0 END) % 12 AS x,
       (u + 3 * (r // 6 - 1) + 12 + CASE WHEN u % 3 = 1 THEN 5 ELSE 0 END) % 12 AS px,
       90 * r + u % 60 + 1 AS t, 'host-' || (u % 8)::VARCHAR AS host
FROM ev0"""

CTES["ev2"] = """
SELECT *,
  row_number() OVER (PARTITION BY host ORDER BY t, e) AS seq,
  CASE WHEN s = 0 THEN 3 WHEN s = 1 OR (s = 3 AND u % 3 = 1) THEN 1
       ELSE [4,4,5,5,6,7,8,8,9,10,11,12,2][k + 1] END AS type,
  ['/usr/bin/sudo','/bin/sh','/tmp/x','/usr/bin/python3.11','/usr/sbin/nginx','/usr/bin/chmod',
   '/bin/bash','/usr/sbin/sshd','/usr/bin/php8.2','/usr/bin/node','/usr/sbin/modprobe',
   '/usr/bin/vim'][x + 1] AS prog,
  ['/usr/bin/sudo','/bin/sh','/tmp/x','/usr/bin/python3.11','/usr/sbin/nginx','/usr/bin/chmod',
   '/bin/bash','/usr/sbin/sshd','/usr/bin/php8.2','/usr/bin/node','/usr/sbin/modprobe',
   '/usr/bin/vim'][px + 1] AS pprog,
  1000000 + 50 * u + g % 7 AS cpid, (540 * g + u % 60 + 1) * 1000000000 AS cstart,
  CASE WHEN g % 5 = 0 THEN 500000 + u ELSE 1000000 + 50 * u + (g - 1) % 7 END AS qpid,
  CASE WHEN g % 5 = 0 THEN 1 ELSE (540 * (g - 1) + u % 60 + 1) * 1000000000 END AS qstart
FROM ev1"""

CTES["cap"] = """
SELECT host, seq, t * 1000000000 AS ts_ns, type, e, u, g, s, k,
  CASE WHEN s = 0 THEN qpid ELSE cpid END AS pid,
  CASE WHEN s = 0 THEN qstart ELSE cstart END AS start,
  CASE WHEN s = 0 THEN cpid ELSE 0 END AS child_pid,
  CASE WHEN s = 0 THEN cstart ELSE 0 END AS child_start,
  CASE WHEN s <> 0 THEN split_part(prog, '/', -1)
       WHEN g % 5 = 0 THEN ['nginx','bash','sshd','kworker/0:1'][u % 4 + 1]
       ELSE split_part(pprog, '/', -1) END AS comm,
  CASE WHEN type = 1 THEN prog
       WHEN type = 5 AND k = 2 THEN ['/etc/ld.so.preload','/root/.ssh/authorized_keys',
         '/etc/cron.d/job','/etc/sudoers.d/x','/etc/pam.d/sshd','/etc/passwd',
         '/proc/sys/kernel/core_pattern','/etc/profile.d/a.sh'][(u + g) % 8 + 1]
       WHEN type = 5 THEN ['/etc/shadow','/root/.ssh/id_rsa','/etc/gshadow'][(u + g + s) % 3 + 1]
       WHEN type = 6 THEN '/tmp/.x' WHEN type = 7 THEN 'ping' WHEN type = 9 THEN 'memfd:p'
       WHEN type = 10 THEN 'dummy' WHEN type = 11 THEN 'docker.sock' ELSE '' END AS filename,
  CASE WHEN type = 1 THEN 'arg' || g::VARCHAR ELSE '' END AS arg1,
  CASE WHEN type = 4 AND k = 1 THEN 0 ELSE 1000 END AS uid,
  CASE WHEN type = 4 THEN 0 ELSE 1000 END AS euid,
  CASE WHEN type = 4 AND k = 0 THEN 1000 WHEN type = 4 THEN 42 ELSE 0 END AS old_euid,
  CASE WHEN type = 4 THEN 2097152 ELSE 0 END AS cap_effective,
  CASE WHEN type = 5 AND k = 2 THEN 2 WHEN type = 5 THEN 1 WHEN type = 6 THEN 35309 ELSE 0 END
    AS file_mode,
  CASE WHEN type = 6 THEN 33261 ELSE 0 END AS old_file_mode,
  CASE WHEN type = 8 AND k = 6 THEN 2 WHEN type = 8 THEN 1 WHEN type = 9 THEN 1 + g % 3
       WHEN type = 10 THEN 2 WHEN type = 12 THEN 8000 + u ELSE 0 END AS aux,
  CASE WHEN type = 8 AND g % 2 = 0 THEN qpid WHEN type = 8 THEN 1 ELSE 0 END AS target_pid,
  CASE WHEN u % 5 = 0 THEN 'docker:abc123def' || (100 + u % 900)::VARCHAR ELSE '' END AS container,
  CASE WHEN type = 1 AND u % 3 <> 0 AND x IN (0, 4, 7, 9) THEN split_part(prog, '/', -1) ELSE '' END
    AS exe_trusted,
  type = 1 AND u % 7 = 0 AS socket_stdio,
  CASE WHEN type = 1 AND u % 11 = 0 THEN 4026531841 WHEN type = 1 THEN 4026532000 + u ELSE 0 END
    AS mnt_ns
FROM ev2"""

# Process state. Generated execs always carry a name, so a name is that of the newest exec or, before
# the first one, the earliest name any event gave the process.
CTES["touch"] = """
SELECT host, pid, start, seq, comm, type = 1 AS is_exec, filename AS exe, exe_trusted AS trusted,
       uid, euid, type <> 3 AS has_cred, CASE WHEN type = 3 THEN '' ELSE container END AS container
FROM cap WHERE type IN (1, 3, 4)
UNION ALL
SELECT host, child_pid, child_start, seq, comm, false, '', '', uid, euid, true, container
FROM cap WHERE type = 3"""
CTES["execs"] = "SELECT host, pid, start, seq, comm, exe, trusted FROM touch WHERE is_exec"
CTES["born"] = """
SELECT host, pid, start, min(seq) AS first_seq, min_by(comm, seq) AS first_comm
FROM touch GROUP BY ALL"""
CTES["boxed"] = """
SELECT host, pid, start, min(seq) AS box_seq, min(container) AS box FROM touch
WHERE container <> '' GROUP BY ALL"""

CTES["edge"] = """
SELECT host, child_pid AS pid, child_start AS start, pid AS ppid, start AS pstart, seq AS vf
FROM cap WHERE type = 3"""
# Every acting process and its ancestors.
CTES["anc"] = """
SELECT DISTINCT host, pid, start, pid AS apid, start AS astart, 0 AS depth, -1::BIGINT AS vf
FROM cap WHERE type <> 3
UNION ALL
SELECT a.host, a.pid, a.start, e.ppid, e.pstart, a.depth + 1, greatest(a.vf, e.vf)
FROM anc a JOIN edge e ON a.host = e.host AND a.apid = e.pid AND a.astart = e.start
WHERE a.depth < 63"""

# Lineage nodes with their state, at every event that could signal.
CTES["path"] = """
SELECT c.*, coalesce(x.comm, CASE WHEN b.first_seq <= c.seq THEN b.first_comm END, '') AS acomm,
       coalesce(x.exe, '') AS aexe, coalesce(x.trusted, '') AS atrusted,
       coalesce(b.first_seq <= c.seq, false) AS known,
       CASE WHEN bx.box_seq <= c.seq THEN bx.box ELSE '' END AS acont
FROM (SELECT c.host, c.seq, c.type, c.pid, c.start, a.depth, a.apid, a.astart
      FROM cap c JOIN anc a ON c.host = a.host AND c.pid = a.pid AND c.start = a.start
                           AND a.vf <= c.seq
      WHERE c.type NOT IN (2, 3)) c
ASOF LEFT JOIN execs x ON x.host = c.host AND x.pid = c.apid AND x.start = c.astart AND c.seq >= x.seq
LEFT JOIN born b ON b.host = c.host AND b.pid = c.apid AND b.start = c.astart
LEFT JOIN boxed bx ON bx.host = c.host AND bx.pid = c.apid AND bx.start = c.astart"""

READERS = (
    "('unix_chkpwd','sshd','sudo','su','login','passwd','chpasswd','gpasswd','newgrp','usermod',"
    "'useradd','userdel','vipw','systemd-logind','sssd','agetty','gdm-session-worker','lightdm',"
    "'accounts-daemon','polkitd')"
)
DAEMONS = [
    "nginx", "apache2", "php-fpm", "tomcat", "node", "gunicorn", "uwsgi", "mysqld", "mariadbd",
    "postgres", "redis-server", "mongod", "memcached",
]
DAEMON_SQL = "(" + ",".join(f"'{d}'" for d in DAEMONS) + ")"
LOOKS = "(" + " OR ".join(f"starts_with(acomm, '{d}')" for d in DAEMONS) + ")"
SHELL = (
    "split_part(filename, '/', -1) IN ('sh','bash','dash','zsh','ash','ksh','fish','csh','tcsh')"
)
INTERP = (
    "(split_part(filename, '/', -1) IN ('node','nodejs','lua','tclsh','awk','gawk','mawk') OR"
    " regexp_full_match(split_part(filename, '/', -1), '(python|perl|ruby|php)[0-9.]*'))"
)
ROOT_DAEMONS = "('nginx','apache2','httpd','sshd','postgres','mysqld','redis-server','node')"

# What the ancestry of an event says.
CTES["around"] = f"""
SELECT host, seq,
  max(CASE WHEN depth = 0 THEN atrusted END) AS trusted,
  max(CASE WHEN depth = 0 THEN aexe END) AS exe,
  bool_or(known AND (acomm = 'kthreadd' OR starts_with(acomm, 'kworker/'))) AS kernel,
  bool_or(known AND (atrusted IN {DAEMON_SQL} OR {LOOKS})) AS daemon,
  min_by(CASE WHEN atrusted = '' THEN acomm ELSE atrusted END || '(' || apid || ')', depth)
    FILTER (known AND (atrusted IN {DAEMON_SQL} OR {LOOKS})) AS who,
  list(apid) FILTER (known) AS pids
FROM path GROUP BY host, seq"""

_W = "type = 5 AND (file_mode & 2) <> 0"
_HATCH = (
    "(contains(filename, '/proc/sys/kernel/core_pattern') OR contains(filename, '/proc/sys/kernel/modprobe')"
    " OR contains(filename, '/proc/sys/kernel/poweroff_cmd') OR contains(filename, '/sys/kernel/uevent_helper')"
    " OR contains(filename, '/proc/sys/fs/binfmt_misc/register') OR contains(filename, 'release_agent'))"
)
_PERSIST = (
    "(contains(filename, '/etc/cron') OR contains(filename, 'systemd') OR starts_with(filename, '/etc/ld.so.conf')"
    " OR starts_with(filename, '/etc/profile') OR starts_with(filename, '/etc/bash.bashrc')"
    " OR starts_with(filename, '/etc/environment') OR starts_with(filename, '/etc/update-motd.d/'))"
)
_CREDCFG = (
    "(contains(filename, 'sudoers') OR contains(filename, '/etc/shadow') OR contains(filename, '/etc/pam.'))"
)
_BASE = "split_part(filename, '/', -1)"
# (id, ord, condition, score, detail, target)
DETECTORS: list[tuple[str, int, str, str, str, str]] = [
    ("suid_create", 0, "type = 6", "45", "'created a new SUID binary ' || filename", "filename"),
    (
        "fileless_exec", 0, "type = 9", "45",
        "'executed from ' || ['memfd','anon-inode','deleted-file'][aux] || ' (' || filename || ')'",
        "'/proc/' || pid || '/exe'",
    ),
    (
        "privilege_escalation", 0,
        "type = 4 AND uid <> 0 AND ((old_euid <> 0 AND euid = 0) OR (cap_effective & 549758500868) <> 0)",
        "40", "'changed euid ' || old_euid || ' -> 0; gained CAP_SYS_ADMIN'", "NULL",
    ),
    ("setcap", 0, "type = 7", "40", "'set file capabilities on ' || filename", "filename"),
    (
        "ptrace_attach", 0, "type = 8 AND (aux & 2) <> 0", "30",
        "'ptrace-attached to pid ' || target_pid", "NULL",
    ),
    (
        "cross_uid_proc_read", 0,
        "type = 8 AND (aux & 2) = 0 AND NOT coalesce(list_contains(pids, target_pid), false)", "25",
        "'read an unrelated process''s memory (pid ' || target_pid || ')'", "NULL",
    ),
    (
        "ssh_private_key_read", 0,
        f"type = 5 AND (file_mode & 2) = 0 AND trusted NOT IN {READERS}"
        " AND (contains(filename, 'ssh_host_') OR contains(filename, '/.ssh/id_'))", "35",
        "'read an SSH private key: ' || filename", "filename",
    ),
    (
        "credential_store_read", 0,
        f"type = 5 AND (file_mode & 2) = 0 AND trusted NOT IN {READERS}"
        " AND NOT (contains(filename, 'ssh_host_') OR contains(filename, '/.ssh/id_'))", "30",
        "'read the credential store: ' || filename", "filename",
    ),
    (
        "kernel_escape_hatch_write", 0, f"{_W} AND {_HATCH}",
        "CASE WHEN container = '' THEN 45 ELSE 75 END",
        "CASE WHEN container = '' THEN 'wrote ' || filename || ', which the kernel executes as root'"
        " ELSE 'container ' || container || ' wrote ' || filename ||"
        " ', which the kernel executes as root on the host (escape)' END", "filename",
    ),
    (
        "ldso_preload_write", 0, f"{_W} AND NOT {_HATCH} AND contains(filename, 'ld.so.preload')",
        "40", "'wrote to ' || filename", "NULL",
    ),
    (
        "authorized_keys_write", 0,
        f"{_W} AND NOT {_HATCH} AND contains(filename, 'authorized_keys')", "35",
        "'wrote to ' || filename", "NULL",
    ),
    (
        "persistence_write", 0,
        f"{_W} AND NOT {_HATCH} AND NOT contains(filename, 'ld.so.preload')"
        f" AND NOT contains(filename, 'authorized_keys') AND {_PERSIST}", "30",
        "'wrote to ' || filename", "NULL",
    ),
    (
        "cred_config_write", 0,
        f"{_W} AND NOT {_HATCH} AND NOT contains(filename, 'ld.so.preload')"
        f" AND NOT contains(filename, 'authorized_keys') AND NOT {_PERSIST} AND {_CREDCFG}", "35",
        "'wrote to ' || filename", "NULL",
    ),
    (
        "sensitive_write", 0,
        f"{_W} AND NOT {_HATCH} AND NOT contains(filename, 'ld.so.preload')"
        f" AND NOT contains(filename, 'authorized_keys') AND NOT {_PERSIST} AND NOT {_CREDCFG}",
        "20", "'wrote to ' || filename", "NULL",
    ),
    (
        "module_autoload", 0, "type = 10 AND kernel", "10",
        "'kernel autoloaded module ' || filename || ' on demand (request_module)'", "filename",
    ),
    (
        "module_load", 0, "type = 10 AND NOT coalesce(kernel, false)", "50",
        "'loaded kernel module ' || filename", "filename",
    ),
    (
        "namespace_escape", 0,
        f"type = 1 AND mnt_ns <> 0 AND container <> '' AND mnt_ns = {HOST_NS}", "70",
        f"'container ' || container || ' is executing in the host mount namespace (mnt_ns {HOST_NS})'",
        "filename",
    ),
    (
        "exec_from_tmp", 1,
        "type = 1 AND (starts_with(filename, '/tmp/') OR starts_with(filename, '/dev/shm/')"
        " OR starts_with(filename, '/var/tmp/'))", "20",
        "'executed from a volatile directory: ' || filename", "filename",
    ),
    (
        "shell_from_network_daemon", 2, f"type = 1 AND {SHELL} AND daemon", "50",
        f"who || ' spawned a shell (' || {_BASE} || ')'", "NULL",
    ),
    (
        "interpreter_from_network_daemon", 2, f"type = 1 AND NOT {SHELL} AND {INTERP} AND daemon",
        "25", f"who || ' spawned an interpreter (' || {_BASE} || ')'", "NULL",
    ),
    (
        "socket_backed_shell", 3, f"type = 1 AND socket_stdio AND {SHELL}", "70",
        f"{_BASE} || ' was exec''d with a network socket on its standard descriptors (reverse shell)'",
        "NULL",
    ),
    (
        "unexpected_listener", 0, f"type = 12 AND trusted NOT IN {DAEMON_SQL}", "25",
        "split_part(CASE WHEN exe <> '' THEN exe ELSE comm END, '/', -1) ||"
        " ' opened a listening port (' || aux || ')'", "NULL",
    ),
    (
        "runtime_socket_access", 0, "type = 11", "CASE WHEN container = '' THEN 25 ELSE 60 END",
        "CASE WHEN container = '' THEN 'connected to the container runtime socket ' || filename"
        " ELSE 'container ' || container || ' connected to the host runtime socket ' || filename ||"
        " ' (escape primitive)' END", "NULL",
    ),
]

CTES["seen"] = """
SELECT c.*, coalesce(a.trusted, '') AS trusted, coalesce(a.exe, '') AS exe,
       coalesce(a.kernel, false) AS kernel, coalesce(a.daemon, false) AS daemon, a.who, a.pids
FROM cap c LEFT JOIN around a ON a.host = c.host AND a.seq = c.seq"""
CTES["sig"] = "\nUNION ALL\n".join(
    f"SELECT host, seq, {o} AS ord, '{i}' AS id, ({sc})::BIGINT AS score, ts_ns, pid, start,"
    f" {d} AS detail, {t}::VARCHAR AS target FROM seen WHERE {c}"
    for i, o, c, sc, d, t in DETECTORS
)

FAMILY = (
    "CASE WHEN {id} IN ('ldso_preload_write','authorized_keys_write','persistence_write',"
    "'cred_config_write','sensitive_write') THEN 'watched_write'"
    " WHEN {id} IN ('credential_store_read','ssh_private_key_read') THEN 'credential_read'"
    " WHEN {id} IN ('ptrace_attach','cross_uid_proc_read') THEN 'process_access' ELSE {id} END"
)
# Signals that raise what is on file for their (process, id).
CTES["imp"] = """
SELECT * FROM sig a WHERE NOT EXISTS (
  SELECT 1 FROM sig b WHERE b.host = a.host AND b.pid = a.pid AND b.start = a.start AND b.id = a.id
   AND (b.seq, b.ord) < (a.seq, a.ord) AND b.score >= a.score)"""
CTES["evals"] = "SELECT DISTINCT host, seq, pid, start FROM sig"
# Every evaluation with everything on file in its lineage.
CTES["filed"] = """
SELECT e.host, e.seq, e.pid, e.start, p.depth, p.apid, p.astart, i.id, i.score, i.ts_ns, i.detail,
       i.target, i.seq AS iseq, i.ord AS iord
FROM evals e
JOIN anc p ON p.host = e.host AND p.pid = e.pid AND p.start = e.start AND p.vf <= e.seq
JOIN imp i ON i.host = e.host AND i.pid = p.apid AND i.start = p.astart AND i.seq <= e.seq
WHERE NOT EXISTS (SELECT 1 FROM imp j WHERE j.host = i.host AND j.pid = i.pid AND j.start = i.start
  AND j.id = i.id AND j.seq <= e.seq AND (j.seq, j.ord) > (i.seq, i.ord))"""
CTES["ctx"] = f"""
SELECT e.host, e.seq,
  bool_or(p.known AND p.acont <> '') AS boxed,
  max_by(p.known AND p.acomm IN {ROOT_DAEMONS}, p.depth) AS rooted
FROM evals e JOIN path p ON p.host = e.host AND p.seq = e.seq GROUP BY ALL"""


def score_ctes(filed: str, prefix: str = "") -> dict[str, str]:
    return {
        f"{prefix}fam": f"""
SELECT host, seq, pid, start, {FAMILY.format(id='f.id')} AS family, max(score) AS top
FROM {filed} f
WHERE (SELECT max(g.ts_ns) FROM {filed} g WHERE g.host = f.host AND g.seq = f.seq AND g.pid = f.pid
       AND g.start = f.start) - f.ts_ns <= 600000000000
GROUP BY ALL""",
        f"{prefix}raw": f"""
SELECT f.host, f.seq, f.pid, f.start, sum(top)::BIGINT AS base,
  CASE WHEN count(*) > 1 THEN ((count(*) - 1) * max(top)) // 2 ELSE 0 END AS chain
FROM {prefix}fam f GROUP BY ALL""",
        f"{prefix}scored": f"""
SELECT s.*, mult, least(100, round((base + chain) * mult)::BIGINT) AS total, rooted, boxed
FROM (SELECT r.*, c.rooted, c.boxed,
       (CASE WHEN c.rooted THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)
       * (CASE WHEN c.boxed THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS mult
      FROM {prefix}raw r JOIN ctx c ON c.host = r.host AND c.seq = r.seq) s""",
        f"{prefix}ranked": f"""
SELECT *, CASE WHEN total < 25 THEN 0 WHEN total < 50 THEN 1 WHEN total < 75 THEN 2
               WHEN total < 90 THEN 3 ELSE 4 END AS rank FROM {prefix}scored""",
        f"{prefix}inc": f"""
SELECT r.*, ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][rank + 1] AS severity FROM {prefix}ranked r
WHERE NOT EXISTS (SELECT 1 FROM {prefix}ranked q WHERE q.host = r.host AND q.pid = r.pid
  AND q.start = r.start AND q.seq < r.seq AND q.rank >= r.rank)""",
    }


CTES.update(score_ctes("filed"))

CTES["nsig"] = """
SELECT host, seq, pid, start, count(*) AS n_signals, max(ts_ns) AS ts_ns FROM filed GROUP BY ALL"""

# One triage-ready row per incident.
CTES["stored"] = """
SELECT row_number() OVER (ORDER BY n.ts_ns, i.host, i.seq) AS id, i.host, i.seq, i.pid, i.start,
       n.ts_ns, n.ts_ns // 1000000000 AS received, i.severity, i.total AS score, i.rank
FROM inc i JOIN nsig n ON n.host = i.host AND n.seq = i.seq AND n.pid = i.pid AND n.start = i.start"""


def _deps(sql: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z_0-9]*)", sql))
    return [n for n in names if n in words]


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the shared tables it needs (and theirs) in front, in dependency order."""
    table = {**CTES, **(extra or {})}
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for d in _deps(table[name], list(table)):
            if d != name:
                add(d)
        order.append(name)

    for d in _deps(body, list(table)):
        add(d)
    if not order:
        return body
    parts = []
    for n in order:
        if n == "anc":
            parts.append(f"anc(host, pid, start, apid, astart, depth, vf) AS ({table[n]})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({table[n]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
