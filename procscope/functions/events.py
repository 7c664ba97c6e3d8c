"""SQL expressions over one event row.

Every function takes column text and returns expression text. Plans hand the text to ``selectExpr``
or ``expr``: the JVM parses it once, where building the same tree call by call would take thousands
of round trips for the detector projection alone.
"""

from __future__ import annotations

from procscope import schema as S

# --- Fixed values ------------------------------------------------------------------------------
S_ISUID = 0o4000
S_ISGID = 0o2000
# CAP_DAC_READ_SEARCH, CAP_SYS_MODULE, CAP_SYS_PTRACE, CAP_SYS_ADMIN, CAP_BPF
DANGEROUS_CAP_BITS = [2, 16, 19, 21, 39]
DANGEROUS_CAPS = sum(1 << b for b in DANGEROUS_CAP_BITS)
CAP_NAMES = {
    0: "CAP_CHOWN",
    1: "CAP_DAC_OVERRIDE",
    2: "CAP_DAC_READ_SEARCH",
    6: "CAP_SETGID",
    7: "CAP_SETUID",
    8: "CAP_SETPCAP",
    12: "CAP_NET_ADMIN",
    16: "CAP_SYS_MODULE",
    19: "CAP_SYS_PTRACE",
    21: "CAP_SYS_ADMIN",
    38: "CAP_PERFMON",
    39: "CAP_BPF",
}
SHELLS = ["sh", "bash", "dash", "zsh", "ash", "ksh", "fish", "csh", "tcsh"]
INTERPRETERS = ["node", "nodejs", "lua", "tclsh", "awk", "gawk", "mawk"]
VERSIONED_INTERPRETER = "^(python|perl|ruby|php)[0-9.]*$"
KERNEL_HATCHES = [
    "/proc/sys/kernel/core_pattern",
    "/proc/sys/kernel/modprobe",
    "/proc/sys/kernel/poweroff_cmd",
    "/sys/kernel/uevent_helper",
    "/proc/sys/fs/binfmt_misc/register",
    "release_agent",
]
LOGIN_PREFIXES = [
    "/etc/ld.so.conf",
    "/etc/profile",
    "/etc/bash.bashrc",
    "/etc/environment",
    "/etc/update-motd.d/",
]
VOLATILE_DIRS = ["/tmp/", "/dev/shm/", "/var/tmp/"]
WATCH_LABELS = [
    ("/etc/ld.so.preload", "ld.so.preload (linker hijack)"),
    ("/.ssh/authorized_keys", "authorized_keys"),
    ("/root/.ssh/", "root SSH keys"),
    ("/etc/cron", "cron"),
    ("/etc/systemd/", "systemd unit"),
    ("/usr/lib/systemd/", "systemd unit"),
    ("/lib/systemd/", "systemd unit"),
    ("/etc/sudoers", "sudoers"),
    ("/etc/shadow", "shadow"),
    ("/etc/passwd", "passwd"),
    ("/etc/pam.", "PAM (authentication)"),
    ("/etc/ld.so.conf", "ld.so.conf (library search path)"),
    ("/etc/profile", "login shell script"),
    ("/etc/bash.bashrc", "login shell script"),
    ("/etc/environment", "login environment"),
    ("/etc/update-motd.d/", "login script (motd)"),
]
CREDENTIAL_READERS = [
    "unix_chkpwd", "sshd", "sudo", "su", "login", "passwd", "chpasswd", "gpasswd", "newgrp",
    "usermod", "useradd", "userdel", "vipw", "systemd-logind", "sssd", "agetty",
    "gdm-session-worker", "lightdm", "accounts-daemon", "polkitd",
]
NETWORK_DAEMONS = [
    "nginx", "apache2", "php-fpm", "tomcat", "node", "gunicorn", "uwsgi", "mysqld", "mariadbd",
    "postgres", "redis-server", "mongod", "memcached",
]
# Names that make a lineage count as network-rooted when its oldest process carries one.
ROOT_DAEMONS = [
    "nginx", "apache2", "httpd", "sshd", "postgres", "mysqld", "redis-server", "node",
]
TECHNIQUES = {
    "T1003": "OS Credential Dumping",
    "T1003.008": "/etc/passwd and /etc/shadow",
    "T1036": "Masquerading",
    "T1055.008": "Ptrace System Calls",
    "T1068": "Exploitation for Privilege Escalation",
    "T1098": "Account Manipulation",
    "T1543": "Create or Modify System Process",
    "T1547.006": "Kernel Modules and Extensions",
    "T1548": "Abuse Elevation Control Mechanism",
    "T1548.001": "Setuid and Setgid",
    "T1552": "Unsecured Credentials",
    "T1552.001": "Credentials In Files",
    "T1574.006": "Dynamic Linker Hijacking",
    "T1611": "Escape to Host",
    "T1620": "Reflective Code Loading",
}
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
# -----------------------------------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: str, values: list[str]) -> str:
    return f"({c} IN ({', '.join(quote(v) for v in values)}))"


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def starts_any(c: str, prefixes: list[str]) -> str:
    return any_of([f"startswith({c}, {quote(p)})" for p in prefixes])


def contains_any(c: str, needles: list[str]) -> str:
    return any_of([f"contains({c}, {quote(n)})" for n in needles])


def case(c: str, table: dict, default: str) -> str:
    """CASE over a small constant table of strings or numbers."""

    def lit(v) -> str:
        return quote(v) if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {c} {arms} ELSE {default} END"


def has_bits(c: str, mask: int) -> str:
    return f"(({c} & {mask}L) <> 0)"


def event_name(code: str = "type") -> str:
    return case(code, S.EVENT_NAMES, f"concat('unknown(', {code}, ')')")


def gained_bits(new: str = "file_mode", old: str = "old_file_mode") -> str:
    suid = f"({has_bits(new, S_ISUID)} AND NOT {has_bits(old, S_ISUID)})"
    sgid = f"({has_bits(new, S_ISGID)} AND NOT {has_bits(old, S_ISGID)})"
    return (
        f"CASE WHEN {suid} AND {sgid} THEN 'SUID+SGID' WHEN {suid} THEN 'SUID'"
        f" WHEN {sgid} THEN 'SGID' ELSE 'none' END"
    )


def opened_for_write(mode: str = "file_mode") -> str:
    return has_bits(mode, 2)


def is_attach(aux: str = "aux") -> str:
    return has_bits(aux, 2)


def exec_source(aux: str = "aux") -> str:
    return case(aux, {1: "memfd", 2: "anon-inode", 3: "deleted-file"}, "'unknown'")


def module_origin(aux: str = "aux") -> str:
    return case(aux, {1: "init_module", 2: "finit_module"}, "''")


def cap_names(mask: str) -> str:
    """Named capabilities in a mask, ascending by bit."""
    arms = ", ".join(
        f"CASE WHEN {has_bits(mask, 1 << b)} THEN {quote(n)} END" for b, n in CAP_NAMES.items()
    )
    return f"array_compact(array({arms}))"


def cap_text(mask: str) -> str:
    """Named capabilities, then how many unnamed ones the mask holds besides."""
    named = sum(1 << b for b in CAP_NAMES)
    listed = f"array_join({cap_names(mask)}, ',')"
    rest = f"bit_count({mask} & ~{named}L)"
    return (
        f"CASE WHEN ({mask} & {named}L) = 0 THEN concat({rest}, ' unnamed')"
        f" WHEN {rest} = 0 THEN {listed} ELSE concat({listed}, ',+', {rest}) END"
    )


def gained_caps(new: str = "cap_effective", old: str = "old_cap_effective") -> str:
    return f"({new} & ~{old})"


def dangerous_caps_gained(new: str = "cap_effective", old: str = "old_cap_effective") -> str:
    return f"({gained_caps(new, old)} & {DANGEROUS_CAPS}L)"


def basename(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def is_shell(path: str = "filename") -> str:
    return one_of(basename(path), SHELLS)


def is_interpreter(path: str = "filename") -> str:
    b = basename(path)
    return f"({one_of(b, INTERPRETERS)} OR {b} RLIKE {quote(VERSIONED_INTERPRETER)})"


def watch_label(path: str = "filename") -> str:
    arms = " ".join(
        f"WHEN contains({path}, {quote(n)}) THEN {quote(label)}" for n, label in WATCH_LABELS
    )
    return f"CASE {arms} ELSE 'watched path' END"


def is_kernel_hatch(path: str = "filename") -> str:
    return contains_any(path, KERNEL_HATCHES)


def runs_at_login(path: str = "filename") -> str:
    return starts_any(path, LOGIN_PREFIXES)


def in_volatile_dir(path: str = "filename") -> str:
    return starts_any(path, VOLATILE_DIRS)


def is_credential_reader(trusted: str = "trusted") -> str:
    return one_of(trusted, CREDENTIAL_READERS)


def is_network_daemon(trusted: str = "trusted") -> str:
    return one_of(trusted, NETWORK_DAEMONS)


def looks_like_daemon(comm: str = "comm") -> str:
    return starts_any(comm, NETWORK_DAEMONS)


def is_root_daemon(comm: str = "comm") -> str:
    return one_of(comm, ROOT_DAEMONS)


def is_kernel_worker(comm: str = "comm", strict: bool = False) -> str:
    """``strict`` leaves out the ``kworker/`` prefix, a name any process can take."""
    exact = f"{comm} = 'kthreadd'"
    return f"({exact})" if strict else f"({exact} OR startswith({comm}, 'kworker/'))"


def technique_name(t: str) -> str:
    return case(t, TECHNIQUES, "'Unknown Technique'")


def severity_rank_of_score(score: str) -> str:
    return (
        f"CASE WHEN {score} < 25 THEN 0 WHEN {score} < 50 THEN 1 WHEN {score} < 75 THEN 2"
        f" WHEN {score} < 90 THEN 3 ELSE 4 END"
    )


def severity_of_rank(rank: str) -> str:
    return f"element_at(array({', '.join(quote(s) for s in SEVERITIES)}), CAST({rank} AS INT) + 1)"


def severity_of_score(score: str) -> str:
    return (
        f"CASE WHEN {score} < 25 THEN 'INFO' WHEN {score} < 50 THEN 'LOW'"
        f" WHEN {score} < 75 THEN 'MEDIUM' WHEN {score} < 90 THEN 'HIGH' ELSE 'CRITICAL' END"
    )


def severity_rank(name: str) -> str:
    return case(name, {s: i for i, s in enumerate(SEVERITIES)}, "0")


def host_band(score: str) -> str:
    return f"CASE WHEN {score} = 0 THEN 'OK' ELSE {severity_of_score(score)} END"


def parse_severity(name: str) -> int:
    up = name.upper()
    if up not in SEVERITIES:
        raise ValueError(f"severity must be info, low, medium, high or critical (got {name!r})")
    return SEVERITIES.index(up)


def wall_ms(ts_ns: str, boot_epoch_ms: str) -> str:
    """Wall clock in milliseconds; null where the boot offset was never recorded."""
    return f"({boot_epoch_ms} + {ts_ns} DIV 1000000)"


def clock_text(ts_ns: str) -> str:
    ms = f"({ts_ns} DIV 1000000)"

    def part(v: str, n: int) -> str:
        return f"lpad(CAST({v} AS STRING), {n}, '0')"

    return (
        f"concat({part(f'{ms} DIV 3600000 % 24', 2)}, ':', {part(f'{ms} DIV 60000 % 60', 2)}, ':',"
        f" {part(f'{ms} DIV 1000 % 60', 2)}, '.', {part(f'{ms} % 1000', 3)})"
    )


def octal(mode: str) -> str:
    return f"lower(conv({mode} & 4095L, 10, 8))"


def event_detail() -> str:
    """Text of one capture row, by type."""

    def moved(a: str, b: str, label: str) -> str:
        return (
            f"CASE WHEN old_{a} <> {a} OR old_{b} <> {b} THEN"
            f" concat('{label} ', old_{a}, ':', old_{b}, ' -> ', {a}, ':', {b}) END"
        )

    rest = "CASE WHEN size(argv) > 1 THEN slice(argv, 2, size(argv)) ELSE array() END"
    args = (
        f"CASE WHEN get({rest}, 0) = filename THEN slice({rest}, 2, size(argv)) ELSE {rest} END"
    )
    gained = gained_caps()
    degraded = "if(degraded_path, ' [path degraded]', '')"
    cred = (
        f"concat('cred ', concat_ws(' ', {moved('uid', 'euid', 'uid')},"
        f" {moved('gid', 'egid', 'gid')},"
        f" CASE WHEN {gained} <> 0 THEN concat('+caps ', {cap_text(gained)}) END))"
    )
    texts = {
        S.EXEC: f"concat('exec ', filename, ' ', array_join({args}, ' '), if(truncated, ' …', ''))",
        S.EXIT: "concat('exit code=', exit_code)",
        S.FORK: "concat('fork -> pid ', child_pid)",
        S.CRED: cred,
        S.OPEN: f"concat(if({opened_for_write()}, 'open[write] ', 'open[read] '), filename, '  <',"
        f" {watch_label()}, '>')",
        S.MODE: f"concat('SUID-CREATE ', filename, ' gained ', {gained_bits()}, ' (0',"
        f" {octal('old_file_mode')}, ' -> 0', {octal('file_mode')}, ')', {degraded})",
        S.SETCAP: "concat('SETCAP file capabilities set on ', filename,"
        " if(degraded_path, ' [name only]', ''))",
        S.PTRACE: f"concat(if({is_attach()}, 'PTRACE[ATTACH] -> pid ', 'PTRACE[read] -> pid '),"
        " target_pid, ' (', filename, ')')",
        S.ANON: f"concat('FILELESS-EXEC from ', {exec_source()}, ' ', filename, {degraded})",
        S.MODULE: f"concat('MODULE-LOAD ', filename, CASE WHEN {module_origin()} <> ''"
        f" THEN concat(' (via ', {module_origin()}, ')') ELSE '' END)",
        S.CONNECT: "concat('SOCKET-CONNECT ', filename)",
        S.LISTEN: "concat('LISTEN port ', aux)",
    }
    arms = " ".join(f"WHEN {t} THEN {e}" for t, e in texts.items())
    return f"CASE type {arms} ELSE concat('unknown type=', type) END"
