"""SQL expressions over paths, command lines and records."""

from __future__ import annotations

from procscope.functions import events as X

# --- Fixed values ------------------------------------------------------------------------------
REDACTED = "<redacted>"
SECRET_FLAGS = [
    "password", "passwd", "pass", "pwd", "token", "auth-token", "access-token", "refresh-token",
    "api-key", "apikey", "secret", "secret-key", "secret-access-key", "client-secret",
    "private-key", "credential", "credentials",
]
SHORT_P_TOOLS = ["mysql", "mysqldump", "mysqladmin", "mariadb", "mariadb-dump"]
SECRET_HEADERS = ["authorization:", "cookie:", "x-api-key:", "proxy-authorization:"]
RUNTIME_PREFIXES = [
    ("docker-", "docker"),
    ("cri-containerd-", "containerd"),
    ("containerd-", "containerd"),
    ("libpod-", "podman"),
    ("crio-", "crio"),
]
KEY_TYPES = [
    "ssh-rsa", "ssh-dss", "ssh-ed25519", "ssh-ed25519-cert-v01@openssh.com",
    "sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com", "ecdsa-sha2-nistp256",
    "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521",
]
CMDLINE_BYTES = 200
SYSLOG_FACILITY = 4
# -----------------------------------------------------------------------------------------------


def argv_of(raw: str = "argv_raw") -> str:
    """NUL-separated argument bytes to a list; empty arguments vanish."""
    return f"filter(split({raw}, '\\u0000'), a -> a <> '')"


def container_label(path: str) -> str:
    """``runtime:id`` of the first cgroup path component that names a container, else ''."""
    stem = "regexp_replace(p, '[.]scope$', '')"
    arms = " ".join(
        f"WHEN {stem} RLIKE '^{prefix}[0-9a-fA-F]{{12,}}$' THEN"
        f" concat('{runtime}:', substring({stem}, {len(prefix) + 1}, 12))"
        for prefix, runtime in RUNTIME_PREFIXES
    )
    label = (
        f"CASE {arms} WHEN {stem} RLIKE '^[0-9a-fA-F]{{32,}}$' THEN"
        f" concat('container:', substring({stem}, 1, 12)) END"
    )
    found = f"get(array_compact(transform(split({path}, '/'), p -> {label})), 0)"
    return (
        f"CASE WHEN NOT contains({path}, '-') AND octet_length({path}) < 32 THEN ''"
        f" ELSE coalesce({found}, '') END"
    )


def ns_inode(link: str) -> str:
    """Inode of a namespace link such as ``mnt:[4026531841]``; 0 when it is anything else."""
    return (
        f"coalesce(try_cast(nullif(regexp_extract({link}, '^[^\\\\[]*\\\\[([0-9]+)\\\\]$', 1), '')"
        " AS BIGINT), 0L)"
    )


def kernel_dev(major: str, minor: str) -> str:
    return f"(shiftleft(CAST({major} AS BIGINT), 20) | (CAST({minor} AS BIGINT) & 1048575L))"


def redact_argv(argv: str = "argv") -> str:
    """Command line with secret values replaced; flags and length stay.

    A left fold over the arguments: whether one is a secret depends on the one before it.
    """
    flags = ", ".join(X.quote(f) for f in SECRET_FLAGS)
    tools = X.one_of(X.basename(f"get({argv}, 0)"), SHORT_P_TOOLS)
    headers = "|".join(h for h in SECRET_HEADERS)
    red = X.quote(REDACTED)

    def secret(name: str) -> str:
        return f"lower(regexp_replace({name}, '^-+', '')) IN ({flags})"

    name = "split_part(a, '=', 1)"
    header = X.quote(f"(?i)^([\"' ]*(?:{headers}))")
    url = X.quote(_URL)
    # At most one of these applies; the first that does decides the argument.
    out = (
        f"CASE WHEN s.hide THEN {red}"
        f" WHEN startswith(a, '--') AND contains(a, '=') AND {secret(name)}"
        f" THEN concat(split_part(a, '=', 1), '=', {red})"
        f" WHEN {_flag_takes_next(secret)} THEN a"
        f" WHEN {tools} AND startswith(a, '-p') AND NOT startswith(a, '--') THEN"
        f" CASE WHEN octet_length(a) > 2 THEN concat('-p', {red}) ELSE a END"
        f" WHEN regexp_like(a, {header}) THEN concat(regexp_extract(a, {header}, 1), {red})"
        f" WHEN startswith(a, 'pass:') AND a <> 'pass:' THEN concat('pass:', {red})"
        f" WHEN regexp_like(a, {url}) THEN regexp_replace(a, {url}, '$1$2:{REDACTED}@')"
        " ELSE a END"
    )
    nxt = f"get({argv}, size(s.out) + 1)"
    hide = (
        "CASE WHEN s.hide THEN false"
        f" WHEN startswith(a, '--') AND contains(a, '=') AND {secret(name)} THEN false"
        f" WHEN {_flag_takes_next(secret)} THEN true"
        f" ELSE {tools} AND a = '-p' AND coalesce(NOT startswith({nxt}, '-') AND {nxt} <> '', false)"
        " END"
    )
    zero = "named_struct('out', CAST(array() AS ARRAY<STRING>), 'hide', false)"
    return (
        f"aggregate({argv}, {zero},"
        f" (s, a) -> named_struct('out', concat(s.out, array({out})), 'hide', {hide}),"
        " s -> s.out)"
    )


# scheme://user:password@rest, the first of each separator after the one before it.
_URL = r"^((?:(?!://)[\s\S])*://)([^@:]*):[^@]*@"


def _flag_takes_next(secret) -> str:
    return (
        f"((startswith(a, '--') AND NOT contains(a, '=') AND {secret('a')})"
        f" OR (startswith(a, '-') AND NOT startswith(a, '--') AND {secret('a')}))"
    )


def cmdline(argv: str = "argv") -> str:
    """Arguments joined by spaces, cut to 200 bytes at a character border."""
    j = f"array_join({argv}, ' ')"
    fit = (
        f"element_at(filter(sequence({CMDLINE_BYTES}, {CMDLINE_BYTES // 4}, -1),"
        f" n -> octet_length(left({j}, n)) <= {CMDLINE_BYTES}), 1)"
    )
    return f"CASE WHEN octet_length({j}) <= {CMDLINE_BYTES} THEN {j} ELSE concat(left({j}, {fit}), '...') END"


def key_line(line: str) -> str:
    """One authorized_keys line as (parsed, options, type, comment). A key needs a body after its
    type, and may be preceded by options; anything else is a line sshd ignores."""
    t = f"filter(split({line}, '\\\\s+'), x -> x <> '')"
    types = ", ".join(X.quote(k) for k in KEY_TYPES)
    is_type = f"(x IN ({types}) OR startswith(x, 'sk-') OR startswith(x, 'ecdsa-'))"
    at = f"array_position(transform({t}, x -> {is_type}), true)"
    ok = f"({at} > 0 AND size({t}) > {at})"
    return (
        f"named_struct('parsed', {ok},"
        f" 'options', if({ok} AND {at} > 1, get({t}, 0), ''),"
        f" 'type', if({ok}, get({t}, CAST({at} - 1 AS INT)), ''),"
        f" 'comment', if({ok}, coalesce(get({t}, CAST({at} + 1 AS INT)), ''), ''))"
    )


def haystack(r: str = "record", host: str = "host") -> str:
    """Everything a search looks at, lower-cased: named fields only, so key names never match."""
    parts = [
        f"array({host}, {r}.severity, CAST({r}.score AS STRING), {r}.subject.comm, {r}.subject.exe,"
        f" {r}.subject.cmdline)",
        f"coalesce({r}.lineage, array())",
        f"coalesce(flatten(transform({r}.lineage_detail, n -> array(n.comm, n.exe, n.cmdline))),"
        " array())",
        f"coalesce(flatten(transform({r}.signals, g -> array(g.id, g.detail, g.cmdline))), array())",
        f"coalesce({r}.attack, array())",
        f"coalesce(flatten(transform({r}.yara, y -> concat(array(y.target, y.outcome),"
        " coalesce(y.rules, array())))), array())",
    ]
    joined = f"concat({', '.join(parts)})"
    return f"lower(array_join(filter({joined}, x -> x IS NOT NULL AND x <> ''), ' '))"


def matches_all(hay: str, query: str) -> str:
    terms = query.strip().lower().split()
    return " AND ".join(f"contains({hay}, {X.quote(t)})" for t in terms) or "true"


# --- alerts -------------------------------------------------------------------------------------


def alert_fields(r: str = "record") -> list[str]:
    return [
        f"coalesce({r}.severity, 'INFO') AS severity",
        f"coalesce({r}.score, 0L) AS score",
        f"coalesce({r}.subject.comm, 'incident') AS subject",
        f"coalesce({r}.subject.cmdline, '') AS cmdline",
        f"coalesce({r}.attack, CAST(array() AS ARRAY<STRING>)) AS attack",
    ]


def alert_summary() -> str:
    return (
        "concat(severity, ' ', score, '/100 on ', host, ' — ', subject,"
        " if(cmdline <> '', concat(': ', cmdline), ''),"
        " if(size(attack) > 0, concat(' [', array_join(attack, ', '), ']'), ''))"
    )


def syslog_priority() -> str:
    return (
        f"{SYSLOG_FACILITY * 8} + "
        "CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 4 ELSE 5 END"
    )


# --- durations ----------------------------------------------------------------------------------


def ago(secs: str) -> str:
    return (
        f"CASE WHEN {secs} < 60 THEN concat({secs}, 's ago')"
        f" WHEN {secs} < 3600 THEN concat({secs} DIV 60, 'm ago')"
        f" WHEN {secs} < 86400 THEN concat({secs} DIV 3600, 'h ago')"
        f" ELSE concat({secs} DIV 86400, 'd ago') END"
    )


def offset(ns: str) -> str:
    """Distance inside one incident."""
    return (
        f"CASE WHEN {ns} < 1000 THEN '+0ms'"
        f" WHEN {ns} < 1000000000 THEN concat('+', CAST(floor({ns} / 1e6 + 0.5) AS BIGINT), 'ms')"
        f" WHEN {ns} < 60000000000 THEN concat('+', format_number({ns} / 1e9, '0.00'), 's')"
        f" ELSE concat('+', CAST(floor({ns} / 6e10 + 0.5) AS BIGINT), 'm') END"
    )
