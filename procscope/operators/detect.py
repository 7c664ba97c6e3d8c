"""Built-in detectors: capture rows to signals.

Detectors that need only the event row are one projection. Those that ask about the process or its
ancestors share one lookup pass: the few event types concerned are joined with the ancestor closure
and resolved against process state as of the event.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.functions import events as X
from procscope.operators import graph

# Signal id -> technique ids.
ATTACK = {
    "suid_create": ["T1548.001"],
    "fileless_exec": ["T1620"],
    "privilege_escalation": ["T1068"],
    "setcap": ["T1548"],
    "ptrace_attach": ["T1055.008"],
    "cross_uid_proc_read": ["T1003", "T1552"],
    "ssh_private_key_read": ["T1003.008", "T1552.004"],
    "credential_store_read": ["T1003.008", "T1552.004"],
    "kernel_escape_hatch_write": ["T1611", "T1543"],
    "ldso_preload_write": ["T1543", "T1098"],
    "authorized_keys_write": ["T1543", "T1098"],
    "persistence_write": ["T1543", "T1098"],
    "cred_config_write": ["T1543", "T1098"],
    "sensitive_write": ["T1543", "T1098"],
    "module_autoload": ["T1547.006"],
    "module_load": ["T1547.006"],
    "namespace_escape": ["T1611"],
    "exec_from_tmp": ["T1036"],
    "shell_from_network_daemon": ["T1059.004"],
    "interpreter_from_network_daemon": ["T1059"],
    "socket_backed_shell": ["T1059.004", "T1571"],
    "unexpected_listener": ["T1571"],
    "runtime_socket_access": ["T1611"],
}
# Position of each exec detector among the signals of one event.
ORD_NAMESPACE, ORD_TMP, ORD_DAEMON, ORD_SOCKET = range(4)

SIGNAL_COLS = [
    "host", "seq", "ord", "id", "score", "attack", "detail", "ts_ns", "pid", "start", "target",
]


@dataclass(frozen=True)
class Settings:
    """Host facts and switches the detectors depend on."""

    host_mnt_ns: int | None = None  # one value for every host, or
    hosts: DataFrame | None = None  # (host, host_mnt_ns)
    strict_kernel_worker: bool = False
    chunk: int | None = None  # arrival numbers of a key that one task may hold

    @property
    def lookup(self) -> dict:
        """Plan options of state lookups."""
        return {"size": self.chunk}


def _signal(
    ordinal: int, id_: str, score: int | str, detail: str, target: str | None = None
) -> str:
    target = "CAST(NULL AS STRING)" if target is None else f"nullif({target}, '')"
    return (
        f"named_struct('ord', {ordinal}, 'id', {id_}, 'score', CAST({score} AS BIGINT),"
        f" 'detail', {detail}, 'target', {target})"
    )


def attack_of(id_: str = "id", extra: dict[str, list[str]] | None = None) -> str:
    def techniques(v: list[str]) -> str:
        return "array(" + ", ".join(X.quote(t) for t in v) + ")"

    table = {**ATTACK, **(extra or {})}
    arms = " ".join(
        f"WHEN {X.quote(k)} THEN CAST({techniques(v)} AS ARRAY<STRING>)" for k, v in table.items()
    )
    return f"CASE {id_} {arms} ELSE CAST(array() AS ARRAY<STRING>) END"


def escalates() -> str:
    """A process that was not root became root or gained a dangerous capability."""
    return (
        "(uid <> 0 AND ((old_euid <> 0 AND euid = 0)"
        f" OR {X.dangerous_caps_gained()} <> 0))"
    )


def _escalation_detail() -> str:
    gained = X.dangerous_caps_gained()
    return (
        "concat_ws('; ', CASE WHEN old_euid <> 0 AND euid = 0 THEN"
        " concat('changed euid ', old_euid, ' -> 0') END,"
        f" CASE WHEN {gained} <> 0 THEN"
        f" concat('gained ', array_join({X.cap_names(gained)}, ',')) END)"
    )


def _write_signal() -> str:
    hatch = f"(escape_target OR {X.is_kernel_hatch()})"
    outcome = "CASE WHEN denied THEN 'BLOCKED: ' WHEN would_deny THEN 'would be blocked: ' ELSE '' END"
    detail = (
        "CASE WHEN container = '' THEN"
        " concat('wrote ', filename, ', which the kernel executes as root')"
        f" ELSE concat({outcome}, 'container ', container, ' wrote ', filename,"
        " ', which the kernel executes as root on the host (escape)') END"
    )
    kinds = [
        ("contains(filename, 'ld.so.preload')", "ldso_preload_write", 40),
        ("contains(filename, 'authorized_keys')", "authorized_keys_write", 35),
        (
            "(contains(filename, '/etc/cron') OR contains(filename, 'systemd')"
            f" OR {X.runs_at_login()})",
            "persistence_write",
            30,
        ),
        (
            X.contains_any("filename", ["sudoers", "/etc/shadow", "/etc/pam."]),
            "cred_config_write",
            35,
        ),
    ]
    id_ = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in kinds)
    score = "CASE " + " ".join(f"WHEN {t} THEN {p}" for t, _, p in kinds)
    hatch_signal = _signal(
        0,
        "'kernel_escape_hatch_write'",
        "CASE WHEN container = '' THEN 45 ELSE 75 END",
        detail,
        "filename",
    )
    plain = _signal(
        0,
        f"{id_} ELSE 'sensitive_write' END",
        f"{score} ELSE 20 END",
        "concat('wrote to ', filename)",
    )
    return f"CASE WHEN {hatch} THEN {hatch_signal} ELSE {plain} END"


@cache
def _row_tests() -> list[tuple[str, str]]:
    """(test, signal) for every detector the event row alone decides."""
    socket_detail = (
        "CASE WHEN container = '' THEN"
        " concat('connected to the container runtime socket ', filename)"
        " ELSE concat('container ', container, ' connected to the host runtime socket ', filename,"
        " ' (escape primitive)') END"
    )
    in_host_ns = (
        "(coalesce(host_mnt_ns, 0) <> 0 AND mnt_ns <> 0 AND container <> ''"
        " AND mnt_ns = host_mnt_ns)"
    )
    return [
        (
            f"type = {S.MODE}",
            _signal(
                0,
                "'suid_create'",
                45,
                f"concat('created a new ', {X.gained_bits()}, ' binary ', filename)",
                "filename",
            ),
        ),
        (
            f"type = {S.ANON}",
            _signal(
                0,
                "'fileless_exec'",
                45,
                f"concat('executed from ', {X.exec_source()}, ' (', filename, ')')",
                "concat('/proc/', tgid, '/exe')",
            ),
        ),
        (
            f"type = {S.CRED} AND {escalates()}",
            _signal(0, "'privilege_escalation'", 40, _escalation_detail()),
        ),
        (
            f"type = {S.SETCAP}",
            _signal(
                0, "'setcap'", 40, "concat('set file capabilities on ', filename)", "filename"
            ),
        ),
        (
            f"type = {S.PTRACE} AND {X.is_attach()}",
            _signal(
                0, "'ptrace_attach'", 30, "concat('ptrace-attached to pid ', target_pid)"
            ),
        ),
        (f"type = {S.OPEN} AND {X.opened_for_write()}", _write_signal()),
        (
            f"type = {S.CONNECT}",
            _signal(
                0,
                "'runtime_socket_access'",
                "CASE WHEN container = '' THEN 25 ELSE 60 END",
                socket_detail,
            ),
        ),
        (
            f"type = {S.EXEC} AND {in_host_ns}",
            _signal(
                ORD_NAMESPACE,
                "'namespace_escape'",
                70,
                "concat('container ', container, ' is executing in the host mount namespace"
                " (mnt_ns ', host_mnt_ns, ')')",
                "filename",
            ),
        ),
        (
            f"type = {S.EXEC} AND {X.in_volatile_dir()}",
            _signal(
                ORD_TMP,
                "'exec_from_tmp'",
                20,
                "concat('executed from a volatile directory: ', filename)",
                "filename",
            ),
        ),
        (
            f"type = {S.EXEC} AND socket_stdio AND {X.is_shell()}",
            _signal(
                ORD_SOCKET,
                "'socket_backed_shell'",
                70,
                f"concat({X.basename('filename')}, ' was exec\\'d with a network socket on its"
                " standard descriptors (reverse shell)')",
            ),
        ),
    ]


def row_test() -> str:
    return X.any_of([f"({t})" for t, _ in _row_tests()])


def needs_state() -> str:
    return (
        f"((type = {S.OPEN} AND NOT {X.opened_for_write()})"
        f" OR (type = {S.PTRACE} AND NOT {X.is_attach()})"
        f" OR type IN ({S.MODULE}, {S.LISTEN})"
        f" OR (type = {S.EXEC} AND ({X.is_shell()} OR {X.is_interpreter()})))"
    )


def with_host_ns(capture: DataFrame, st: Settings) -> DataFrame:
    if st.hosts is not None:
        # One row per host: small next to the capture, and AQE checks its size before broadcasting.
        return capture.join(st.hosts.select("host", "host_mnt_ns"), "host", "left")
    return capture.withColumn("host_mnt_ns", F.lit(st.host_mnt_ns or 0).cast("long"))


def may_signal(capture: DataFrame, st: Settings) -> DataFrame:
    """Events that yield a signal or need a state lookup to decide."""
    return with_host_ns(capture, st).filter(f"{row_test()} OR {needs_state()}")


def detect_rows(capture: DataFrame, st: Settings) -> DataFrame:
    """Signals of the detectors that look at the event row only."""
    options = ", ".join(f"CASE WHEN {t} THEN {s} END" for t, s in _row_tests())
    d = with_host_ns(capture, st).filter(row_test())
    return _finish(
        d.selectExpr(
            "host", "seq", "ts_ns", "tgid", "start_boottime",
            f"explode(array_compact(array({options}))) AS sig",
        )
    )


def _finish(d: DataFrame) -> DataFrame:
    return d.selectExpr(
        "host", "seq", "sig.ord AS ord", "sig.id AS id", "sig.score AS score",
        f"{attack_of('sig.id')} AS attack", "sig.detail AS detail", "ts_ns", "tgid AS pid",
        "start_boottime AS start", "sig.target AS target",
    )


def detect_in_context(
    capture: DataFrame, states: DataFrame, reach: DataFrame, st: Settings
) -> DataFrame:
    """Signals of the detectors that depend on process state or ancestry.

    ``reach`` must cover the process of every event concerned.
    """
    own = ["type", "ts_ns", "filename", "comm", "aux", "target_pid"]
    ev = capture.filter(needs_state()).selectExpr(
        "host", "seq", "tgid AS pid", "start_boottime AS start", *[f"{c} AS e_{c}" for c in own]
    )
    daemon = f"({X.is_network_daemon()} OR {X.looks_like_daemon()})"
    worker = X.is_kernel_worker("comm", st.strict_kernel_worker)
    # An ancestor counts only if it is the target, or a daemon or kernel worker at that moment. Few
    # processes ever have such a name, so nearly all ancestors go before events meet them.
    named = states.filter(f"{daemon} OR {worker}").selectExpr(
        "host", "pid AS apid", "start AS astart"
    ).distinct()
    up = reach.filter("depth > 0")
    far = graph.lineage_rows(
        ev.filter(f"e_type IN ({S.MODULE}, {S.EXEC})"),
        up.join(named, ["apid", "astart", "host"], "left_semi"),
    )
    traced = ev.filter(f"e_type = {S.PTRACE}").join(
        up.selectExpr("*", "apid AS e_target_pid"), [*S.KEY, "e_target_pid"]
    ).filter("vf <= seq AND seq < vt")
    here = ev.selectExpr("*", "pid AS apid", "start AS astart", "0 AS depth")
    cols = here.columns
    lk = here.unionByName(far.select(*cols)).unionByName(traced.select(*cols)).selectExpr(
        "host", "apid AS pid", "astart AS start", "seq", "pid AS s_pid", "start AS s_start",
        "depth", *[f"e_{c}" for c in own],
    )
    a = graph.state_asof(lk, states, ("comm", "exe", "trusted"), **st.lookup)
    who = "concat(if(trusted = '', comm, trusted), '(', pid, ')')"
    a = a.groupBy("seq", "host", "s_pid", "s_start", *[f"e_{c}" for c in own]).agg(
        F.expr("max(CASE WHEN depth = 0 THEN trusted END) AS trusted"),
        F.expr("max(CASE WHEN depth = 0 THEN exe END) AS exe"),
        F.expr(f"min_by({who}, CASE WHEN known AND {daemon} THEN depth END) AS daemon"),
        F.expr(f"bool_or(known AND {worker}) AS kernel"),
        F.expr("bool_or(known AND pid = e_target_pid) AS in_lineage"),
    )
    key_path = "(contains(e_filename, 'ssh_host_') OR contains(e_filename, '/.ssh/id_'))"
    shell = X.is_shell("e_filename")
    base = X.basename("e_filename")
    listener = X.basename("CASE WHEN exe <> '' THEN exe ELSE e_comm END")
    arms = [
        (
            f"e_type = {S.OPEN} AND NOT {X.is_credential_reader()}",
            _signal(
                0,
                f"if({key_path}, 'ssh_private_key_read', 'credential_store_read')",
                f"if({key_path}, 35, 30)",
                f"concat(if({key_path}, 'read an SSH private key: ',"
                " 'read the credential store: '), e_filename)",
                "e_filename",
            ),
        ),
        (
            f"e_type = {S.PTRACE} AND NOT in_lineage",
            _signal(
                0,
                "'cross_uid_proc_read'",
                25,
                "concat('read an unrelated process\\'s memory (pid ', e_target_pid, ')')",
            ),
        ),
        (
            f"e_type = {S.MODULE}",
            _signal(
                0,
                "if(kernel, 'module_autoload', 'module_load')",
                "if(kernel, 10, 50)",
                "CASE WHEN kernel THEN concat('kernel autoloaded module ', e_filename,"
                " ' on demand (request_module)')"
                " ELSE concat('loaded kernel module ', e_filename) END",
                "e_filename",
            ),
        ),
        (
            f"e_type = {S.LISTEN} AND NOT {X.is_network_daemon()}",
            _signal(
                0,
                "'unexpected_listener'",
                25,
                f"concat({listener}, ' opened a listening port (', e_aux, ')')",
            ),
        ),
        (
            f"e_type = {S.EXEC} AND daemon IS NOT NULL",
            _signal(
                ORD_DAEMON,
                f"if({shell}, 'shell_from_network_daemon', 'interpreter_from_network_daemon')",
                f"if({shell}, 50, 25)",
                f"concat(daemon, if({shell}, ' spawned a shell (', ' spawned an interpreter ('),"
                f" {base}, ')')",
            ),
        ),
    ]
    sig = "CASE " + " ".join(f"WHEN {t} THEN {s}" for t, s in arms) + " END"
    return _finish(
        a.selectExpr(
            "host", "seq", "e_ts_ns AS ts_ns", "s_pid AS tgid", "s_start AS start_boottime",
            f"{sig} AS sig",
        ).filter("sig IS NOT NULL")
    )


def signals(
    capture: DataFrame,
    st: Settings = Settings(),
    states: DataFrame | None = None,
    reach: DataFrame | None = None,
) -> DataFrame:
    """Every built-in signal of a capture."""
    if states is None:
        states = graph.state_rows(capture)
    if reach is None:
        seeds = capture.filter(needs_state()).select(
            "host", F.col("tgid").alias("pid"), F.col("start_boottime").alias("start")
        )
        reach = graph.closure(
            graph.edge_intervals(graph.edges(capture), st.chunk), seeds.distinct()
        )
    return detect_rows(capture, st).unionByName(detect_in_context(capture, states, reach, st))
