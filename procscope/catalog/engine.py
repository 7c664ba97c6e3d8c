"""Graph, trust, detectors, scoring, baselines, budget, rules and composite queries (D to L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procscope import schema as S
from procscope.catalog.base import EXTRA, Inputs, query
from procscope.catalog.oracle_base import DETECTORS, FAMILY, ROOT_DAEMONS, score_ctes, sql
from procscope.catalog.rows import (
    ATTACK_SQL, DETAIL_SQL, LEARNED, SNAP, TECHNIQUE_SQL, snapshot,
)
from procscope.functions import events as X
from procscope.operators import baseline as B
from procscope.operators import content, detect, graph, records, rules, score, trust
from procscope.plans.replay import replay
from procscope.session import materialize


def _e(text: str):
    return F.expr(text)


# --- D: graph -----------------------------------------------------------------------------------


@query(
    "d01_lineage",
    sql(
        "SELECT host, seq, pid, start, depth::BIGINT AS depth, apid, astart, acomm AS comm FROM path"
        " WHERE known"
    ),
)
def d01(i: Inputs):
    subjects = i.cap.filter("type NOT IN (2, 3)").selectExpr(
        "host", "tgid AS pid", "start_boottime AS start", "seq"
    )
    return graph.ancestry(i.cap, subjects, 64).selectExpr(
        "host", "seq", "pid", "start", "CAST(depth AS BIGINT) AS depth", "apid", "astart", "comm"
    )


@query(
    "d02_state_as_of",
    sql(
        """SELECT c.host, c.seq, coalesce(x.comm, b.first_comm) AS comm, coalesce(x.exe, '') AS exe,
 coalesce(x.trusted, '') AS trusted, CASE WHEN bx.box_seq <= c.seq THEN bx.box ELSE '' END AS container,
 coalesce(k.uid, 0) AS uid, coalesce(k.euid, 0) AS euid
FROM cap c
ASOF LEFT JOIN execs x ON x.host = c.host AND x.pid = c.pid AND x.start = c.start AND c.seq >= x.seq
ASOF LEFT JOIN (SELECT host, pid, start, seq, uid, euid FROM touch WHERE has_cred) k
  ON k.host = c.host AND k.pid = c.pid AND k.start = c.start AND c.seq >= k.seq
LEFT JOIN born b ON b.host = c.host AND b.pid = c.pid AND b.start = c.start
LEFT JOIN boxed bx ON bx.host = c.host AND bx.pid = c.pid AND bx.start = c.start"""
    ),
)
def d02(i: Inputs):
    lk = i.cap.selectExpr("host", "tgid AS pid", "start_boottime AS start", "seq")
    # The multi-chunk plan on purpose, with chunks small enough to be crossed often.
    return graph.state_asof(
        lk, i.states, ("comm", "exe", "trusted", "container", "uid", "euid"), 64
    ).select("host", "seq", "comm", "exe", "trusted", "container", "uid", "euid")


@query("d03_fork_edges", sql("SELECT host, pid, start, ppid, pstart, vf FROM edge"))
def d03(i: Inputs):
    return graph.edge_intervals(graph.edges(i.cap), 1000).selectExpr(
        "host", "pid", "start", "apid AS ppid", "astart AS pstart", "vf"
    )


FIRST_KEY = """
SELECT host, pid, arg_min(start, seq) AS first_start FROM (
 SELECT host, seq, pid, start FROM cap WHERE type IN (1, 2, 3, 4)
 UNION ALL SELECT host, seq, child_pid, child_start FROM cap WHERE type = 3) GROUP BY ALL"""


@query(
    "d04_snapshot_reconcile",
    sql(
        "SELECT s.host, s.pid, s.start, abs(f.first_start - s.start) <= 20000000 AS adopted,"
        " CASE WHEN abs(f.first_start - s.start) <= 20000000 THEN f.first_start ELSE s.start END AS exact_start"
        " FROM snap s JOIN firsts f ON f.host = s.host AND f.pid = s.pid"
        " UNION ALL SELECT s.host, s.pid, s.start, false, s.start FROM snap s"
        " WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.host = s.host AND f.pid = s.pid)",
        {**SNAP, "firsts": FIRST_KEY},
    ),
)
def d04(i: Inputs):
    return graph.reconcile(snapshot(i), i.cap).select(
        "host", "pid", "start", "adopted", "exact_start"
    )


@query(
    "d05_snapshot_edges",
    sql(
        "SELECT c.host, c.pid, c.start, p.pid AS parent_pid, p.start AS parent_start FROM snap c"
        " JOIN snap p ON p.host = c.host AND p.pid = c.ppid",
        SNAP,
    ),
)
def d05(i: Inputs):
    return graph.snapshot_edges(snapshot(i))


TRUST_SQL = {
    "runs": """
SELECT host, seq, filename, u % 5 AS exe_dev,
 CASE WHEN u % 13 = 0 THEN 0 ELSE 100 + (u % 2) * 10 END AS exe_ino FROM cap WHERE type = 1""",
    "bindings": """
SELECT h.host, p.name, p.path, p.dev, p.ino, p.valid_from, p.valid_to
FROM (SELECT DISTINCT host FROM cap) h,
 (VALUES ('sudo', '/usr/bin/sudo', 1, 100, 0, 50), ('sudo', '/usr/bin/sudo', 1, 110, 50, 9000000000),
         ('nginx', '/usr/sbin/nginx', 9, 100, 0, 9000000000)) p(name, path, dev, ino, valid_from, valid_to)""",
}


@query(
    "d06_executable_trust",
    sql(
        """SELECT r.host, r.seq, coalesce(
 (SELECT min(name) FROM bindings k WHERE k.host = r.host AND k.dev = r.exe_dev AND k.ino = r.exe_ino
   AND r.exe_ino <> 0 AND k.valid_from <= r.seq AND r.seq < k.valid_to),
 (SELECT min(name) FROM bindings k WHERE k.host = r.host AND k.path = r.filename AND k.ino = r.exe_ino
   AND r.exe_ino <> 0 AND k.valid_from <= r.seq AND r.seq < k.valid_to), '') AS exe_trusted
FROM runs r""",
        TRUST_SQL,
    ),
)
def d06(i: Inputs):
    runs = i.cap.filter("type = 1").selectExpr(
        "host", "seq", "filename", "(tgid - 1000000) DIV 50 AS u"
    ).selectExpr(
        "host", "seq", "filename", "u % 5 AS exe_dev",
        "if(u % 13 = 0, 0L, 100 + u % 2 * 10) AS exe_ino",
    )
    table = (
        "array(named_struct('name', 'sudo', 'path', '/usr/bin/sudo', 'dev', 1L, 'ino', 100L,"
        " 'valid_from', 0L), named_struct('name', 'sudo', 'path', '/usr/bin/sudo', 'dev', 1L,"
        " 'ino', 110L, 'valid_from', 50L), named_struct('name', 'nginx', 'path',"
        " '/usr/sbin/nginx', 'dev', 9L, 'ino', 100L, 'valid_from', 0L))"
    )
    known = i.cap.select("host").distinct().selectExpr("host", f"inline({table})").selectExpr(
        "host", "name", "path", "path AS real_path", "dev", "ino", "valid_from"
    )
    return trust.resolve(runs, known).select("host", "seq", "exe_trusted")


def _of(i: Inputs, *ids: str):
    return i.signals.filter(F.col("id").isin(*ids))


@query(
    "d07_nearest_daemon",
    sql("SELECT host, seq, who AS daemon FROM around WHERE daemon AND EXISTS (SELECT 1 FROM cap c WHERE"
        " c.host = around.host AND c.seq = around.seq AND c.type = 1 AND c.filename IN ('/bin/sh','/bin/bash'))"),
)
def d07(i: Inputs):
    return _of(i, "shell_from_network_daemon").selectExpr(
        "host", "seq", "split_part(detail, ' ', 1) AS daemon"
    )


@query(
    "d08_in_lineage_reads",
    sql("SELECT host, seq, target_pid, list_contains(pids, target_pid) AS inside FROM seen"
        " WHERE type = 8 AND (aux & 2) = 0"),
)
def d08(i: Inputs):
    fired = _of(i, "cross_uid_proc_read").selectExpr("host", "seq", "true AS fired")
    return i.cap.filter("type = 8 AND (aux & 2) = 0").join(fired, ["host", "seq"], "left").selectExpr(
        "host", "seq", "target_pid", "fired IS NULL AS inside"
    )


@query(
    "d09_reader_suppression",
    sql("SELECT host, seq, trusted IN ('sudo', 'sshd') AS suppressed FROM seen"
        " WHERE type = 5 AND (file_mode & 2) = 0"),
)
def d09(i: Inputs):
    fired = _of(i, "credential_store_read", "ssh_private_key_read").selectExpr(
        "host", "seq", "true AS fired"
    )
    return i.cap.filter("type = 5 AND (file_mode & 2) = 0").join(
        fired, ["host", "seq"], "left"
    ).selectExpr("host", "seq", "fired IS NULL AS suppressed")


@query("d10_kernel_initiated", sql("SELECT host, seq, kernel FROM seen WHERE type = 10"))
def d10(i: Inputs):
    return _of(i, "module_autoload", "module_load").selectExpr(
        "host", "seq", "id = 'module_autoload' AS kernel"
    )


# Entries seen at least twice, by program; confidence as published: ln1p support times recurrence.
CONF_SQL = {
    **LEARNED,
    "learned": "SELECT signal, exe, count(*) AS cnt, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,"
    " (SELECT max(ts_ns) - min(ts_ns) FROM cap) AS win FROM exe_at GROUP BY ALL",
    "conf": "SELECT *, least(ln(1 + cnt) / ln(9), 1.0) * (0.5 + 0.5 * ((last_ns - first_ns) / win))"
    " AS c FROM learned",
}
ADJUSTED = {
    **CONF_SQL,
    "filed2": """
SELECT f.* REPLACE (CASE WHEN k.c IS NOT NULL THEN round(f.score * (1 - k.c * 0.9))::BIGINT
                    ELSE f.score END AS score)
FROM filed f
ASOF LEFT JOIN execs x ON x.host = f.host AND x.pid = f.apid AND x.start = f.astart AND f.seq >= x.seq
LEFT JOIN conf k ON k.signal = f.id AND k.exe = x.exe""",
    **score_ctes("filed2", "b"),
}


def _baseline(i: Inputs) -> B.Baseline:
    return B.learn(i.cap, i.signals, i.states, 1_700_000_000_000)


@query(
    "d11_baseline_adjust",
    sql(
        "SELECT host, seq, pid, total AS score, severity FROM binc",
        ADJUSTED,
    ),
)
def d11(i: Inputs):
    r = replay(i.cap, i.settings, "info", baseline=_baseline(i))
    return r.incidents.selectExpr("host", "seq", "pid", "total AS score", "severity")


@query(
    "d15_forest",
    sql(
        """SELECT host, pid, start, max(depth)::BIGINT AS depth, max_by(apid, depth) AS root,
 string_agg(apid::VARCHAR, '/' ORDER BY depth DESC) AS path
FROM (SELECT * FROM anc WHERE (host, pid, start) IN (SELECT (host, pid, start) FROM nodes)) GROUP BY ALL""",
        {"nodes": "SELECT DISTINCT host, pid, start FROM cap WHERE type <> 3"},
    ),
)
def d15(i: Inputs):
    nodes = i.states.select(*S.KEY).distinct()
    links = graph.edges(i.cap).selectExpr(
        *S.KEY, "parent.pid AS parent_pid", "parent.start AS parent_start"
    )
    f = graph.forest(nodes, links, paths=True).join(i.acting, S.KEY, "left_semi")
    return f.selectExpr(
        *S.KEY, "CAST(depth AS BIGINT) AS depth", "root.pid AS root",
        "array_join(transform(path, p -> CAST(p.pid AS STRING)), '/') AS path",
    )


# --- E: one query per detector -------------------------------------------------------------------


def _register_detector(number: int, id_: str) -> None:
    text = (
        "SELECT host, seq, ord::BIGINT AS ord, score, pid, start, ts_ns, detail, target FROM sig"
        f" WHERE id = '{id_}'"
    )

    @query(f"e{number:02d}_{id_}", sql(text))
    def run(i: Inputs):
        return _of(i, id_).selectExpr(
            "host", "seq", "CAST(ord AS BIGINT) AS ord", "score", "pid", "start", "ts_ns", "detail",
            "target",
        )


for _n, _d in enumerate(DETECTORS, 1):
    _register_detector(_n, _d[0])


# --- F, G, H, I: aggregation, windows, order -----------------------------------------------------


@query(
    "f01_collapse",
    sql("SELECT host, pid, start, id, score, seq, ts_ns FROM imp"),
)
def f01(i: Inputs):
    return i.run.improving.selectExpr(
        "host", "bpid AS pid", "bstart AS start", "id", "score", "vf AS seq", "ts_ns"
    )


@query(
    "f02_lineage_score",
    sql("SELECT host, seq, pid, base, chain, total FROM inc"),
)
def f02(i: Inputs):
    return i.run.incidents.select("host", "seq", "pid", "base", "chain", "total")


@query(
    "f02b_every_evaluation",
    sql("SELECT host, seq, pid, start, base, chain, total, round(mult, 6) AS mult FROM scored"),
)
def f02b(i: Inputs):
    """All evaluations, not only those that can change the outcome."""
    r = i.run
    ev = r.signals.selectExpr("host", "bpid AS pid", "bstart AS start", "seq").distinct()
    scored, _ = score.score_candidates(
        ev, r.improving, r.reach, r.states, None, r.settings.lookup, flags=r.flags
    )
    return scored.selectExpr(
        "host", "seq", "pid", "start", "base", "chain", "total", "round(mult, 6) AS mult"
    )


@query(
    "f02c_context",
    sql("SELECT i.host, i.seq, round(i.mult, 6) AS mult, c.rooted, c.boxed FROM inc i JOIN ctx c"
        " ON c.host = i.host AND c.seq = i.seq"),
)
def f02c(i: Inputs):
    return i.run.incidents.selectExpr(
        "host", "seq", "round(mult, 6) AS mult",
        "coalesce(contains(note, 'network daemon'), false) AS rooted",
        "coalesce(contains(note, 'container'), false) AS boxed",
    )


@query(
    "f03_techniques",
    sql(
        f"SELECT host, seq, string_agg(DISTINCT t, ',' ORDER BY t) AS attack FROM"
        f" (SELECT f.host, f.seq, unnest({ATTACK_SQL}) AS t FROM filed f"
        " JOIN inc i ON i.host = f.host AND i.seq = f.seq) GROUP BY ALL"
    ),
)
def f03(i: Inputs):
    return records.techniques(records.evidence(i.run)).selectExpr(
        "host", "seq", "array_join(attack, ',') AS attack"
    )


@query(
    "f04_baseline_learn",
    sql("SELECT signal, exe, cnt AS count, first_ns, last_ns FROM learned", CONF_SQL),
)
def f04(i: Inputs):
    return _baseline(i).entries


@query(
    "f05_confidence",
    sql(
        "SELECT signal, exe, round(c * f, 8) AS confidence, round(1 - c * f * 0.9, 8) AS factor,"
        " c * f >= 0.75 AS strong FROM conf, (SELECT 1 - (30.0 - 14) / 76 AS f)",
        CONF_SQL,
    ),
)
def f05(i: Inputs):
    b = _baseline(i)
    b.evaluate_at_ms = 1_700_000_000_000 + 30 * 86_400_000
    return B.weights(b).selectExpr(
        "signal", "exe", "round(confidence, 8) AS confidence", "round(factor, 8) AS factor",
        "confidence >= 0.75D AS strong",
    )


@query(
    "f06_alert_budget",
    sql(
        """SELECT f.floor, count(i.rank) AS incidents,
 round(count(i.rank) / ((SELECT (max(ts_ns) - min(ts_ns)) / 1e9 FROM cap) / 86400), 4) AS per_day,
 (SELECT count(*) FROM binc b WHERE b.rank >= f.r) AS with_baseline
FROM (VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) f(floor, r)
LEFT JOIN inc i ON i.rank >= f.r GROUP BY f.floor, f.r""",
        ADJUSTED,
    ),
)
def f06(i: Inputs):
    stats = records.capture_stats(i.cap)
    plain = records.floors(i.run.incidents, stats)
    with_b = replay(i.cap, i.settings, "info", baseline=_baseline(i)).incidents
    b = records.floors(with_b, stats).selectExpr("floor", "incidents AS with_baseline")
    return plain.join(b, "floor").selectExpr(
        "floor", "incidents", "round(per_day, 4) AS per_day", "with_baseline"
    )


@query(
    "f07_offenders",
    sql(
        """SELECT * FROM (SELECT 'signal' AS kind, f.id AS name, count(*) AS count FROM filed f
 JOIN inc i ON i.host = f.host AND i.seq = f.seq WHERE i.rank >= 2 GROUP BY ALL
 ORDER BY count DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'subject', CASE WHEN p.aexe <> '' THEN p.aexe ELSE p.acomm END AS name,
 count(*) AS count FROM inc i JOIN path p ON p.host = i.host AND p.seq = i.seq AND p.depth = 0
 WHERE i.rank >= 2 GROUP BY ALL ORDER BY count DESC, name LIMIT 10)"""
    ),
)
def f07(i: Inputs):
    inc = i.run.incidents.filter("rank >= 2")
    ev = records.evidence(i.run, inc)
    a = records.offenders(ev, "id", 10).selectExpr("'signal' AS kind", "name", "count")
    b = records.offenders(records.subject_names(i.run, inc), "subject", 10)
    return a.unionByName(b.selectExpr("'subject' AS kind", "name", "count"))


@query(
    "f12_capture_stats",
    sql(
        "SELECT count(*) AS events, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,"
        " (max(ts_ns) - min(ts_ns)) / 1e9 AS duration_secs,"
        " round(count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9), 8) AS events_per_sec,"
        " (SELECT count(*) FROM (SELECT DISTINCT host, pid, start FROM touch)) AS nodes,"
        " (SELECT count(*) FROM (SELECT DISTINCT host, pid, start FROM touch) t WHERE NOT EXISTS"
        " (SELECT 1 FROM cap c WHERE c.type = 2 AND c.host = t.host AND c.pid = t.pid"
        " AND c.start = t.start)) AS alive,"
        " (SELECT count(*) FROM (SELECT host, pid, start, max(ts_ns) AS exited FROM cap WHERE type = 2 GROUP BY ALL) x"
        " JOIN (SELECT host, max(ts_ns) AS now FROM cap GROUP BY ALL) m ON m.host = x.host"
        " WHERE now - exited > 300000000000) AS reaped FROM cap"
    ),
)
def f12(i: Inputs):
    s = records.capture_stats(i.cap)
    nodes = records.graph_stats(i.states, i.cap, 300_000_000_000)
    return s.crossJoin(nodes).selectExpr(
        "events", "first_ns", "last_ns", "duration_secs",
        "round(events_per_sec, 8) AS events_per_sec", "nodes", "alive", "reaped",
    )


@query("g01_emission", sql("SELECT host, seq, pid, start, rank::BIGINT AS rank, severity FROM inc"))
def g01(i: Inputs):
    return i.run.incidents.selectExpr(
        "host", "seq", "pid", "start", "CAST(rank AS BIGINT) AS rank", "severity"
    )


@query(
    "g04_credential_history",
    sql(
        "SELECT host, pid, start, seq, uid, euid, n FROM (SELECT *, row_number() OVER"
        " (PARTITION BY host, pid, start ORDER BY seq) AS n FROM cap WHERE type = 4)"
    ),
)
def g04(i: Inputs):
    return records.credential_history(i.cap).selectExpr(
        "host", "pid", "start", "seq", "uid", "euid", "CAST(n AS BIGINT) AS n"
    )


@query(
    "h01_signal_order",
    sql(
        "SELECT f.host, f.seq, string_agg(f.id, ',' ORDER BY f.ts_ns, f.depth, f.iseq, f.iord) AS ids"
        " FROM (SELECT f.* REPLACE ((SELECT min(s.seq) FROM sig s WHERE s.host = f.host AND"
        " s.pid = f.apid AND s.start = f.astart AND s.id = f.id) AS iseq) FROM filed f) f"
        " JOIN inc i ON i.host = f.host AND i.seq = f.seq GROUP BY ALL"
    ),
)
def h01(i: Inputs):
    return i.records.selectExpr(
        "host", "seq", "array_join(transform(record.signals, s -> s.id), ',') AS ids"
    )


TARGETS_SQL = (
    "SELECT host, seq, target, arg_min(id, (ts_ns, depth, iseq)) AS signal FROM"
    " (SELECT f.* REPLACE ((SELECT min(s.seq * 1024 + s.ord) FROM sig s WHERE s.host = f.host AND"
    " s.pid = f.apid AND s.start = f.astart AND s.id = f.id) AS iseq) FROM filed f"
    " JOIN inc i ON i.host = f.host AND i.seq = f.seq) WHERE target IS NOT NULL GROUP BY ALL"
)


@query("i02_scan_targets", sql(TARGETS_SQL))
def i02(i: Inputs):
    return content.targets(records.evidence(i.run)).select("host", "seq", "target", "signal")


@query(
    "d14_content_identification",
    """WITH want AS (SELECT DISTINCT doc_id AS target FROM documents UNION
   SELECT DISTINCT conv_id + 100000000 FROM conversations),
 hits AS (SELECT d.doc_id AS target, string_agg('rule-' || b.item_id, ',' ORDER BY 'rule-' || b.item_id)
   AS rules FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY ALL)
SELECT w.target::VARCHAR AS target, CASE WHEN coalesce(d.text, '') = '' THEN 'raced'
   WHEN h.rules IS NOT NULL THEN 'matched' ELSE 'clean' END AS outcome, h.rules
FROM want w LEFT JOIN documents d ON d.doc_id = w.target LEFT JOIN hits h ON h.target = w.target""",
)
def d14(i: Inputs):
    # Every other body is no valid text; a third of the signatures each is literal, hex and regex.
    contents = i.table("documents").selectExpr(
        "CAST(doc_id AS STRING) AS target",
        "CASE WHEN doc_id % 2 = 1 AND text <> '' THEN unhex(concat('FFFE80', hex(encode(text, 'UTF-8'))))"
        " ELSE encode(text, 'UTF-8') END AS body",
    )
    sigs = i.table("benchmark").selectExpr(
        "concat('rule-', item_id) AS rule",
        "CASE item_id % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'hex' ELSE 'regex' END AS kind",
        "CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN hex(encode(text, 'UTF-8'))"
        " ELSE concat('\\\\Q', text, '\\\\E') END AS pattern",
    )
    # Text that only half-byte offsets would give, which must not match.
    sigs = sigs.unionByName(
        i.table("benchmark").selectExpr(
            "concat('half-', item_id) AS rule", "'hex' AS kind",
            "substring(hex(encode(text, 'UTF-8')), 2, 24) AS pattern",
        )
    )
    gone = i.table("conversations").selectExpr("conv_id + 100000000 AS t").distinct()
    want = contents.select("target").distinct().unionByName(
        gone.selectExpr("CAST(t AS STRING) AS target")
    )
    return content.identify(want, contents, sigs).selectExpr(
        "target", "outcome", "array_join(rules, ',') AS rules"
    )


# --- J: rules ------------------------------------------------------------------------------------

MATCH_RULES = [
    rules.parse_rule(
        {"name": "usr_exec", "id": "R-1", "score": 30, "attack": ["T1036"],
         "match": {"event": "exec", "filename_prefix": "/usr/", "in_container": False}}
    ),
    rules.parse_rule(
        {"name": "memfd", "score": 22, "match": {"event": "exec_anon", "exec_source": "memfd"}}
    ),
    rules.parse_rule(
        {"name": "became_root", "score": 15, "match": {"event": "cred_change", "to_root": True}}
    ),
]
SEQUENCES = {
    "lineage": rules.parse_rule(
        {"name": "escalate_then_suid", "id": "R-7", "score": 55, "attack": ["T1068", "T1548.001"],
         "scope": "same_lineage", "within": "600s",
         "sequence": [{"event": "cred_change", "to_root": True},
                      {"event": "file_mode", "gained_suid": True}]}
    ),
    "process": rules.parse_rule(
        {"name": "cred_then_open", "score": 25, "within": "200s",
         "sequence": [{"event": "cred_change"}, {"event": "file_open"}]}
    ),
    "overlap": rules.parse_rule(
        {"name": "three_execs", "score": 25, "within": "20m", "scope": "same_lineage",
         "sequence": [{"event": "exec"}, {"event": "exec"}, {"event": "exec_anon"}]}
    ),
}


@query(
    "j01_match_rules",
    sql(
        "SELECT host, seq, 'R-1' AS id, 30 AS score FROM cap WHERE type = 1 AND filename LIKE '/usr/%'"
        " AND container = '' UNION ALL SELECT host, seq, 'memfd', 22 FROM cap WHERE type = 9 AND aux = 1"
        " UNION ALL SELECT host, seq, 'became_root', 15 FROM cap WHERE type = 4 AND old_euid <> 0"
        " AND euid = 0"
    ).replace("30 AS score", "30::BIGINT AS score"),
)
def j01(i: Inputs):
    return rules.match_signals(i.cap, MATCH_RULES).select("host", "seq", "id", "score")


def _many_rules(n: int = 5000) -> list[rules.Rule]:
    """Rules as a large deployment has them: most name a program or file that is never seen."""
    out = []
    for k in range(n):
        j = k // 5
        match = (
            {"event": "exec", "filename_equals": f"/usr/bin/{'sudo' if j % 100 == 0 else f'tool{j}'}"},
            {"event": "exec", "filename_prefix": f"/usr/s{'bin/ng' if j % 90 == 1 else f'hare/{j}/'}"},
            {"event": "file_open", "filename_contains": "shadow" if j % 80 == 2 else f"/vault-{j}/",
             "in_container": j % 2 == 0},
            {"event": "cred_change", "uid": j, "to_root": True},
            {"event": "exec", "comm_equals": "bash" if j % 70 == 3 else f"agent{j}"},
        )[k % 5]
        out.append(rules.parse_rule({"name": f"rule-{k}", "score": k % 90 + 1, "match": match}))
    return out


@query(
    "j01b_many_rules",
    sql(
        """SELECT host, seq, id, score::BIGINT AS score FROM (
SELECT c.host, c.seq, 'rule-' || r.k AS id, r.k % 90 + 1 AS score
FROM (SELECT range AS k, range // 5 AS j FROM range(5000)) r JOIN cap c ON
  (r.k % 5 = 0 AND c.type = 1 AND c.filename = '/usr/bin/' || CASE WHEN j % 100 = 0 THEN 'sudo' ELSE 'tool' || j END)
  OR (r.k % 5 = 1 AND c.type = 1
    AND starts_with(c.filename, '/usr/s' || CASE WHEN j % 90 = 1 THEN 'bin/ng' ELSE 'hare/' || j || '/' END))
  OR (r.k % 5 = 2 AND c.type = 5 AND (j % 2 = 0) = (c.container <> '')
    AND contains(c.filename, CASE WHEN j % 80 = 2 THEN 'shadow' ELSE '/vault-' || j || '/' END))
  OR (r.k % 5 = 3 AND c.type = 4 AND c.uid = j AND c.old_euid <> 0 AND c.euid = 0)
  OR (r.k % 5 = 4 AND c.type = 1 AND c.comm = CASE WHEN j % 70 = 3 THEN 'bash' ELSE 'agent' || j END))"""
    ),
)
def j01b(i: Inputs):
    """Five thousand rules; an event meets those under its own values."""
    return rules.match_signals(i.cap, _many_rules()).select("host", "seq", "id", "score")


# With steps that exclude each other a second step completes exactly when the step event before it in
# the scope is a first step in time.
SCOPED = """
SELECT c.host, c.seq, c.ts_ns, c.type, max_by(p.apid, p.depth) FILTER (p.known) AS spid,
       max_by(p.astart, p.depth) FILTER (p.known) AS sstart
FROM cap c JOIN path p ON p.host = c.host AND p.seq = c.seq WHERE c.type IN (4, 6) GROUP BY ALL"""


@query(
    "j02_lineage_sequence",
    sql(
        """SELECT host, seq, spid AS pid FROM (SELECT *,
  lag(type) OVER (PARTITION BY host, spid, sstart ORDER BY seq) AS ptype,
  lag(ts_ns) OVER (PARTITION BY host, spid, sstart ORDER BY seq) AS pts FROM scoped)
WHERE type = 6 AND ptype = 4 AND ts_ns - pts <= 600000000000""",
        {"scoped": SCOPED},
    ),
)
def j02(i: Inputs):
    return _completions(i, "lineage")


def _completions(i: Inputs, name: str):
    r = SEQUENCES[name]
    # Chunks far smaller than a process, so that carrying across them is part of the check.
    return rules.sequence_completions(rules.steps_of(i.cap, r, i.reach), r, 50).select(
        "host", "seq", "pid"
    )


@query(
    "j02b_process_sequence",
    sql(
        """SELECT host, seq, pid FROM (SELECT host, seq, pid, type, ts_ns,
  lag(type) OVER (PARTITION BY host, pid, start ORDER BY seq) AS ptype,
  lag(ts_ns) OVER (PARTITION BY host, pid, start ORDER BY seq) AS pts FROM cap WHERE type IN (4, 5))
WHERE type = 5 AND ptype = 4 AND ts_ns - pts <= 200000000000"""
    ),
)
def j02b(i: Inputs):
    return _completions(i, "process")


FOLD = {
    "sco2": SCOPED.replace("IN (4, 6)", "IN (1, 9)"),
    "turn": """SELECT host, spid, sstart, seq, ts_ns, type,
  row_number() OVER (PARTITION BY host, spid, sstart ORDER BY seq) AS rn FROM sco2""",
    "fold": """
SELECT DISTINCT host, spid, sstart, 0::BIGINT AS rn, 0::BIGINT AS seq, 0 AS step, 0::BIGINT AS began, false AS hit
FROM turn
UNION ALL
SELECT host, spid, sstart, rn, seq,
  CASE WHEN live AND step = 1 AND type = 1 THEN 2 WHEN live AND step = 2 AND type = 9 THEN 0
       WHEN type = 1 THEN 1 WHEN live THEN step ELSE 0 END,
  CASE WHEN live AND step = 1 AND type = 1 THEN began WHEN type = 1 THEN ts_ns WHEN live THEN began ELSE 0 END,
  live AND step = 2 AND type = 9
FROM (SELECT t.*, w.step, w.began, w.step > 0 AND t.ts_ns - w.began <= 1200000000000 AS live
  FROM fold w JOIN turn t ON t.host = w.host AND t.spid = w.spid AND t.sstart = w.sstart AND t.rn = w.rn + 1)""",
}


@query("j02c_overlapping_sequence", sql("SELECT host, seq, spid AS pid FROM fold WHERE hit", FOLD))
def j02c(i: Inputs):
    """Steps that one event can match twice over, against a recursive fold."""
    return _completions(i, "overlap")


_RULE_TEXT = (
    """concat('{"name": "r', conv_id, '"', if(turn % 7 = 0, '', ', "score": 5'), CASE conv_id % 5 WHEN 0 THEN ''"""
    """ WHEN 1 THEN ', "within": "30s"' WHEN 2 THEN ', "within": "2m"' WHEN 3 THEN ', "within": "500ms"'"""
    """ ELSE ', "within": "soon"' END, if(turn % 3 = 0, ', "match": {"event": "exec", "uid": 0}', ''),"""
    """ if(turn % 2 = 0, concat(', "sequence": [{"event": "', if(role = 'user', 'exec', role), '"}]'), ''),"""
    """ if(conv_id % 11 = 0, ', "colour": 1', ''), '}')"""
)


@query(
    "j03_rule_check",
    """SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 'needs a `name` and a `score`'
  WHEN conv_id % 11 = 0 THEN 'unknown field ''colour'''
  WHEN turn % 3 <> 0 AND turn % 2 <> 0 THEN 'needs a `match` or a `sequence`'
  WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 'has both `match` and `sequence` (pick one)'
  WHEN conv_id % 5 = 4 THEN 'bad duration ''soon'''
  WHEN turn % 2 = 0 AND role <> 'user' THEN 'unknown event type ''' || role || '''' END AS error
FROM conversations""",
)
def j03(i: Inputs):
    """Rules as rows: a rule text from every turn, most of them wrong in some way."""
    texts = i.table("conversations").selectExpr("conv_id", "turn", f"{_RULE_TEXT} AS rule")
    return rules.check_rules(texts).select("conv_id", "turn", "error")


@query(
    "j04_rule_hits",
    sql(
        "SELECT 'R-1' AS id, 'usr_exec' AS name, 30 AS score, 'match' AS kind, 'T1036' AS attack,"
        " (SELECT count(*) FROM cap WHERE type = 1 AND filename LIKE '/usr/%' AND container = '') AS hits"
        " UNION ALL SELECT '-', 'memfd', 22, 'match', '', (SELECT count(*) FROM cap WHERE type = 9 AND"
        " aux = 1) UNION ALL SELECT '-', 'became_root', 15, 'match', '', (SELECT count(*) FROM cap"
        " WHERE type = 4 AND old_euid <> 0 AND euid = 0)"
    ),
)
def j04(i: Inputs):
    """Loaded rules with how often each fires on the capture."""
    hits = rules.match_signals(i.cap, MATCH_RULES).groupBy(_e("id AS sid")).agg(_e("count(1) AS hits"))
    return rules.listing(i.spark, MATCH_RULES).withColumn(
        "sid", _e("if(id = '-', name, id)")
    ).join(hits, "sid", "left").selectExpr(
        "id", "name", "score", "kind", "attack", "coalesce(hits, 0L) AS hits"
    )


RULED = {
    "scoped": SCOPED,
    "rsig": """
SELECT host, seq, ord, id, score, ts_ns, pid, start FROM sig
UNION ALL SELECT host, seq, 64, 'R-7', 55, ts_ns, spid, sstart FROM (SELECT *,
  lag(type) OVER (PARTITION BY host, spid, sstart ORDER BY seq) AS ptype,
  lag(ts_ns) OVER (PARTITION BY host, spid, sstart ORDER BY seq) AS pts FROM scoped)
WHERE type = 6 AND ptype = 4 AND ts_ns - pts <= 600000000000
UNION ALL SELECT host, seq, 65, 'R-1', 30, ts_ns, pid, start FROM cap WHERE type = 1
  AND filename LIKE '/usr/%' AND container = ''""",
    # Every signal of an event is filed under the process of its first one.
    "rbuck": """
SELECT r.*, f.fpid, f.fstart FROM rsig r JOIN (SELECT host, seq, arg_min(pid, ord) AS fpid,
  arg_min(start, ord) AS fstart FROM rsig GROUP BY ALL) f ON f.host = r.host AND f.seq = r.seq""",
    "rimp": """
SELECT * FROM rbuck a WHERE NOT EXISTS (SELECT 1 FROM rbuck b WHERE b.host = a.host
  AND b.fpid = a.fpid AND b.fstart = a.fstart AND b.id = a.id AND (b.seq, b.ord) < (a.seq, a.ord)
  AND b.score >= a.score)""",
    "rfiled": """
SELECT e.host, e.seq, e.fpid AS pid, e.fstart AS start, i.id, i.score, i.ts_ns
FROM (SELECT DISTINCT host, seq, fpid, fstart FROM rbuck) e
JOIN anc p ON p.host = e.host AND p.pid = e.fpid AND p.start = e.fstart AND p.vf <= e.seq
JOIN rimp i ON i.host = e.host AND i.fpid = p.apid AND i.fstart = p.astart AND i.seq <= e.seq
WHERE NOT EXISTS (SELECT 1 FROM rimp j WHERE j.host = i.host AND j.fpid = i.fpid
  AND j.fstart = i.fstart AND j.id = i.id AND j.seq <= e.seq AND (j.seq, j.ord) > (i.seq, i.ord))""",
}


@query(
    "i01_signal_union",
    sql(
        "SELECT host, seq, ord::BIGINT AS ord, id, score::BIGINT AS score, fpid, fstart FROM rbuck",
        RULED,
    ),
)
def i01(i: Inputs):
    r = replay(i.cap, i.settings, "info", ruleset=[SEQUENCES["lineage"], MATCH_RULES[0]])
    return r.signals.selectExpr(
        "host", "seq", "CAST(ord AS BIGINT) AS ord", "id", "score", "bpid AS fpid",
        "bstart AS fstart",
    )


# --- L: composites -------------------------------------------------------------------------------

INCIDENT_COLS = "host, seq, pid, start, base, chain, total, severity"


@query(
    "l1_replay",
    sql(
        f"SELECT i.host, i.seq, i.pid, i.start, base, chain, total, severity, n_signals FROM inc i"
        " JOIN nsig n ON n.host = i.host AND n.seq = i.seq WHERE rank >= 1"
    ),
)
def l1(i: Inputs):
    return replay(i.cap, i.settings, "low").incidents.select(
        "host", "seq", "pid", "start", "base", "chain", "total", "severity", "n_signals"
    )


RSCORE = score_ctes("rfiled", "r")
RSCORE["rscored"] = RSCORE["rscored"].replace("JOIN ctx c", "JOIN rctx c").replace(
    "ON c.host = r.host AND c.seq = r.seq",
    "ON c.host = r.host AND c.seq = r.seq AND c.pid = r.pid AND c.start = r.start",
)
# A session root never acts itself, so its own (one-node) lineage is added.
RULED["rfiled"] = RULED["rfiled"].replace(
    "JOIN anc p ON",
    "JOIN (SELECT * FROM anc UNION SELECT DISTINCT host, fpid, fstart, fpid, fstart, 0, -1 FROM rbuck) p ON",
)
RSCORE["rnode"] = """
SELECT DISTINCT e.host, e.seq, e.fpid, e.fstart, p.apid, p.astart, p.depth
FROM (SELECT DISTINCT host, seq, fpid, fstart FROM rbuck) e
JOIN (SELECT * FROM anc UNION SELECT DISTINCT host, fpid, fstart, fpid, fstart, 0, -1 FROM rbuck) p
  ON p.host = e.host AND p.pid = e.fpid AND p.start = e.fstart AND p.vf <= e.seq"""
RSCORE["rctx"] = f"""
SELECT e.host, e.seq, e.fpid AS pid, e.fstart AS start,
  coalesce(bool_or(bx.box_seq <= e.seq), false) AS boxed,
  max_by(coalesce(x.comm, CASE WHEN b.first_seq <= e.seq THEN b.first_comm END, '')
    IN {ROOT_DAEMONS}, e.depth) AS rooted
FROM rnode e
ASOF LEFT JOIN execs x ON x.host = e.host AND x.pid = e.apid AND x.start = e.astart AND e.seq >= x.seq
LEFT JOIN born b ON b.host = e.host AND b.pid = e.apid AND b.start = e.astart
LEFT JOIN boxed bx ON bx.host = e.host AND bx.pid = e.apid AND bx.start = e.astart
GROUP BY ALL"""


@query(
    "l1b_replay_with_rules",
    sql(f"SELECT {INCIDENT_COLS} FROM rinc", {**RULED, **RSCORE}),
)
def l1b(i: Inputs):
    r = replay(i.cap, i.settings, "info", ruleset=[SEQUENCES["lineage"], MATCH_RULES[0]])
    return r.incidents.select(*INCIDENT_COLS.split(", "))


@query(
    "l2_baseline",
    sql(
        "SELECT count(*) AS patterns, count(*) FILTER (c >= 0.75) AS strong, any_value(win) AS window_ns,"
        " (SELECT count(*) FROM cap) AS events_observed FROM conf",
        CONF_SQL,
    ),
)
def l2(i: Inputs):
    return B.summary(_baseline(i)).select("patterns", "strong", "window_ns", "events_observed")


@query(
    "l3_budget",
    sql(
        """SELECT rank AS line, '  ' || rpad(floor, 10, ' ') || '  ' || lpad(n::VARCHAR, 9, ' ') || '  '
  || lpad(printf('%.1f', n / (d / 86400)), 9, ' ') AS text
FROM (SELECT f.floor, f.r::BIGINT AS rank, (SELECT count(*) FROM inc i WHERE i.rank >= f.r) AS n,
  (SELECT (max(ts_ns) - min(ts_ns)) / 1e9 FROM cap) AS d
 FROM (VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) f(floor, r))"""
    ),
)
def l3(i: Inputs):
    stats = records.capture_stats(i.cap)
    return records.budget_text(records.floors(i.run.incidents, stats), stats).selectExpr(
        "CAST(line AS BIGINT) AS line", "text"
    )


# State at the end of the capture, for every process that acted.
FINAL = {
    "tail": "SELECT DISTINCT host, pid, start, 281474976710655 AS seq FROM cap WHERE type <> 3",
    "efiled": """
SELECT t.host, t.seq, t.pid, t.start, p.depth, i.id, i.score, i.ts_ns FROM tail t
JOIN anc p ON p.host = t.host AND p.pid = t.pid AND p.start = t.start
JOIN imp i ON i.host = t.host AND i.pid = p.apid AND i.start = p.astart
WHERE NOT EXISTS (SELECT 1 FROM imp j WHERE j.host = i.host AND j.pid = i.pid AND j.start = i.start
  AND j.id = i.id AND (j.seq, j.ord) > (i.seq, i.ord))""",
    "epath": "SELECT t.*, p.apid, p.astart, p.depth FROM tail t JOIN anc p ON p.host = t.host"
    " AND p.pid = t.pid AND p.start = t.start",
    "enode": """
SELECT e.host, e.pid, e.start, e.depth, e.apid,
  coalesce(x.comm, b.first_comm, '') AS comm, coalesce(bx.box, '') AS box
FROM epath e
ASOF LEFT JOIN execs x ON x.host = e.host AND x.pid = e.apid AND x.start = e.astart AND e.seq >= x.seq
LEFT JOIN born b ON b.host = e.host AND b.pid = e.apid AND b.start = e.astart
LEFT JOIN boxed bx ON bx.host = e.host AND bx.pid = e.apid AND bx.start = e.astart""",
    "ectx": f"SELECT host, pid, start, bool_or(box <> '') AS boxed, max_by(comm IN {ROOT_DAEMONS}, depth)"
    " AS rooted, string_agg(comm || '(' || apid || ')', ' -> ' ORDER BY depth DESC) AS lineage"
    " FROM enode GROUP BY ALL",
    "efam": f"""
SELECT host, pid, start, {FAMILY.format(id='f.id')} AS family, max(score) AS top FROM efiled f
WHERE (SELECT max(g.ts_ns) FROM efiled g WHERE g.host = f.host AND g.pid = f.pid AND g.start = f.start)
 - f.ts_ns <= 600000000000 GROUP BY ALL""",
    "erisk": """
SELECT c.host, c.pid, c.start, c.lineage, coalesce(sum(top)::BIGINT, 0) AS base,
  CASE WHEN count(top) > 1 THEN ((count(top) - 1) * max(top)) // 2 ELSE 0 END AS chain,
  any_value(c.rooted) AS rooted, any_value(c.boxed) AS boxed
FROM ectx c LEFT JOIN efam f ON f.host = c.host AND f.pid = c.pid AND f.start = c.start GROUP BY ALL""",
}


@query(
    "l4_investigate_risk",
    sql(
        """SELECT host, pid, start, lineage, base, chain, least(100, round((base + chain) *
 ((CASE WHEN rooted THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) *
  (CASE WHEN boxed THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)))::BIGINT) AS total FROM erisk""",
        FINAL,
    ),
)
def l4(i: Inputs):
    r = i.run
    scored, _ = records.assess(r, i.acting)
    end = i.acting.selectExpr(*S.KEY, f"{records.END_SEQ}L AS seq")
    reach = graph.lineage_rows(end, i.reach).selectExpr(
        "host", "apid AS pid", "astart AS start", "seq", "pid AS s_pid", "start AS s_start", "depth"
    )
    names = graph.state_asof(reach, r.states, ("comm",), r.settings.chunk).filter("known")
    chain = names.groupBy("host", _e("s_pid AS pid"), _e("s_start AS start")).agg(
        _e("array_join(transform(sort_array(collect_list(struct(-depth AS d, comm, pid AS p))),"
           " n -> concat(n.comm, '(', n.p, ')')), ' -> ') AS lineage")
    )
    return chain.join(scored.drop("seq"), S.KEY, "left").selectExpr(
        *S.KEY, "lineage", "coalesce(base, 0L) AS base", "coalesce(chain, 0L) AS chain",
        "coalesce(total, 0L) AS total",
    )


@query(
    "l4b_investigate_identity",
    sql(
        """SELECT n.host, n.pid, n.start, n.comm, coalesce(x.exe, '') AS exe, k.uid, k.euid,
 e.exited_ns FROM (SELECT host, pid, start, comm FROM enode WHERE depth = 0) n
LEFT JOIN (SELECT host, pid, start, arg_max(exe, seq) AS exe FROM execs GROUP BY ALL) x
  ON x.host = n.host AND x.pid = n.pid AND x.start = n.start
LEFT JOIN (SELECT host, pid, start, arg_max(uid, seq) AS uid, arg_max(euid, seq) AS euid FROM touch
  WHERE has_cred GROUP BY ALL) k ON k.host = n.host AND k.pid = n.pid AND k.start = n.start
LEFT JOIN (SELECT host, pid, start, arg_max(ts_ns, seq) AS exited_ns FROM cap WHERE type = 2 GROUP BY ALL) e
  ON e.host = n.host AND e.pid = n.pid AND e.start = n.start
WHERE (n.host, n.pid, n.start) IN (SELECT (host, pid, start) FROM touch)""",
        FINAL,
    ),
)
def l4b(i: Inputs):
    return records.identity(i.run).join(i.acting, S.KEY, "left_semi").select(
        *S.KEY, "comm", "exe", "uid", "euid", "exited_ns"
    )


@query(
    "l4c_investigate_timeline",
    sql(
        f"SELECT host, pid, start, seq, strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S.000') AS at,"
        f" {DETAIL_SQL} AS detail FROM cap"
    ),
)
def l4c(i: Inputs):
    return records.timeline(i.cap)


@query(
    "l4d_investigate_techniques",
    sql(
        f"SELECT host, pid, start, t, {TECHNIQUE_SQL} AS name FROM (SELECT DISTINCT host, pid, start,"
        f" unnest({ATTACK_SQL}) AS t FROM efiled)",
        FINAL,
    ),
)
def l4d(i: Inputs):
    _, on_file = records.assess(i.run, i.acting)
    return on_file.selectExpr(
        "host", "s_pid AS pid", "s_start AS start", f"explode({detect.attack_of()}) AS t"
    ).distinct().selectExpr("*", f"{X.technique_name('t')} AS name")


@query(
    "l5_tree",
    sql(
        """SELECT s.host, s.pid, coalesce(p.depth, 0)::BIGINT AS depth,
 s.comm || ' (' || s.pid || ')' || CASE WHEN s.u % 4 <> s.u % 3 THEN ' [uid=' || (s.u % 4) || '→' ||
   (s.u % 3) || ']' WHEN s.u % 4 <> 0 THEN ' [uid=' || (s.u % 4) || ']' ELSE '' END AS line
FROM snap s LEFT JOIN up p ON p.host = s.host AND p.pid = s.pid""",
        {
            **SNAP,
            "up": "SELECT host, pid, max(d) AS depth FROM hops GROUP BY ALL",
            "hops": "SELECT s.host, s.pid, k.d FROM snap s, (SELECT unnest(range(1, 64)) AS d) k"
            " WHERE (SELECT count(*) FROM range(0, k.d) r(n) WHERE (s.u - 24 * r.n) % 3 <> 0 AND EXISTS"
            " (SELECT 1 FROM snap q WHERE q.host = s.host AND q.pid = s.pid - 24 * (r.n + 1))) = k.d",
        },
    ),
)
def l5(i: Inputs):
    nodes = snapshot(i)
    f = graph.forest(nodes, graph.snapshot_edges(nodes))
    cred = (
        "CASE WHEN uid <> euid THEN concat(' [uid=', uid, '→', euid, ']')"
        " WHEN uid <> 0 THEN concat(' [uid=', uid, ']') ELSE '' END"
    )
    return f.selectExpr(
        "host", "pid", "CAST(depth AS BIGINT) AS depth", f"concat(comm, ' (', pid, ')', {cred}) AS line"
    )


@query(
    "l8_incident_text",
    sql(
        """SELECT i.host, i.seq, severity || '  risk ' || total AS head, 'base ' || base || ' + chain ' ||
 chain || ' ' || CASE WHEN mult <> 1 THEN printf('x%.2f ', mult) ELSE '' END AS score,
 (SELECT count(*) FROM filed f WHERE f.host = i.host AND f.seq = i.seq) AS n FROM inc i"""
    ),
)
def l8(i: Inputs):
    return records.render(i.records).selectExpr(
        "host", "seq", "regexp_extract(text, '^([A-Z]+  risk [0-9]+)', 1) AS head",
        "regexp_extract(text, 'score: (base [0-9]+ [+] chain [0-9]+ (x[0-9.]+ )?)', 1) AS score",
        "CAST(size(regexp_extract_all(text, '(?m)  [(][+][0-9]+[)]$', 0)) AS BIGINT) AS n",
    )
