"""Self-contained incident records, their text form, and the alert-budget and investigation views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.functions import events as X
from procscope.functions import text as T
from procscope.operators import graph, score
from procscope.operators.scan import chunk_of, numbered

FULL = ("comm", "exe", "argv", "uid", "euid", "container")


def evidence(r, scored: DataFrame | None = None) -> DataFrame:
    """One row per (incident, signal on file), with detail, techniques and target.

    ``ord`` sorts them oldest first; ties keep lineage order, then the order they were first filed.
    """
    inc = (r.incidents if scored is None else scored).select(*S.KEY, "seq")
    text = r.signals.selectExpr(
        "host", "named_struct('seq', seq, 'ord', ord) AS so", "detail", "attack", "target"
    )
    if r.baseline is None:
        # What is on file needs no state of the nodes, and only the incidents' lineages are expanded. It
        # meets its texts first: a signal is on file once, but evidence of many incidents.
        nodes = graph.lineage_rows(inc, r.reach).withColumnsRenamed({"pid": "s_pid", "start": "s_start"})
        filed = r.improving.join(text, ["so", "host"])
        keep = score.stored_signals(nodes, filed, ("detail", "attack", "target")).filter("id IS NOT NULL")
    else:
        keep = r.on_file.filter("id IS NOT NULL").join(
            inc.selectExpr("host", "pid AS s_pid", "start AS s_start", "seq"),
            ["seq", "s_pid", "s_start", "host"],
            "left_semi",
        ).join(text, ["so", "host"])
    note = "evidence_note" if "evidence_note" in keep.columns else "CAST(NULL AS STRING)"
    return keep.selectExpr(
        "host", "seq", "s_pid AS pid", "s_start AS start", "depth", "first_so", "id", "score",
        f"concat(detail, coalesce({note}, '')) AS detail", "attack", "target", "ts_ns", "spid",
        "sstart",
    )


def techniques(rows: DataFrame) -> DataFrame:
    """Sorted distinct technique ids per incident."""
    return (
        rows.selectExpr(*S.KEY, "seq", "explode(attack) AS t")
        .groupBy(*S.KEY, "seq")
        .agg(F.expr("array_sort(collect_set(t)) AS attack"))
    )


def records(
    r, boot_epoch_ms: str = "CAST(NULL AS BIGINT)", tag: str = S.INCIDENT_TAG, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(host, seq, record)`` with the lineage resolved to names, root first, and the ``carry`` columns
    of the incidents.

    Wall-clock fields are null unless ``boot_epoch_ms`` (an expression over ``host``) is known.
    Everything collected per incident is bounded by the 64 nodes of a lineage.
    """
    st = r.settings
    inc = r.incidents
    ev = evidence(r)
    ids = ["seq", *S.KEY]
    lineage = graph.lineage_rows(inc.select(*ids), r.reach)
    nodes = lineage.selectExpr(
        "host", "apid AS npid", "astart AS nstart", "seq", "pid", "start", "depth"
    )
    # A signal fired on the lineage node it is filed under, except for some signals of rules. Lineage nodes
    # and those other processes are looked up together.
    away = r.improving.filter("spid <> bpid OR sstart <> bstart")
    other = score.stored_signals(lineage.withColumnsRenamed({"pid": "s_pid", "start": "s_start"}), away)
    other = other.filter("id IS NOT NULL").selectExpr(
        "host", "spid AS npid", "sstart AS nstart", "seq", "s_pid AS pid", "s_start AS start"
    ).distinct()
    ask = nodes.drop("depth").unionByName(other).selectExpr(
        "host", "npid AS pid", "nstart AS start", "seq"
    ).distinct()
    known = graph.state_asof(ask, r.states, FULL, **st.lookup).selectExpr(
        "host", "pid AS npid", "start AS nstart", "seq", "known", "comm", "exe",
        f"{T.cmdline()} AS cmdline", "uid",
    )
    chain = (
        nodes.join(known, ["seq", "npid", "nstart", "host"])
        .filter("known")
        .groupBy(*ids)
        .agg(
            F.expr(
                "sort_array(collect_list(struct(-depth AS d, npid AS pid, comm, exe, cmdline,"
                " nstart AS start))) AS chain"
            ),
            F.expr("max_by(struct(comm, exe, uid, cmdline), -depth) AS me"),
            F.expr("min(depth) AS nearest"),
        )
    )
    wall = f"({boot_epoch_ms})"
    others = other.join(known, ["seq", "npid", "nstart", "host"]).groupBy(*ids).agg(
        F.expr("collect_list(struct(npid AS pid, nstart AS start, cmdline)) AS others")
    )
    sigs = ev.groupBy(*ids).agg(
        F.expr(
            "sort_array(collect_list(named_struct('t', ts_ns, 'd', depth, 'f', first_so,"
            " 's', named_struct('id', id, 'score', score, 'detail', detail, 'attack', attack,"
            f" 'ts_ns', ts_ns, 'ts', {X.wall_ms('ts_ns', wall)}, 'pid', spid, 'start', sstart))))"
            " AS sigs"
        )
    )
    d = inc.withColumnRenamed("chain", "chain_bonus").join(chain, ids, "left").join(sigs, ids)
    d = d.join(others, ids, "left")
    cmdline = (
        "coalesce(get(filter(cmdlines, n -> n.pid = x.s.pid AND n.start = x.s.start), 0).cmdline, '')"
    )
    signals = (
        "transform(sigs, x -> named_struct('id', x.s.id, 'score', x.s.score, 'detail', x.s.detail,"
        " 'attack', x.s.attack, 'ts_ns', x.s.ts_ns, 'ts', x.s.ts, 'pid', x.s.pid,"
        f" 'cmdline', {cmdline}))"
    )
    own = "nearest = 0"
    subject = (
        "named_struct('pid', pid, 'start_boottime', start,"
        f" 'comm', if({own}, me.comm, ''), 'exe', if({own}, me.exe, ''),"
        f" 'uid', if({own}, me.uid, 0L), 'cmdline', if({own}, me.cmdline, ''))"
    )
    record = (
        f"named_struct('schema', {X.quote(tag)}, 'ts_ns', ts_ns,"
        f" 'ts', {X.wall_ms('ts_ns', wall)}, 'severity', severity, 'score', total,"
        " 'score_breakdown', named_struct('base', base, 'chain_bonus', chain_bonus,"
        " 'context_mult', mult, 'context_note', note),"
        f" 'subject', {subject},"
        " 'lineage', coalesce(transform(chain, n -> concat(n.comm, '(', n.pid, ')')), array()),"
        " 'lineage_detail', coalesce(transform(chain, n -> named_struct('pid', n.pid,"
        " 'comm', n.comm, 'exe', n.exe, 'cmdline', n.cmdline)), array()),"
        " 'attack', array_sort(array_distinct(flatten(transform(sigs, x -> x.s.attack)))),"
        f" 'signals', {signals},"
        " 'yara', CAST(array() AS ARRAY<STRUCT<signal: STRING, target: STRING, outcome: STRING,"
        " rules: ARRAY<STRING>, reason: STRING>>))"
    )
    d = d.selectExpr(
        *ids, "total", "severity", "base", "chain_bonus", "mult", "note", "ts_ns", "chain", "me",
        "coalesce(nearest, -1) AS nearest", "sigs",
        "concat(coalesce(transform(chain, n -> struct(n.pid, n.start, n.cmdline)), array()),"
        " coalesce(others, array())) AS cmdlines", *carry,
    )
    return d.selectExpr("host", "seq", "severity", "total AS score", f"{record} AS record", *carry)



def slim(record: str = "record") -> str:
    """JSON of a record with empty optional fields left out."""
    opt = [
        f"'subject', named_struct('pid', {record}.subject.pid, 'start_boottime',"
        f" {record}.subject.start_boottime, 'comm', {record}.subject.comm,"
        f" 'exe', nullif({record}.subject.exe, ''), 'uid', {record}.subject.uid,"
        f" 'cmdline', nullif({record}.subject.cmdline, ''))",
        f"'lineage', {record}.lineage",
        f"'lineage_detail', transform({record}.lineage_detail, n -> named_struct('pid', n.pid,"
        " 'comm', n.comm, 'exe', nullif(n.exe, ''), 'cmdline', nullif(n.cmdline, '')))",
        f"'attack', {record}.attack",
        f"'signals', transform({record}.signals, g -> named_struct('id', g.id, 'score', g.score,"
        " 'detail', g.detail, 'attack', g.attack, 'ts_ns', g.ts_ns, 'ts', g.ts, 'pid', g.pid,"
        " 'cmdline', nullif(g.cmdline, '')))",
        f"'yara', CASE WHEN size({record}.yara) > 0 THEN {record}.yara END",
    ]
    head = ", ".join(
        f"'{f}', {record}.{f}"
        for f in ("schema", "ts_ns", "ts", "severity", "score", "score_breakdown")
    )
    return f"to_json(named_struct({head}, {', '.join(opt)}))"


def render(recs: DataFrame) -> DataFrame:
    """Incident text: headline, lineage, signals in causal order, score breakdown."""
    lines = (
        "transform(record.signals, g -> concat('    ', {clock}, ' ', rpad(g.id,"
        " greatest(22, char_length(g.id)), ' '), ' ', g.detail, '  (+', g.score, ')\\n',"
        " if(g.cmdline <> '', concat('             $ ', g.cmdline, '\\n'), '')))"
    ).format(clock=X.clock_text("g.ts_ns"))
    b = "record.score_breakdown"
    text = (
        "concat(record.severity, '  risk ', record.score, '/100  [',"
        " array_join(record.attack, ', '), ']\\n',"
        " if(size(record.lineage) > 0, concat('  ', array_join(record.lineage, ' -> '), '\\n'), ''),"
        f" array_join({lines}, ''), '  score: base ', {b}.base, ' + chain ', {b}.chain_bonus, ' ',"
        f" if({b}.context_mult <> 1.0D, concat('x', format_number({b}.context_mult, '0.00'), ' ',"
        f" if({b}.context_note IS NOT NULL, concat('(', {b}.context_note, ') '), '')), ''),"
        " '= ', record.score, '\\n')"
    )
    return recs.selectExpr("host", "seq", f"{text} AS text")


# --- alert budget ---------------------------------------------------------------------------------

MIN_RELIABLE_SECS = 3600


def graph_stats(
    states: DataFrame, capture: DataFrame, retain_ns: int | None = None, snapshot: DataFrame | None = None
) -> DataFrame:
    """Processes of a capture in one row: nodes seen, alive (no exit), reaped (their exit lies more
    than ``retain_ns`` before their host's newest event) and adopted (snapshot processes that took the
    exact key of the capture)."""
    exits = capture.filter(f"type = {S.EXIT}").groupBy(
        "host", F.expr("tgid AS pid"), F.expr("start_boottime AS start")
    ).agg(F.expr("max(ts_ns) AS exited"))
    newest = capture.groupBy("host").agg(F.expr("max(ts_ns) AS now"))
    old = "false" if retain_ns is None else f"now - exited > {retain_ns}L"
    out = (
        states.select(*S.KEY)
        .distinct()
        .join(exits.withColumn("_gone", F.lit(True)), S.KEY, "full")
        .join(newest, "host", "left")
        .agg(
            F.expr("count(1) AS nodes"),
            F.expr("count_if(_gone IS NULL) AS alive"),
            F.expr(f"count_if({old}) AS reaped"),
        )
    )
    if snapshot is None:
        return out.withColumn("adopted", F.lit(0).cast("long"))
    taken = graph.reconcile(snapshot, capture).agg(F.expr("count_if(adopted) AS adopted"))
    return out.crossJoin(taken)  # one row each


def capture_stats(capture: DataFrame, bad_lines: DataFrame | None = None) -> DataFrame:
    """Volume and span of a capture."""
    d = capture.agg(
        F.expr("count(1) AS events"),
        F.expr("min(nullif(ts_ns, 0)) AS first_ns"),
        F.expr("max(nullif(ts_ns, 0)) AS last_ns"),
    )
    bad = (
        bad_lines.agg(F.expr("count(1) AS parse_errors"))
        if bad_lines is not None
        else capture.sparkSession.range(1).selectExpr("0L AS parse_errors")
    )
    secs = "coalesce(last_ns - first_ns, 0L) / 1e9D"
    # Both sides are one row.
    return d.crossJoin(F.broadcast(bad)).selectExpr(
        "events", "parse_errors", "coalesce(first_ns, 0L) AS first_ns",
        "coalesce(last_ns, 0L) AS last_ns", f"{secs} AS duration_secs",
        f"CASE WHEN {secs} > 0 THEN events / ({secs}) ELSE 0.0D END AS events_per_sec",
        f"{secs} >= {MIN_RELIABLE_SECS} AS reliable",
    )


def floors(incidents: DataFrame, stats: DataFrame) -> DataFrame:
    """Incidents and daily rate at each of the five floors, from one pass at the lowest.

    Emission needs a severity above all earlier ones of the process; for severities at or above a
    floor that does not depend on what happened below the floor. So filtering the lowest-floor
    result gives what a separate pass per floor would.
    """
    n = incidents.groupBy("rank").agg(F.expr("count(1) AS n"))
    ladder = incidents.sparkSession.range(len(X.SEVERITIES)).selectExpr("CAST(id AS INT) AS f")
    # Five floors against at most five counts and one stats row.
    per = (
        ladder.join(n, F.expr("rank >= f"), "left")
        .groupBy("f")
        .agg(F.expr("CAST(coalesce(sum(n), 0) AS BIGINT) AS incidents"))
    )
    return per.crossJoin(F.broadcast(stats)).selectExpr(
        f"{X.severity_of_rank('f')} AS floor", "incidents",
        "CASE WHEN reliable THEN incidents / (duration_secs / 86400.0D) END AS per_day",
    )


def offenders(rows: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, count descending then by name (the report's length)."""
    return (
        rows.groupBy(F.expr(f"{name} AS name"))
        .agg(F.expr("count(1) AS count"))
        .orderBy(F.desc("count"), "name")
        .limit(n)
    )


def subject_names(r, incidents: DataFrame | None = None) -> DataFrame:
    """Who set each incident off: program, else name, else ``<unknown>``."""
    inc = r.incidents if incidents is None else incidents
    st = graph.state_asof(
        inc.select(*S.KEY, "seq"), r.states, ("comm", "exe"), **r.settings.lookup
    )
    return st.selectExpr(
        *S.KEY, "seq", "CASE WHEN NOT known THEN '<unknown>' WHEN exe <> '' THEN exe ELSE comm END"
        " AS subject",
    )


def budget_text(floor_rows: DataFrame, stats: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The floor table as text lines, in order."""
    d = floor_rows
    delta = "''"
    if without is not None:
        d = d.join(without.selectExpr("floor", "incidents AS was"), "floor")
        delta = (
            "if(was <> incidents, concat('   (was ', was, ' without the baseline)'), '')"
        )
    return d.selectExpr(
        f"{X.severity_rank('floor')} AS line",
        "concat('  ', rpad(floor, 10, ' '), '  ', lpad(CAST(incidents AS STRING),"
        " greatest(9, length(CAST(incidents AS STRING))), ' '),"
        " if(per_day IS NOT NULL, concat('  ', lpad(format_number(per_day, '0.0'),"
        f" greatest(9, length(format_number(per_day, '0.0'))), ' ')), ''), {delta}) AS text",
    ).orderBy("line")


# --- investigation --------------------------------------------------------------------------------


def final_states(r) -> DataFrame:
    """State of every process at the end of the capture."""
    last = r.states.groupBy(*S.KEY).agg(F.expr("max(seq) AS seq"))
    return graph.state_asof(last, r.states, FULL + ("trusted",), **r.settings.lookup)


def assess(r, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score the lineage of each process as it stands at the end, without reporting anything.

    Returns (scores, signal rows).
    """
    at_end = subjects.select(*S.KEY).distinct().selectExpr(*S.KEY, f"{END_SEQ}L AS seq")
    reach = graph.closure(
        graph.edge_intervals(r.edges, r.settings.chunk), subjects.select(*S.KEY).distinct()
    )
    # Sequence numbers past the capture belong to one chunk of their own.
    scored, on_file = score.score_candidates(
        at_end, r.improving, reach, r.states, r.baseline, r.settings.lookup, one_per_event=False,
        flags=r.flags,
    )
    return scored, on_file.filter("id IS NOT NULL")


END_SEQ = (1 << 48) - 1


def identity(r, pid: int | None = None) -> DataFrame:
    """Final identity of every instance of a pid (all processes when None), with exit time."""
    nodes = final_states(r)
    if pid is not None:
        nodes = nodes.filter(F.col("pid") == pid)
    exits = (
        r.capture.filter(f"type = {S.EXIT}")
        .groupBy("host", F.expr("tgid AS pid"), F.expr("start_boottime AS start"))
        .agg(F.expr("max_by(ts_ns, seq) AS exited_ns"))
    )
    return nodes.join(exits, S.KEY, "left").selectExpr(
        *S.KEY, "comm", "exe", "array_join(argv, ' ') AS command", "uid", "euid", "container",
        "exited_ns",
    )


def credential_history(capture: DataFrame, pid: int | None = None, keep: int | None = None) -> DataFrame:
    """Credential changes of every process, numbered in order; only the first ``keep`` if given."""

    d = capture.filter(f"type = {S.CRED}")
    if pid is not None:
        d = d.filter(F.col("tgid") == pid)
    d = d.selectExpr(
        "host", "tgid AS pid", "start_boottime AS start", "seq", "ts_ns", "uid", "euid", "gid",
        "egid", "cap_effective AS caps",
    )
    d = numbered(d, S.KEY, ["seq"], chunk_of("seq"), "n")
    return d if keep is None else d.filter(f"n <= {keep}")


def timeline(capture: DataFrame, pid: int | None = None) -> DataFrame:
    """Readable events of a process, in arrival order."""
    d = capture if pid is None else capture.filter(F.col("tgid") == pid)
    return d.selectExpr(
        "host", "tgid AS pid", "start_boottime AS start", "seq",
        f"{X.clock_text('ts_ns')} AS at", f"{X.event_detail()} AS detail",
    )
