"""From signals to incidents.

A process' signals collapse to the strongest of each id; whenever a process signals again, its whole
lineage is scored; an incident is reported when that score reaches a band the process has not been
reported at before.

The score depends only on what is stored, not on when it is looked at. Between two changes of a
lineage every evaluation of a process gives the same result and cannot be reported twice, so only the
first evaluation after each change is expanded. That keeps a process with billions of identical
signals down to a handful of evaluations, found by aggregation instead of a window over its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.functions import events as X
from procscope.operators import baseline as B
from procscope.operators import graph
from procscope.operators.scan import BEFORE, END, chunk_of, collapse_runs, next_at_or_after, over
from procscope.session import materialize, materialize_counted

CHAIN_WINDOW_NS = 600 * 1_000_000_000

# Signal ids that are one behaviour.
FAMILIES = {
    "ldso_preload_write": "watched_write",
    "authorized_keys_write": "watched_write",
    "persistence_write": "watched_write",
    "cred_config_write": "watched_write",
    "sensitive_write": "watched_write",
    "credential_store_read": "credential_read",
    "ssh_private_key_read": "credential_read",
    "ptrace_attach": "process_access",
    "cross_uid_proc_read": "process_access",
}


def family(id_: str = "id") -> str:
    return X.case(id_, FAMILIES, id_)


def with_bucket(signals: DataFrame, from_rules: bool = False) -> DataFrame:
    """Add ``(bpid, bstart)``: the process an event's signals are filed under, which is the one of
    its first signal. Only rules can name a process other than the acting one."""
    if not from_rules:
        return signals.selectExpr("*", "pid AS bpid", "start AS bstart")
    w = over(["seq", "host"], "ord")
    return signals.selectExpr("*", f"first(pid) {w} AS bpid", f"first(start) {w} AS bstart")


def improving(bucketed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Rows that raise the stored score of their (process, id), valid until the next one does.

    Earliest wins on equal scores. Signals first shrink to one row per distinct score with a hash
    aggregate on the map side; the window that follows sees a few rows per process.
    """
    so = "named_struct('seq', seq, 'ord', ord)"
    g = bucketed.groupBy("bpid", "bstart", "host", "id", "score").agg(
        F.expr(f"min({so}) AS so"),
        F.expr(f"min_by(ts_ns, {so}) AS ts_ns"),
        F.expr(f"min_by(pid, {so}) AS spid"),
        F.expr(f"min_by(start, {so}) AS sstart"),
    )
    if prior is not None:
        g = prior.select(*g.columns).unionByName(g)
    key = ["bpid", "bstart", "host", "id"]
    g = g.selectExpr("*", f"max(score) {over(key, 'so', BEFORE)} AS _best")
    g = g.filter("_best IS NULL OR score > _best").drop("_best")
    return g.selectExpr(
        "*",
        f"min(so) OVER (PARTITION BY {', '.join(key)}) AS first_so",
        "so.seq AS vf",
        f"coalesce((lead(so) {over(key, 'so')}).seq, {END}L) AS vt",
    )


def context_flags(states: DataFrame, how: dict) -> DataFrame:
    """Periods ``[vf, vt)`` of a process with ``flags``: is it a root daemon (d), in a container (c).
    Processes that never have such a name or a container are left out: nothing holds for them."""
    daemon = X.is_root_daemon()
    # A name or container that a process has at some moment stands in one of its rows.
    ever = states.filter(f"{daemon} OR container <> ''").select(*S.KEY).distinct()
    states = states.join(ever, S.KEY, "left_semi")
    own = graph.state_asof(
        states.select(*S.KEY, "seq"), states, ("comm", "container"), **how
    ).selectExpr(*S.KEY, "seq", f"named_struct('d', {daemon}, 'c', container <> '') AS flags")
    return collapse_runs(own, S.KEY, "flags", size=how.get("size")).selectExpr(
        *S.KEY, "flags", "valid_from AS vf", "valid_to AS vt"
    )


def candidates(
    bucketed: DataFrame,
    imp: DataFrame,
    reach: DataFrame,
    flags: DataFrame,
    how: dict,
    incremental: bool = False,
) -> DataFrame:
    """Evaluations ``(host, pid, start, seq)`` that can differ from the one before them.

    Those are the evaluations that store something new themselves, plus the first one after each
    change elsewhere in the lineage. With ``incremental`` the changes may lie in earlier batches, so
    the first evaluation of the batch always counts.
    """
    evals = bucketed.selectExpr("host", "bpid AS pid", "bstart AS start", "seq")
    span = evals.groupBy(*S.KEY).agg(
        F.expr("min(seq) AS first_eval"), F.expr("max(seq) AS last_eval")
    )
    own = imp.selectExpr("host", "bpid AS pid", "bstart AS start", "vf AS seq")
    if incremental:
        after = own.join(span, S.KEY).filter("seq > first_eval").select(*S.KEY, "seq")
        own = after.unionByName(span.selectExpr(*S.KEY, "first_eval AS seq"))
        # Written out: both parts are dealt by process, and Spark plans a join on top of their union
        # without dealing it again, but then cuts the parts into different numbers of partitions.
        own = materialize(own.distinct(), "own-evaluations")
    # A process evaluated once cannot be affected by anything later.
    again = span.filter("last_eval > first_eval")
    path = reach.join(again, S.KEY)
    elsewhere = (
        path.filter("depth > 0")
        .selectExpr("*", "explode(array(vf, vt)) AS c")
        .selectExpr(*S.KEY, "first_eval", "last_eval", "c")
    )
    stored = imp.selectExpr("host", "bpid AS apid", "bstart AS astart", "vf AS at")
    turned = flags.selectExpr("host", "pid AS apid", "start AS astart", "vf AS at")
    moved = (
        path.join(stored.unionByName(turned), ["apid", "astart", "host"])
        .filter("at < vt")
        .selectExpr(*S.KEY, "first_eval", "last_eval", "greatest(at, vf) AS c")
    )
    points = (
        elsewhere.unionByName(moved)
        .filter("c > first_eval AND c <= last_eval")
        .selectExpr(*S.KEY, "c AS seq")
        .distinct()
    )
    points, changes = materialize_counted(points, "change-points")
    own = own.distinct()
    if changes == 0:
        return own
    touched = evals.join(points.select(*S.KEY).distinct(), S.KEY, "left_semi")
    later = next_at_or_after(points, touched, S.KEY, how.get("size"))
    return own.unionByName(later).distinct()


def lineage_state(
    evals: DataFrame,
    reach: DataFrame,
    states: DataFrame,
    fields: tuple[str, ...],
    how: dict,
) -> DataFrame:
    """One row per (evaluation, lineage node) with the node's state at the evaluation."""
    rows = graph.lineage_rows(evals, reach).selectExpr(
        "host", "apid AS pid", "astart AS start", "seq", "pid AS s_pid", "start AS s_start",
        "depth",
    )
    return graph.state_asof(rows, states, fields, **how).withColumnsRenamed(
        {"pid": "apid", "start": "astart"}
    )


def stored_signals(nodes: DataFrame, imp: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Signals on file for every lineage node at the evaluation, with the ``carry`` columns of ``imp``;
    nodes without one stay, with nulls, because they still contribute context."""
    i = imp.selectExpr(
        "host", "bpid AS apid", "bstart AS astart", "id", "score", "so", "ts_ns", "spid",
        "sstart", "first_so", "vf AS ivf", "vt AS ivt", *carry,
    )
    n, i = nodes.alias("n"), i.alias("i")
    return n.join(
        i,
        F.expr(
            "n.apid = i.apid AND n.astart = i.astart AND n.host = i.host"
            " AND i.ivf <= n.seq AND n.seq < i.ivt"
        ),
        "left",
    ).selectExpr(
        "n.*", "i.id", "i.score", "i.so", "i.ts_ns", "i.spid", "i.sstart", "i.first_so",
        *[f"i.{c}" for c in carry],
    )


def scoring_rows(on_file: DataFrame) -> DataFrame:
    """Input of ``score_evals`` from lineage rows: (host, seq, s_pid, s_start, depth, comm, container,
    known, id, score, ts_ns)."""
    return on_file.selectExpr(
        "seq", "host", "s_pid", "s_start", f"depth * 2 + CAST(known AND {X.is_root_daemon()} AS INT) AS root",
        "known AND container <> '' AS boxed", f"{family()} AS family", "score", "ts_ns",
    )


def scoring_periods(
    cand: DataFrame, imp: DataFrame, reach: DataFrame, flags: DataFrame, size: int | None = None
) -> DataFrame:
    """The rows of ``scoring_rows`` without a look-up per evaluation and node.

    Between changes a node is the same for every evaluation, so what is known of a node (its signals
    and flags, each for a period) meets the lineages once, and evaluations meet only what their own
    process has. That is dealt by (process, chunk of arrivals), and the rows stay so.
    """
    who = ["pid", "start", "host"]  # numbers first: joins sort by them
    c = cand.selectExpr(*who, "seq", f"{chunk_of('seq', size)} AS _chunk")
    asked = c.groupBy(*who, "_chunk").agg(F.expr("min(seq) AS lo"), F.expr("max(seq) AS hi"))
    path = reach.join(asked, who).filter("vf <= hi AND lo < vt")
    # Depth says only which ancestor is the last, so a node with one behind it all the time may go.
    path = path.selectExpr("*", f"lead(struct(vf, vt)) {over([*who, '_chunk'], 'depth')} AS up")
    path = path.selectExpr("*", "coalesce(up.vf <= vf AND vt <= up.vt, false) AS passed").drop("up")
    at = ["apid", "astart", "host"]
    filed = imp.selectExpr(
        "bpid AS apid", "bstart AS astart", "host", "0 AS d", "false AS c", f"{family()} AS family",
        "score", "ts_ns", "vf AS f", "vt AS t",
    )
    marks = flags.filter("flags.d OR flags.c").selectExpr(
        "pid AS apid", "start AS astart", "host", "CAST(flags.d AS INT) AS d", "flags.c AS c", "vf AS f", "vt AS t"
    )
    info = filed.unionByName(marks, allowMissingColumns=True)
    # A node counts with its depth for as long as it is an ancestor, whatever else is known of it.
    plain = info.select(*at).distinct().selectExpr("*", "-1L AS f", f"{END}L AS t")
    info = info.unionByName(plain, allowMissingColumns=True)
    rows = path.join(info, at, "left").filter("d IS NOT NULL OR NOT passed").selectExpr(
        *who, "_chunk", "lo", "hi", "depth * 2 + coalesce(d, 0) AS root", "coalesce(c, false) AS boxed",
        "family", "score", "ts_ns", "greatest(vf, f) AS f", "least(vt, t) AS t",
    )
    rows = rows.filter("f < t AND f <= hi AND lo < t").drop("lo", "hi")
    return c.join(rows, [*who, "_chunk"]).filter("f <= seq AND seq < t").selectExpr(
        "seq", "host", "pid AS s_pid", "start AS s_start", "_chunk", "root", "boxed", "family", "score", "ts_ns"
    )


def score_evals(on_file: DataFrame, one_per_event: bool = True) -> DataFrame:
    """Score every evaluation from its lineage rows. An event evaluates one process, so (host, seq) names
    the evaluation; without ``one_per_event`` the process is part of its name."""
    return score_rows(scoring_rows(on_file), ["seq", "host", *([] if one_per_event else ["s_pid", "s_start"])])


def score_rows(rows: DataFrame, ev: list[str]) -> DataFrame:
    """Score every evaluation, named by the columns ``ev``, from its ``scoring_rows``. The window and both
    aggregates group by it and share one shuffle. All aggregation buffers are fixed-size, which keeps
    them in hash aggregates."""
    carried = [F.expr(f"max({c}) AS {c}") for c in ("s_pid", "s_start") if c not in ev]
    d = rows.selectExpr("*", f"max(ts_ns) OVER (PARTITION BY {', '.join(ev)}) AS newest")
    # Saturating difference: a signal newer than the newest one cannot exist, only equal.
    live = f"CASE WHEN newest - ts_ns <= {CHAIN_WINDOW_NS}L THEN score END"
    fam = d.groupBy(*ev, "family").agg(
        F.expr(f"max({live}) AS top"),
        F.expr("max(root) AS root"),
        F.expr("bool_or(boxed) AS boxed"),
        F.expr("count(score) AS n"),
        F.expr("max(newest) AS newest"),
        *carried,
    )
    e = fam.groupBy(*ev).agg(
        F.expr("sum(top) AS base"),
        F.expr("count(top) AS families"),
        F.expr("max(top) AS top"),
        F.expr("max(root) % 2 = 1 AS rooted"),
        F.expr("bool_or(boxed) AS boxed"),
        F.expr("sum(n) AS n_signals"),
        F.expr("max(newest) AS newest"),
        *carried,
    )
    e = e.filter("n_signals > 0").selectExpr(
        "*",
        "CASE WHEN families > 1 THEN (families - 1) * top DIV 2 ELSE 0L END AS chain",
        "(CASE WHEN rooted THEN 1.3D ELSE 1.0D END) * (CASE WHEN boxed THEN 1.1D ELSE 1.0D END)"
        " AS mult",
        "nullif(concat_ws('; ', CASE WHEN rooted THEN 'lineage rooted at a network daemon' END,"
        " CASE WHEN boxed THEN 'inside a container' END), '') AS note",
    )
    e = e.selectExpr(
        "*", "least(100L, CAST(round((base + chain) * mult) AS BIGINT)) AS total"
    )
    return e.selectExpr(
        "host", "seq", "s_pid AS pid", "s_start AS start", "CAST(base AS BIGINT) AS base",
        "CAST(chain AS BIGINT) AS chain", "mult", "note", "total",
        f"CAST({X.severity_rank_of_score('total')} AS INT) AS rank",
        f"{X.severity_of_score('total')} AS severity", "CAST(n_signals AS BIGINT) AS n_signals",
        "newest AS ts_ns",
    )


def emit(scored: DataFrame, floor: int = 0, reported: DataFrame | None = None) -> DataFrame:
    """Keep the evaluations that exceed every band already reported for their process.

    ``reported``: (host, pid, start, rank) from earlier batches.
    """
    d = scored.filter(f"rank >= {floor}")
    if reported is not None:
        d = d.join(reported.selectExpr(*S.KEY, "rank AS r0"), S.KEY, "left")
    else:
        d = d.withColumn("r0", F.lit(None).cast("int"))
    d = d.selectExpr("*", f"max(rank) {over(S.KEY, 'seq', BEFORE)} AS r1")
    return d.filter("rank > greatest(coalesce(r0, -1), coalesce(r1, -1))").drop("r0", "r1")


def score_candidates(
    cand: DataFrame,
    imp: DataFrame,
    reach: DataFrame,
    states: DataFrame,
    base: B.Baseline | None,
    how: dict,
    one_per_event: bool = True,
    flags: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored evaluations, the stored signals behind them). ``flags``: ``context_flags`` of ``states``,
    if they are at hand."""
    fields = ("comm", "container") if base is None else ("comm", "container", "exe")
    on_file = stored_signals(lineage_state(cand, reach, states, fields, how), imp)
    if base is not None:
        on_file = B.adjust(with_signal_exe(on_file, states, how), base)
        return score_evals(on_file, one_per_event), on_file
    if flags is None:
        flags = context_flags(states, how)
    rows = scoring_periods(cand, imp, reach, flags, how.get("size"))
    return score_rows(rows, ["seq", "s_pid", "s_start", "host", "_chunk"]), on_file


def with_signal_exe(on_file: DataFrame, states: DataFrame, how: dict) -> DataFrame:
    """Add ``sexe``, the program of the process each signal fired on. That is the lineage node
    itself except for a rule signal filed under another process."""
    foreign = "id IS NOT NULL AND (spid <> apid OR sstart <> astart)"
    other = on_file.filter(foreign).selectExpr(
        "host", "spid AS pid", "sstart AS start", "seq"
    ).distinct()
    looked = graph.state_asof(other, states, ("exe",), **how).selectExpr(
        "host", "pid AS spid", "start AS sstart", "seq", "exe AS f_exe"
    )
    return on_file.join(looked, ["seq", "spid", "sstart", "host"], "left").selectExpr(
        *on_file.columns, f"CASE WHEN {foreign} THEN coalesce(f_exe, '') ELSE exe END AS sexe"
    )
