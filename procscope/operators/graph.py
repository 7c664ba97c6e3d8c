"""Process graph: state as of any event, parent edges, ancestor closure, forest order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope import schema as S
from procscope.operators.scan import BEFORE, END, UPTO, chunk_of, collapse_runs, over
from procscope.session import materialize, materialize_counted, release

CYCLE_CHECK = 8  # lineages this deep are rare, so cycles are looked for only then
SNAPSHOT_TOLERANCE_NS = 20_000_000

def state_rows(capture: DataFrame) -> DataFrame:
    """Every touch of a process' state: an exec or credential change of itself, and both ends of a
    fork (the parent end only names a process that has no name yet)."""
    own = (
        "named_struct('pid', tgid, 'start', start_boottime, 'sub', 0, 'kind',"
        f" CASE type WHEN {S.EXEC} THEN 'exec' WHEN {S.CRED} THEN 'cred' ELSE 'parent' END)"
    )
    child = (
        "named_struct('pid', child_pid, 'start', child_start_boottime, 'sub', 1, 'kind', 'child')"
    )
    return (
        capture.filter(f"type IN ({S.EXEC}, {S.FORK}, {S.CRED})")
        .selectExpr(
            "host", "seq", "comm", "filename", "exe_trusted", "argv", "uid", "euid", "container",
            f"explode(CASE WHEN type = {S.FORK} THEN array({own}, {child})"
            f" ELSE array({own}) END) AS e",
        )
        .selectExpr(
            "host", "e.pid AS pid", "e.start AS start", "seq", "e.sub AS sub", "e.kind AS kind",
            "comm",
            "CASE WHEN e.kind = 'exec' THEN filename END AS exe",
            "CASE WHEN e.kind = 'exec' THEN exe_trusted END AS trusted",
            "CASE WHEN e.kind = 'exec' THEN argv END AS argv",
            "uid", "euid",
            "CASE WHEN e.kind <> 'parent' THEN container ELSE '' END AS container",
        )
    )


def edges(capture: DataFrame) -> DataFrame:
    return capture.filter(f"type = {S.FORK}").selectExpr(
        "host", "child_pid AS pid", "child_start_boottime AS start",
        "named_struct('pid', tgid, 'start', start_boottime) AS parent", "seq",
    )


def edge_intervals(edge_rows: DataFrame, size: int | None = None) -> DataFrame:
    """One row per (child, parent) period; the newest fork of a child decides its parent."""
    return collapse_runs(edge_rows, S.KEY, "parent", size=size).selectExpr(
        *S.KEY, "parent.pid AS apid", "parent.start AS astart", "valid_from AS vf",
        "valid_to AS vt",
    )


def state_asof(
    lookups: DataFrame,
    changes: DataFrame,
    fields: tuple[str, ...] = ("comm", "exe", "trusted"),
    size: int | None = None,
) -> DataFrame:
    """Attach the state of ``(host, pid, start)`` as of ``seq`` (inclusive) to every lookup row.

    Adds ``known`` and the requested fields. A name comes from the newest exec; while that is empty
    the first non-empty name seen since then is used.
    """
    payload = [c for c in lookups.columns if c not in S.KEY + ["seq"]]
    want = set(fields)
    image = [f for f in ("exe", "trusted", "argv") if f in want]
    cred = [f for f in ("uid", "euid") if f in want]
    named = "comm" in want

    left = lookups.selectExpr(
        *S.KEY, "seq * 4 + 3 AS o",
        f"named_struct('_seq', seq, {', '.join(f'{c!r}, {c}' for c in payload)}) AS row"
        if payload
        else "named_struct('_seq', seq) AS row",
    )
    parts = {}
    if image:
        parts["img"] = (
            f"CASE WHEN kind = 'exec' THEN struct({', '.join(image)}) END"
        )
    if cred:
        parts["cred"] = f"CASE WHEN kind <> 'parent' THEN struct({', '.join(cred)}) END"
    if "container" in want:
        parts["cont"] = "nullif(container, '')"
    if named:
        parts["name"] = "nullif(comm, '')"
        parts["exec_o"] = "CASE WHEN kind = 'exec' THEN seq * 4 + sub END"
    right = changes.selectExpr(
        *S.KEY, "seq * 4 + sub AS o", "true AS touch", *[f"{e} AS {n}" for n, e in parts.items()]
    )
    ck = S.KEY + ["_chunk"]
    chunk = f"{chunk_of('floor(o / 4)', size)} AS _chunk"
    run = over(ck, "o", UPTO)
    filled = [n for n in ("img", "cred", "cont") if n in parts]

    def running(d: DataFrame, *rest: str) -> DataFrame:
        """The state after each row of its chunk."""
        d = d.selectExpr("*", chunk).repartition(*ck)
        step = [*ck, "o", *rest, f"max(touch) {run} AS touch"]
        step += [f"last({n}, true) {run} AS {n}" for n in filled]
        if named:
            # The name that counts is the earliest one of the latest exec period.
            step += ["name", f"coalesce(max(exec_o) {run}, -1L) AS era"]
        d = d.selectExpr(*step)
        if named:
            d = d.selectExpr(
                *ck, "o", *rest, "touch", *filled, "era",
                f"max(CASE WHEN name IS NOT NULL THEN named_struct('era', era, 'neg', -o, 'name', name)"
                f" END) {run} AS best",
            )
        return d

    d = running(left.unionByName(right, allowMissingColumns=True), "row")
    kept = ["touch", *filled] + (["era", "best"] if named else [])
    # A chunk ends as its last change left it; of the lookups only the chunks they lie in are needed.
    ends = running(right).groupBy(*ck).agg(F.expr(f"max_by(struct({', '.join(kept)}), o) AS t"))
    asked = left.selectExpr(*S.KEY, chunk).distinct()
    tails = asked.join(ends, ck, "full")
    before, upto = over(S.KEY, "_chunk", BEFORE), over(S.KEY, "_chunk", UPTO)
    carried = [f"max(t.touch) {before} AS c_touch"]
    carried += [f"last(t.{n}, true) {before} AS c_{n}" for n in filled]
    if named:
        tails = tails.selectExpr(
            "*",
            f"CASE WHEN t.best.era = t.era THEN named_struct('era', max(t.era) {upto},"
            " 'neg', t.best.neg, 'name', t.best.name) END AS cand",
        )
        carried += [
            f"max(cand) {before} AS c_best",
            f"coalesce(max(t.era) {before}, -1L) AS c_era",
        ]
    tails = tails.selectExpr(*ck, *carried)
    d = d.filter("row IS NOT NULL").join(tails, ck, "left")

    return d.selectExpr(*_state_columns(payload, named, image, cred, want))


def _state_columns(
    payload: list[str], named: bool, image: list[str], cred: list[str], want: set[str]
) -> list[str]:
    """Output columns of ``state_asof``: the value found inside the chunk, else the carried one."""

    def pick(part: str, f: str, empty: str) -> str:
        return f"coalesce(if({part} IS NOT NULL, {part}.{f}, c_{part}.{f}), {empty}) AS {f}"

    out = [*S.KEY, "row._seq AS seq", *[f"row.{c} AS {c}" for c in payload]]
    out.append("coalesce(touch, c_touch, false) AS known")
    if named:
        near = "CASE WHEN best.era = era THEN best.name END"
        far = "CASE WHEN c_best.era = c_era THEN c_best.name END"
        out.append(
            f"coalesce(CASE WHEN era >= 0 THEN {near} ELSE coalesce({far}, {near}) END, '') AS comm"
        )
    out += [
        pick("img", f, "CAST(array() AS ARRAY<STRING>)" if f == "argv" else "''") for f in image
    ]
    out += [pick("cred", f, "0L") for f in cred]
    if "container" in want:
        out.append("coalesce(cont, c_cont, '') AS container")
    return out


def closure(edge_iv: DataFrame, seeds: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """All ancestors of the seed processes: ``(host, pid, start, apid, astart, depth, vf, vt)``.

    A row is part of the lineage as of ``seq`` when ``vf <= seq < vt``. Distances double each
    round, and the loop ends as soon as a round finds no ancestor that is not known yet; a lineage
    that returns to one of its nodes ends there. ``max_nodes`` keeps only the first so many nodes.
    Jump tables are written out: each is read three times, and reading the previous plan twice per
    round would double it.
    """
    jump = materialize(edge_iv, "jump")
    read = [jump]
    reach = seeds.selectExpr(
        *S.KEY, "pid AS apid", "start AS astart", "0 AS depth", "-1L AS vf", f"{END}L AS vt"
    )
    step = 1
    while max_nodes is None or step < max_nodes:
        # The mid node is the join key: an ancestor shared by very many processes is one row on
        # the jump side, so a skewed reach side splits without replication cost.
        j = jump.selectExpr(
            "host", "pid AS apid", "start AS astart", "apid AS jpid", "astart AS jstart",
            "vf AS jvf", "vt AS jvt",
        )
        hop = [
            *S.KEY, "jpid AS apid", "jstart AS astart", "greatest(vf, jvf) AS vf",
            "least(vt, jvt) AS vt",
        ]
        longer = reach.join(j, ["apid", "astart", "host"]).selectExpr(
            *hop, f"depth + {step} AS depth"
        )
        reach = reach.unionByName(longer.filter("vf < vt"))
        step *= 2
        if step >= CYCLE_CHECK:
            reach = materialize(without_returns(reach), "reach")
            read.append(reach)
            if reach.filter(f"depth >= {step // 2}").isEmpty():
                break
        jump, rows = materialize_counted(
            jump.join(j, ["apid", "astart", "host"]).selectExpr(*hop).filter("vf < vt"), "jump"
        )
        read.append(jump)
        if rows == 0:
            break
    reach = without_returns(reach)
    if max_nodes is not None:
        reach = reach.filter(f"depth < {max_nodes}")
    out = materialize(reach, "closure")
    release(*read)
    return out


def without_returns(reach: DataFrame) -> DataFrame:
    """Drop rows that reach a node a second time: the way around a cycle holds only while the
    shorter way does, so its interval lies inside that one's."""
    w = (
        "OVER (PARTITION BY pid, start, host, apid, astart ORDER BY depth"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    d = reach.selectExpr("*", f"collect_list(named_struct('vf', vf, 'vt', vt)) {w} AS _shorter")
    return d.filter("NOT exists(_shorter, s -> s.vf <= vf AND vt <= s.vt)").drop("_shorter")


def ancestry(capture: DataFrame, subjects: DataFrame, size: int | None = None) -> DataFrame:
    """Lineage of each ``(host, pid, start, seq)`` subject, self first: one row per node with the
    node's name as of that moment. A process nobody has seen has no lineage."""
    reach = closure(edge_intervals(edges(capture), size), subjects.select(*S.KEY).distinct())
    rows = lineage_rows(subjects, reach).selectExpr(
        "host", "apid AS pid", "astart AS start", "seq", "pid AS s_pid", "start AS s_start",
        "depth",
    )
    st = state_asof(rows, state_rows(capture), ("comm", "exe"), size)
    return st.filter("known").selectExpr(
        "host", "s_pid AS pid", "s_start AS start", "seq", "depth", "pid AS apid",
        "start AS astart", "comm", "exe",
    )


def lineage_rows(subjects: DataFrame, reach: DataFrame) -> DataFrame:
    """Expand ``(host, pid, start, seq, …)`` to one row per lineage node visible at ``seq``."""
    return subjects.join(reach, S.KEY).filter("vf <= seq AND seq < vt").drop("vf", "vt")


# --- processes known before the capture started -------------------------------------------------


def snapshot_edges(snapshot: DataFrame) -> DataFrame:
    """Parent links of a process snapshot: ppid resolves to the most recent key of that pid."""
    latest = snapshot.groupBy("host", F.col("pid").alias("ppid")).agg(
        F.max("start").alias("parent_start")
    )
    return (
        snapshot.join(latest, ["host", "ppid"])
        .filter((F.col("ppid") != F.col("pid")) | (F.col("parent_start") != F.col("start")))
        .select(*S.KEY, F.col("ppid").alias("parent_pid"), "parent_start")
    )


def reconcile(snapshot: DataFrame, capture: DataFrame) -> DataFrame:
    """Give each snapshot process the exact key the capture uses for it.

    Snapshot start times are truncated to clock ticks. The first event that names the pid decides:
    if its start lies within the tolerance the process is the same one and takes the exact key.
    The newest snapshot row of a pid is the one considered. Adds ``exact_start`` and ``adopted``.
    """
    pid_newest = snapshot.groupBy("host", "pid").agg(F.max("start").alias("start"))
    first = first_namings(capture).drop("seq")
    near = (
        F.abs(F.col("seen_start") - F.col("start")) <= SNAPSHOT_TOLERANCE_NS
    )
    match = (
        pid_newest.join(first, ["host", "pid"])
        .filter(near)
        .select("host", "pid", "start", F.col("seen_start").alias("exact_start"))
    )
    return snapshot.join(match, ["host", "pid", "start"], "left").select(
        *snapshot.columns,
        F.col("exact_start").isNotNull().alias("adopted"),
        F.coalesce("exact_start", "start").alias("exact_start"),
    )


def first_namings(capture: DataFrame) -> DataFrame:
    """(host, pid, seen_start, seq): the first event that names each pid."""
    naming = capture.filter(F.col("type").isin(S.EXEC, S.FORK, S.CRED, S.EXIT)).select(
        "host",
        "seq",
        F.explode(
            F.when(
                F.col("type") == S.FORK,
                F.array(
                    F.struct(F.col("tgid").alias("pid"), F.col("start_boottime").alias("start")),
                    F.struct(
                        F.col("child_pid").alias("pid"),
                        F.col("child_start_boottime").alias("start"),
                    ),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.col("tgid").alias("pid"), F.col("start_boottime").alias("start"))
                )
            )
        ).alias("k"),
    )
    return naming.groupBy("host", F.col("k.pid").alias("pid")).agg(
        F.min_by("k.start", "seq").alias("seen_start"), F.min("seq").alias("seq")
    )


def snapshot_as_state(snapshot: DataFrame, capture: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State rows and parent edges of a snapshot, ready to precede those of the capture.

    Snapshot facts get sequence -1; a parent link that reconciliation moved follows the new key.
    """
    keyed = reconcile(snapshot, capture)
    names = keyed.select("host", "pid", "start", "exact_start")
    rows = keyed.select(
        "host",
        "pid",
        F.col("exact_start").alias("start"),
        F.lit(-1).cast("long").alias("seq"),
        F.lit(0).alias("sub"),
        F.lit("exec").alias("kind"),
        "comm",
        "exe",
        F.col("trusted"),
        "argv",
        "uid",
        "euid",
        F.lit("").alias("container"),
    )
    parents = names.select(
        "host",
        F.col("pid").alias("parent_pid"),
        F.col("start").alias("parent_start"),
        F.col("exact_start").alias("parent_exact"),
    )
    links = (
        snapshot_edges(snapshot)
        .join(names, ["host", "pid", "start"])
        .join(parents, ["host", "parent_pid", "parent_start"])
        .select(
            "host",
            "pid",
            F.col("exact_start").alias("start"),
            F.struct(
                F.col("parent_pid").alias("pid"), F.col("parent_exact").alias("start")
            ).alias("parent"),
            F.lit(-1).cast("long").alias("seq"),
        )
    )
    return rows, links


# --- forest display -----------------------------------------------------------------------------


def forest(nodes: DataFrame, links: DataFrame, paths: bool = False) -> DataFrame:
    """Every node with its ``depth`` and ``root`` (pid, start); with ``paths`` also its ``path``: ordering by
    ``(host, path)`` prints the trees in order, children by key. A root is a node whose parent is not in the
    node set; a lineage that returns to one of its nodes ends there, and its last node counts as the root.

    ``nodes``: (host, pid, start, …). ``links``: (host, pid, start, parent_pid, parent_start). Paths hold a
    row for each ancestor of a node. Without them a node is one row throughout, unless one has several parents:
    then lineages are walked as for paths, and each ancestor counts where it is nearest.
    """
    present = links.join(
        nodes.select("host", F.col("pid").alias("parent_pid"), F.col("start").alias("parent_start")),
        ["host", "parent_pid", "parent_start"],
        "left_semi",
    )
    if not paths:
        up = materialize(
            nodes.select(*S.KEY).distinct().join(present, S.KEY, "left").selectExpr(
                *S.KEY, "parent_pid AS apid", "parent_start AS astart"
            ).distinct(),
            "parents",
        )
        if up.groupBy(*S.KEY).count().where("count > 1").isEmpty():
            found = _tops(up)
            release(up)
            return nodes.join(found, S.KEY).select(*nodes.columns, "depth", "root")
        release(up)
    iv = present.select(
        *S.KEY,
        F.col("parent_pid").alias("apid"),
        F.col("parent_start").alias("astart"),
        F.lit(-1).cast("long").alias("vf"),
        F.lit(END).alias("vt"),
    )
    reach = closure(iv, nodes.select(*S.KEY))
    # A path is as long as its tree is deep.
    walked = reach.groupBy(*S.KEY).agg(
        F.max("depth").alias("depth"),
        F.min(F.struct((-F.col("depth")).alias("d"), "apid", "astart")).alias("top"),
        F.sort_array(
            F.collect_list(F.struct((-F.col("depth")).alias("d"), "apid", "astart"))
        ).alias("p"),
    )
    path = F.transform("p", lambda x: F.struct(x.apid.alias("pid"), x.astart.alias("start")))
    root = F.struct(F.col("top.apid").alias("pid"), F.col("top.astart").alias("start"))
    return nodes.join(walked, S.KEY).select(
        *nodes.columns, "depth", root.alias("root"), *([path.alias("path")] if paths else [])
    )


def _tops(up: DataFrame) -> DataFrame:
    """(host, pid, start, depth, root) for ``up``: (host, pid, start, apid, astart), one row a node with its
    parent or null. Every node looks at an ancestor, and each round at that one's ancestor, so there are as
    many rounds as the logarithm of the depth, of one row a node."""
    self_ = "struct(pid, start)"
    first = up.selectExpr(
        *S.KEY, "coalesce(apid, pid) AS apid", "coalesce(astart, start) AS astart",
        "if(apid IS NULL, 0, 1) AS depth", f"if(apid IS NULL, {self_}, NULL) AS root",
    )
    found, left, n = _jumped(first)
    if left:
        # Lineages without a root: each now looks at a node of its cycle, and every such node is looked at.
        cycle = found.where("root IS NULL").selectExpr("host", "apid AS pid", "astart AS start").distinct()
        cycle = materialize(up.join(cycle, S.KEY), "cycles")
        release(found)
        ring = materialize(cycle.selectExpr("*", f"{self_} AS low"), "rings")
        step = 1
        while step < n:
            far = ring.selectExpr("host", "pid AS apid", "start AS astart", "apid AS bpid", "astart AS bstart", "low AS low2")
            ring, old = materialize(
                ring.join(far, ["host", "apid", "astart"]).selectExpr(
                    *S.KEY, "bpid AS apid", "bstart AS astart", "least(low, low2) AS low"
                ),
                "rings",
            ), ring
            release(old)
            step *= 2
        sizes = ring.groupBy("host", "low").agg(F.count("*").alias("size"))
        # A lineage from a node of a cycle ends at the one below it.
        below = cycle.selectExpr("host", "apid AS pid", "astart AS start", f"{self_} AS child")
        ends = ring.join(sizes, ["host", "low"]).join(below, S.KEY).selectExpr(*S.KEY, "CAST(size - 1 AS INT) AS size", "child")
        ends = materialize(ends, "cycle-ends")
        first = first.join(ends, S.KEY, "left").selectExpr(
            *S.KEY, "if(child IS NULL, apid, pid) AS apid", "if(child IS NULL, astart, start) AS astart",
            "if(child IS NULL, depth, size) AS depth", "coalesce(child, root) AS root",
        )
        found, _, _ = _jumped(first)
        release(cycle, ring, ends)
    return found.select(*S.KEY, "depth", "root")


def _jumped(first: DataFrame) -> tuple[DataFrame, bool, int]:
    """``first`` (host, pid, start, apid, astart, depth, root) with the roots that nodes without one find at
    the ends of their lineages, whether some have none, and the number of nodes."""
    table, n = materialize_counted(first, "tops")
    step = 1
    while True:
        if table.where("root IS NULL").isEmpty():
            return table, False, n
        if step > n:
            return table, True, n
        far = table.selectExpr(
            "host", "pid AS apid", "start AS astart", "apid AS bpid", "astart AS bstart", "depth AS more",
            "root AS top",
        )
        # One row a node on the right: an ancestor that very many nodes look at splits.
        further = table.where("root IS NULL").join(far, ["host", "apid", "astart"]).selectExpr(
            *S.KEY, "bpid AS apid", "bstart AS astart", "depth + more AS depth", "top AS root"
        )
        old, table = table, materialize(table.where("root IS NOT NULL").unionByName(further), "tops")
        release(old)
        step *= 2
