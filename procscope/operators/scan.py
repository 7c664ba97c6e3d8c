"""Ordered operators that stay balanced when one key holds a large share of the rows.

A plain window over ``(key) order by seq`` sends every row of a key to one task. Here each key is cut
into chunks of ``seq``; the window runs inside ``(key, chunk)`` and only one summary row per chunk
crosses chunk borders. A chunk spans ``CHUNK`` arrival numbers of a host, so no task sees more than
that many rows of one key however hot the key is. There is one plan at every size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.session import materialize, release

CHUNK = 1 << 18
END = (1 << 62) - 1


def over(keys: list[str], order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} {frame})"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def chunk_of(seq: str, size: int | None = None) -> str:
    return f"CAST(floor({seq} / {CHUNK if size is None else size}) AS BIGINT)"


def collapse_runs(
    df: DataFrame, keys: list[str], value: str, seq: str = "seq", size: int | None = None
) -> DataFrame:
    """Keep the rows where ``value`` differs from the previous row of the key, as validity
    intervals ``[valid_from, valid_to)``."""
    whole = over(keys, seq)
    cols = [c for c in df.columns if c != seq]
    changed = f"_n = 1 OR NOT (_prev <=> {value})"
    d = df
    local = over(keys + ["_chunk"], seq)
    d = d.selectExpr("*", f"{chunk_of(seq, size)} AS _chunk")
    d = d.selectExpr("*", f"lag({value}) {local} AS _prev", f"row_number() {local} AS _n")
    d = d.filter(changed).drop("_prev", "_n")
    d = d.selectExpr("*", f"lag({value}) {whole} AS _prev", f"row_number() {whole} AS _n")
    return d.filter(changed).selectExpr(
        *cols, f"{seq} AS valid_from", f"coalesce(lead({seq}) {whole}, {END}L) AS valid_to"
    )


def next_at_or_after(
    lookups: DataFrame, points: DataFrame, keys: list[str], size: int | None = None
) -> DataFrame:
    """For every lookup ``(keys, seq)`` the first point ``(keys, seq)`` not before it, as distinct
    ``(keys, seq)`` rows. Lookups past the last point of their key yield nothing."""
    u = lookups.selectExpr(*keys, "seq", "false AS is_point").unionByName(
        points.selectExpr(*keys, "seq", "true AS is_point")
    )
    u = u.selectExpr("*", f"{chunk_of('seq', size)} AS _chunk").repartition(*keys, "_chunk")
    ahead = over(keys + ["_chunk"], "seq DESC, is_point DESC", UPTO)
    later = over(keys, "_chunk DESC", BEFORE)
    local = u.selectExpr("*", f"min(CASE WHEN is_point THEN seq END) {ahead} AS _hit")
    heads = u.groupBy(*keys, "_chunk").agg(F.expr("min(CASE WHEN is_point THEN seq END) AS _head"))
    heads = heads.selectExpr(*keys, "_chunk", f"min(_head) {later} AS _carry")
    return (
        local.filter("NOT is_point")
        .join(heads, keys + ["_chunk"], "left")
        .selectExpr(*keys, "coalesce(_hit, _carry) AS seq")
        .filter("seq IS NOT NULL")
        .distinct()
    )


def last_known(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], size: int | None = None
) -> DataFrame:
    """Add, for each named expression, its newest non-null value up to and including the row."""
    w = over(keys + ["_chunk"], order, UPTO)
    before = over(keys, "_chunk", BEFORE)
    d = df.selectExpr("*", f"{chunk_of(order, size)} AS _chunk").repartition(*keys, "_chunk")
    d = d.selectExpr("*", *[f"last({c}, true) {w} AS _l_{n}" for n, c in cols.items()])
    tails = d.groupBy(*keys, "_chunk").agg(
        *[F.expr(f"max_by(_l_{n}, CASE WHEN _l_{n} IS NOT NULL THEN {order} END) AS _t_{n}")
          for n in cols]
    )
    tails = tails.selectExpr(
        *keys, "_chunk", *[f"last(_t_{n}, true) {before} AS _c_{n}" for n in cols]
    )
    return d.join(tails, keys + ["_chunk"], "left").selectExpr(
        *df.columns, *[f"coalesce(_l_{n}, _c_{n}) AS {n}" for n in cols]
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str = "rn"
) -> DataFrame:
    """``row_number()`` per key without giving a key to one task.

    ``bucket`` must be non-decreasing in ``order``; rows are counted per (key, bucket) first and
    only the counts are accumulated across the key.
    """
    d = df.selectExpr("*", f"{bucket} AS _bucket")
    base = d.groupBy(*keys, "_bucket").agg(F.expr("count(1) AS _cnt"))
    base = base.selectExpr(
        *keys, "_bucket", f"coalesce(sum(_cnt) {over(keys, '_bucket', BEFORE)}, 0L) AS _base"
    )
    d = d.selectExpr("*", f"row_number() {over(keys + ['_bucket'], ', '.join(order))} AS _rn")
    return d.join(base, keys + ["_bucket"]).selectExpr(
        *df.columns, f"CAST(_base + _rn AS BIGINT) AS {name}"
    )


def max_before(
    df: DataFrame, keys: list[str], order: str, expr: str, name: str, size: int | None = None
) -> DataFrame:
    """Add the maximum of ``expr`` over the earlier rows of the key, null for its first row."""
    ck = keys + ["_chunk"]
    d = df.selectExpr("*", f"{chunk_of(order, size)} AS _chunk").repartition(*ck)
    tails = d.groupBy(*ck).agg(F.expr(f"max({expr}) AS _top"))
    tails = tails.selectExpr(*ck, f"max(_top) {over(keys, '_chunk', BEFORE)} AS _carry")
    d = d.selectExpr("*", f"max({expr}) {over(ck, order, BEFORE)} AS _in").join(tails, ck, "left")
    # greatest skips nulls
    return d.selectExpr(*df.columns, f"greatest(_in, _carry) AS {name}")


def next_rows(
    df: DataFrame,
    keys: list[str],
    tests: dict[str, str],
    value: str,
    peak: str | None = None,
    seq: str = "seq",
    size: int | None = None,
) -> DataFrame:
    """For each named test, ``value`` of the first later row of the key that passes it, null if none.

    With ``peak``, ``<name>_peak`` is its maximum over the rows after this one up to and including that
    row, or over all later rows if there is none. Inside a chunk a window that runs backwards finds
    both; across chunks one row each carries its first passing row and the maximum up to it.
    """
    ck = keys + ["_chunk"]
    back, up = f"{seq} DESC", "_chunk DESC"
    d = df.selectExpr("*", f"{chunk_of(seq, size)} AS _chunk").repartition(*ck)
    d = d.selectExpr(
        "*",
        *[f"last(CASE WHEN {t} THEN {value} END, true) {over(ck, back, BEFORE)} AS _n_{n}"
          for n, t in tests.items()],
        *[f"count_if({t}) {over(ck, back, UPTO)} AS _h_{n}" for n, t in tests.items() if peak],
    )
    if peak:
        # Rows that share their next passing row share a number; it is the last of them.
        d = d.selectExpr("*", *[f"max({peak}) {over([*ck, f'_h_{n}'], back, UPTO)} AS _w_{n}" for n in tests])
        d = d.selectExpr("*", *[f"lag(_w_{n}) {over(ck, back)} AS _m_{n}" for n in tests])
    heads = d.groupBy(*ck).agg(
        *[F.expr(f"min_by({value}, CASE WHEN {t} THEN {seq} END) AS _f_{n}") for n, t in tests.items()],
        *[F.expr(f"min_by(_w_{n}, {seq}) AS _p_{n}") for n in tests if peak],
    )
    heads = heads.selectExpr(
        "*",
        *[f"last(_f_{n}, true) {over(keys, up, BEFORE)} AS _c_{n}" for n in tests],
        *[f"count(_f_{n}) {over(keys, up, UPTO)} AS _h_{n}" for n in tests if peak],
    )
    if peak:
        heads = heads.selectExpr(
            "*", *[f"max(_p_{n}) {over([*keys, f'_h_{n}'], up, UPTO)} AS _w_{n}" for n in tests]
        )
        heads = heads.selectExpr("*", *[f"lag(_w_{n}) {over(keys, up)} AS _r_{n}" for n in tests])
    heads = heads.select(*ck, *[f"_{x}_{n}" for n in tests for x in (["c", "r"] if peak else ["c"])])
    d = d.join(heads, ck, "left")
    return d.selectExpr(
        *df.columns,
        *[f"coalesce(_n_{n}, _c_{n}) AS {n}" for n in tests],
        *[f"CASE WHEN _n_{n} IS NULL THEN greatest(_m_{n}, _r_{n}) ELSE _m_{n} END AS {n}_peak"
          for n in tests if peak],
    )


def reachable(roots: DataFrame, jump: DataFrame, keys: list[str], at: str, label: str) -> DataFrame:
    """Places (keys, at) that the roots lead to, themselves included, where each place leads to at most
    one other, ``jump``: (keys, at, nxt). Jumps double in length every round, so there are as many
    rounds as the logarithm of the longest way."""
    found = materialize(roots.select(*keys, at).distinct(), label)
    jump = materialize(jump.select(*keys, at, "nxt"), label)
    while not jump.isEmpty():
        more = found.join(jump, [*keys, at]).selectExpr(*keys, f"nxt AS {at}")
        wider = materialize(found.unionByName(more).distinct(), label)
        far = jump.selectExpr(*keys, f"{at} AS nxt", "nxt AS far")
        further = materialize(
            jump.join(far, [*keys, "nxt"]).selectExpr(*keys, at, "far AS nxt"), label
        )
        release(found, jump)
        found, jump = wider, further
    release(jump)
    return found
