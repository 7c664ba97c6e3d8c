"""Compare registered queries with their SQL on an independent engine."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t))
    )


def compare(df, con, sql):
    """(ok, message) for a DataFrame against SQL text."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = list(set(got[1]) - set(want[1]))[:2], list(set(want[1]) - set(got[1]))[:2]
        return False, f"rows {len(got[1])} / {len(want[1])} {extra}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return False, f"{got[0]}: {a} / {b}"
    return True, f"{len(got[1])} rows"
