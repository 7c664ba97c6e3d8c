"""Exact top-k search by inner product over a pivot-distance index.

Vectors are whole numbers. An extra coordinate ``sqrt(M - |x|^2)``, with M the largest squared length,
turns inner products into distances: ``|q - x|^2 = |q|^2 + M - 2 q.x`` for a query with extra
coordinate 0. Every vector is keyed by its nearest pivot and its distance to it; the distances of a
pivot are cut into annuli. For a query, the triangle inequality gives each annulus a least
distance. The first expansion visits the nearest annuli until they hold enough vectors; the k-th
best of these bounds the answer, and the second expansion visits the annuli that can still hold
something as near, and stops there. Scores are exact integers.

Annuli are a fixed number; their rows are dealt out in blocks, so a vector that a third of the rows
share spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.session import materialize

PIVOTS, ANNULI = 16, 8
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
TASK = "pivot int, annulus int, query_id long, q long, vec binary, bound double"
HITS = "query_id long, q long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): components as floor(scale * component). Rows with a null id, a null vector, or
    a null or non-finite component are left out."""
    bad = "exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    return vectors.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT {bad}").selectExpr(
        "CAST(vec_id AS LONG) AS vec_id",
        f"transform(embedding, v -> floor(CAST(v AS DOUBLE) * {scale})) AS x",
    )


@dataclass
class Index:
    """Rows by pivot and annulus, and what is known about each annulus."""

    rows: DataFrame  # vec_id, pivot, distance, annulus, vec
    pivots: np.ndarray
    annuli: np.ndarray  # pivot, annulus, rows, least and greatest distance
    dim: int
    top: float  # largest squared length
    dtype: str
    exact_float: bool  # products stay below 2^53


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def _distances(x: np.ndarray, p: np.ndarray, top: float, query: bool) -> np.ndarray:
    """From each row of ``x`` to each pivot, in the lengthened space."""
    x, p = x.astype(np.float64), p.astype(np.float64)
    xx, pp = (x * x).sum(1), (p * p).sum(1)
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - xx, 0))
    d = xx[:, None] + pp[None, :] - 2 * x @ p.T
    d += (extra[:, None] - np.sqrt(np.maximum(top - pp, 0))[None, :]) ** 2
    return np.sqrt(np.maximum(d, 0))


def build(vectors: DataFrame, scale: int = 1024) -> Index | None:
    """Index every vector; None without any. Vectors of different sizes count as padded with 0."""
    q = quantized(vectors, scale)
    dim, top, most = q.agg(
        F.expr("max(size(x))"),
        F.expr("max(aggregate(x, 0D, (a, v) -> a + CAST(v AS DOUBLE) * v))"),
        F.expr("max(coalesce(array_max(transform(x, v -> abs(v))), 0L))"),
    ).first()
    if dim is None:
        return None
    dtype = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    by_hash = q.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
    pivots = np.zeros((len(by_hash), dim), np.int64)
    for i, r in enumerate(by_hash):
        pivots[i, : len(r.x)] = r.x
    pivots = np.unique(pivots, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            d = _distances(x, pivots, top, False)
            near = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            vec = [v.tobytes() for v in x.astype(dtype)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(near, pa.int32()),
                 pa.array(d[np.arange(len(x)), near], pa.float64()), pa.array(vec, pa.binary())],
                names=["vec_id", "pivot", "distance", "vec"],
            )

    rows = materialize(
        q.mapInArrow(run, "vec_id long, pivot int, distance double, vec binary"), "pivot-index"
    )
    cuts = ", ".join(str(i / ANNULI) for i in range(1, ANNULI))
    edges = rows.groupBy("pivot").agg(
        F.expr(f"percentile_approx(distance, array({cuts}), 1000) AS edges")
    )
    rows = rows.join(F.broadcast(edges), "pivot").selectExpr(  # one row per pivot
        "vec_id", "pivot", "distance", "vec", "size(filter(edges, e -> distance > e)) AS annulus"
    )
    known = rows.groupBy("pivot", "annulus").agg(
        F.count("*"), F.min("distance"), F.max("distance")
    )
    table = np.array([tuple(r) for r in known.collect()], np.float64)  # PIVOTS x ANNULI rows
    return Index(rows, pivots, table, dim, top, dtype, float(most) ** 2 * max(dim, 1) < 2**52)


def _tasks(index: Index, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """The annuli that each query visits. ``queries``: query_id, q, vec and, for the second
    expansion, the k-th best score so far (null without one)."""
    n, low, high = index.annuli[:, 2], index.annuli[:, 3], index.annuli[:, 4]
    pivot, annuli = index.annuli[:, 0].astype(int), index.annuli
    dtype, pivots, most = index.dtype, index.pivots, index.top
    names = ["pivot", "annulus", "query_id", "q", "vec", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v.as_py(), dtype) for v in b.column("vec")]
            if not x:
                continue
            x = np.stack(x).astype(np.float64)
            d = _distances(x, pivots, most, True)
            here = d[:, pivot]
            least = np.maximum(here - high, low - here)
            # Whoever is keyed by a pivot is no nearer to the others.
            least = np.maximum(np.maximum(least, (here - d.min(1, keepdims=True)) / 2), 0)
            order = np.argsort(least, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            start = np.zeros_like(least, bool)
            np.put_along_axis(start, order, before < k + 1, axis=1)
            if first:
                visit, bound = start, np.full(len(x), -np.inf)
            else:
                bound = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                bound = np.where(np.isnan(bound), -np.inf, bound)
                reach = np.sqrt(np.maximum((x * x).sum(1) + most - 2 * bound, 0))
                visit = ~start & (least <= (reach * (1 + 1e-9) + 1e-6)[:, None])
            i, a = np.nonzero(visit)
            cols = [
                pa.array(annuli[a, 0], pa.int32()), pa.array(annuli[a, 1], pa.int32()),
                b.column("query_id").take(pa.array(i)), b.column("q").take(pa.array(i)),
                b.column("vec").take(pa.array(i)), pa.array(bound[i], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return queries.mapInArrow(run, TASK)


def _visit(index: Index, tasks: DataFrame, k: int, n_queries: int) -> DataFrame:
    """Best ``k`` of each annulus block for each query that visits it."""
    blocks = {(int(a[0]), int(a[1])): math.ceil(a[2] / BLOCK_ROWS) for a in index.annuli}
    of_queries = math.ceil(n_queries / BLOCK_QUERIES)
    sizes = index.rows.sparkSession.createDataFrame(
        [(*key, n) for key, n in blocks.items()], "pivot int, annulus int, n int"
    )
    sizes = F.broadcast(sizes)  # one row per annulus
    rows = index.rows.join(sizes, ["pivot", "annulus"]).selectExpr(
        "pivot", "annulus", "CAST(pmod(xxhash64(vec_id), n) AS INT) AS block",
        f"explode(sequence(0, {max(of_queries, 1) - 1})) AS part", "vec_id", "vec",
    )
    asks = tasks.join(sizes, ["pivot", "annulus"]).selectExpr(
        "pivot", "annulus", "explode(sequence(0, n - 1)) AS block",
        f"CAST(pmod(xxhash64(query_id), {max(of_queries, 1)}) AS INT) AS part",
        "query_id", "q", "vec", "bound",
    )
    dtype, kind = index.dtype, np.float64 if index.exact_float else np.int64

    def best(key, data: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if data.num_rows and ask.num_rows:
            data = data.sort_by("vec_id")
            ids = data["vec_id"].to_numpy()
            x = np.stack([np.frombuffer(v, dtype) for v in data["vec"].to_pylist()]).astype(kind)
            asked, q = ask["query_id"].to_numpy(), ask["q"].to_numpy()
            bound, vecs = ask["bound"].to_numpy(), ask["vec"].to_pylist()
            for lo in range(0, len(asked), 256):
                y = np.stack([np.frombuffer(v, dtype) for v in vecs[lo : lo + 256]]).astype(kind)
                for i, s in enumerate(y @ x.T, lo):
                    keep = np.flatnonzero((s >= bound[i]) & (ids != asked[i]))
                    s = s[keep].astype(np.int64)
                    top = np.argsort(-s, kind="stable")[:k]
                    for col, v in zip(out, (asked[i], q[i]), strict=False):
                        col.append(np.full(len(top), v))
                    out[2].append(ids[keep[top]])
                    out[3].append(s[top])
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(
            {n: pa.array(c, pa.int64())
             for n, c in zip(("query_id", "q", "vec_id", "score"), cols, strict=True)}
        )

    keys = ["pivot", "annulus", "block", "part"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(best, HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = "PARTITION BY query_id, q ORDER BY score DESC, vec_id"
    return hits.selectExpr("*", f"row_number() OVER ({order}) AS rank").where(f"rank <= {k}")


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` highest inner products of every query row with all other rows.

    ``vectors``: vec_id, embedding; ``is_query``: SQL condition on vec_id. Returns query_id, rank,
    vec_id, score; all candidates where there are fewer than ``k``. Ties go to the smaller vec_id.
    Rows with null or non-finite parts take no part; a query is not its own candidate, nor are rows
    with its id. A repeated id with another vector is another query; repeated rows are one query
    and a candidate each. No vectors: no rows.
    """
    index = build(vectors, scale)
    if index is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long"
        )
    queries = (
        index.rows.where(is_query)
        .selectExpr("vec_id AS query_id", "xxhash64(vec) AS q", "vec")
        .dropDuplicates(["query_id", "q"])
    )
    queries = materialize(queries, "queries")
    n = queries.count()
    near = materialize(_top(_visit(index, _tasks(index, queries, k, True), k, n), k), "near")
    kth = near.where(f"rank = {k}").selectExpr("query_id", "q", "score AS kth")
    bounded = queries.join(kth, ["query_id", "q"], "left")
    rest = _visit(index, _tasks(index, bounded, k, False), k, n)
    both = near.drop("rank").unionByName(rest)
    return _top(both, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
