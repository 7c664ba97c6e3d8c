"""Best-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so documents and gaps fall into at most ``capacity``
classes. Documents are range-sorted by length and ranked inside a class by a distributed sweep; what
crosses the network to the driver is one count per class, at any size of the corpus. One superstep
handles all documents of a length, the longest first: its successor sweep walks the classes of gaps
from the smallest that fits, every gap there takes as many documents as fit, conflicts go by rank
(document ranks to sequence numbers, as ranges), the gaps are updated, and the next superstep
follows. That equals best-fit decreasing document by document. The ranges (a few thousand) are
then joined back to the documents, which never leave the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.encoder import default_path, encoder
from procscope.operators.scan import numbered
from procscope.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, base long"
SALTS = 64


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the first takes the rest."""
    head = n % capacity
    bounds = ([0] if head else []) + list(range(head, n, capacity)) + [n]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every row of ``docs``; a null text has only the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    row = (doc_id, k, at, n, zlib.crc32(part.tobytes()))
                    rows.append(row + (part.tolist(),) if with_ids else row)
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    types.append(pa.list_(pa.int64()))
                    names.append("ids")
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN`` for so many documents of each length."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted classes of gaps that have sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequence numbers
    free = 0

    def put(gap: int, lo: int, hi: int) -> None:
        if gap and lo < hi:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((lo, hi))

    def fill(length: int, rank: int, left: int, gap: int, lo: int, hi: int) -> tuple[int, int]:
        """Documents from ``rank`` on into sequences [lo, hi); returns how many and the sequences
        used. Each takes ``gap // length`` of them, the last one what is left."""
        each = gap // length
        n = min(left, each * (hi - lo))
        used = -(-n // each)
        rows.append((length, rank, rank + n, each, lo, capacity - gap))
        full = n // each
        put(gap - each * length, lo, lo + full)
        if full < used:
            put(gap - (n - full * each) * length, lo + full, lo + used)
        return n, used

    for length in sorted(counts, reverse=True):
        rank, left = 1, counts[length]
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                n, used = fill(length, rank, left, capacity, free, free + left)
                free += used
            else:
                gap = gaps[i]
                lo, hi = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(i)
                n, used = fill(length, rank, left, gap, lo, hi)
                put(gap, lo + used, hi)
            rank, left = rank + n, left - n
    return rows


def best_fit(
    docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a null or empty text is the end token alone. Longer ones
    are cut into full pieces, the first takes the rest. Returns per piece doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Rows with the same or no doc_id are packed as documents
    of their own; other columns of ``docs`` are ignored; an empty table gives an empty result.
    ``sequences`` adds the ids themselves.
    """
    spark = docs.sparkSession
    p = materialize(pieces(docs, path or default_path(), capacity, end_id, False), "pieces")
    counts = {r[0]: r[1] for r in p.groupBy("length").count().collect()}  # one row per length
    steps = spark.createDataFrame(plan(counts, capacity), PLAN)
    p = p.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    order = ["_salt", "doc_id", "piece", "ids_crc32", "start"]
    p = numbered(p, ["length"], order, "_salt", "_rank").drop("_salt")
    # Bounded by the classes of lengths and gaps, not by the documents.
    s = F.broadcast(steps.withColumnRenamed("length", "_length"))
    at = F.col("_rank") - F.col("rank_from")
    placed = p.join(
        s, (F.col("length") == F.col("_length")) & (at >= 0) & (F.col("_rank") < F.col("rank_to"))
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(at / F.col("per_sequence"))).cast("long")
        .alias("sequence_id"),
        (F.col("base") + (at % F.col("per_sequence")) * F.col("length")).cast("long")
        .alias("offset"),
    )


def sequences(
    docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = 2048,
    end_id: int = 0,
) -> DataFrame:
    """Token ids of every packed sequence: sequence_id, ids. A group is one sequence, so bounded."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Rows alike in all of these hold the same ids.
    ids = pieces(docs, path or default_path(), capacity, end_id, True).dropDuplicates(key)
    keep = [F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key]
    on = keep[0]
    for k in keep[1:]:
        on = on & k
    j = placed.alias("p").join(ids.alias("i"), on)
    parts = F.sort_array(F.collect_list(F.struct("p.offset", "i.ids")))
    return j.groupBy("p.sequence_id").agg(
        F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids")
    )
