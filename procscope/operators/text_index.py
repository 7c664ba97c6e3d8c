"""Search over incidents by posting lists that grow with the store.

A search term is a substring, so words do not help: what is listed are the three-byte grams of each
incident's search text, in segments of arrival numbers. A list of a gram and a segment holds at most
``SEGMENT`` numbers, however common the gram, and lies in a folder of its gram's bucket. It is cut by
slices of texts as they are read, and its numbers are places in the segment of two bytes each, so that
neither a shuffle nor a sort meets one row per gram of a text. A search reads the lists of its rarest
grams only, intersects them, and looks at the texts of what is left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procscope.functions import events as X
from procscope.functions import text as T

GRAM = 3
SEGMENT = 1 << 16  # arrival numbers of a list; at most that, as places have two bytes
BUCKETS = 64  # folders that the grams are dealt to
MOST_GRAMS = 4  # lists that a search intersects
BLOCK = 1 << 13  # arrival numbers whose texts are in one file
SLICE = 1 << 21  # bytes of text whose grams are sorted at once
ZERO = 1 << 15  # what is taken off a place so that it fits a smallint
LISTS = "segment long, gram binary, n int, places array<smallint>"
TEXTS = "id long, host string, hay string"


def _bucket(gram: str) -> str:
    return f"CAST(pmod(xxhash64({gram}), {BUCKETS}) AS INT)"


def _codes(data: np.ndarray) -> np.ndarray:
    """Every gram of the bytes as a number, by the place of its first byte."""
    d = data.astype(np.uint32)
    return d[:-2] << 16 | d[1:-1] << 8 | d[2:]


def _grams_of(data: np.ndarray) -> np.ndarray:
    """The distinct grams of one text of any length."""
    seen = np.zeros(1 << 24, bool)
    for a in range(0, len(data) - GRAM + 1, SLICE):
        seen[_codes(data[a : a + SLICE + GRAM - 1])] = True
    return np.flatnonzero(seen).astype(np.uint64)


def _listed(data: np.ndarray, offsets: np.ndarray, segment: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The lists of the texts ``data[offsets[i]:offsets[i + 1]]``, which are in order of segment and place."""
    lengths = np.diff(offsets)
    if len(lengths) == 1:
        pairs = _grams_of(data[offsets[0] : offsets[1]])
        row = np.zeros(len(pairs), np.int64)
    else:
        first = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        # A gram that reaches into the next text is of none.
        whole = first[:-2] == first[2:]
        part = np.cumsum(np.diff(segment, prepend=segment[:1]) != 0).astype(np.uint64)
        codes = _codes(data[offsets[0] : offsets[-1]])[whole].astype(np.uint64)
        row = first[:-2][whole]
        # Twenty bits hold the texts of a slice, as each has a byte; 24 the gram; the rest its segment.
        pairs = np.unique(part[row.astype(np.int64)] << np.uint64(44) | codes << np.uint64(20) | row)
        row = (pairs & np.uint64((1 << 20) - 1)).astype(np.int64)
        pairs >>= np.uint64(20)
    starts = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] + np.uint64(1)) != 0)
    ends = np.append(starts, len(pairs))
    code = (pairs[starts] & np.uint64(0xFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    grams = pa.Array.from_buffers(
        pa.binary(GRAM), len(starts), [None, pa.py_buffer(np.ascontiguousarray(code))]
    ).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(segment[row[starts]], pa.int64()), grams, pa.array(np.diff(ends), pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[row], pa.int16())),
        ],
        names=["segment", "gram", "n", "places"],
    )


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``SLICE`` bytes and an eighth as many texts; a longer text is one."""
    a, total = 0, 0
    for b, n in enumerate(lengths.tolist()):
        if b > a and (total + n > SLICE or b - a >= SLICE >> 3):
            yield a, b
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def _lists(texts: DataFrame, segment: int) -> DataFrame:
    """Lists of (id, hay) rows, one for each gram, segment and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("id")
            id_ = table["id"].to_numpy()
            hay = table["raw"].combine_chunks()
            hay = hay.chunk(0) if isinstance(hay, pa.ChunkedArray) else hay
            if not len(hay):
                continue
            _, offsets, data = hay.buffers()
            offsets = np.frombuffer(offsets, np.int32)[hay.offset : hay.offset + len(hay) + 1]
            data = np.frombuffer(data, np.uint8)
            part = np.floor_divide(id_, segment)
            place = (id_ - part * segment - ZERO).astype(np.int16)
            for a, b in _slices(np.diff(offsets)):
                yield _listed(data, offsets[a : b + 1], part[a:b], place[a:b])

    raw = texts.selectExpr("id", "encode(hay, 'UTF-8') AS raw").filter(f"octet_length(raw) >= {GRAM}")
    return raw.mapInArrow(run, LISTS)


class SearchIndex:
    """The index of one store, in ``folder``. Each batch of arrivals adds files of its own, so that one
    that runs again replaces what it wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, table: str, batch: int | None = None) -> str:
        path = os.path.join(self.folder, table)
        return path if batch is None else os.path.join(path, f"batch={batch}")

    def add(self, incidents: DataFrame, batch: int) -> None:
        """Index (id, host, record) rows. A row without any text is found by no term."""
        texts = incidents.selectExpr("id", "host", f"{T.haystack()} AS hay", f"id DIV {SEGMENT} AS segment")
        # By number: texts of the same words shrink so much in a shuffle that a few tasks would get them all.
        ends = incidents.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        blocks = 1 if ends.lo is None else ends.hi // BLOCK - ends.lo // BLOCK + 1
        (texts.repartition(blocks, F.expr(f"id DIV {BLOCK}")).write.mode("overwrite")
         .partitionBy("segment").parquet(self._path("texts", batch)))
        written = self.spark.read.schema(f"{TEXTS}, segment long").parquet(self._path("texts", batch))
        lists = _lists(written, SEGMENT).selectExpr("*", f"{_bucket('gram')} AS bucket")
        lists = lists.repartition("bucket", "segment").sortWithinPartitions("bucket", "gram")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(self._path("lists", batch))

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"{LISTS}, batch int, bucket int").parquet(self._path("lists"))

    def texts(self) -> DataFrame:
        return self.spark.read.schema(f"{TEXTS}, batch int, segment long").parquet(self._path("texts"))

    def search(self, query: str) -> DataFrame:
        """(id, host) of incidents whose text contains every whitespace-separated term."""
        terms = sorted(set(query.strip().lower().split()))
        holds = " AND ".join(f"contains(hay, {X.quote(t)})" for t in terms) or "true"
        raw = [t.encode() for t in terms]
        grams = sorted({t[i : i + GRAM] for t in raw for i in range(len(t) - GRAM + 1)})
        texts = self.texts()
        if not grams:  # terms of one or two bytes are in no list
            return texts.filter(holds).select("id", "host")
        names = ", ".join(f"X'{g.hex()}'" for g in grams)
        of = self.spark.range(1).selectExpr(*[_bucket(f"X'{g.hex()}'") for g in grams]).first()
        buckets = ", ".join(str(b) for b in set(of))
        lists = self.lists().filter(f"bucket IN ({buckets}) AND gram IN ({names})")
        counted = lists.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # one row a gram at most
        sizes = {bytes(r.gram): r.n for r in counted}
        if len(sizes) < len(grams):
            return texts.limit(0).select("id", "host")
        rarest = sorted(grams, key=lambda g: (sizes[g], g))[:MOST_GRAMS]
        names = ", ".join(f"X'{g.hex()}'" for g in rarest)
        found = (
            lists.filter(f"gram IN ({names})")
            .selectExpr("segment", "explode(places) AS place")
            .selectExpr("segment", f"segment * {SEGMENT} + {ZERO} + place AS id")
            .groupBy("segment", "id").agg(F.count("*").alias("n"))
            .filter(f"n = {len(rarest)}").select("segment", "id")
        )
        # Segments without a candidate are pruned by their folders.
        return texts.join(found, ["segment", "id"], "left_semi").filter(holds).select("id", "host")
