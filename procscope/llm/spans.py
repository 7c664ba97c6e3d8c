"""Removal of word windows that occur more than once in the corpus.

A window of ``window`` words is known by its minimizer, the least hash of its ``GRAM``-word pieces:
equal windows have equal minimizers. Neighbouring windows with one minimizer form a context. Only
contexts whose minimizer occurs elsewhere can hold a repeated window, and two alike contexts hold
the same windows, so almost everything is decided by counting contexts, about one for sixteen
words. Contexts that differ but share a minimizer (the edges of shared passages) are compared window
by window.

The reference is the corpus itself here, and grows with it, so automata of its shards can not be
broadcast; see the README.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.words import R, Words, _power_table, mix, ngrams, rolling, slices
from procscope.session import materialize

GRAM = 5
CONTEXTS = "key long, start int, n int, minimizer long, content long, inner boolean"
FULL, PARTIAL, SAMPLE = 0, 1, 2


def _least(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value of every ``width`` consecutive ones, and its first and last position."""
    value, first, last = g, np.arange(len(g)), np.arange(len(g))

    def merge(shift: int, v, f, z):
        n = len(v) - shift
        a, b = v[:n], v[shift:]
        return (
            np.minimum(a, b),
            np.where(b < a, f[shift:], f[:n]),
            np.where(b <= a, z[shift:], z[:n]),
        )

    have = 1
    while have * 2 <= width:
        value, first, last = merge(have, value, first, last)
        have *= 2
    if have < width:
        value, first, last = merge(width - have, value, first, last)
    return value, first, last


def contexts(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimizer, content hash, inner) of each context of a slice.
    ``inner``: the minimizer occurs in it at two places, so windows in it may be alike."""
    h = w.hashes()
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(h) < window:
        return none
    value, first, last = _least(ngrams(h, GRAM), window - GRAM + 1)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
    if not len(at):
        return none
    value, first, last, doc = value[at], first[at], last[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    # Long runs (texts that repeat a few words) are cut, so that no context is long.
    if (n > window).any():
        start = np.concatenate(
            [np.arange(s, s + k, window) for s, k in zip(start, n, strict=True)]
        )
        n = np.diff(np.append(start, len(at)))
    moved = np.maximum.reduceat(last, start) != np.minimum.reduceat(first, start)
    power, inverse = _power_table(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    a = at[start]
    content = mix((total[a + n + window - 1] - total[a]) * inverse[a] ^ (n.astype(np.uint64) * R))
    d = doc[start]
    return d, a - w.first[d], n, value[start], content, moved


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows alike in id and text share a key; they are still counted one by one."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _contexts_of(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, _, data, offsets in slices(b.column(1)):
                d, start, n, least, content, inner = contexts(Words(data, offsets), window)
                cols = [
                    pa.array(keys[lo + d]), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                    pa.array(least.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(inner.astype(bool)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _keyed(docs.select("doc_id", "text")).select("__key", "text").mapInArrow(run, CONTEXTS)


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(__key, *columns, __z) with the text compressed, which halves what the next shuffle moves."""
    kept = _keyed(docs).select("__key", *[F.col(f"`{c}`") for c in columns], "text")
    schema = kept.drop("text").schema.add("__z", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack((x.as_py() or "").encode()) for x in b.columns[-1]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(z, pa.binary())], names=[*b.schema.names[:-1], "__z"]
            )

    return kept.mapInArrow(run, schema)


def _windows_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, at, hash, weight) of each window in the wanted contexts (key, items)."""
    both = _packed(docs, []).join(wanted.withColumnRenamed("key", "__key"), "__key")
    schema = "key long, at int, hash long, weight int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            keys, z, items = b.column(0).to_pylist(), b.column(1), b.column(2)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, key in enumerate(keys):
                raw = np.frombuffer(unpack(z[i].as_py()), np.uint8)
                r = rolling(Words(raw, np.array([0, len(raw)])).hashes(), window).view(np.int64)
                flat = items[i].values
                start, n, kind = (
                    flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "kind")
                )
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                weight = np.repeat(np.where(kind == SAMPLE, 2, 1), n)
                for col, v in zip(out, (np.full(len(at), key), at, r[at], weight), strict=True):
                    col.append(v)
            if keys:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
                cols = [pa.array(np.concatenate(c), t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "at", "hash", "weight"])

    return both.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(key, spans): for each document key the first words and numbers of its repeated windows."""
    found = materialize(_contexts_of(docs, window), "contexts")
    kinds = found.groupBy("minimizer", "content").agg(
        F.count("*").alias("n_alike"),
        F.max("inner").alias("inner"),
        F.min(F.struct("key", "start")).alias("first"),
    )
    shared = (
        kinds.groupBy("minimizer")
        .agg(F.sum("n_alike").alias("total"), F.count("*").alias("kinds"),
             F.max("inner").alias("any_inner"), F.min("n_alike").alias("fewest"))
        .where("total > 1 OR any_inner")
    )
    # Only what occurs again goes on.
    kinds = kinds.select("minimizer", "content", "n_alike", "first").join(shared, "minimizer")
    kinds = materialize(kinds.drop("total"), "context-kinds")
    marked = found.drop("inner").join(
        kinds.select("minimizer", "content", "n_alike", "kinds", "any_inner"),
        ["minimizer", "content"],
    )
    once = "n_alike = 1 AND (kinds > 1 OR any_inner)"
    marked = marked.where(f"n_alike > 1 OR ({once})").selectExpr(
        "key", "start", "n", f"if(n_alike > 1, {FULL}, {PARTIAL}) AS kind"
    )
    marked = materialize(marked, "marked-contexts")
    # One of the alike contexts stands for all where others must be compared with it.
    samples = (
        kinds.where("n_alike > 1 AND fewest = 1")
        .selectExpr("first.key AS key", "first.start AS start")
        .distinct()
        .join(marked.where(f"kind = {FULL}"), ["key", "start"])
        .selectExpr("key", "start", "n", f"{SAMPLE} AS kind")
        .distinct()
    )
    item = F.struct("start", "n", "kind")
    compare = marked.where(f"kind = {PARTIAL}").unionByName(samples)
    wanted = compare.groupBy("key").agg(F.collect_list(item).alias("items"))
    windows = materialize(_windows_of(docs, wanted, window), "windows")
    again = windows.groupBy("hash").agg(F.sum("weight").alias("w")).where("w > 1").select("hash")
    single = windows.where("weight = 1").join(again, "hash", "left_semi")
    spans = marked.where(f"kind = {FULL}").select("key", "start", "n").unionByName(
        single.selectExpr("key", "at AS start", "1 AS n")
    )
    # At most a document's words.
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(spans: pa.Scalar, n_words: int, window: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    flat = spans.values
    start, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Documents without the words of repeated windows: doc_id, n_words, n_removed, kept, removed.

    Words are longest runs of anything but 0x20 and 0x09-0x0D. A window goes where its words, in
    order, also start anywhere else in the corpus, its own document included; that is judged on the
    input. ``kept`` are the other words, joined by one space, and ``removed`` the spans of words
    (first, after the last) that went. A null text has no words; documents of fewer words than
    a window keep all. Repeated rows, with or without an id, repeat each other. Other columns of
    ``docs`` are ignored.
    """
    spans = repeated_windows(docs, window).withColumnRenamed("key", "__key")
    both = _packed(docs, ["doc_id"]).join(spans, "__key", "left").drop("__key")
    schema = (
        "doc_id long, n_words long, n_removed long, kept string,"
        " removed array<struct<word_from: int, word_to: int>>"
    )
    span = pa.struct([("word_from", pa.int32()), ("word_to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids, z, spans = b.column(0), b.column(1), b.column(2)
            rows: list[tuple] = []
            for i in range(b.num_rows):
                words = unpack(z[i].as_py()).split()  # bytes split at just the six break bytes
                gone, cut = 0, []
                n = len(words)
                if spans[i].is_valid:
                    mask = covered(spans[i], n, window)
                    gone = int(mask.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
                    cut = [
                        {"word_from": x, "word_to": y}
                        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
                    ]
                    words = itertools.compress(words, (~mask).tolist())
                rows.append((n, gone, b" ".join(words), cut))
            if rows:
                n, gone, kept, cut = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(cut, pa.list_(span))],
                    names=["doc_id", "n_words", "n_removed", "kept", "removed"],
                )

    return both.mapInArrow(run, schema)
