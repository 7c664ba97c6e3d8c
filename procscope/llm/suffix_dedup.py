"""Removal of byte strings that occur more than once in the corpus, by longest previous factors.

A suffix array of the whole corpus would hold one entry a byte. Instead strings meet where it can
matter: a string of ``length`` bytes is known by its anchor, the place of the least hash of its
``GRAM``-byte pieces, and equal strings have equal anchors at the same place. Neighbouring strings with
one anchor form a context, about one for ninety bytes. Contexts are counted by (anchor, content): what
is alike is repeated, what has an anchor of its own is not. Only unlike contexts of one anchor (the edges
of shared passages) are compared: their texts come together, are sorted as suffixes, and the longest
previous factor of every string start, found from the previous and next smaller position in suffix
order, says whether it is a later copy and of what.

An anchor may have any number of unlike contexts. Beyond ``GROUP`` they are cut into narrower contexts,
keyed by what all their strings share; the narrowest hold one string, so counting decides them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.suffix_arrays import repeats
from procscope.llm.words import _power_table, mix, slices
from procscope.session import materialize

GRAM = 24  # bytes of an anchor
GROUP = 1024  # unlike contexts of an anchor that are compared in one place
WIDTHS = (16, 1)  # strings of a narrower context
CHUNK = 1 << 18  # string starts that are looked at at once, with some 80 bytes of memory each
TEXT = 1 << 20  # bytes of contexts that are sorted at once, with some 130 bytes of memory each
KNOWN = -1  # anchor of rows that are known to repeat; ``content`` is then their number
ROW = "id long, h long, at long, anchor long, content long, weight long"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _at(start, n, lead):
    """A context's place in one number: first string, strings, bytes from there to the anchor."""
    return (start << 16) | (n << 8) | lead


START, N, LEAD = "shiftright(at, 16)", "CAST((at >> 8) & 255 AS INT)", "CAST(at & 255 AS INT)"


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every position."""
    m = len(data) - GRAM + 1
    power, inverse = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[GRAM:] - total[:m]) * inverse[:m])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from running minima of blocks of that width."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first string, strings, lead, anchor) of each context of the texts of a slice."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    out = []
    for lo in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        width = length - GRAM + 1
        g = _hashes(part)
        places = np.uint64((1 << 21) - 1)
        least = _sliding_least((g & ~places) | np.arange(len(g), dtype=np.uint64), width)
        anchor = (least & places).astype(np.int64)
        start = np.arange(len(anchor))
        text = np.searchsorted(offsets, start + lo, "right") - 1
        inside = offsets[text + 1] >= start + lo + length
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        runs = np.append(np.flatnonzero(new), len(start))
        stop = runs[np.searchsorted(runs, first, "right")]
        # The last strings of a text may reach into the next one.
        last = offsets[text[first] + 1] - length - lo + 1
        n = np.minimum(stop, last) - first
        a = anchor[first]
        out.append((text[first], first + lo - offsets[text[first]], n, a - first, g[a].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else none


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, h) name a row: rows alike in both are alike in text and are counted one by one."""
    return docs.withColumns(
        {"id": F.expr("coalesce(doc_id, -9223372036854775808)"), "h": F.xxhash64("doc_id", "text")}
    )


def _found(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offsets in slices(b.column(2)):
                text, start, n, lead, anchor = contexts(data, offsets, length)
                raw, begin = memoryview(data), offsets[text] + start
                content = np.fromiter(
                    (digest(raw[x:y]) for x, y in zip(begin.tolist(), (begin + n + length - 1).tolist(),
                                                      strict=True)),
                    np.uint64, len(text),
                ).view(np.int64)
                weight = np.ones(len(text), np.int64)
                at = _at(start, n, lead)
                if not keep_first and len(text) > len(data) // 16:
                    text, at, anchor, content, weight = _folded(text, start, n, at, anchor, content)
                cols = (ids[lo + text], hs[lo + text], at, anchor, content, weight)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)

    return _keyed(docs.select("doc_id", "text")).select("id", "h", "text").mapInArrow(run, ROW)


def _folded(text, start, n, at, anchor, content) -> tuple[np.ndarray, ...]:
    """Contexts of texts that repeat themselves within a few bytes, where a context may be as short as
    a byte: alike ones of a slice become one of their number, and runs of them are known repeats."""
    key = np.stack([anchor, content], axis=1)
    _, one, which, count = np.unique(key, axis=0, return_index=True, return_inverse=True, return_counts=True)
    again = count[which.ravel()] > 1
    spots = np.flatnonzero(again)
    if not len(spots):
        return text, at, anchor, content, np.ones(len(text), np.int64)
    new = np.ones(len(spots), bool)
    p, q = spots[1:], spots[:-1]
    new[1:] = (text[p] != text[q]) | (start[p] != start[q] + n[q])
    head = spots[new]
    size = np.add.reduceat(n[spots], np.flatnonzero(new))
    return (
        np.concatenate([text[one], text[head]]),
        np.concatenate([at[one], _at(start[head], 0, 0)]),
        np.concatenate([anchor[one], np.full(len(head), KNOWN)]),
        np.concatenate([content[one], size]),
        np.concatenate([count, np.zeros(len(head), np.int64)]),
    )


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(id, h, *columns, z) with the text compressed, which halves what the next shuffle moves."""
    kept = _keyed(docs).select("id", "h", *[F.col(f"`{c}`") for c in columns], "text")
    schema = kept.drop("text").schema.add("z", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack((x.as_py() or "").encode()) for x in b.columns[-1]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(z, pa.binary())], names=[*b.schema.names[:-1], "z"]
            )

    return kept.mapInArrow(run, schema)


def _with_texts(docs: DataFrame, wanted: DataFrame, once: bool) -> DataFrame:
    """(id, h, z, items): the texts that ``wanted`` names with its rows of them. Repeated rows come
    repeatedly unless ``once``; all their strings repeat, so that changes no verdict."""
    items = wanted.groupBy("id", "h").agg(
        F.collect_list(F.struct("at", "anchor", "content", "weight")).alias("items")
    )
    texts = _packed(docs, []).join(items, ["id", "h"]).select("id", "h", "z", "items")
    return texts.dropDuplicates(["id", "h"]) if once else texts


def _narrower(
    docs: DataFrame, wanted: DataFrame, length: int, width: int, once: bool
) -> DataFrame:
    """``wanted`` contexts cut into those of at most ``width`` strings, aligned to the anchor. Their new
    anchor is the hash of the old one, the place and the bytes that all strings of the place share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
        for b in batches:
            rows: list[list[int]] = [[] for _ in NAMES]
            for id_, h, z, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = unpack(z)
                for x in items:
                    at = x["at"]
                    start, n, lead = at >> 16, (at >> 8) & 255, at & 255
                    place = start + lead  # of the anchor
                    for bin_ in range((lead - n + 1) // width, lead // width + 1):
                        # Strings that begin ``far`` to ``near`` bytes before the anchor.
                        far = min(lead, bin_ * width + width - 1)
                        near = max(lead - n + 1, bin_ * width)
                        core = raw[place - bin_ * width : place - bin_ * width - width + 1 + length]
                        new = digest(core, seed=(x["anchor"] * 512 + bin_) & ((1 << 64) - 1))
                        text = raw[place - far : place - near + length]
                        row = (id_, h, _at(place - far, far - near + 1, far), _signed(new),
                               _signed(digest(text, seed=far)), x["weight"])
                        for col, v in zip(rows, row, strict=True):
                            col.append(v)
                    if len(rows[0]) > 1 << 18:
                        yield _batch(rows)
                        rows = [[] for _ in NAMES]
            yield _batch(rows)

    return _with_texts(docs, wanted, once).mapInArrow(run, ROW)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=NAMES)


def _compared(docs: DataFrame, wanted: DataFrame, length: int, once: bool) -> DataFrame:
    """(anchor, content, id, h, start, n, later) of the repeated strings in unlike contexts of one
    anchor: runs of string starts of the context's first place, all of them later copies or none."""
    piece = "anchor long, content long, id long, h long, at long, text binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = [c.split()[0] for c in piece.split(", ")]
        parts: list[list[pa.Array]] = [[] for _ in range(5)]
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.concat_arrays(p) for p in parts]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())], names=names)
            for p in (*parts, texts):
                p.clear()
            return out

        for b in batches:
            for i in range(b.num_rows):
                raw = unpack(b.column(2)[i].as_py())
                flat = b.column(3)[i].values
                at = flat.field("at").to_numpy()
                begin, n = at >> 16, (at >> 8) & 255
                ends = (begin + n + length - 1).tolist()
                texts += [raw[x:y] for x, y in zip(begin.tolist(), ends, strict=True)]
                one = pa.repeat(b.column(0)[i], len(at)), pa.repeat(b.column(1)[i], len(at))
                cols = (flat.field("anchor"), flat.field("content"), *one, flat.field("at"))
                for p, c in zip(parts, cols, strict=True):
                    p.append(c)
                if len(texts) >= 10_000:
                    yield flush()
            if texts:
                yield flush()

    texts = _with_texts(docs, wanted, once).mapInArrow(cut, piece)
    groups = texts.repartition("anchor").sortWithinPartitions("anchor", "id", "h", "at")

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            text = pa.concat_arrays(rows["text"].chunks).cast(pa.large_binary())
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            at = rows["at"].to_numpy()
            n = np.diff(off) - length + 1
            which = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            later, either = repeats(data, off[which] + inside, length)
            # Runs of one context and one kind.
            edge = np.ones(len(which), bool)
            edge[1:] = (which[1:] != which[:-1]) | (later[1:] != later[:-1]) | (either[1:] != either[:-1])
            head = np.flatnonzero(edge)
            many = np.diff(np.append(head, len(which)))
            keep = either[head]
            head, many = head[keep], many[keep]
            w = which[head]
            cols = [rows[c].combine_chunks().take(pa.array(w)) for c in ("anchor", "content", "id", "h")]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array((at[w] >> 16) + inside[head]), pa.array(many), pa.array(later[head])],
                names=["anchor", "content", "id", "h", "start", "n", "later"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(5).nbytes
            if size < TEXT:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["anchor"].to_numpy()
            whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if not whole:
                continue
            # Groups that are complete, in pieces of about TEXT bytes.
            yield from _solved(rows.slice(0, whole), solve)
            held = rows.slice(whole).to_batches()
            size = sum(x.column(5).nbytes for x in held)
        if held:
            yield from _solved(pa.Table.from_batches(held), solve)

    return groups.mapInArrow(
        factors, "anchor long, content long, id long, h long, start long, n long, later boolean"
    )


def _solved(rows: pa.Table, solve) -> Iterator[pa.RecordBatch]:
    """``solve`` on runs of whole groups of about TEXT bytes."""
    keys = rows["anchor"].to_numpy()
    size = np.cumsum(pc.binary_length(rows["text"]).to_numpy())
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    lo = 0
    for i, stop in enumerate(ends):
        last = i + 1 == len(ends)
        if last or size[ends[i + 1] - 1] - (size[lo - 1] if lo else 0) > TEXT:
            yield solve(rows.slice(lo, stop - lo))
            lo = int(stop)


def repeated_strings(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """(id, h, start, n): runs of string starts whose ``length`` bytes occur elsewhere, or earlier if
    ``keep_first``. A document's runs may overlap no other."""
    found = materialize(_found(docs, length, keep_first), "contexts")
    known = found.where(f"anchor = {KNOWN} AND weight = 0").selectExpr(
        "id", "h", f"{START} AS start", "content AS n"
    )
    spans, compare = [known], []
    rows = found.where("weight > 0")
    for width in (*WIDTHS, None):
        kinds = rows.groupBy("anchor", "content").agg(F.sum("weight").alias("alike"))
        groups = (
            kinds.groupBy("anchor")
            .agg(F.sum("alike").alias("total"), F.count("*").alias("kinds"))
            .where("total > 1")
        )
        kinds = kinds.join(groups.select("anchor", "kinds"), "anchor")
        marked = materialize(rows.join(kinds, ["anchor", "content"]), "marked-contexts")
        again = marked.where("alike > 1").selectExpr(
            "id", "h", "at", f"{START} AS start", f"CAST({N} AS LONG) AS n", "anchor", "content"
        )
        firsts = (
            marked.where("kinds > 1" if not keep_first else "kinds > 1 OR alike > 1")
            .groupBy("anchor", "content", "kinds")
            .agg(F.expr("min(struct(id, h, at)) AS f"), F.expr("max(alike) AS weight"))
            .selectExpr("f.id AS id", "f.h AS h", "f.at AS at", "anchor", "content", "weight", "kinds")
        )
        firsts = materialize(firsts, "unlike-contexts")
        if keep_first:
            # All but the first of alike contexts are later copies.
            first = firsts.select("anchor", "content", "id", "h", "at", F.lit(True).alias("first"))
            again = again.join(first, ["anchor", "content", "id", "h", "at"], "left").where("first IS NULL")
        spans.append(again.select("id", "h", "start", "n"))
        compare.append(firsts.where(f"kinds > 1 AND kinds <= {GROUP}").drop("kinds"))
        large = firsts.where(f"kinds > {GROUP}").drop("kinds")
        if width is None or large.isEmpty():
            break
        rows = materialize(_narrower(docs, large, length, width, keep_first), "narrower-contexts")
    wanted = compare[0]
    for c in compare[1:]:
        wanted = wanted.unionByName(c)
    shared = _compared(docs, wanted, length, keep_first)
    if keep_first:
        shared = shared.where("later")
    out = shared.select("id", "h", "start", "n")
    for s in spans:
        out = out.unionByName(s)
    return out


def covered(start: np.ndarray, n: np.ndarray, size: int, length: int) -> np.ndarray:
    """Edges of the maximal runs of bytes that lie in one of the strings: [from, to, from, to, …]."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n + length - 1, size), -1)
    mask = np.cumsum(edge[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """Documents without the bytes of repeated strings: doc_id, n_bytes, n_removed, kept, removed.

    A string of ``length`` bytes of a text's UTF-8 goes where it also starts anywhere else in the
    corpus, its own document included; with ``keep_first`` only where it starts earlier, in the order
    of doc_id and place. That is judged on the input, so overlapping copies count. ``kept`` are the
    other bytes (a cut may fall inside a character) and ``removed`` the maximal runs (first byte, after
    the last) that went. Null and empty texts have no bytes; texts shorter than ``length`` keep all.
    Repeated rows, with or without an id, repeat each other (with ``keep_first`` such rows are one
    document and are cut alike). Other columns of ``docs`` are ignored. A text must fit a worker's
    memory several times over, as any row of Spark must.
    """
    if not GRAM <= length <= 255:
        raise ValueError(f"length must lie between {GRAM} and 255")
    spans = repeated_strings(docs, length, keep_first)
    spans = spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    both = _packed(docs, ["doc_id"]).join(spans, ["id", "h"], "left").select("doc_id", "z", "spans")
    schema = (
        "doc_id long, n_bytes long, n_removed long, kept binary,"
        " removed array<struct<byte_from: long, byte_to: long>>"
    )
    span = pa.struct([("byte_from", pa.int64()), ("byte_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            size, gone, kept, froms, tos, ends = [], [], [], [], [], [0]
            for i in range(b.num_rows):
                raw = unpack(b.column(1)[i].as_py())
                cut = np.zeros(0, np.int64)
                if b.column(2)[i].is_valid:
                    flat = b.column(2)[i].values
                    cut = covered(flat.field("start").to_numpy(), flat.field("n").to_numpy(), len(raw), length)
                edges = [0, *cut.tolist(), len(raw)]
                size.append(len(raw))
                gone.append(int((cut[1::2] - cut[::2]).sum()))
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                froms.append(cut[::2])
                tos.append(cut[1::2])
                ends.append(ends[-1] + len(cut) // 2)
            if size:
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(froms)), pa.array(np.concatenate(tos))], fields=list(span)
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", "n_bytes", "n_removed", "kept", "removed"],
                )

    return both.mapInArrow(run, schema)
