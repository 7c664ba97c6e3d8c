"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

The ends of A's and of B's tokens are two sorted lists of byte offsets; where both have one, a group of
tokens ends. Merging two lists of any shape splits into equal work along diagonals: on the diagonal d a
binary search finds how many of the first d merged ends are A's. Texts are laid side by side, so neither
a long text nor many short ones make a piece larger than ``PIECE`` ends. Pieces find the ends they hold
twice on their own; an end that a cut has parted is found at the cut, and groups that reach over cuts
come together when the pieces' ends are put in a row.

A pair of tokens that end together is linked: the shorter one's bytes end the longer one's. So the
vocabularies bound how many pairs there can be (``pair_bound``), whatever the size of the corpus, and
the table of pair counts may be sent to every task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.encoder import byte_letters, encoder
from procscope.session import materialize

PIECE = 1 << 13  # merged ends of a piece
SLICE = 1 << 20  # characters of texts that are laid side by side


def vocabulary_a(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    letters = byte_letters()
    size = 1 + max([*spec["model"]["vocab"].values(), *special])
    out = [b""] * size
    for token, i in spec["model"]["vocab"].items():
        out[i] = special[i] if i in special else bytes(letters[c] for c in token)
    return out


def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary_b(path: str) -> list[bytes]:
    """Bytes of each id of a piece file: U+2581 is a space, ``<0xHH>`` a byte."""
    model = _pieces(path)
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


def pair_bound(a_path: str, b_path: str) -> int:
    """The most pairs of ids that can be linked: those of which one's bytes end with the other's."""
    a, b = vocabulary_a(a_path), vocabulary_b(b_path)

    def ends(longer: list[bytes], shorter: list[bytes], whole: bool) -> int:
        many: dict[bytes, int] = {}
        for x in shorter:
            many[x] = many.get(x, 0) + 1
        first = 0 if whole else 1
        return sum(many.get(x[i:], 0) for x in longer for i in range(first, len(x)))

    return ends(a, b, True) + ends(b, a, False)


class Both:
    """The two tokenizers in a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path), _pieces(b_path)
        self.bytes_a, self.bytes_b = vocabulary_a(a_path), vocabulary_b(b_path)
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.stride = max(len(self.bytes_a), len(self.bytes_b))
        #: Every id with each mark that may follow it.
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(self.stride)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where the bytes of either are not space + text."""
        none = np.zeros(0, np.int64)
        seconds = self.b.encode(texts, num_threads=1)
        a, b = [], []
        for text, ids_b in zip(texts, seconds, strict=True):
            x, y = none, none
            if text:
                whole = b" " + text.encode()
                ids_a = self.a.encode_plain(" " + text)
                if (
                    b"".join(map(self.bytes_b.__getitem__, ids_b)) == whole
                    and b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == whole
                ):
                    x, y = ids_a.astype(np.int64), np.array(ids_b, np.int64)
            a.append(x)
            b.append(y)
        return a, b


@lru_cache(maxsize=1)
def both(a_path: str, b_path: str) -> Both:
    return Both(a_path, b_path)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the merge of two ascending lists into pieces of ``piece`` values: how many of ``a`` and of
    ``b`` come before each. Of equal values ``a``'s comes first. All diagonals are searched at once."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) >> 1
        open_ = low < high
        x, y = np.where(open_, mid, 0), np.where(open_, d - mid - 1, 0)
        first = a[x] <= b[y]
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both hold, found piece by piece."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut_a, cut_b = diagonals(a, b, piece)
    in_a, in_b = [], []
    for k in range(len(cut_a) - 1):
        i, j = cut_a[k], cut_b[k]
        if i and j < cut_b[k + 1] and a[i - 1] == b[j]:  # parted by the cut
            in_a.append(np.array([i - 1]))
            in_b.append(np.array([j]))
        x, y = a[i : cut_a[k + 1]], b[j : cut_b[k + 1]]
        if len(x) and len(y):
            at = np.searchsorted(x, y)
            hit = np.flatnonzero(x[np.minimum(at, len(x) - 1)] == y)
            in_a.append(i + at[hit])
            in_b.append(j + hit)
    if not in_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(in_a), np.concatenate(in_b)


def _side_by_side(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, byte offset after each, first token of each text and the count)."""
    flat = np.concatenate(ids)
    return flat, np.cumsum(sizes[flat]), np.cumsum([0, *map(len, ids)])


def _groups(t: Both, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """Places in ``t.marked`` of all tokens: A's, then B's, group by group."""
    gone_b, done_a = np.append(0, in_b + 1), in_a + 1
    i, j = np.arange(len(a)), np.arange(len(b))
    of_a, of_b = np.searchsorted(in_a, i), np.searchsorted(in_b, j)
    out = np.zeros(len(a) + len(b), np.int64)
    out[i + gone_b[of_a]] = a + t.stride * (in_a[of_a] == i)
    out[j + done_a[of_b]] = b + 2 * t.stride * (in_b[of_b] == j)
    return out


NAMES = ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links"]
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
LINKS = (
    "n_a long, n_b long, n_groups long, groups_sha256 string, groups string,"
    " links array<struct<a: int, b: int, n: int>>"
)


def links(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, row (a number of its own), n_a, n_b, n_groups, groups_sha256, groups and links of each
    document: its distinct linked pairs with how often they occur. ``groups`` is the text that the hash
    is of, null unless ``with_groups``."""
    kept = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    kept = kept.select("doc_id", "row", "text")
    schema = f"doc_id long, row long, {LINKS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = both(a_path, b_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                    size += len(texts[hi])
                    hi += 1
                yield align(t, batch.slice(lo, hi - lo), texts[lo:hi])
                lo = hi

    def align(t: Both, rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids_a, ids_b = t.encode(texts)
        a, end_a, first_a = _side_by_side(ids_a, t.size_a)
        b, end_b, first_b = _side_by_side(ids_b, t.size_b)
        in_a, in_b = common_ends(end_a, end_b)
        first = np.searchsorted(in_a, first_a)  # a text ends a group, so none reaches over
        order = _groups(t, a, b, in_a, in_b)
        pair = (a[in_a] << 32) | b[in_b]
        shas, texts_of, keys, counts = [], [], [], []
        for k in range(len(texts)):
            x, y = first_a[k] + first_b[k], first_a[k + 1] + first_b[k + 1]
            line = "".join(map(t.marked.__getitem__, order[x:y].tolist()))[:-1]
            shas.append(hashlib.sha256(line.encode()).hexdigest() if line else "")
            texts_of.append(line if with_groups else None)
            u, c = np.unique(pair[first[k] : first[k + 1]], return_counts=True)
            keys.append(u)
            counts.append(c)
        u, c = np.concatenate(keys), np.concatenate(counts)
        flat = pa.StructArray.from_arrays(
            [pa.array(u >> 32, pa.int32()), pa.array(u & 0xFFFFFFFF, pa.int32()), pa.array(c, pa.int32())],
            fields=list(PAIR),
        )
        cols = [
            rows.column(0), rows.column(1), pa.array(np.diff(first_a)), pa.array(np.diff(first_b)),
            pa.array(np.diff(first)), pa.array(shas), pa.array(texts_of, pa.string()),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat),
        ]
        return pa.RecordBatch.from_arrays(cols, names=NAMES)

    return kept.mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, count, best): corpus-wide links of each pair, and the most that any pair of its B id has.
    At most ``pair_bound`` rows; the window over a B id is as small as the A ids that fit its end."""
    pairs = linked.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("count"))
    return pairs.selectExpr("a", "b", "count", "max(count) OVER (PARTITION BY b) AS best")


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups per document.

    A's tokens are those of a byte-level BPE file for space + text, B's those of a piece file, which adds
    the space itself; strings of special tokens are plain text for both. Texts that are null, empty,
    or whose bytes either tokenizer does not give back have no tokens: zeros and an empty hash. Two tokens
    are linked where their byte ranges end together. A pair's count is how many links of the corpus are of
    it; ``n_best`` are a document's links whose count is the highest of their B id, ties included.
    Repeated rows count each; extra columns of ``docs`` are ignored. A text must fit a worker's memory
    several times over.
    """
    linked = materialize(links(docs, a_path, b_path, with_groups), "token-links")
    counts = materialize(pair_counts(linked), "pair-counts")
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups"]
    each = linked.select(*keys, F.explode_outer("links").alias("l")).selectExpr(*keys, "l.a", "l.b", "l.n")
    each = each.join(F.broadcast(counts), ["a", "b"], "left")
    return each.groupBy(*keys).agg(
        F.expr("coalesce(sum(n), 0) AS n_links"),
        F.expr("coalesce(sum(if(count = best, n, 0)), 0) AS n_best"),
        F.expr("coalesce(sum(n * count), 0) AS count_sum"),
    ).drop("row")
