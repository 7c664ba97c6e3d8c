"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The index is over the items, so it is small, and every passage of the training documents is a query
against it. Items are ordered by their greatest reachable score and cut into blocks; each term keeps
its greatest contribution per block. A passage skips every block whose bounds add up to less than
what its cheapest item needs, and scores the items of the others exactly. A passage that reaches an
item's threshold is then compared with the item's question and with its answer, word by word.

Documents stay where they are: no shuffle. An index of more than ``SHARD_BYTES`` of items is made in
shards, each of bounded size, and the documents pass by each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procscope.llm.words import PUNCTUATION_TABLE, Words, ngrams, slices

SHARD_BYTES = 8 << 20
STRIDE = 96  # passages are two strides long and start every stride
BLOCK = 8
K1, B = 1.2, 0.75
SHARE = 0.6  # of the score that the item itself would reach
OVERLAP = 0.6  # of the words of the question, and of those of the answer
GRAM = 3

LEAK = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("word_from", T.LongType()),
     T.StructField("word_to", T.LongType()), T.StructField("score", T.DoubleType()),
     T.StructField("share", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
     T.StructField("answer_overlap", T.DoubleType())]
)
ARROW_LEAK = pa.struct(
    [(f.name, pa.int64() if f.dataType == T.LongType() else pa.float64()) for f in LEAK]
)


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), PUNCTUATION_TABLE).hashes()


def split_item(text: str) -> tuple[np.ndarray, int]:
    """Word hashes of an item in lower case, and how many of them belong to the question: all but
    the last sentence, or the first two thirds of a single one."""
    parts = [h for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(h := _words_of(s))]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(parts) > 1:
        return words, len(words) - len(parts[-1])
    return words, -(-2 * len(words) // 3)


@dataclass
class Index:
    items: list[tuple[int, np.ndarray, int]]  # item_id, words, words of the question
    terms: np.ndarray  # sorted hashes
    owner: np.ndarray  # item of each indexed segment
    need: np.ndarray  # score that each segment asks for
    own: np.ndarray  # score of each segment by itself
    impact: np.ndarray  # terms x segments
    block_max: np.ndarray  # terms x blocks
    block_need: np.ndarray


def build_index(items: list[tuple[int, np.ndarray, int]], share: float = SHARE) -> Index | None:
    """Items longer than a stride are indexed by segments of that length, and verified whole."""
    segments = [
        (i, words[lo : lo + STRIDE])
        for i, (_, words, _) in enumerate(items)
        for lo in range(0, len(words), STRIDE)
    ]
    if not segments:
        return None
    terms = np.unique(np.concatenate([w for _, w in segments]))
    tf = np.zeros((len(terms), len(segments)), np.float32)
    for j, (_, w) in enumerate(segments):
        np.add.at(tf[:, j], np.searchsorted(terms, w), 1)
    df = (tf > 0).sum(1)
    idf = np.log1p((len(segments) - df + 0.5) / (df + 0.5))
    size = np.array([len(w) for _, w in segments], np.float32)
    norm = K1 * (1 - B + B * size / size.mean())
    impact = (idf[:, None] * tf * (K1 + 1) / (tf + norm[None, :])).astype(np.float32)
    own = impact.sum(0)
    order = np.argsort(own, kind="stable")  # blocks of items that ask for about the same
    impact, own = impact[:, order], own[order]
    owner = np.array([segments[j][0] for j in order])
    at = np.arange(0, len(order), BLOCK)
    need = own * np.float32(share * (1 - 1e-5))
    return Index(
        items, terms, owner, need, own, impact,
        np.maximum.reduceat(impact, at, axis=1), np.minimum.reduceat(need, at),
    )


def _covered(part: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Words of ``part`` in grams that the region has too; a shorter part is one gram."""
    n = min(GRAM, len(part))
    covered = np.zeros(len(part), bool)
    if n:
        hit = np.isin(ngrams(part, n), ngrams(region, n))
        for k in range(n):
            covered[k : k + len(hit)] |= hit
    return covered


def _overlap(item: np.ndarray, n_question: int, region: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's words in grams that the region has too: grams of the
    item, and those of each part by itself, which need not stand side by side."""
    whole = _covered(item, region)
    share = lambda x: float(x.mean()) if len(x) else 1.0
    question = whole[:n_question] | _covered(item[:n_question], region)
    answer = whole[n_question:] | _covered(item[n_question:], region)
    return share(question), share(answer)


def find_leaks(texts: pa.Array, index: Index, overlap: float = OVERLAP) -> list[list[dict]]:
    """Verified leaks of each text, given in lower case; one per item, at its best passage."""
    out: list[list[dict]] = []
    for lo, hi, data, offsets in slices(texts):
        w = Words(data, offsets, PUNCTUATION_TABLE)
        found: list[dict[int, dict]] = [{} for _ in range(hi - lo)]
        if len(w):
            _query(w, index, overlap, found)
        out += [list(f.values()) for f in found]
    return out


def _query(w: Words, index: Index, overlap: float, found: list[dict[int, dict]]) -> None:
    h = w.hashes()
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == h)
    if not len(known):
        return
    n_words = np.diff(w.first)
    doc = np.searchsorted(w.first, known, "right") - 1
    n_strides = -(-n_words // STRIDE)
    base = np.cumsum(n_strides) - n_strides
    stride = base[doc] + (known - w.first[doc]) // STRIDE
    n_terms = len(index.terms)
    pair = np.unique(stride * n_terms + at[known])
    # A passage has the terms of its stride and of the next one of its document.
    stride_doc = np.repeat(np.arange(len(n_words)), n_strides)
    s = pair // n_terms
    back = s > base[stride_doc[s]]
    pair = np.unique(np.concatenate((pair, pair[back] - n_terms)))
    passage, term = pair // n_terms, pair % n_terms
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    bound = np.add.reduceat(index.block_max[term], first, axis=0)
    rows, blocks = np.nonzero(bound >= index.block_need * np.float32(1 - 1e-5))
    ends = np.append(first, len(term))
    for r in np.unique(rows):
        terms = term[ends[r] : ends[r + 1]]
        segs = (blocks[rows == r][:, None] * BLOCK + np.arange(BLOCK)).ravel()
        segs = segs[segs < len(index.own)]
        score = index.impact[np.ix_(terms, segs)].sum(0)
        p = int(passage[first[r]])
        d = int(stride_doc[p])
        start = w.first[d] + (p - base[d]) * STRIDE
        stop = min(start + 2 * STRIDE, w.first[d + 1])
        for j in np.flatnonzero(score >= index.need[segs]):
            seg = segs[j]
            k = int(index.owner[seg])
            item_id, words, n_question = index.items[k]
            reach = len(words) if len(words) > STRIDE else 0
            a, b = max(w.first[d], start - reach), min(w.first[d + 1], stop + reach)
            q, ans = _overlap(words, n_question, h[a:b])
            if q < overlap or ans < overlap:
                continue
            leak = {
                "item_id": item_id, "word_from": int(a - w.first[d]),
                "word_to": int(b - w.first[d]), "score": float(score[j]),
                "share": float(score[j] / index.own[seg]), "question_overlap": q,
                "answer_overlap": ans,
            }
            old = found[d].get(k)
            if old is None or (q + ans, leak["share"]) > (
                old["question_overlap"] + old["answer_overlap"], old["share"]
            ):
                found[d][k] = leak


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes over all items with words, each of about ``SHARD_BYTES`` at most."""
    low = items.where("item_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "CAST(item_id AS LONG) AS item_id", "lower(text) AS text"
    )
    total = low.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SHARD_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = low.where(part == k).distinct().orderBy("item_id", "text").collect()
        split = [(r.item_id, *split_item(r.text)) for r in rows]
        index = build_index([x for x in split if len(x[1])])
        if index is not None:
            yield index


def mark_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks") -> DataFrame:
    """``docs`` with the leaked items of each row as an array column, empty for clean ones.

    ``items``: item_id, text. Words are compared in lower case without punctuation. Null and empty
    texts have no leaks; items without words or id are in none; repeated rows are judged alike.
    Columns of ``docs`` stay, whatever their names.
    """
    fields = [f for f in docs.schema.fields if f.name != name]
    low = "__lower"
    out = docs.select(*[F.col(f"`{f.name}`") for f in fields]).withColumn(
        name, F.lit(None).cast(T.ArrayType(LEAK))
    )
    for index in shards(items):
        schema = T.StructType([*fields, T.StructField(name, T.ArrayType(LEAK))])
        out = out.withColumn(low, F.lower("text")).mapInArrow(_marker(index, name, low), schema)
    return out.withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(LEAK))))


def _marker(index: Index, name: str, low: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, n in enumerate(b.schema.names) if n not in (name, low)]
            leaks = find_leaks(b.column(low), index)
            before = b.column(name).to_pylist()
            leaks = [(x or []) + y for x, y in zip(before, leaks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(leaks, pa.list_(ARROW_LEAK))],
                names=[*(b.schema.names[i] for i in keep), name],
            )

    return run
