"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of what its words
look like (sizes, letters, symbols, repetition), an encoder layer turns it into a representation,
gated attention weighs the passages of a document, and a logistic layer scores the weighted sum. All
layers are learned together from labels of documents. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procscope.llm.words import Words, give_back, slices

PASSAGE = 48
HIDDEN, ATTENTION = 24, 12
CLASSES = ("|", "#$%&*", "!", ".", ",;:", "?", "\"'`", "()[]{}<>", "@/\\_=+~^", "0123456789")


def _byte_classes() -> np.ndarray:
    """(256, classes): upper-case ASCII, lower-case ASCII, bytes of longer characters, CLASSES."""
    t = np.zeros((256, 3 + len(CLASSES)), np.float32)
    t[65:91, 0] = t[97:123, 1] = t[128:, 2] = 1
    for i, chars in enumerate(CLASSES):
        t[[ord(c) for c in chars], 3 + i] = 1
    return t


BYTES = _byte_classes()
_PER_WORD = BYTES.shape[1] + 12
FEATURES = _PER_WORD + 2


def _word_features(w: Words) -> np.ndarray:
    """One row of features for each word."""
    n = len(w)
    size = (w.ends - w.starts).astype(np.float32)
    out = np.zeros((n, _PER_WORD), np.float32)
    k = BYTES.shape[1]
    for j in range(k):  # the share of each class among the word's bytes
        hit = np.concatenate(([0], np.cumsum(BYTES[w.data, j], dtype=np.float64)))
        out[:, j] = (hit[w.ends] - hit[w.starts]) / size
    h = w.hashes()
    for lag in (1, 2, 3, 4):
        if n > lag:
            out[lag:, k + lag - 1] = h[lag:] == h[:-lag]
    first = w.first[:-1][w.first[:-1] < n]
    for lag in (1, 2, 3, 4):  # not across documents
        for d in range(lag):
            at = first + d
            out[at[at < n], k + lag - 1] = 0
    last, lead = w.data[w.ends - 1], w.data[w.starts]
    out[:, k + 4] = np.minimum(size, 60) / 10
    out[:, k + 5] = (np.minimum(size, 60) / 10) ** 2
    out[:, k + 6] = size <= 3
    out[:, k + 7] = size > 14
    out[:, k + 8] = (last >= 33) & (last < 48)
    out[:, k + 9] = (lead >= 65) & (lead <= 90)
    out[:, k + 10] = out[:, 0] > 0.6
    out[:, k + 11] = (out[:, 0] + out[:, 1] + out[:, 2]) == 0
    return out


def _passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``passages`` of one slice of texts after the other."""
    for _, _, data, offsets in slices(texts):
        w = Words(data, offsets)
        n_words = np.diff(w.first)
        n_pass = np.maximum(-(-n_words // PASSAGE), 1)
        x = np.zeros((int(n_pass.sum()), FEATURES), np.float32)
        first_pass = np.cumsum(n_pass) - n_pass
        if len(w):
            doc = np.repeat(np.arange(len(n_words)), n_words)
            of_word = first_pass[doc] + (np.arange(len(w)) - w.first[doc]) // PASSAGE
            starts = np.flatnonzero(np.concatenate(([True], of_word[1:] != of_word[:-1])))
            sizes = np.diff(np.append(starts, len(w)))
            x[of_word[starts], :_PER_WORD] = (
                np.add.reduceat(_word_features(w), starts, axis=0) / sizes[:, None]
            )
            x[of_word[starts], _PER_WORD] = sizes / PASSAGE
        x[:, _PER_WORD + 1] = np.repeat(np.log1p(n_words), n_pass) / 10
        yield x, n_pass


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text). An empty text has one empty passage."""
    found = list(_passages(texts))
    if not found:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """Weights of the network, and the centre and scale of its inputs."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fresh(cls, mean: np.ndarray, std: np.ndarray, seed: int) -> GatedAttention:
        rng = np.random.default_rng(seed)
        n = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        p = {
            "W": n(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, ATTENTION),
            "U": n(HIDDEN, ATTENTION), "w": n(ATTENTION, 1)[:, 0], "c": n(HIDDEN, 1)[:, 0],
            "d": np.zeros(1),
        }
        return cls(p, mean, std)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = _sigmoid(z @ p["c"] + p["d"])
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "bag": bag, "at": starts}

    def gradients(self, f: dict[str, np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, f["bag"]
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[bag])
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }

    def score(self, texts: pa.Array) -> np.ndarray:
        """One score for each text, computed in blocks of whole bags."""
        return np.concatenate([np.zeros(0), *(self.forward(x, n)["y"] for x, n in _passages(texts))])


def fit(
    x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = 30, seed: int = 7
) -> GatedAttention:
    """Train by Adam on bags in random batches of 64."""
    if not len(label):
        return GatedAttention.fresh(np.zeros(FEATURES), np.ones(FEATURES), seed)
    model = GatedAttention.fresh(x.mean(0), x.std(0) + 1e-3, seed)
    prior = np.clip(label.mean(), 0.01, 0.99)
    model.p["d"] += np.log(prior / (1 - prior))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    rng, starts, step = np.random.default_rng(seed), np.cumsum(counts) - counts, 0
    epochs = max(epochs, -(-1500 * 64 // len(label)) if len(label) < 3200 else 0)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(label)), 4e-3 * (1 - epoch / epochs)
        for lo in range(0, len(order), 64):
            bags = order[lo : lo + 64]
            n = counts[bags]
            rows = np.repeat(starts[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = model.gradients(model.forward(x[rows], n), label[bags])
            step += 1
            for k, grad in g.items():
                grad = grad + 1e-4 * model.p[k]
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad**2 - v[k])
                hat = m[k] / (1 - 0.9**step), v[k] / (1 - 0.99**step)
                model.p[k] -= rate * hat[0] / (np.sqrt(hat[1]) + 1e-8)
    return model


def training_bags(
    docs: DataFrame, labels: DataFrame, max_docs: int, max_passages: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the labelled documents to learn from, at most ``max_docs``, chosen by a hash of
    their ids. Documents of more than ``max_passages`` passages are not learned from."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("_label"), F.min("quality").alias("_low"))
        .where("_label = _low")  # contradicting labels teach nothing
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
        .select("doc_id", "_label")
    )
    # At most max_docs rows of two numbers.
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, counts = passages(b.column("text"))
            starts = np.cumsum(counts) - counts
            keep = [i for i, n in enumerate(counts) if n <= max_passages]
            cells = [x[starts[i] : starts[i] + counts[i]].tobytes() for i in keep]
            names = ["doc_id", "label", "cells"]
            ids, label = b.column("doc_id").take(keep), b.column("_label").take(keep)
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(cells, pa.binary())], names=names)

    got = bags.select("doc_id", "text", "_label").mapInArrow(
        run, "doc_id long, label int, cells binary"
    )
    # A doc_id may have many rows: the bound holds for rows too.
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "cells").limit(max_docs).collect()
    cells = [np.frombuffer(r.cells, np.float32).reshape(-1, FEATURES) for r in got]
    x = np.concatenate(cells) if cells else np.zeros((0, FEATURES), np.float32)
    counts = np.array([len(c) for c in cells], np.int64)
    return x, counts, np.array([r.label for r in got], np.float64)


def learn(
    docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_passages: int = 256
) -> GatedAttention:
    """Learn quality from ``labels`` (doc_id, quality), never from rows whose
    crc32(doc_id) mod 5 is 0. Null or other labels are left out; without any, every score is near
    one half. Bounded by ``max_docs`` documents of at most ``max_passages`` passages."""
    return fit(*training_bags(docs, labels, max_docs, max_passages))


def score(docs: DataFrame, model: GatedAttention, name: str = "score") -> DataFrame:
    """``docs`` with a score for every row, null and empty texts included. Other columns, whatever
    their names, stay."""
    fields = [f for f in docs.schema.fields if f.name != name]
    kept = docs.select(*[F.col(f"`{f.name}`") for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name]
            )
            give_back()

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
