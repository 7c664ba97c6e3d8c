"""Encoder, token trees and packing against the tokenizer library and whole texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from procscope.llm import packing, token_tree
from procscope.llm.encoder import encoder


@pytest.fixture(scope="module")
def exact(encoder_path):
    t = Tokenizer.from_file(encoder_path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_agrees_for_every_character(encoder_path, exact):
    enc = encoder(encoder_path)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    assert enc.fast is not None
    t = Tokenizer.from_file(encoder_path)
    for lo in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}1{chr(c)}{chr(c)}. {chr(c)} b" for c in points[lo : lo + (1 << 16)]]
        want = t.encode_batch_fast(texts, add_special_tokens=False)
        for text, w in zip(texts, want, strict=True):
            assert enc.fast.encode_ordinary(text) == w.ids, text


@pytest.mark.parametrize(
    "text",
    ["", "a", "  \n\n x", "don't we'll I'M", "<|endoftext|> a", "é" * 5000, "\x1c \x85 x",
     "x" * 20000, "a  b\t\tc \r\n"],
)
def test_encoder_on_odd_texts(encoder_path, exact, text):
    assert encoder(encoder_path).encode(text).tolist() == exact(text)


def test_encoder_survives_long_white_space(encoder_path):
    assert len(encoder(encoder_path).encode(" " * 300_000)) > 0


def test_leaves_add_up(encoder_path, exact):
    text = "".join(random.Random(3).choices(["the ", " x", "\n", "don't", "  ", "é", "7 ", "."], k=4000))
    parts = token_tree.leaves(text, 64)
    assert "".join(parts) == text and len(parts) > 20
    assert sum(len(exact(p)) for p in parts) == len(exact(text))


def test_random_edits_keep_the_count(encoder_path, exact):
    rng = random.Random(5)
    words = ["the ", "an ", " ", "\n", "word", " 12", "é ", "  ", "it's "]
    enc = encoder(encoder_path)
    text = "".join(rng.choices(words, k=900))
    parts = token_tree.leaves(text)
    tree = token_tree.TokenTree(
        parts, [len(enc.encode(p)) for p in parts], lambda x: len(enc.encode(x))
    )
    for _ in range(150):
        at, cut = rng.randrange(-3, len(text) + 5), rng.choice([0, 0, 1, 5, 700])
        new = "".join(rng.choices(words, k=rng.choice([0, 1, 4, 600])))
        tree.edit(at, cut, new)
        at = min(max(at, 0), len(text))
        text = text[:at] + new + text[at + cut :]
        got, chars, tokens, total = tree.row()
        assert got == text and sum(chars) == len(text) and sum(tokens) == total
        assert total == len(exact(text))
    tree.edit(0, len(text), "")
    assert tree.row() == ("", [], [], 0)
    tree.edit(0, 0, "again here")
    assert tree.row()[3] == len(exact("again here"))


def test_edits_of_a_table(spark, docs, exact):
    d = docs([(1, "one two three"), (2, None), (3, "same"), (3, "other"), (None, "no id"), (4, "")])
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "ONE"), (1, 1, 99, None, " four"), (1, 3, None, 1, "x"), (2, 1, 0, 0, "new"),
         (3, 1, 0, 1, None), (7, 1, 0, 0, "lost"), (None, 1, 0, 0, "lost")],
        "doc_id long, seq long, at long, delete long, insert string",
    )
    out = token_tree.apply_edits(token_tree.build_trees(d), edits).collect()
    got = sorted(((r.doc_id, r.text, r.n_edits, r.n_rejected) for r in out), key=str)
    assert got == sorted(
        [(1, "ONE two three four", 2, 1), (2, "new", 1, 0), (3, "ame", 1, 0), (3, "other", 0, 0),
         (None, "no id", 0, 0), (4, "", 0, 0)], key=str,
    )
    assert all(r.n_tokens == len(exact(r.text)) for r in out)
    # What comes out can take the next edits.
    again = token_tree.apply_edits(
        spark.createDataFrame(out, token_tree.EDITED).select("doc_id", "text", "leaf_chars", "leaf_tokens"),
        edits.limit(0),
    )
    assert {r.doc_id: r.n_tokens for r in again.collect()} == {r.doc_id: r.n_tokens for r in out}
    none = token_tree.apply_edits(token_tree.build_trees(d.limit(0)), edits)
    assert none.count() == 0


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def best_fit_by_hand(lengths, capacity):
    """Best-fit decreasing, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 50, 300]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, placed = {}, {}
    for n, lo, hi, each, first, base in packing.plan(counts, capacity):
        for k in range(hi - lo):
            seq, offset = first + k // each, base + (k % each) * n
            assert fill.get(seq, 0) == offset
            fill[seq] = offset + n
            placed[n] = placed.get(n, 0) + 1
    assert placed == counts and all(x <= capacity for x in fill.values())
    assert len(fill) == best_fit_by_hand(lengths, capacity)


def test_packing_of_a_table(spark, docs, exact):
    rows = [(1, "word " * 100), (1, "word " * 100), (2, None), (None, "x y"), (3, ""), (4, "é" * 90)]
    out = packing.best_fit(docs(rows), capacity=32).collect()
    want = []
    for i, text in rows:
        ids = [*exact(text or ""), 0]
        for k, (at, n) in enumerate(packing.cut(len(ids), 32)):
            crc = zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            want.append((i, k, at, n, crc))
    assert sorted(((*r[:5],) for r in out), key=str) == sorted(want, key=str)
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 32
    assert len(fill) == best_fit_by_hand([r.length for r in out], 32)
    seqs = packing.sequences(docs(rows), spark.createDataFrame(out), capacity=32).collect()
    assert {r.sequence_id: len(r.ids) for r in seqs} == fill
    assert packing.best_fit(docs([])).count() == 0
