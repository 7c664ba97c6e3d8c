"""Repeated byte strings against brute force: contexts, narrower contexts, factors, both modes."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from procscope.llm import suffix_arrays, suffix_dedup


def brute(rows, length, keep_first=False):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row, by counting every string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, raw in texts:
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            seen[s] = seen.get(s, 0) + 1
    met, out = set(), []
    for i, raw in sorted(texts, key=lambda x: x[0]) if keep_first else texts:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in met if keep_first else seen[s] > 1:
                gone[k : k + length] = True
            met.add(s)
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), edges, kept))
    return sorted(out, key=repr)


def got(df, length, keep_first=False):
    rows = suffix_dedup.remove_repeats(df, length, keep_first).collect()
    for r in rows:
        assert sum(s.byte_to - s.byte_from for s in r.removed) == r.n_removed
        assert r.n_bytes - r.n_removed == len(r.kept)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choices("aeinrst", k=rng.randint(2, 8))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.5:  # a part of it, or one with an edit
                a = rng.randrange(len(s) // 2)
                s = s[a : a + rng.randint(50, 400)]
            if rng.random() < 0.3:
                k = rng.randrange(len(s))
                s = s[:k] + "É" + s[k + 1 :]
            parts += [s, prose(rng, rng.randint(0, 20))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "x"), (102, None), (103, ""), (104, "a" * 700), (105, "short")]
    rows += [(106, "ab" * 300 + prose(rng, 30) + "ab" * 150)]
    return rows


@pytest.mark.parametrize("length", [40, 200])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, docs, length, keep_first):
    rows = corpus()
    assert got(docs(rows).repartition(3), length, keep_first) == brute(rows, length, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_large_groups_are_cut(spark, docs, keep_first, monkeypatch):
    """With groups of at most two contexts everything goes through the narrower ones."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    rng = random.Random(9)
    middle = prose(rng, 40)
    rows = [(i, prose(rng, 10) + middle[rng.randrange(4) :] + prose(rng, 10)) for i in range(30)]
    rows += corpus(4)[:25]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert got(docs(rows), 60, keep_first) == brute(rows, 60, keep_first)


def test_long_text_is_looked_at_in_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    rows = corpus(7)
    whole = "\n".join(t or "" for _, t in rows[:40])
    rows = [(1, whole), (2, whole[5000:9000] + "!"), (3, prose(random.Random(2), 500))]
    assert got(docs(rows), 100) == brute(rows, 100)


def test_repeated_rows_nulls_ties_and_clashing_names(spark):
    text = prose(random.Random(3), 90)
    rows = [(None, text, 1, 2), (None, text, 3, 4), (5, None, 1, 1), (5, "", 1, 1), (6, "z", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, h long")
    out = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df, 200).collect()}
    n = len(text)
    assert out == {(None, n, n), (5, 0, 0), (6, 1, 0)}


def test_empty_table(spark, docs):
    out = suffix_dedup.remove_repeats(docs([]), 200)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "kept", "removed"] and out.count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs([]), 300)


def test_longest_previous_factors():
    """Against the definition, for every position of texts with many repeats."""
    rng = random.Random(6)
    for alphabet, depth in (("ab", 40), ("abcd", 16), ("a", 24)):
        raw = "".join(rng.choices(alphabet, k=300)) + "abcdabcdabcdabcdabcd" * 5
        data = np.frombuffer(raw.encode(), np.uint8)
        at = np.arange(len(raw) - depth + 1)
        levels = suffix_arrays.ranks(data, depth)
        order = suffix_arrays.suffix_order(levels, at, depth)
        assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in at)
        length, source = suffix_arrays.longest_previous_factors(
            order, suffix_arrays.common_prefixes(levels, order, depth)
        )
        for i, n, j in zip(order, length, source, strict=True):
            best = 0
            for k in range(i):
                m = 0
                while m < depth and raw[k + m] == raw[i + m]:
                    m += 1
                best = max(best, m)
            if best == depth:
                assert n == depth and j < i and raw[j : j + depth] == raw[i : i + depth]
            else:  # common prefixes below the depth are known to eight bytes
                assert n == best // 8 * 8 or n == best


def test_kept_bytes_of_the_query_are_hashed(spark, docs):
    rows = corpus(5)
    df = suffix_dedup.remove_repeats(docs(rows), 200).selectExpr("doc_id", "sha2(kept, 256) AS s")
    want = {i: hashlib.sha256(kept).hexdigest() for i, _, _, _, kept in brute(rows, 200)}
    assert {r.doc_id: r.s for r in df.collect()} == want


def test_memory_of_a_slice_of_texts():
    """Executors hold several tasks: 56 MB for contexts of a slice and 259 MB for a sort were too much."""
    data = np.random.default_rng(2).integers(97, 123, 1 << 20).astype(np.uint8)
    offsets = np.array([0, 1 << 19, 1 << 20])
    suffix_dedup.contexts(data[:1000], np.array([0, 1000]), 200)  # tables of powers
    tracemalloc.start()
    text, start, n, _, _ = suffix_dedup.contexts(data, offsets, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    tracemalloc.start()
    suffix_arrays.repeats(data[: suffix_dedup.TEXT], np.arange(suffix_dedup.TEXT - 200), 200)
    assert suffix_dedup.TEXT <= len(data) and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    for t in (0, 1):  # every string start once
        at = start[text == t]
        order = np.argsort(at)
        assert at.min() == 0 and (at + n[text == t]).max() == (1 << 19) - 199
        assert np.array_equal(at[order][1:], (at + n[text == t])[order][:-1])
