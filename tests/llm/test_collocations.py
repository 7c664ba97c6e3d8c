"""Phrase counts and scores against brute force."""

import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from procscope.llm import collocations


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, threshold, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: v for k, v in f.items() if v >= threshold}
    out = {}
    for (lang, p), a in found.items():
        if len(p) == 1:
            continue
        inside = [
            b for (other, q), b in found.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ]
        if inside and 100 * max(inside) >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, found_ in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found_)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = ["a", "New", "york", "the", "of", "é", "x1", "Zürich", "to", "be", "or", "not"]
    fixed = ["new york city hall", "to be or not", "of the", "a priori", "A  Priori", "rare words here"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 5))))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", ", ", ".\n", "\t"]).join(parts)))
    return rows + [("en", None), ("fr", ""), ("de", " . , "), ("en", "again " * 70), ("one", "only once")]


def table(spark, rows):
    return spark.createDataFrame([(x, t, 1) for x, t in rows], "lang string, text string, phrase int")


def got(df, **kw):
    out = collocations.collocations(df, **kw).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out)


@pytest.mark.parametrize("shards,threshold,top", [(3, 10, 2000), (2, 25, 7)])
def test_against_brute_force(spark, shards, threshold, top):
    rows = corpus(shards)
    want = brute(rows, threshold, top)
    assert len(want) > 5
    assert got(table(spark, rows).repartition(5), threshold=threshold, top=top, shards=shards) == want


def test_bit_maps_that_let_everything_through(spark, monkeypatch):
    """Full maps cost work, not results, and the scan still ends."""
    monkeypatch.setattr(collocations._Bits, "has", lambda self, h: h == h)
    rows = corpus(9, 60)
    assert got(table(spark, rows), threshold=6, top=50) == brute(rows, 6, 50)


def test_what_was_let_through_by_mistake_is_counted_to_the_end(spark):
    """Rare words become frequent late; the table of counts grows by then."""
    items = [f"f{k} g{k}" for k in range(2500)] * 24 + [f"f{k % 2500} b{k}" for k in range(3000)] * 8
    random.Random(5).shuffle(items)
    rows = [("en", ", ".join(items[i : i + 40])) for i in range(0, len(items), 40)]
    assert got(table(spark, rows), threshold=6, top=10**6) == brute(rows, 6, 10**6)


def test_phrases_that_only_the_last_shard_makes_frequent(spark):
    """All occurrences in neighbouring rows or one long text; counts do not depend on the dealing."""
    rows = [("en", "x")] * 7 + [("en", "one two three four. " * 40)] + [("en", f"w{k}") for k in range(20)]
    want = brute(rows, 30, 100)
    assert [r[2] for r in want] == ["one two three four"]
    assert got(table(spark, rows).coalesce(1), threshold=30, top=100, shards=4) == want


def test_empty_tables(spark):
    df = table(spark, [])
    assert collocations.collocations(df).count() == 0
    assert got(table(spark, [(None, None), ("en", "")]), threshold=1) == []


def test_maps_of_few_entries_are_small_on_their_way(spark):
    """Every step sends three maps to every executor; full ones of a small corpus took its disk."""
    rng = np.random.default_rng(3)
    for n in (0, 1000, 1 << 19):
        at = np.unique(rng.integers(0, (1 << collocations.MAP_BITS) // 64, n))
        bits = collocations._Bits(collocations.MAP_BITS, at, rng.integers(1, 1 << 63, len(at), np.uint64))
        sent = pickle.dumps(bits)
        assert len(sent) < min(1000 + 16 * len(at), len(bits.words) * 8 + 1000)
        assert np.array_equal(pickle.loads(sent).words, bits.words) and pickle.loads(sent).mask == bits.mask


def test_maps_and_counts_go_when_their_step_is_done(spark, monkeypatch):
    made, gone = [], []
    first, last = collocations.materialize, collocations.release
    monkeypatch.setattr(collocations, "materialize", lambda *a: made.append(first(*a)) or made[-1])
    monkeypatch.setattr(collocations, "release", lambda *t: (gone.extend(t), last(*t)))
    rows = corpus(4, 80)
    assert got(table(spark, rows), threshold=6, top=50) == brute(rows, 6, 50)
    assert len(made) > 3 and gone == made[:-1]


def test_phrases_are_counted_by_plain_sorts_whatever_the_vocabulary(monkeypatch):
    """Ranks stand in only where a code would pass 64 bits, and no order of spots is asked for."""
    rng = random.Random(4)
    few = [f"w{rng.randrange(40)}" for _ in range(3000)]
    many = [f"v{rng.randrange(70_000)}" for _ in range(120_000)] + ["v1 v2 v3 v4"] * 3
    asked = []
    unique = np.unique

    def watched(*args, **kw):
        asked.append(sorted(kw))
        return unique(*args, **kw)

    for words, ranks in ((few, [0, 0, 0]), (many, [0, 0, 1])):
        text = " ".join(words).encode()
        w = collocations._Words("en", np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        words = text.decode().split()
        for size, ranked in zip((2, 3, 4), ranks):
            asked.clear()
            monkeypatch.setattr(np, "unique", watched)
            phrases, n = w.counted(np.arange(len(words) - size + 1), size)
            monkeypatch.undo()
            assert asked == [["return_inverse"]] * ranked + [["return_counts"]]
            want = Counter(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
            assert dict(zip(phrases.to_pylist(), n.tolist())) == want
