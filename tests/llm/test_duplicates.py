"""Near duplicates, repeated windows and repeated lines against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from procscope.llm import line_align, prefix_join, spans
from procscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def corpus(seed, n=60, vocabulary=40, length=60):
    """Families of edited copies, exact copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "x.", "The"]
    make = lambda k: rng.choices(words, k=k)
    passage = make(45)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b"),
            (None, "a b"), (906, "a " * 80), (907, "b a " * 60)]
    for i in range(n):
        base = make(rng.randint(3, length))
        if i % 7 == 0:
            base = base[:5] + passage + base[5:]
        rows.append((10 * i, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * i + j + 1, "  ".join(copy) if j % 2 else "\n".join(copy)))
    rows.append(rows[-1])
    return rows


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else None


def brute_groups(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    live = [(i, s) for i, s in sets if i is not None and s]
    root = {k: k for k in range(len(live))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(live)):
        for b in range(a):
            x, y = live[a][1], live[b][1]
            if 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(live):
        least[find(k)] = min(least.get(find(k), i), i)
    of = {(i, s): least[find(k)] for k, (i, s) in enumerate(live)}
    return sorted(
        ((i, len(s or ()), of.get((i, s), i)) for i, s in sets), key=str
    )


@pytest.mark.parametrize("seed,frequent", [(1, 48), (2, 1), (3, 3), (4, 2)])
def test_groups(spark, docs, monkeypatch, seed, frequent):
    """Low limits for frequent lists bring longer prefixes, whole sets and the dense rest."""
    monkeypatch.setattr(prefix_join, "FREQUENT", frequent)
    rows = corpus(seed)
    got = prefix_join.groups(docs(rows), 3, 90).collect()
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert out == brute_groups(rows, 3, 90)


def test_groups_of_a_dense_family(spark, docs, monkeypatch):
    monkeypatch.setattr(prefix_join, "FREQUENT", 4)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            copy[rng.randrange(60)] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(copy)))
    got = prefix_join.groups(docs(rows), 3, 90).collect()
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert out == brute_groups(rows, 3, 90)


def test_links(spark, docs):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "A B c d e f g h i j"), (4, "z")]
    members, classes, links = prefix_join.similar(docs(rows), 2, 70)
    assert members.count() == 4 and classes.count() == 3
    assert [round(r.j, 3) for r in links.collect()] == [0.8]
    got = {r.doc_id: (r.component_id, r.n_links) for r in prefix_join.groups(docs(rows), 2, 70).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0)}
    assert prefix_join.groups(docs([])).count() == 0


def test_one_of_each(spark, docs):
    rows = corpus(5, n=25)
    kept = prefix_join.one_of_each(docs(rows), 3, 90)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = Counter(c for i, n, c in set(brute_groups(rows, 3, 90)) if i is not None and n)
    alone = [(i, t) for i, t in rows if i is None or not WORD.search(t or "")]
    ids = sorted(i for i, t in got if (i, t) not in alone)
    assert ids == sorted(groups) and all(got[x] == alone.count(x) for x in alone)
    assert len(list(got.elements())) == len(groups) + len(alone)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 1)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in root.items() if k != v}
    assert components(df.limit(0)).count() == 0


def brute_windows(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size", [(1, 8), (2, 12), (3, 35), (4, 6)])
def test_remove_repeats(spark, docs, seed, size):
    rows = corpus(seed, n=40)
    got = spans.remove_repeats(docs(rows), size).collect()
    out = sorted(
        ((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got),
        key=str,
    )
    assert out == brute_windows(rows, size)
    for r in got:
        assert sum(s.word_to - s.word_from for s in r.removed) == r.n_removed


def test_remove_repeats_of_none(spark, docs):
    assert spans.remove_repeats(docs([])).count() == 0
    long = " ".join(str(i) for i in range(40_000))
    got = spans.remove_repeats(docs([(1, long), (2, "a b")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 40_000, 0), (2, 2, 0)]


def test_patience():
    a, b = np.array([1, 2, 3, 4, 5, 9, 9]), np.array([7, 2, 3, 8, 5, 1, 9, 9])
    assert line_align.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 6), (6, 7)]
    rng = random.Random(1)
    for _ in range(200):
        x, y = (np.array(rng.choices(range(6), k=rng.randrange(9))) for _ in "ab")
        got = line_align.patience(x, y)
        assert all(x[i] == y[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def brute_lines(rows, least):
    """Every document aligned with all earlier ones that share a line of enough words."""
    docs = sorted({(i if i is not None else 1 << 63, t) for i, t in rows if t}, key=lambda x: x[0])
    lines = {d: [x.strip("\r\t ") for x in d[1].split("\n")] for d in docs}
    count = lambda x: len(re.split("[ \t]+", x)) if x else 0
    long = {d: {x for x in lines[d] if count(x) >= least} for d in docs}
    out = {}
    for k, d in enumerate(docs):
        gone = set()
        words = np.array([count(x) for x in lines[d]])
        for owner in (e for e in docs[:k] if long[e] & long[d]):
            a, b = (np.array([hash(x) for x in lines[e]]) for e in (owner, d))
            gone |= set(line_align.common_blocks(a, b, words, least))
        out[d] = [x for i, x in enumerate(d[1].split("\n")) if i not in gone]
    return sorted(
        ((i, "\n".join(out[(i if i is not None else 1 << 63, t)]) if t else t) for i, t in rows), key=str
    )


@pytest.mark.parametrize("seed", range(3))
def test_dedup_lines(spark, docs, seed):
    rng = random.Random(seed)
    pool = [f"line {i} has five words" for i in range(25)] + ["", "short", " padded line of five words "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "\n".join(pool[:4])), (7, rows[7][1]), rows[3]]
    got = line_align.dedup_lines(docs(rows)).collect()
    out, brute = sorted(((r.doc_id, r.text) for r in got), key=str), brute_lines(rows, 5)
    texts = {(r.doc_id, r.text) for r in got}
    assert len(out) == len(brute) and len(texts) >= 40
    for (i, text), (j, least) in zip(out, brute, strict=True):
        assert i == j and (text is None) == (least is None)
        if text is None:
            continue
        # Lines that lead are gone where any earlier document has them aligned; those too short to lead
        # go with the holders that were met.
        text, least = text.split("\n"), least.split("\n")
        assert [x for x in text if len(x.split()) >= 5] == [x for x in least if len(x.split()) >= 5]
        it = iter(text)
        assert least == [""] or all(x in it for x in least)
    for r in got:
        assert r.lang == "en" and r.n_removed <= r.n_lines


def test_dedup_lines_of_copies(spark, docs):
    text = "first line of the text\nsecond line of the text"
    got = line_align.dedup_lines(docs([(i, text) for i in range(30)])).collect()
    assert {r.doc_id: r.text for r in got} == {0: text} | {i: "" for i in range(1, 30)}
    assert line_align.dedup_lines(docs([])).count() == 0


def test_dedup_lines_held_in_other_orders(spark, docs, monkeypatch):
    """Lines that the first holders have in another order go by a later holder that has the same order."""
    monkeypatch.setattr(line_align, "STEP", 2)
    a, b, c = (f"{x} is a line of many words" for x in ("alpha", "beta", "gamma"))
    rows = [(1, f"{b}\n{c}\n{a}")] + [(i, f"{c}\nown line number {i} of some length\n{b}\n{a}") for i in range(2, 9)]
    rows += [(9, f"{a}\n{b}\nnine"), (10, f"ten\n{a}\n{b}"), (11, f"{a}\n{b}\nnine"), (12, "nine")]
    got = {r.doc_id: r.text for r in line_align.dedup_lines(docs(rows)).collect()}
    assert sorted(got.items(), key=str) == brute_lines(rows, 5)
    assert (got[10], got[11]) == ("ten", "")


def mixed_family(rng, texts=12, shared=14, own=10):
    """Texts with a common stretch whose shingles are frequent, and rare rests of mixed lengths."""
    common = [f"c{rng.randrange(10**6)}" for _ in range(shared)]
    bases = [[f"r{rng.randrange(10**9)}" for _ in range(own)] for _ in range(3)]
    out = []
    for _ in range(texts):
        base = rng.choice(bases)[: rng.randrange(own + 1)]
        text = [*common, *base]
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed,size,percent,frequent", [(2, 2, 80, 3)])
def test_candidates_of_mixed_families(spark, docs, monkeypatch, seed, size, percent, frequent):
    """Sets that settle at different lengths keep their links."""
    monkeypatch.setattr(prefix_join, "FREQUENT", frequent)
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        family = mixed_family(rng, rng.randrange(2, 14), rng.randrange(10, 40), rng.randrange(1, 12))
        rows += [(len(rows) + k, t) for k, t in enumerate(family)]
    got = prefix_join.groups(docs(rows), size, percent).collect()
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert out == brute_groups(rows, size, percent)


def test_partner_that_settles_first(spark, docs, monkeypatch):
    """Of two sets with 19 of 21 words in common, the one settles with m = 12; the other has asked for
    nine matches, and ten words of both prefixes are frequent."""
    monkeypatch.setattr(prefix_join, "FREQUENT", 4)
    pool = sorted((f"p{i}" for i in range(600)), key=lambda w: prefix_join.shingles(w.encode(), 1)[0])
    s = pool[100:119]
    rows = [(1, [pool[0], *s]), (2, [*s, pool[-1]])]
    rows += [(10 + k, [*s[:10], *pool[200 + 10 * k : 210 + 10 * k]]) for k in range(8)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r.doc_id: (r.component_id, r.n_links) for r in prefix_join.groups(docs(rows), 1, 90).collect()}
    assert got == {1: (1, 1), 2: (1, 1)} | {10 + k: (10 + k, 0) for k in range(8)}


def brute_degrees(rows, size, percent):
    sets = {shingle_set(t, size) for _, t in rows} - {None}
    near = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
    return {x: sum(x != y and near(x, y) for y in sets) for x in sets}


@pytest.mark.parametrize("block", [128, 7])
def test_links_of_a_dense_family(spark, docs, monkeypatch, block):
    """Every link counts, those among sets that are near what their family has in common too."""
    monkeypatch.setattr(prefix_join, "FREQUENT", 4)
    monkeypatch.setattr(prefix_join, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for i in range(60):
        copy = [f"v{k}" for k in range(60)]
        for _ in range(rng.choice([1, 1, 2])):
            copy[rng.randrange(60)] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(copy)))
    degrees = brute_degrees(rows, 3, 90)
    if block == 7:
        links = prefix_join.similar(docs(rows), 3, 90)[2].collect()
        assert len({(r.a, r.b) for r in links}) == len(links) == sum(degrees.values()) // 2
    else:
        got = {r.doc_id: r.n_links for r in prefix_join.groups(docs(rows), 3, 90).collect()}
        assert got == {i: degrees[shingle_set(t, 3)] for i, t in rows}


def test_dedup_lines_of_few_words(spark, docs):
    """Lines too short to lead by themselves lead by the run that has words enough."""
    verse = "\n".join(f"verse {i} of four" for i in range(300))
    rows = [(1, verse), (2, "a title\n" + verse), (3, "one\n\ntwo three"), (4, "one\n\ntwo three")]
    rows += [(5, "x y\n\nz v\nw u"), (6, "other\nx y\n\nz v\nw u\nlast")]
    got = {r.doc_id: r.text for r in line_align.dedup_lines(docs(rows)).collect()}
    assert got == dict(rows) | {2: "a title", 6: "other\nlast"}


def families(rng, kinds=6, least=6, most=40):
    """Families of edited copies of several sizes, and texts with the stretch that one of them begins with."""
    rows = []
    for kind in range(kinds):
        base = [f"f{kind}w{k}" for k in range(rng.randrange(30, 60))]
        for _ in range(rng.randrange(least, most)):
            copy = base[: len(base) - rng.choice([0, 0, 0, 3])]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
        for _ in range(5):
            own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
            rows.append((len(rows), " ".join(base[:10] + own)))
    return rows


def test_families_take_few_steps(spark, docs, monkeypatch):
    """Families are compared at once: what is written does not grow with how they meet."""
    monkeypatch.setattr(prefix_join, "FREQUENT", 4)
    monkeypatch.setattr(prefix_join, "BLOCK", 16)
    written, write = [], prefix_join.materialize
    monkeypatch.setattr(prefix_join, "materialize", lambda d, label: written.append(label) or write(d, label))
    rows = families(random.Random(3))
    got = prefix_join.groups(docs(rows), 3, 90).collect()
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert out == brute_groups(rows, 3, 90)
    degrees = brute_degrees(rows, 3, 90)
    assert {r.doc_id: r.n_links for r in got} == {i: degrees[shingle_set(t, 3)] for i, t in rows}
    assert len(written) <= 26, Counter(written)


@pytest.mark.parametrize("bits", [1, 5])
def test_groups_where_bits_hold_too_much(spark, docs, monkeypatch, bits):
    """Tokens taken for frequent or shared by mistake change the order, not the result."""
    monkeypatch.setattr(prefix_join, "FREQUENT", 4)
    monkeypatch.setattr(prefix_join, "FEW_BITS", bits)
    monkeypatch.setattr(prefix_join, "MANY_BITS", bits)
    rows = families(random.Random(4), 3, 4, 16) + [(1000 + i, t) for i, t in corpus(6, n=20)[:40] if i is not None]
    got = prefix_join.groups(docs(rows), 3, 90).collect()
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert out == brute_groups(rows, 3, 90)


def test_frequent_tokens_come_last():
    """The prefix of every set in one order, and which sketches hold too little of it."""
    frequent = prefix_join._Bits(8, np.array([0]), np.array([0b1110], np.uint64))  # tokens 1, 2 and 3
    sets = [[1, 2, 3, 70, 80, 90, 100, 110, 120, 130], [1, 2, 3, 70], [1, 2, 3, 71]]
    b = prefix_join.pa.RecordBatch.from_arrays(
        [prefix_join.pa.array([7, 8, 9]), prefix_join.pa.array([10, 4, 40], prefix_join.pa.int32()),
         prefix_join.pa.array([np.array(s, np.uint64).tobytes() for s in sets])],
        names=["set", "n", "sketch"],
    )
    o = prefix_join._Order(b, 50, frequent)
    prefixes = [sorted(o.tokens[o.inside & (o.at == k)].tolist()) for k in range(3)]
    assert o.long.tolist() == [6, 3, 21] and o.short.tolist() == [False, False, True]
    assert prefixes[:2] == [[70, 80, 90, 100, 110, 120], [1, 2, 70]]
    everything = prefix_join._Bits(1, np.array([0]), np.array([3], np.uint64))
    out = prefix_join._prefix_rows(b, o, everything).to_pylist()
    assert [(r["set"], r["tokens"], r["rest"]) for r in out] == [(7, [70, 80, 90, 100, 110, 120], 4), (8, [1, 2, 70], 1)]
    assert out[0]["stop"] == 120 - (1 << 63) and out[1]["stop"] == prefix_join.LAST
