"""Token groups and links of two tokenizers against the definition, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from procscope.llm import token_align

TEXTS = [
    (1, "The quick brown fox, 12 times; don't"), (2, None), (3, ""), (4, " "), (5, "  two  spaces\n\n\tand tabs "),
    (6, "Élan vital — naïve café über 漢字かな"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (8, "a▁b"), (9, "\x00\x01 x"), (10, "🙂🙂 ok"), (11, "The quick brown fox, 12 times; don't"),
    (11, "The quick brown fox, 12 times; don't"), (None, "no id here"), (12, "word " * 3000),
]


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute(rows, paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths[0])
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=paths[1])
    bytes_a, bytes_b = token_align.vocabulary_a(paths[0]), token_align.vocabulary_b(paths[1])
    out, links = [], []
    for doc_id, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = b" " + text.encode() if text else b""
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in a]), np.cumsum([len(bytes_b[i]) for i in b])
        cuts = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups, lo = [], 0
        for hi in cuts:
            one = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
                   for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(one))
            lo = hi
        pairs = [(i, j) for i, e in zip(a, ends_a, strict=True) for j, f in zip(b, ends_b, strict=True) if e == f]
        out.append((doc_id, len(a), len(b), len(groups), ";".join(groups), pairs))
        links += pairs
    count = Counter(links)
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        (
            (i, na, nb, ng, len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p),
             hashlib.sha256(g.encode()).hexdigest() if g else "")
            for i, na, nb, ng, g, p in out
        ),
        key=repr,
    )


def test_against_brute_force(spark, paths, monkeypatch):
    rows = [(i, t) for i, t in TEXTS if i != 12] + [(12, "word, " * 40)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, a string")
    out = token_align.align(df.repartition(3), *paths, with_groups=True)
    got = [
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in out.collect()
    ]
    assert sorted(got, key=repr) == brute(rows, paths)
    for r in out.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert (r.n_a == 0) == (r.doc_id in (2, 3, 8))


def test_empty_table(spark, docs, paths):
    out = token_align.align(docs([]), *paths)
    assert out.count() == 0 and "n_best" in out.columns


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1000])
def test_pieces_do_not_change_the_merge(piece):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        a = np.unique(rng.integers(0, 200, rng.integers(0, 120)))
        b = np.unique(rng.integers(0, rng.choice([40, 200]), rng.integers(0, 120)))
        in_a, in_b = token_align.common_ends(a, b, piece)
        assert a[in_a].tolist() == b[in_b].tolist() == np.intersect1d(a, b).tolist()
        if len(a) and len(b):
            cut_a, cut_b = token_align.diagonals(a, b, piece)
            work = np.diff(cut_a + cut_b)
            assert work.max() <= piece and (work[:-1] == piece).all() and work.sum() == len(a) + len(b)


def test_the_vocabularies_bound_the_pairs(spark, docs, paths):
    bound = token_align.pair_bound(*paths)
    assert 0 < bound < 1_000_000
    a, b = token_align.vocabulary_a(paths[0]), token_align.vocabulary_b(paths[1])
    counts = token_align.pair_counts(token_align.links(docs(TEXTS), *paths)).collect()
    assert len(counts) <= bound
    for r in counts:
        x, y = a[r.a], b[r.b]
        assert (x.endswith(y) or y.endswith(x)) and r.best >= r["count"]
