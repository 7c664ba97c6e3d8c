"""Decontamination, quality, secrets and the pipeline on planted cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from procscope.llm import mil, packing, secrets_forest, wand

ITEMS = "item_id long, text string"


def sentence(rng, k):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(k))


def item(rng):
    return f"{sentence(rng, 14).capitalize()}, {sentence(rng, 6)}.\n{sentence(rng, 9).capitalize()}."


def test_leaks(spark, docs, monkeypatch):
    rng = random.Random(4)
    items = [(i, item(rng)) for i in range(60)] + [(90, None), (91, ""), (None, "x y"), (92, "...")]
    items.append((93, " ".join(sentence(rng, 12) + "." for _ in range(20))))  # longer than a passage
    rows, want = [], set()
    for i in range(80):
        text = sentence(rng, rng.choice([0, 5, 100, 700]))
        for k in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            planted = items[k][1].upper().replace(",", " ;") if k % 2 else items[k][1]
            at = rng.randrange(len(text) + 1)
            text = f"{text[:at]} {planted} {text[at:]}"
            want.add((i, k))
        rows.append((i, text))
    question = items[1][1].split("\n")[0]
    rows += [(200, None), (201, ""), (202, question), (203, "in " + items[-1][1] + " end")]
    want.add((203, 93))
    rows.append(rows[0])
    b = spark.createDataFrame(items, ITEMS)
    got = wand.mark_leaks(docs(rows).withColumn("score", F.lit(1)), b)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "leaks"]
    found = {(r.doc_id, x.item_id) for r in got.collect() for x in r.leaks}
    nested = {p for p in want if not any(p[0] == r[0] for r in rows)}
    lost = {p for p in want - found if items[p[1]][1] in dict(rows)[p[0]]}
    assert not lost and not nested and found <= want
    monkeypatch.setattr(wand, "SHARD_BYTES", 600)  # several indexes
    again = wand.mark_leaks(docs(rows), b)
    assert {(r.doc_id, x.item_id) for r in again.collect() for x in r.leaks} >= want - (want - found)
    clean = wand.mark_leaks(docs(rows), b.limit(0)).collect()
    assert all(r.leaks == [] for r in clean) and wand.mark_leaks(docs([]), b).count() == 0


def test_blocks_skip_nothing():
    """Every item that an exhaustive scan scores above its threshold is found."""
    rng = random.Random(8)
    items = [(k, *wand.split_item(item(rng))) for k in range(50)]
    index = wand.build_index(items)
    text = " ".join(item(rng) for _ in range(3)) + " " + " ".join(sentence(rng, 30) for _ in range(5))
    texts = [text, "", items[3] and "a b c"]
    assert [len(x) for x in wand.find_leaks(pa.array(texts), index, 0.0)][1] == 0
    words = wand._words_of(text)
    least = set()
    for lo in range(0, len(words), wand.STRIDE):
        near = np.isin(index.terms, words[lo : lo + 2 * wand.STRIDE])
        score = index.impact[near].sum(0)
        least |= set(index.owner[score >= index.need])
    got = {x["item_id"] for x in wand.find_leaks(pa.array([text]), index, 0.0)[0]}
    assert got == {items[k][0] for k in least}


def good(rng):
    return sentence(rng, rng.randint(1, 300)).capitalize() + "."


def bad(rng):
    words = sentence(rng, rng.randint(5, 80)).split()
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w for w in words for _ in range(8))
    return " | ".join(words) if kind == 1 else " ".join(w + rng.choice(["###", "%%%"]) for w in words)


def quality_tables(spark, docs, n=900):
    rng = random.Random(6)
    rows = [(i, bad(rng) if i % 6 == 0 else good(rng)) for i in range(n)]
    rows += [(5000, None), (5001, ""), (None, "no id"), rows[1]]
    labels = [(i, int(i % 6 != 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0), (7, 0, 0)]
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs):
    d, labels = quality_tables(spark, docs)
    model = mil.learn(d, labels)
    out = mil.score(d.withColumn("label", F.lit("x")), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "score"]
    got = out.withColumn("h", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0")).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id < 900]
    right = sum((r.score >= 0.3) == (r.doc_id % 6 != 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert len({r.score for r in got if not r.text}) == 1


def test_quality_learns_from_allowed_rows_only(spark, docs):
    d, labels = quality_tables(spark, docs, 300)
    wrong = labels.withColumn("quality", F.expr(
        "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END"
    ))
    x, counts, y = mil.training_bags(d, labels, 100, 50)
    x2, counts2, y2 = mil.training_bags(d, wrong, 100, 50)
    assert (x == x2).all() and (counts == counts2).all() and (y == y2).all() and len(y) == 100
    none = mil.score(d, mil.learn(d, labels.limit(0)))
    assert none.count() == d.count()


def test_gradients():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 2])
    x = rng.normal(size=(7, mil.FEATURES)).astype(np.float32)
    model = mil.GatedAttention.fresh(np.zeros(mil.FEATURES), np.ones(mil.FEATURES), 1)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, counts)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = model.gradients(model.forward(x, counts), y)
    for k, v in model.p.items():
        at = np.unravel_index(int(np.abs(g[k]).argmax()), v.shape)
        keep = v[at]
        v[at] = keep + 1e-5
        up = loss()
        v[at] = keep - 1e-5
        down = loss()
        v[at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3), k


def test_secrets(spark, docs):
    rng = random.Random(3)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows, true = [], set()
    for i in range(300):
        text = sentence(rng, 40)
        if i % 3 == 0:
            key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + "7"
            secret = rng.choice([f"password={hexes(17)}7a", f'token = "{hexes(38)}a1"', key])
            text += f" {secret} " + sentence(rng, 10)
            true.add(i)
        elif i % 3 == 1:
            text += f" commit {hexes(38)}b2 uuid {hexes(8)}-{hexes(4)}-4{hexes(3)}-{hexes(12)} x"
        rows.append((i, text))
    rows += [(900, None), (901, ""), (None, "password=0123456789abcdef01"), rows[0]]
    d = docs(rows)
    model = secrets_forest.train(secrets_forest.labelled_findings(d, 200, "source"))
    out = secrets_forest.scan(d, model, "source")
    got = out.collect()
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, False) or r.is_secret
    assert all(by.get(i) for i in true) and by[None]
    false = [i for i in range(300) if i % 3 == 1]
    assert sum(by.get(i, False) for i in false) <= 0.05 * len(false)
    assert all(r.candidate in dict(rows)[r.doc_id] for r in got if r.doc_id is not None)
    assert sum(r.doc_id == 0 for r in got) == 2 * len([1 for r in got if r.doc_id == 0]) // 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert secrets_forest.train(secrets_forest.labelled_findings(d.limit(0), 5)) is None
    bare = secrets_forest.scan(d, None).collect()
    assert all(r.score is None and r.is_secret == (r.format != "") for r in bare)
    assert secrets_forest.scan(docs([]), model).count() == 0


def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(12)
    d, labels = quality_tables(spark, docs, 240)
    base = sentence(rng, 80)
    near = base.rsplit(" ", 2)[0] + " other end"
    leak = item(rng)
    line = sentence(rng, 12)
    extra = docs(
        [(6000, base), (6001, near), (6002, good(rng) + " " + leak + " " + good(rng)),
         (6003, line + "\n" + sentence(rng, 30)), (6004, sentence(rng, 30) + "\n" + line),
         (6005, base)]
    )
    d = d.unionByName(extra).withColumn("leaks", F.lit("own")).withColumn("quality_score", F.lit(1))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "line_dedup", "near_duplicates", "decontaminate", "packing"]
    left = d
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == d.columns
        left = spark.createDataFrame(left.collect(), left.schema)
        seen[name] = {r.doc_id: r.text for r in left.collect()}
    kept = [i for i in range(240) if i % 6 != 0]
    assert sum(i in seen["quality"] for i in kept) > 0.97 * len(kept)
    assert sum(i not in seen["quality"] for i in range(0, 240, 6)) > 0.9 * 40
    assert 6005 not in seen["line_dedup"] and 6000 in seen["line_dedup"]
    assert line in seen["line_dedup"][6003] and line not in seen["line_dedup"][6004]
    assert 6001 not in seen["near_duplicates"] and 6000 in seen["near_duplicates"]
    assert 6002 not in seen["decontaminate"] and len(seen["decontaminate"]) >= len(
        seen["near_duplicates"]
    ) - 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    want = packing.best_fit(left)
    pick = lambda df: sorted(
        (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()
    )
    assert pick(out) == pick(want)


def test_pipeline_on_empty_tables(spark, docs, tmp_path):
    empty = docs([])
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_leak_with_a_word_before_the_answer(length):
    question = "Which of the seven old bridges crosses the river near the northern market?"
    answer = " ".join(["cobalt", "lantern", "meadow", "seven", "harbour"][:length])
    items = [(1, *wand.split_item(f"{question} {answer}.".lower()))]
    items += [(k, *wand.split_item(f"some other item {k} with words{k} of its own. yes{k}")) for k in range(2, 9)]
    index = wand.build_index(items)
    for between in ("", "Answer:", "so"):
        text = f"words before it. {question} {between} {answer}. words after it".lower()
        assert [x["item_id"] for x in wand.find_leaks(pa.array([text]), index)[0]] == [1]
    assert wand.find_leaks(pa.array([question.lower() + " unknown"]), index) == [[]]
