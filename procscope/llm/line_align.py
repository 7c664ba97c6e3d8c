"""Line dedup by pairwise alignment.

Each shared line, and each shortest run of short lines that has words enough, leads a document to the
first document that holds it, so there are at most as many pairs as lines, however large a group of
copies is. The two are aligned by patience diff
(lines that are unique in both are the anchors, the longest run of them in the same order holds, and
equal neighbours join), and the aligned blocks go from the later document. Where lines stay, because
the first holder has them in another order, they lead on to the next holders until they have gone or
no earlier holder is left.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procscope.llm.words import runs
from procscope.session import materialize, release

MIN_WORDS = 5  # a line or run of lines that leads to a pair, and a block that goes, has so many words


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned (line of ``a``, line of ``b``), in order."""
    a, b = a.tolist(), b.tolist()
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if na[x] == 1 and nb.get(x) == 1}
        pairs = [(where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where]
        run = _longest_rising(pairs)
        edges = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        out += run
        if run:
            todo += [
                (x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)
            ]
    return sorted(out)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of ``pairs``, given by rising second number, whose first number rises."""
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        n = bisect_left(tails, i)
        before.append(last[n - 1] if n else -1)
        tails[n : n + 1] = [i]
        last[n : n + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(
    a: np.ndarray, b: np.ndarray, words: np.ndarray, least: int = MIN_WORDS
) -> list[int]:
    """Lines of ``b`` in aligned blocks of at least so many words; ``words`` are those of ``b``."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(int(words[x]) for x in block) >= least:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def _lead_places(
    hashes: np.ndarray, words: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which lines lead by themselves, and the first lines, last lines and hashes of the runs that lead."""
    words = words.astype(np.int64)
    long = words >= least
    total = np.cumsum(words)
    first = np.flatnonzero((words > 0) & ~long)
    last = np.searchsorted(total, total[first] - words[first] + least)
    some = last < len(words)
    first, last = first[some], last[some]
    n_long = np.concatenate(([0], np.cumsum(long)))
    some = n_long[last + 1] == n_long[first]
    first, last = first[some], last[some]
    none = np.zeros(0, np.int64)
    short = runs(hashes.view(np.uint64), first, last + 1).view(np.int64) if len(first) else none
    return long, first, last, short


def leads(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Distinct hashes by which a document meets others: its lines of at least so many words, and from
    each shorter line the shortest run of shorter lines that together have as many. Every block of so
    many words holds one of them."""
    long, _, _, short = _lead_places(hashes, words, least)
    return np.unique(np.concatenate([hashes[long], short]))


def leads_left(
    hashes: np.ndarray, words: np.ndarray, gone: np.ndarray, least: int = MIN_WORDS
) -> np.ndarray:
    """Those of ``leads`` with a line that is not ``gone`` at one of their places."""
    stays = np.ones(len(hashes), bool)
    stays[gone] = False
    if stays.all():
        return leads(hashes, words, least)
    lines, first, last, short = _lead_places(hashes, words, least)
    before = np.concatenate(([0], np.cumsum(stays)))
    some = before[last + 1] > before[first]
    return np.unique(np.concatenate([hashes[lines & stays], short[some]]))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows alike in id and text are one document here; their copies get the same result."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _aligned(pairs: DataFrame, classes: DataFrame, min_words: int) -> DataFrame:
    """(key, gone): the lines of ``key`` in blocks aligned with any ``holder`` of ``pairs``."""
    both = pairs.join(classes.select("key", "hashes", "words"), "key").join(
        classes.selectExpr("key AS holder", "hashes AS held"), "holder"
    ).select("key", "held", "hashes", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, own, words = (b.column(i) for i in (1, 2, 3))
            get = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
            gone = [
                common_blocks(get(held, i), get(own, i), get(words, i), min_words)
                for i in range(b.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"]
            )

    found = both.mapInArrow(run, "key long, gone array<int>").where("size(gone) > 0")
    return _merged(found)


def _merged(found: DataFrame) -> DataFrame:
    # At most a document's lines, however many partners it has.
    return found.select("key", F.explode("gone").alias("line")).groupBy("key").agg(
        F.collect_set("line").alias("gone")
    )


def _leads(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, at, line) of ``rows`` (key, at, hashes, words, gone): the leads that have lines left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c, i: b.column(c)[i].values.to_numpy(zero_copy_only=False)
            found = [leads_left(get(2, i), get(3, i), get(4, i), min_words) for i in range(b.num_rows)]
            if not found:
                continue
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(found))],
                names=["key", "at", "line"],
            )

    rows = rows.select("key", "at", "hashes", "words", "gone")
    return rows.mapInArrow(run, "key long, at long, line long")


STEP = 8  # so many times the holders in each round


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, gone, every): for each document key the line numbers that go, or whether all do.

    Documents with the same lines are one class; its first document stands for it, and of the
    others all goes. Leads take the first documents of the classes to the first holder of each lead.
    A lead with lines that stay takes its document on to the next holders, ``STEP`` times as many in
    each round, until its lines are gone or no earlier holder is left: no line of so many words, and no
    such run, is lost to a holder that has it in another order. Lines too few in words to lead go with
    the blocks of the holders that were met.
    """
    lines = _keyed(docs.select("doc_id", "text")).where("text <> ''").selectExpr(
        "__key AS key", "coalesce(doc_id, 9223372036854775807L) AS at",
        "transform(split(text, '\\n', -1), l -> trim(BOTH '\\r\\t ' FROM l)) AS lines",
    ).selectExpr(
        "key", "at", "transform(lines, l -> xxhash64(l)) AS hashes",
        "transform(lines, l -> if(l = '', 0, size(split(l, '[ \\t]+')))) AS words",
    )
    lines = materialize(lines, "lines").withColumn("seq", F.xxhash64("hashes"))
    lines = lines.where(f"aggregate(words, 0L, (x, y) -> x + y) >= {int(min_words)}")
    firsts = lines.groupBy("seq").agg(F.min(F.struct("at", "key")).alias("f"))
    copies = lines.select("seq", "at", "key").join(firsts, "seq").where("key <> f.key")
    copies = copies.selectExpr("key", "CAST(array() AS array<int>) AS gone", "true AS every").distinct()
    classes = lines.join(firsts.selectExpr("f.key AS key"), "key").dropDuplicates(["key"])
    classes = materialize(
        classes.selectExpr("key", "at", "hashes", "words", "CAST(array() AS array<int>) AS gone"), "classes"
    )
    entries = materialize(_leads(classes, min_words), "leads")
    first = entries.groupBy("line").agg(
        F.count("*").alias("n"), F.min(F.struct("at", "key")).alias("holder")
    )
    first = materialize(first.where("n > 1"), "first-holders")
    pairs = (
        entries.join(first, "line")
        .where("holder.key <> key")
        .selectExpr("key", "holder.key AS holder")
        .distinct()
    )
    found = materialize(_aligned(pairs, classes, min_words), "gone")
    # Whoever has leads left, with holders between the first one and itself.
    seen, parts = 1, [found]
    further = entries.join(first.where("n > 2"), "line").where("holder.key <> key")
    further = materialize(further.select("key", "at", "line", "n"), "further")
    here = classes.join(further.select("key").distinct(), "key", "left_semi")
    left = _leads(_with_gone(here, found), min_words).select("key", "line")
    rest = materialize(further.join(left, ["key", "line"]), "left")
    release(further)
    while not rest.isEmpty():
        upto = seen * STEP
        active = rest.select("line").distinct()
        order = Window.partitionBy("line").orderBy("at", "key")
        # Only the first ``upto`` of a line leave a task, and reach the one that ranks them.
        ranked = entries.join(active, "line", "left_semi").withColumn("rank", F.row_number().over(order))
        holders = ranked.where(f"rank <= {upto}").where(f"rank > {seen}")
        holders = holders.selectExpr("line", "at AS held_at", "key AS holder")
        pairs = rest.join(holders, "line").where("held_at < at OR (held_at = at AND holder < key)")
        pairs = pairs.select("key", "holder").distinct()
        more = materialize(_aligned(pairs, classes, min_words), "gone")
        parts.append(more)
        found = _merged(reduce(DataFrame.unionByName, parts))
        here = classes.join(rest.where(f"n > {upto}").select("key").distinct(), "key", "left_semi")
        left = _leads(_with_gone(here, found), min_words).select("key", "line")
        before, rest = rest, materialize(rest.where(f"n > {upto}").join(left, ["key", "line"]), "left")
        release(before)
        seen = upto
    gone = _merged(reduce(DataFrame.unionByName, parts)).withColumn("every", F.lit(False))
    return gone.unionByName(copies)


def _with_gone(classes: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("gone", "found")
    return classes.join(found, "key", "left").withColumn("gone", F.expr("coalesce(found, gone)"))


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, total: str = "n_lines", removed: str = "n_removed"
) -> DataFrame:
    """``docs`` without the blocks of lines that an earlier document has too.

    Lines end with a newline and are compared without white space at their ends. Documents are
    ordered by doc_id, then by a hash of the text; those without an id come last. Rows alike in id
    and text are one document. A text of which nothing is left is empty; null and empty texts stay.
    Adds the number of lines and of those removed (null texts: 0) under the names ``total`` and
    ``removed``, in place of columns of those names; all other columns stay.
    """
    gone = repeated_lines(docs, min_words).selectExpr("key AS __key", "gone AS __gone", "every AS __every")
    names = [c for c in docs.columns if c not in (total, removed)]
    kept = (
        "array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone),"
        " i -> __lines[i]), '\\n')"
    )
    out = _keyed(docs).join(gone, "__key", "left")
    out = out.withColumn("__lines", F.split("text", "\n", -1))
    cols = [
        F.expr(f"CASE WHEN __gone IS NULL THEN text WHEN __every THEN '' ELSE {kept} END").alias("text") if c == "text" else F.col(f"`{c}`")
        for c in names
    ]
    return out.select(
        *cols,
        F.expr("CAST(if(text IS NULL OR text = '', 0, size(__lines)) AS LONG)").alias(total),
        F.expr("CAST(if(__every, size(__lines), coalesce(size(__gone), 0)) AS LONG)").alias(removed),
    )
