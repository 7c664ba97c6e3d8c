"""Jaccard join of word shingles with adaptive multi-match prefixes.

If two sets are as similar as asked, then in any one order of all shingles and for every ``m`` the
first ``|x| - o(x) + m`` shingles of the one and of the other, with ``o(x)`` the least overlap that
a partner of ``x`` needs, share at least ``m``. With ``m = 1`` that is the usual prefix filter. A
prefix that meets frequent shingles is costly: such a document takes a longer prefix by its hashes, so that
``m`` exceeds the number of frequent shingles in it, and the frequent lists need not be read. What is
frequent is settled once for all documents (``_Order``): prefixes are counted, those that hold frequent
shingles grow and are counted on, and a bounded set of bits tells every task what was found. So
the ``m`` of two documents never disagree: a grown prefix holds the first ``|x| - o(x) + 1`` shingles
of the order that has the frequent ones last. The set of bits may hold more than was found; the order
is then another one, but still one for all.

A pair whose prefixes share only frequent shingles is left. Both are then documents nearly all of whose
shingles are frequent: large families of edited copies. They are dealt into blocks of alike sets, and two
blocks that hold one of the frequent shingles are compared as a whole, once (``_families``).

Documents with the same set are one class throughout. Candidates are pruned by size and by the
shingles that their prefixes share, and the rest are compared by their whole texts.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.collocations import _Bits
from procscope.llm.components import components
from procscope.llm.words import SLICE, Words, give_back, lower_ascii, mix, ngrams, slices
from procscope.session import materialize, release

FREQUENT = 48  # lists beyond this are frequent
SKETCH = "doc_id long, key long, set long, n int, sketch binary"
FEW_BITS, MANY_BITS = 24, 27  # sets of hashes that tasks look things up in have 2 to the power of this bits
LAST = (1 << 63) - 1  # end of a prefix that holds frequent tokens


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """A set of ``n`` needs so many common shingles with any partner."""
    return -(-percent * n // 100)


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text, letters A-Z in lower case."""
    data = lower_ascii(np.frombuffer(raw, np.uint8))
    return _sets(Words(data, np.array([0, len(data)])), size)[0]


def _sets(w: Words, size: int) -> list[np.ndarray]:
    h, grams = w.hashes(), {}
    out = []
    for a, b in zip(w.first, w.first[1:], strict=False):
        k = min(size, b - a)  # fewer words: the whole sequence
        if k and k not in grams:
            grams[k] = ngrams(h, k)
        out.append(np.unique(grams[k][a : b - k + 1]) if k else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """One number for a set."""
    total = (len(s) * 0x9E3779B97F4A7C15 + int(mix(s).sum(dtype=np.uint64))) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sketches(docs: DataFrame, size: int, percent: int, whole: bool = False) -> DataFrame:
    """(doc_id, key, set, n, sketch) of every row; the sketch holds the set's first shingles, enough for
    a doubled prefix, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(2)):
                sets = _sets(Words(lower_ascii(data), offsets), size)
                n = [len(s) for s in sets]
                cut = [
                    len(s) if whole else 2 * (len(s) - least_overlap(len(s), percent) + 1) + 8
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi],
                     pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array(n, pa.int32()),
                     pa.array([s[:k].tobytes() for s, k in zip(sets, cut, strict=True)],
                              pa.binary())],
                    names=["doc_id", "key", "set", "n", "sketch"],
                )
            give_back()

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text"), "text")
    return keyed.mapInArrow(run, SKETCH)


def _bits_of(hashes: DataFrame, bits: int) -> _Bits:
    """The set of a table's one column of hashes; at most 2^bits / 64 rows come to the driver."""
    found = (
        hashes.toDF("h").selectExpr(f"h & {(1 << bits) - 1}L AS i")
        .groupBy(F.expr("shiftright(i, 6) AS at"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(i & 63 AS INT))) AS mask"))
        .toArrow()
    )
    at, mask = (found[c].to_numpy() for c in ("at", "mask"))
    return _Bits(bits, at, mask.view(np.uint64))


def _tokens(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sketches, and where each sketch begins in them."""
    _, offsets, data = sketches.buffers()
    off = np.frombuffer(offsets, np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]].view(np.uint64), (off - off[0]) // 8


class _Order:
    """Sets of some sketches (set, n, sketch) in the order that has frequent tokens last, others by hash.
    ``long`` is the length of the prefix; ``short`` tells the sets whose sketch holds too little of it."""

    def __init__(self, b: pa.RecordBatch, percent: int, frequent: _Bits | None):
        self.tokens, self.first = _tokens(b.column("sketch"))
        size = np.diff(self.first)
        n = b.column("n").to_numpy().astype(np.int64)
        self.long = n - least_overlap(n, percent) + 1
        self.at = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.tokens)) - self.first[self.at]
        late = np.zeros(len(self.tokens), bool) if frequent is None else frequent.has(self.tokens)
        early = np.append(0, np.cumsum(~late))
        before = early[:-1] - early[self.first[:-1]][self.at]
        self.early = early[self.first[1:]] - early[self.first[:-1]]
        self.late, self.rank = late, np.where(late, self.early[self.at] + self.place - before, before)
        self.short = (self.early < self.long) & (size < n)
        self.inside = self.rank < self.long[self.at]


def _in_order(sketches: DataFrame, percent: int, box: Broadcast, run, schema: str) -> DataFrame:
    """``run`` on runs of ``sketches`` (set, n, sketch) of about ``SLICE`` bytes and their ``_Order``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, lo = _tokens(b.column("sketch"))[1], 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + SLICE // 8, "right")) - 1)
                part = b.slice(lo, hi - lo)
                yield run(part, _Order(part, percent, box.value[0]), *box.value[1:])
                lo = hi
            give_back()

    return sketches.select("set", "n", "sketch").mapInArrow(each, schema)


def _first_tokens(b: pa.RecordBatch, o: _Order) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(o.tokens[o.inside].view(np.int64))], names=["token"])


def _later_tokens(b: pa.RecordBatch, o: _Order) -> pa.RecordBatch:
    """Tokens of the prefixes that were not in those by hash only."""
    new = o.inside & (o.place >= o.long[o.at])
    return pa.RecordBatch.from_arrays([pa.array(o.tokens[new].view(np.int64))], names=["token"])


def _short_sets(b: pa.RecordBatch, o: _Order) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("set").filter(pa.array(o.short))], names=["set"])


def _prefix_rows(b: pa.RecordBatch, o: _Order, shared: _Bits) -> pa.RecordBatch:
    """Prefixes (without tokens that no other prefix has) and their ends, of sets that are not short."""
    keep = np.flatnonzero(~o.short)
    wanted = o.inside & ~o.short[o.at]
    # Each set has one last token.
    last = np.flatnonzero(wanted & (o.rank == o.long[o.at] - 1))
    stop = np.where(o.late[last], LAST, (o.tokens[last] ^ np.uint64(1 << 63)).view(np.int64))
    n = b.column("n").to_numpy()
    some = wanted & shared.has(o.tokens)
    ends = np.append(0, np.cumsum(np.bincount(o.at[some], minlength=len(n))[keep])).astype(np.int32)
    tokens = pa.array(o.tokens[some].view(np.int64))
    return pa.RecordBatch.from_arrays(
        [b.column("set").take(pa.array(keep)), pa.array(n[keep]), pa.ListArray.from_arrays(ends, tokens),
         pa.array((n - o.long)[keep].astype(np.int32)), pa.array(stop)],
        names=["set", "n", "tokens", "rest", "stop"],
    )


def _plain(
    docs: DataFrame, classes: DataFrame, size: int, percent: int
) -> tuple[DataFrame, list[DataFrame]]:
    """(set, n, tokens, rest, stop): the prefix of each set in one order of all tokens that has frequent
    ones last, without tokens that no two prefixes share; how many tokens lie behind it, and its end as a number.
    Also tables (set, n, sketch) of sets whose whole tokens were needed for it.

    Frequent tokens are looked for three times: in prefixes by hash only, in what takes the place of those
    found, and in whole sets where sketches have too little that is not frequent. What is still missed
    makes lists longer, not results wrong."""
    spark, used, whole = docs.sparkSession, [], []

    def send(*what: _Bits | None) -> Broadcast:
        return spark.sparkContext.broadcast(what)

    def found(more: DataFrame) -> tuple[DataFrame, Broadcast]:
        """Frequent tokens by now, with ``more`` tokens of prefixes; these go round anew."""
        n = more.groupBy("token").count().withColumnRenamed("count", "more")
        n = n.join(counts, "token", "left").where(f"more + coalesce(count, 0L) > {FREQUENT}")
        out = materialize(frequent.unionByName(n.select("token")), "frequent-tokens")
        used.append(out)
        box.destroy()
        return out, send(_bits_of(out, FEW_BITS))

    def short() -> DataFrame:
        used.append(materialize(_in_order(classes, percent, box, _short_sets, "set long"), "short-sets"))
        return used[-1]

    def fetch(sets: DataFrame) -> DataFrame:
        whole.append(_texts(docs, classes, sets, size, whole=True))
        return whole[-1]

    box = send(None)
    counts = _in_order(classes, percent, box, _first_tokens, "token long")
    counts = materialize(counts.groupBy("token").count().where("count > 1"), "shared-tokens")
    used.append(counts)
    frequent = counts.where(f"count > {FREQUENT}").select("token")
    box = send(_bits_of(frequent, FEW_BITS))
    frequent, box = found(_in_order(classes, percent, box, _later_tokens, "token long"))
    sets = short()
    if not sets.isEmpty():
        frequent, box = found(_in_order(fetch(sets), percent, box, _later_tokens, "token long"))
        more = short().join(sets, "set", "left_anti")
        if not more.isEmpty():
            fetch(more)
    later = [_in_order(x, percent, box, _later_tokens, "token long") for x in (classes, *whole)]
    shared = reduce(DataFrame.unionByName, [counts.select("token"), *later])
    both = send(box.value[0], _bits_of(shared, MANY_BITS))
    box.destroy()
    schema = "set long, n int, tokens array<long>, rest int, stop long"
    rows = [_in_order(x, percent, both, _prefix_rows, schema) for x in (classes, *whole)]
    rows = materialize(reduce(DataFrame.unionByName, rows), "plain-prefixes")
    both.destroy()
    release(*used)
    return rows, whole


def _round(plain: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate pairs a, b of ``set``; frequent tokens of the prefixes (token, set), written; a table to
    release once the pairs are written). ``plain`` as ``_plain``."""
    entries = plain.selectExpr("explode(tokens) AS token", "set", "n")
    sizes = materialize(entries.groupBy("token").count().where("count > 1"), "list-sizes")
    few = sizes.where(f"count <= {FREQUENT}").select("token")
    # No list is longer than FREQUENT.
    lists = entries.join(few, "token").groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("set", "n"))).alias("l")
    )
    alike = f"100L * least(a.n, b.n) >= {percent}L * greatest(a.n, b.n)"
    pairs = lists.selectExpr(
        "inline(flatten(transform(l, (a, i) -> transform(filter(slice(l, i + 2, size(l)), b ->"
        f" {alike}), b -> struct(a.set AS a, b.set AS b, a.n + b.n AS n)))))"
    )
    pairs = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.count("*").alias("shared"))
    many = sizes.where(f"count > {FREQUENT}")
    frequent = materialize(entries.join(many, "token").select("token", "count", "set"), "frequent")
    hot = frequent.groupBy("set").agg(F.count("*").alias("hot"))
    # What the ends of the prefixes rule out: the one that ends first has only its rest left.
    ends = plain.join(hot, "set", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    a = ends.selectExpr("set AS a", "hot AS ha", "rest AS ra", "stop AS sa")
    b = ends.selectExpr("set AS b", "hot AS hb", "rest AS rb", "stop AS sb")
    most = (
        "shared + least(ha, hb) + CASE WHEN sa < sb THEN ra WHEN sb < sa THEN rb"
        f" WHEN sa = {LAST}L THEN greatest(ra, rb) ELSE least(ra, rb) END"
    )
    enough = f"{100 + percent}L * ({most}) >= {percent}L * n"
    pairs = pairs.join(a, "a").join(b, "b").where(enough).select("a", "b")
    return pairs, frequent, sizes


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """(set, z), written: the compressed text of each wanted set (set); with ``whole`` (set, n, sketch) of all
    its shingles instead. Texts of other documents stay where they are. One Python step: two in one
    stage would hold twice as many workers from then on."""
    of = classes.join(wanted, "set", "left_semi").select("set", F.col("first").alias("doc_id"))
    of = materialize(of, "wanted")
    box = docs.sparkSession.sparkContext.broadcast(_bits_of(of.select(F.xxhash64("doc_id")), FEW_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            b = b.filter(pa.array(box.value.has(b.column(2).to_numpy().view(np.uint64))))
            keys, n, out = [], [], []
            for x in b.column(1):
                raw = (x.as_py() or "").encode()
                s = shingles(raw, size)
                keys.append(set_key(s) if len(s) else None)
                n.append(len(s))
                out.append(s.tobytes() if whole else pack(raw))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.binary())],
                names=["doc_id", "set", "n", "z"],
            )
            give_back()

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id"))
    got = keyed.mapInArrow(run, "doc_id long, set long, n int, z binary")
    got = got.join(of, ["doc_id", "set"])  # a repeated doc_id may have other texts
    got = got.select("set", "n", F.col("z").alias("sketch")) if whole else got.select("set", "z")
    got = materialize(got.dropDuplicates(["set"]), "whole-sets" if whole else "texts")
    box.destroy()
    release(of)
    return got


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are as similar as asked, by their whole texts, with their similarity."""
    both = pairs.join(texts.selectExpr("set AS a", "z AS za"), "a").join(
        texts.selectExpr("set AS b", "z AS zb"), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def get(key: int, z: pa.Scalar) -> np.ndarray:
            nonlocal held
            s = known.get(key)
            if s is None:
                s = known[key] = shingles(unpack(z.as_py()), size)
                held += len(s)
                while held > 1 << 21 and len(known) > 2:
                    held -= len(known.popitem(last=False)[1])
            return s

        for batch in batches:
            out: list[tuple[int, int, float]] = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            za, zb = batch.column("za"), batch.column("zb")
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = get(x, za[i]), get(y, zb[i])
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                common = int((t[at] == s).sum())
                union = len(s) + len(t) - common
                if 100 * common >= percent * union:
                    out.append((x, y, common / union))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "j"]
            )

    # Near partners together, so that a set is made once.
    both = both.select("a", "b", "za", "zb").sortWithinPartitions("a", "b")
    return both.mapInArrow(run, "a long, b long, j double")


def similar(
    docs: DataFrame, size: int = 5, percent: int = 80
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of word shingles whose Jaccard similarity is at least ``percent`` of 100.

    Returns (members, classes, links): each row of ``docs`` with its set (doc_id, key, set, n), the
    key a hash of id and text; each set
    with its smallest doc_id (set, n, first); all links between different sets (a, b, j). Words are
    longest runs of anything
    but 0x20 and 0x09-0x0D, letters A-Z in lower case; a text of fewer words than ``size`` is one
    shingle; null and empty texts have no set and no links. Rows without an id have a set but no
    links. Other columns are ignored.
    """
    members, classes, links, family = _similar(docs, size, percent, "links")
    return members, classes, links.unionByName(family.select("a", "b", "j"))


def _similar(
    docs: DataFrame, size: int, percent: int, every: str | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ``similar``, with what is found among the blocks of large families apart, as ``_families`` has it:
    with ``every`` None links that lead to the same components, with "counts" also how many links there are, with
    "links" all of them."""
    rows = _sketches(docs, size, percent)
    members = materialize(rows.drop("sketch"), "members")
    classes = (
        rows.where("doc_id IS NOT NULL AND set IS NOT NULL")
        .groupBy("set")
        .agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    classes = materialize(classes, "classes")
    plain, whole = _plain(docs, classes, size, percent)
    pairs, hot, sizes = _round(plain, percent)
    found = materialize(pairs, "pairs")
    release(plain, sizes)
    dense = _dense(docs, classes, hot, whole, size)
    release(*whole)
    family, blocks, met = _families(dense, hot, percent, every)
    # What blocks that met have found is not compared again.
    a = blocks.selectExpr("set AS a", "at AS x")
    b = blocks.selectExpr("set AS b", "at AS y")
    again = found.join(a, "a").join(b, "b").selectExpr("a", "b", "least(x, y) AS x", "greatest(x, y) AS y")
    again = again.join(met, ["x", "y"], "left_semi").select("a", "b")
    pairs = materialize(found.join(again, ["a", "b"], "left_anti"), "pairs")
    wanted = pairs.selectExpr("a AS set").unionByName(pairs.selectExpr("b AS set")).distinct()
    texts = _texts(docs, classes, wanted, size)
    links = materialize(_links(pairs, texts, size, percent), "links")
    release(found, pairs, texts, dense, hot, blocks, met)
    return members, classes.select("set", "n", "first"), links, family


def _dense(
    docs: DataFrame, classes: DataFrame, hot: DataFrame, whole: list[DataFrame], size: int
) -> DataFrame:
    """(set, n, sketch) of the sets of ``hot`` with all their tokens; those of ``whole`` are at hand."""
    sets = materialize(hot.select("set").distinct(), "dense-sets")
    got = [x.join(sets, "set", "left_semi") for x in whole]
    rest, more = sets, None
    for x in whole:
        rest = rest.join(x, "set", "left_anti")
    if not rest.isEmpty():
        more = _texts(docs, classes, rest, size, whole=True)
        got.append(more)
    rows = materialize(reduce(DataFrame.unionByName, got, classes.select("set", "n", "sketch").limit(0)), "dense")
    release(sets, *([more] if more is not None else []))
    return rows


BLOCK = 128  # sets of a family that are compared at once
BLOCK_TOKENS = 1 << 18  # and their tokens, unless one set has more


def _families(
    dense: DataFrame, hot: DataFrame, percent: int, every: str | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What links the ``dense`` sets that share one of the ``hot`` tokens (token, count, set) of their prefixes:
    (a, b, j, count), (set, at) with the block of each set, and (x, y) of the blocks that met, x <= y.

    Each set lies in one block, among sets of alike size that hold the same of their frequent tokens. Two blocks
    that share a token meet once, whatever the number of tokens, so each pair of sets is looked at once. With
    "links", (a, b, j) are all links; else b is the smallest set that a reaches within both blocks, and with
    "counts" (a, count) says how many links a has there. Blocks are bounded and dealt by hash."""
    step = math.log(max(100 / percent, 1.1)) + 1e-6  # linked sets are at most one level apart
    kinds = hot.groupBy("set").agg(F.max_by("token", F.struct("count", "token")).alias("kind"))
    kinds = dense.select("set", "n").join(kinds, "set")
    kinds = kinds.withColumn("level", F.expr(f"CAST(floor(ln(n) / {step!r}D) AS INT)"))
    parts = kinds.groupBy("kind", "level").agg(
        F.expr(f"CAST(ceil(greatest(count(*) / {BLOCK}, sum(n) / {BLOCK_TOKENS})) AS INT) AS parts")
    )
    blocks = kinds.join(parts, ["kind", "level"]).selectExpr(
        "set", "struct(level, kind, CAST(pmod(xxhash64(set), parts) AS INT) AS part) AS at"
    )
    blocks = materialize(blocks, "blocks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = []
            for held in b.column(1):
                sets, n, sketches = (held.values.field(k) for k in ("set", "n", "sketch"))
                packed.append((sets, n, z.compress(_tokens(sketches)[0].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0].to_pylist() for x in packed], pa.list_(pa.int64())),
                 pa.array([x[1].to_pylist() for x in packed], pa.list_(pa.int32())),
                 pa.array([x[2] for x in packed], pa.binary())],
                names=["at", "sets", "n", "z"],
            )

    at = "at struct<level: int, kind: long, part: int>"
    packed = dense.join(blocks, "set").groupBy("at").agg(F.collect_list(F.struct("set", "n", "sketch")).alias("l"))
    packed = materialize(packed.mapInArrow(pack, f"{at}, sets array<long>, n array<int>, z binary"), "packed-blocks")
    held = hot.join(blocks, "set").select("token", "at").distinct()
    met = held.selectExpr("token", "at AS x").join(held.selectExpr("token", "at AS y"), "token")
    met = materialize(met.where("x <= y AND y.level - x.level <= 1").select("x", "y").distinct(), "met")
    both = met.join(packed.selectExpr("at AS x", "sets AS sa", "n AS na", "z AS za"), "x").join(
        packed.selectExpr("at AS y", "sets AS sb", "n AS nb", "z AS zb"), "y"
    )
    both = both.selectExpr("x = y AS same", "sa", "na", "za", "sb", "nb", "zb")
    tasks = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "a long, b long, j double, count long"
    found = both.repartition(tasks).mapInArrow(lambda x: _compare(x, percent, every), schema)
    found = materialize(found, "family-links")
    release(packed)
    return found, blocks, met


def _compare(batches: Iterator[pa.RecordBatch], percent: int, every: str | None) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks as ``_families`` has them: (a, b, j, count)."""
    unpack = zstandard.ZstdDecompressor().decompress

    def block(b: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, ...]:
        sets, n = (np.array(b.column(c + side)[i].as_py(), np.int64) for c in "sn")
        return sets, n, np.repeat(np.arange(len(n)), n), np.frombuffer(unpack(b.column("z" + side)[i].as_py()), np.uint64)

    for batch in batches:
        for i in range(batch.num_rows):
            same = batch.column("same")[i].as_py()
            sets, n, at, tokens = block(batch, i, "a")
            sets2, n2, at2, tokens2 = (sets, n, at, tokens) if same else block(batch, i, "b")
            both = np.intersect1d(tokens, tokens2)
            common = np.zeros((len(sets), len(sets2)), np.float32)
            for lo in range(0, len(both), 4096):  # bounded space
                some = both[lo : lo + 4096]
                has = []
                for size, at_, t in ((len(sets), at, tokens), (len(sets2), at2, tokens2)):
                    k = np.minimum(np.searchsorted(some, t), len(some) - 1)
                    hit = some[k] == t
                    m = np.zeros((size, len(some)), np.float32)
                    m[at_[hit], k[hit]] = 1
                    has.append(m)
                    if same:
                        break
                common += has[0] @ has[-1].T
            common = common.astype(np.int64)
            union = n[:, None] + n2[None, :] - common
            linked = 100 * common >= percent * union
            if same:
                np.fill_diagonal(linked, False)
            a, b, j, count = [], [], [], []
            if every == "links":
                x, y = np.nonzero(np.triu(linked) if same else linked)
                a, b = np.minimum(sets[x], sets2[y]), np.maximum(sets[x], sets2[y])
                j, count = common[x, y] / union[x, y], [None] * len(x)
            else:
                a, b = _smallest(sets, sets2, linked)
                j, count = [None] * len(a), [None] * len(a)
                if every == "counts":
                    sides = [(sets, linked.sum(1))] if same else [(sets, linked.sum(1)), (sets2, linked.sum(0))]
                    for ids, k in sides:
                        a, count = [*a, *ids[k > 0]], [*count, *k[k > 0]]
                    j, b = [None] * len(a), [*b, *[None] * (len(a) - len(b))]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip((a, b, j, count), types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "j", "count"])


def _smallest(x: np.ndarray, y: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """(set, smallest set that it reaches by the links of x and y), where that is another one."""
    most = np.iinfo(np.int64).max
    low, low2 = x.copy(), y.copy()
    while True:
        old, old2 = low, low2
        low2 = np.minimum(low2, np.where(linked, low[:, None], most).min(0, initial=most))
        low = np.minimum(low, np.where(linked, low2[None, :], most).min(1, initial=most))
        if np.array_equal(low, old) and np.array_equal(low2, old2):
            break
    ids, root = np.append(x, y), np.append(low, low2)
    return ids[ids != root].tolist(), root[ids != root].tolist()


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Each row of ``docs`` with its group of near duplicates: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, its own included), n_links (links of its set to others),
    key (a hash of id and text).
    A row without an id has component_id null; one without words is alone. See ``similar``."""
    members, classes, links, family = _similar(docs, size, percent, "counts")
    ways = links.selectExpr("a AS set", "1L AS count").unionByName(links.selectExpr("b AS set", "1L AS count"))
    ways = ways.unionByName(family.where("count IS NOT NULL").selectExpr("a AS set", "count"))
    degree = ways.groupBy("set").agg(F.sum("count").alias("n_links"))
    return _grouped(members, classes, links, family, degree)


def _grouped(
    members: DataFrame, classes: DataFrame, links: DataFrame, family: DataFrame, degree: DataFrame
) -> DataFrame:
    of = components(links.select("a", "b").unionByName(family.where("b IS NOT NULL").select("a", "b")))
    named = classes.join(of, F.col("set") == F.col("node"), "left").selectExpr(
        "set", "first", "coalesce(root, set) AS root"
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(smallest, "root").join(degree, "set", "left")
    named = named.selectExpr("set AS _set", "component", "n_links")
    return members.join(named, F.col("set") == F.col("_set"), "left").selectExpr(
        "doc_id", "CAST(n AS LONG) AS n_shingles",
        "CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id",
        "coalesce(n_links, 0L) AS n_links", "key",
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id, then the smallest key.
    Rows without an id or without words belong to no group and all stay. Columns stay as they are."""
    members, classes, links, family = _similar(docs, size, percent, None)  # n_links is not needed
    degree = classes.selectExpr("set", "0L AS n_links")
    judged = _grouped(members, classes, links, family, degree).where("doc_id IS NOT NULL AND n_shingles > 0")
    stay = judged.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("s"))
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    none = F.col("doc_id").isNull() | ~words
    one = keyed.join(stay.selectExpr("s.key AS __key"), "__key", "left_semi")
    one = one.where(~none).dropDuplicates(["__key"])
    return one.unionByName(keyed.where(none)).drop("__key")
