"""Collocations by dynamic itemset counting: phrases of all lengths in one cyclic scan of shards.

The corpus is dealt into ``shards`` of alike size, which are scanned in turn, round and round. A phrase
is watched once both phrases it is made of (all but its last and all but its first word) have reached the
threshold, from the next shard on and for one full cycle; lengths are so counted side by side instead of
in a pass each. A phrase that is frequent holds its share of the threshold in at least one shard, so a
watched one is taken up when a shard gives it that much, and is then counted for one full cycle, which makes
its count exact. What no shard makes heavy is dropped at once, so the table of counts stays near the size
of the result.

Scanning tasks know what to look for from bit maps over hashes of phrases, of one size in every step. They
may let through too much, never too little. What has once been let through by mistake must be so to the end of its
cycle, or its count lacks the later shards: the map of what has reached the threshold only ever gains entries, and
as its size stays, it never takes a mistake back. So what is let through is counted exactly and dropped if it is
light; what was counted stays, so nothing is counted twice. The scan ends when no phrase is being counted and none can begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.words import Words, lower_ascii, slices
from procscope.session import materialize, release, scratch_path

LONGEST = 4  # words of a phrase
SLICE = 1 << 22  # bytes of texts whose phrases are counted at once
MAP_BITS = 25  # a bit map has 2 to the power of this bits, in all steps
SHARDS = 3

_CUTS = np.zeros(256, bool)
_CUTS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BREAKS = _CUTS.copy()
_BREAKS[list(b" \t")] = True
#: Hash of a phrase, as ``_Words.extend`` has it: 64-bit rotations, so nothing overflows.
HASH = (
    "aggregate(split(phrase, ' '), xxhash64(lang), (acc, w) ->"
    " (shiftleft(acc, 21) | shiftrightunsigned(acc, 43)) ^ xxhash64(w))"
)
KINDS = ("reached", "recent", "counting")


def _hashes(raw: list[bytes]) -> np.ndarray:
    """As the SQL function."""
    return np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(42)), np.uint64, len(raw))


class _Bits:
    """A bounded set of hashes; it may hold more than was put in, never less. It travels to the tasks as
    its entries while these are few."""

    def __init__(self, bits: int, at: np.ndarray, mask: np.ndarray):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = np.zeros(max(1, (1 << bits) // 64), np.uint64)
        self.words[at] = mask

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.words)
        if 2 * len(at) >= len(self.words):
            return self.mask, len(self.words), None, self.words
        return self.mask, len(self.words), at, self.words[at]

    def __setstate__(self, state: tuple) -> None:
        self.mask, size, at, words = state
        if at is not None:
            full = np.zeros(size, np.uint64)
            full[at] = words
            words = full
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        i = h & self.mask
        word = self.words[(i >> np.uint64(6)).astype(np.int64)]
        return ((word >> (i & np.uint64(63))) & np.uint64(1)).astype(bool)


def _bit_maps(state: DataFrame, step: int, shards: int) -> dict[str, _Bits]:
    """What the next step looks for: phrases that have reached the threshold, those of them that did
    so within the last cycle, and those being counted."""
    marks = (
        f"array(CASE WHEN tau IS NOT NULL AND words < {LONGEST} THEN 0 END,"
        f" CASE WHEN tau >= {step - shards} AND words < {LONGEST} THEN 1 END,"
        f" CASE WHEN born + {shards} > {step} THEN 2 END)"
    )
    found = (
        state.where("phrase <> ''")
        .selectExpr(f"{HASH} & {(1 << MAP_BITS) - 1} AS i", f"explode(array_compact({marks})) AS kind")
        .groupBy("kind", F.expr("shiftright(i, 6) AS at"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(i & 63 AS INT))) AS mask"))
        .toArrow()  # at most three times 2^MAP_BITS / 64 rows
    )
    kind, at, mask = (found[c].to_numpy() for c in ("kind", "at", "mask"))
    return {
        name: _Bits(MAP_BITS, at[kind == k], mask[kind == k].view(np.uint64)) for k, name in enumerate(KINDS)
    }


class _Words:
    """Words of some texts of one language: ids, and where pieces end."""

    def __init__(self, lang: str, data: np.ndarray, offsets: np.ndarray):
        data = lower_ascii(data)
        w = Words(data, offsets, _BREAKS)
        inside = ~_BREAKS[data]
        ends = np.cumsum(w.ends - w.starts)
        flat = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(w),
            [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[inside])],
        )
        coded = flat.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary.cast(pa.large_string())
        # Which words follow the one before them in its piece and text.
        follows = np.ones(len(w) + 1, bool)
        follows[np.searchsorted(w.starts, np.flatnonzero(_CUTS[data]))] = False
        follows[w.first] = False
        self.joined = follows[1 : len(w)]
        self.word_hash = _hashes(coded.dictionary.to_pylist())
        self.lang_hash = _hashes([lang.encode()])

    def extend(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hashes of phrases with one more word."""
        return ((h << np.uint64(21)) | (h >> np.uint64(43))) ^ self.word_hash[word]

    def counted(self, spots: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """The phrases of ``size`` words that start at ``spots`` and how often each does."""
        v, code = len(self.dictionary), self.ids[spots]
        # A code spells its words as digits, so plain sorts do. Where one more word would pass 64 bits, ranks
        # stand in place of codes, and ``spelt`` says what a rank stands for.
        room, spelt, ahead = np.iinfo(np.int64).max // v, None, 0
        top = v  # codes lie below
        for k in range(1, size):
            if top > room:
                one, code = np.unique(code, return_inverse=True)
                spelt, ahead, top = (one, spelt, ahead), k, len(one)
            code, top = code * v + self.ids[spots + k], top * v
        code, count = np.unique(code, return_counts=True)
        words = []
        for k in reversed(range(size)):
            if spelt and k < ahead:
                one, spelt, ahead = spelt
                code = one[code]
            words.insert(0, self.dictionary.take(pa.array(code % v)))
            code = code // v
        return pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())), count


def _phrases(lang: str, data, offsets, step: int, shards: int, bits) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of what the step looks for in some texts; first '' with the number of words."""
    w = _Words(lang, data, offsets)
    m, v = len(w.ids), len(w.dictionary)
    if not m:
        return
    if step < shards:
        yield pa.array([""], pa.large_string()), np.array([m])
    h = w.extend(np.repeat(w.lang_hash, v), np.arange(v))
    count = np.bincount(w.ids, minlength=v)
    wanted = np.ones(v, bool) if step < shards or bits is None else bits["counting"].has(h)
    if wanted.any():
        yield w.dictionary.filter(pa.array(wanted)), count[wanted]
    if bits is None:
        return
    # At every word: the hash of the phrase that starts there, whether it has reached the threshold, and
    # whether it did so within the last cycle. Only what is wanted is looked at as words.
    reached, recent = bits["reached"].has(h)[w.ids], bits["recent"].has(h)[w.ids]
    h, tail = h[w.ids], w.word_hash[w.ids]
    for size in range(1, LONGEST):
        both = reached[:-1] & reached[1:]
        if size == 1:
            both &= w.joined
        at = np.flatnonzero(both)
        if not len(at):
            return
        longer = ((h[at] << np.uint64(21)) | (h[at] >> np.uint64(43))) ^ tail[at + size]
        wanted = recent[at] | recent[at + 1]
        rest = np.flatnonzero(~wanted)
        wanted[rest] = bits["counting"].has(longer[rest])
        spots = at[wanted]
        if len(spots):
            yield w.counted(spots, size + 1)
        h = np.zeros(len(both), np.uint64)
        h[at] = longer
        reached, recent = np.zeros(len(both), bool), np.zeros(len(both), bool)
        reached[at] = bits["reached"].has(longer)
        recent[at] = reached[at] & bits["recent"].has(longer)


def _scan(shard: DataFrame, step: int, shards: int, box: Broadcast) -> DataFrame:
    """(lang, phrase, n) of what the step looks for by the bit maps in ``box``, added up within slices of
    texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0)
            for lang in pc.unique(langs).to_pylist():
                texts = b.column(1).filter(pc.equal(langs, lang))
                for _, _, data, offsets in slices(texts, SLICE):
                    for phrase, n in _phrases(lang, data, offsets, step, shards, box.value):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(lang), len(n)), phrase.cast(pa.string()), pa.array(n, pa.int64())],
                            names=["lang", "phrase", "n"],
                        )

    return shard.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, text, shard), written once: later scans read their shard only."""
    path = scratch_path(docs.sparkSession, "phrase-shards")
    d = docs.selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    d = d.withColumn("shard", F.expr(f"CAST(pmod(monotonically_increasing_id(), {shards}) AS INT)"))
    d.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(d.schema).parquet(path)


def phrase_counts(docs: DataFrame, threshold: int = 30, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, words, f): every phrase of one to four words that occurs ``threshold`` times or
    more in a language, with its count, and per language the phrase '' with the count of all words."""
    dealt = _dealt(docs, shards)
    state, step, bits = None, 0, None
    share = -(-threshold // shards)
    while True:
        box = docs.sparkSession.sparkContext.broadcast(bits)  # bounded by MAP_BITS
        found = _scan(dealt.where(f"shard = {step % shards}"), step, shards, box)
        rows = found.selectExpr("lang", "phrase", "n", "CAST(NULL AS LONG) AS total",
                                "CAST(NULL AS INT) AS born", "CAST(NULL AS INT) AS tau")
        if state is not None:
            rows = rows.unionByName(state.selectExpr("lang", "phrase", "0L AS n", "total", "born", "tau"))
        merged = rows.groupBy("lang", "phrase").agg(
            F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("total", "born", "tau")]
        )
        merged = merged.where(f"born IS NOT NULL OR n >= {share} OR phrase = ''").selectExpr(
            "lang", "phrase", "coalesce(total, 0L) + if(born IS NULL OR "
            f"born + {shards} > {step}, n, 0L) AS total",
            f"coalesce(born, if(phrase = '', 0, {step})) AS born", "tau",
        )
        merged = merged.selectExpr(
            "lang", "phrase", "total", "born",
            f"CASE WHEN phrase <> '' THEN coalesce(tau, if(total >= {threshold}, {step}, NULL)) END AS tau",
            "if(phrase = '', 0, size(split(phrase, ' '))) AS words",
        )
        counted = materialize(merged, "phrase-counts")
        # No later plan scans this step's shard or reads the counts before it again.
        box.destroy()
        if state is not None:
            release(state)
        state = counted
        step += 1
        open_ = state.agg(
            F.expr(f"count_if(born + {shards} > {step} AND phrase <> '')").alias("counting"),
            F.expr(f"count_if(tau + {shards} >= {step} AND words < {LONGEST})").alias("beginning"),
        ).first()
        if step >= shards and not open_.counting and not open_.beginning:
            done = state.where(f"total >= {threshold} OR phrase = ''")
            return done.selectExpr("lang", "phrase", "words", "total AS f")
        bits = _bit_maps(state, step, shards)


def _cut(k: str) -> tuple[str, str]:
    """SQL of a phrase's first ``k`` words and of the rest."""
    return (
        f"substring_index(phrase, ' ', {k})",
        f"substring_index(phrase, ' ', {k} - words)",
    )


def _parts(longer: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the runs of two or more words inside each longer phrase."""
    runs = (
        "explode(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))) AS phrase"
    )
    return longer.where("words > 2").selectExpr("lang", "f AS longer", runs)


def collocations(
    docs: DataFrame, threshold: int = 30, top: int = 2000, inside: int = 80, shards: int = SHARDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to four words.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?`` and line ends ``]`` and those into words
    at spaces and tabs; a null text is empty and a null language ``und``. ``a`` counts a phrase's
    occurrences within pieces, overlaps included, and must reach ``threshold``. Cut after its first k
    words it has parts of counts l and r and the score floor(2000000 a / (l + r)); its lowest-scoring
    cut counts, the smallest k among equals. A phrase goes if a longer one that holds its words in a row
    has at least ``inside`` hundredths of its count. Ties in the ranking go to the larger count, then to
    the smaller phrase by bytes. ``n`` are all words of the language. Repeated rows count each; empty
    tables have no phrases; other columns are ignored. A text must fit a worker's memory several times
    over.
    """
    counts = phrase_counts(docs, threshold, shards)
    words = counts.where("words = 0").selectExpr("lang", "f AS n")
    counts = counts.where("words > 0")
    found = counts.where("words > 1")
    first, rest = _cut("k")
    cuts = found.selectExpr("*", "explode(sequence(1, words - 1)) AS k").selectExpr(
        "lang", "phrase", "f AS a", "k", f"{first} AS head", f"{rest} AS tail"
    )
    cuts = cuts.join(counts.selectExpr("lang", "phrase AS head", "f AS l"), ["lang", "head"])
    cuts = cuts.join(counts.selectExpr("lang", "phrase AS tail", "f AS r"), ["lang", "tail"])
    score = "CAST((CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + r) AS LONG)"
    scored = cuts.selectExpr("lang", "phrase", "a", "k", "l", "r", f"{score} AS score")
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.expr("min_by(struct(l, r, score), struct(score, k)) AS c")
    )
    longer = _parts(found).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hundred = "CAST({} AS DECIMAL(3, 0)) * CAST({} AS DECIMAL(19, 0))"
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR {hundred.format(100, 'longer')} < {hundred.format(inside, 'a')}"
    )
    order = "PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase"
    ranked = kept.selectExpr("*", f"row_number() OVER ({order}) AS rank").where(f"rank <= {top}")
    return ranked.join(words, "lang").selectExpr(
        "lang", "CAST(rank AS LONG) AS rank", "phrase", "a", "c.l AS l", "c.r AS r", "n", "c.score AS score"
    )
