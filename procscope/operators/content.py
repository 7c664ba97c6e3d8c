"""Content identification of the files incidents point at. Enrichment only: scores never change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.session import materialize


def targets(evidence: DataFrame) -> DataFrame:
    """Distinct targets per incident, with the first signal that named each."""
    return (
        evidence.filter("target IS NOT NULL AND target <> ''")
        .groupBy("host", "seq", "pid", "start", "target")
        .agg(F.expr("min_by(id, struct(ts_ns, depth, first_so)) AS signal"))
    )


def read_files(spark, path: str, glob: str = "*") -> DataFrame:
    """(target, body) of files on shared storage, whole and as bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .selectExpr("path AS target", "content AS body")
    )


GRAM = 4  # bytes of a signature that a body is looked up by
BLOCK = 1 << 16  # bytes of a body whose grams are listed at once
SCANNED = 1 << 22  # bytes of blocks that are looked at together
SLOTS = 33_554_393  # a prime below 2^25: grams are told apart by their remainder before they are joined
SIGNATURE_BYTES = 8 * 1024 * 1024

#: Escapes that stand for a character, a class by name or a quotation: what is sure then is not plain.
_OPAQUE = r"\\\\[xucpPQEN0-9k]|\\[[^\\]]*\\[|[|(]"


def _core(pattern: str) -> str:
    """SQL of the longest text that every match of a regular expression holds, as far as is plain: ''
    for alternatives, groups and escapes of characters; what is optional, repeated or a class splits
    it."""
    cut = f"regexp_replace({pattern}, '([?*+}}])[?+]', '$1')"  # lazy and possessive
    for part in (r"\\\\.", r"\\[[^\\]]*\\]", r".\\{[^}]*\\}", r".[?*]", r"[.^$+]"):
        cut = f"regexp_replace({cut}, '{part}', '\\u0001')"
    longest = f"array_max(transform(split({cut}, '\\u0001'), x -> struct(length(x) AS n, x AS x))).x"
    quoted = f"startswith({pattern}, '\\\\Q') AND instr({pattern}, '\\\\E') = length({pattern}) - 1"
    return (
        f"CASE WHEN {quoted} THEN substring({pattern}, 3, length({pattern}) - 4)"
        f" WHEN {pattern} RLIKE '{_OPAQUE}' THEN '' ELSE {longest} END"
    )


def _signatures(signatures: DataFrame) -> DataFrame:
    """(rule, bytes, pattern, sure): what to look for, on bytes: ``bytes`` as they are, or else a
    ``pattern``. ``sure`` are bytes that any match holds. Half bytes of a hex signature may be ``?``."""
    d = signatures.selectExpr(
        "rule", "kind", "pattern", "upper(regexp_replace(pattern, '[ \\t\\r\\n]', '')) AS hex",
    ).selectExpr(
        "*",
        "CASE WHEN kind = 'hex' AND NOT hex RLIKE '^([0-9A-F?]{2})+$' THEN"
        " raise_error(concat('signature ', rule, ' is not pairs of hex digits: ', pattern))"
        " WHEN kind = 'hex' THEN transform(sequence(1, length(hex) DIV 2), i -> substring(hex, 2 * i - 1, 2))"
        " END AS pairs",
    ).selectExpr("*", "kind = 'hex' AND contains(hex, '?') AS masked")
    nibbles = "array_join(transform(sequence(0, 15), j -> concat('\\\\x', conv(j, 10, 16), right(p, 1))), '')"
    mask = (
        "array_join(transform(pairs, p -> CASE WHEN p = '??' THEN '[\\\\s\\\\S]'"
        f" WHEN p LIKE '?_' THEN concat('[', {nibbles}, ']')"
        " WHEN p LIKE '_?' THEN concat('[\\\\x', left(p, 1), '0-\\\\x', left(p, 1), 'F]')"
        " ELSE concat('\\\\x', p) END), '')"
    )
    runs = "split(array_join(transform(pairs, p -> if(contains(p, '?'), '|', p)), ''), '[|]')"
    longest = f"array_max(transform({runs}, x -> struct(length(x) AS n, x AS x))).x"
    text = "encode(pattern, 'UTF-8')"
    return d.selectExpr(
        "rule",
        f"CASE WHEN kind = 'regex' OR masked THEN NULL WHEN kind = 'hex' THEN unhex(hex) ELSE {text} END AS bytes",
        f"CASE WHEN kind = 'regex' THEN decode({text}, 'ISO-8859-1') WHEN masked THEN {mask} END AS pattern",
        f"CASE WHEN kind = 'regex' THEN encode({_core('pattern')}, 'UTF-8')"
        f" WHEN masked THEN unhex({longest}) WHEN kind = 'hex' THEN unhex(hex) ELSE {text} END AS sure",
    )


HIT = (
    "CASE WHEN s.bytes IS NULL THEN regexp_like(decode(body, 'ISO-8859-1'), s.pattern)"
    " ELSE contains(body, s.bytes) END"
)


def _slots(grams: DataFrame) -> dict[int, np.ndarray]:
    """Per length a bit map of the ``grams`` (k, code). It may hold more, never less."""
    found = (
        grams.selectExpr("k", f"code % {SLOTS} AS i")
        .groupBy("k", F.expr("i DIV 64 AS at"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(i % 64 AS INT))) AS mask"))
        .toArrow()  # at most GRAM times SLOTS / 64 rows
    )
    k, at, mask = (found[c].to_numpy() for c in ("k", "at", "mask"))
    maps = {}
    for size in np.unique(k).tolist():
        maps[size] = np.zeros(SLOTS // 64 + 1, np.uint64)
        maps[size][at[k == size]] = mask[k == size].view(np.uint64)
    return maps


def _sightings(blocks: pa.Array, maps: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, rows, codes) of the grams in ``blocks`` that the maps have, with repeats, some MB at a time."""
    blocks = blocks.cast(pa.large_binary())
    _, offsets, raw = blocks.buffers()
    off = np.frombuffer(offsets, np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(blocks):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SCANNED, "right")) - 1)
        data, ends = raw[off[lo] : off[hi]], off[lo + 1 : hi + 1] - off[lo]
        for k, bits in maps.items():
            m = max(len(data) - k + 1, 0)
            code = np.zeros(m, np.uint32)
            for j in range(k):
                code = (code << np.uint32(8)) | data[j : m + j]
            slot = code % np.uint32(SLOTS)
            at = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            row = np.searchsorted(ends, at, "right")
            whole = at + k <= ends[row]  # not across two blocks
            yield k, lo + row[whole], code[at[whole]].astype(np.int64)
        lo = hi


def _gram_counts(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """(k, code, n): how often each of the ``grams`` occurs in the blocks; those that do not are left out."""
    box = blocks.sparkSession.sparkContext.broadcast(_slots(grams))  # bounded by SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, _, codes in _sightings(b.column(0), box.value):
                code, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n.astype(np.int64))],
                    names=["k", "code", "n"],
                )

    counts = blocks.select("block").mapInArrow(run, "k int, code long, n long")
    counts = counts.groupBy("k", "code").agg(F.sum("n").alias("n"))
    return counts.join(grams.select("k", "code").distinct(), ["k", "code"], "left_semi")


def _holders(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """(target, k, code): the targets whose blocks hold one of the few ``grams``."""
    box = blocks.sparkSession.sparkContext.broadcast(_slots(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, rows, codes in _sightings(b.column(1), box.value):
                pairs = np.unique(np.stack([rows, codes]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(pairs[0])).cast(pa.string()),
                     pa.array(np.full(pairs.shape[1], k, np.int32)), pa.array(pairs[1])],
                    names=["target", "k", "code"],
                )

    found = blocks.select("target", "block").mapInArrow(run, "target string, k int, code long")
    return found.join(grams.select("k", "code").distinct(), ["k", "code"], "left_semi").distinct()


def identify(
    targets_: DataFrame,
    contents: DataFrame,
    signatures: DataFrame,
    pass_bytes: int = SIGNATURE_BYTES,
) -> DataFrame:
    """Outcome per target: matched (with rule names), clean, or raced when there was nothing to read.

    ``contents``: (target, body) with bytes, or text that counts as its UTF-8 bytes. ``signatures``:
    (rule, kind, pattern) of kind literal, regex or hex; all match bytes, so that a regular
    expression sees each byte as one character. A hex signature may have ``?`` for half bytes; one that
    is not pairs of digits is an error that names its rule.

    A signature is looked up by the rarest of the four-byte grams that any match of it holds, as counted
    in these bodies: first bytes are often a magic number that every file has. Where one of its grams
    occurs nowhere it is not looked up at all. Shorter ones are grams themselves. One scan counts the
    grams, a second one names the bodies that hold the chosen ones, so common grams yield counts, never
    a row a body. The candidates of a
    target come together before they meet its body, so a body travels once. Only regular expressions
    without any sure byte are tried on all bodies; they travel to the executors in passes of at most
    ``pass_bytes``, measured first.
    """
    want = targets_.select("target").distinct()
    bodies = want.join(contents.selectExpr("target", "CAST(body AS BINARY) AS body"), "target", "left")
    bodies = materialize(bodies, "bodies")
    sigs = _signatures(signatures).withColumn("sig", F.monotonically_increasing_id())
    sigs = materialize(sigs, "signatures")
    size = f"least({GRAM}, octet_length(sure))"
    own = sigs.filter("octet_length(sure) > 0").selectExpr(
        "sig", f"{size} AS k",
        f"explode(array_distinct(transform(sequence(1, octet_length(sure) - {size} + 1),"
        f" i -> CAST(conv(hex(substring(sure, i, {size})), 16, 10) AS LONG)))) AS code",
    )
    own = materialize(own, "signature-grams")
    blocks = bodies.filter("octet_length(body) > 0").selectExpr(
        "target",
        f"explode(transform(sequence(0, (octet_length(body) - 1) DIV {BLOCK}),"
        f" k -> substring(body, k * {BLOCK} + 1, {BLOCK + GRAM - 1}))) AS block",
    )
    often = materialize(_gram_counts(blocks, own), "gram-counts")
    rarest = (
        own.join(often, ["k", "code"], "left").groupBy("sig")
        .agg(F.expr("min_by(struct(k, code), struct(n, k, code)) AS gram"), F.expr("count(n) = count(1) AS whole"))
        .filter("whole").select("sig", "gram.k", "gram.code")
    )
    rarest = materialize(rarest, "rarest-grams")
    found = materialize(_holders(blocks, rarest), "body-grams")
    per = found.join(rarest, ["k", "code"]).join(sigs, "sig").groupBy("target").agg(
        F.expr("collect_list(struct(rule, bytes, pattern)) AS sigs")  # at most all signatures
    )
    hits = bodies.join(per, "target").selectExpr("target", f"explode(filter(sigs, s -> {HIT})) AS s")
    rest = sigs.filter("coalesce(octet_length(sure), 0) = 0")
    total = rest.agg(F.expr("sum(coalesce(octet_length(pattern), 0) + octet_length(rule) + 32)")).first()[0] or 0
    passes = -(-total // pass_bytes)
    for k in range(passes):
        part = rest.filter(f"pmod(sig, {passes}) = {k}")
        row = part.groupBy().agg(F.expr("collect_list(struct(rule, bytes, pattern)) AS sigs"))
        tried = bodies.filter("octet_length(body) > 0").crossJoin(F.broadcast(row))
        tried = tried.selectExpr("target", f"explode(filter(sigs, s -> {HIT})) AS s")
        hits = hits.unionByName(tried)
    hits = hits.groupBy("target").agg(F.expr("array_sort(collect_set(s.rule)) AS rules"))
    gone = bodies.groupBy("target").agg(
        F.expr("bool_and(coalesce(octet_length(body), 0) = 0) AS gone")
    )
    scanned = gone.join(hits, "target", "left").selectExpr(
        "target",
        "CASE WHEN gone THEN 'raced' WHEN rules IS NOT NULL THEN 'matched' ELSE 'clean' END AS outcome",
        "rules",
        "CASE WHEN gone THEN concat(target, ' was empty or already gone') END AS reason",
    )
    return targets_.join(scanned, "target")


def enrich(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Put scan results on the records they belong to."""
    per = outcomes.groupBy("host", "seq").agg(
        F.expr(
            "sort_array(collect_list(struct(signal, target, outcome, rules, reason))) AS scans"
        )
    )
    return records.join(per, ["host", "seq"], "left").selectExpr(
        *[c for c in records.columns if c != "record"],
        "named_struct('schema', record.schema, 'ts_ns', record.ts_ns, 'ts', record.ts,"
        " 'severity', record.severity, 'score', record.score,"
        " 'score_breakdown', record.score_breakdown, 'subject', record.subject,"
        " 'lineage', record.lineage, 'lineage_detail', record.lineage_detail,"
        " 'attack', record.attack, 'signals', record.signals,"
        " 'yara', coalesce(scans, array())) AS record",
    )
