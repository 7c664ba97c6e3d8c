"""Registered queries of the data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procscope.llm import collocations, line_align, mil, packing, pivots, prefix_join, secrets_forest
from procscope.llm import spans, suffix_dedup, token_align, token_tree, url_rules, wand

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 1024) for x in embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10"""


@query("op1_top_k", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10, 1024)


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_join.groups(docs, 3, 90).drop("key")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of every document, one row for each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = wand.mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.selectExpr("doc_id", "inline(leaks)")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, before and after its editing session: the turns of the
    conversation with its number, each an edit at a place anywhere in the text and of a size that
    follow from the turn."""
    docs = table(spark, sf_dir, "documents")
    trees = token_tree.build_trees(docs)
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    edits = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id").join(
        sizes, "doc_id"
    ).selectExpr(
        "doc_id", "turn AS seq", "pmod(xxhash64(doc_id, turn), coalesce(chars, 0) + 1L) AS at",
        "pmod(turn * 13, 40) AS delete", "text AS insert",
    )
    return token_tree.apply_edits(trees, edits).selectExpr(
        "doc_id", "n_edits", "n_rejected", "n_tokens_before", "n_tokens",
        "CAST(length(text) AS LONG) AS n_chars", "n_reencoded", "sha2(text, 256) AS sha256",
    )


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs, 35).selectExpr(
        "doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256"
    )


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = secrets_forest.train(secrets_forest.labelled_findings(docs, 3000, "source"))
    return secrets_forest.scan(docs, model, "source")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_align.dedup_lines(docs).selectExpr(
        "doc_id", "n_lines", "n_removed", "CAST(length(text) AS LONG) AS n_chars",
        "sha2(text, 256) AS kept_sha256",
    )


QUALITY_CUT = 0.3


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.learn(docs, table(spark, sf_dir, "labels"))
    return mil.score(docs, model).selectExpr(
        "doc_id",
        "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 AS held_out",
        "score",
        f"CAST(score >= {QUALITY_CUT} AS INT) AS predicted",
    )


HOST_RULES = [
    url_rules.Rule("com/", "allow", True),
    url_rules.Rule("example.com/en/", "block", True),
    url_rules.Rule("www.example.com/en/", "allow", True),
    url_rules.Rule("net/es/", "block", True),
    url_rules.Rule("net/fr/", "block", True),
]
WILDCARD_RULES = [
    url_rules.Rule(text, "block", False)
    for text in ("/ads/", "/tracking/", "/login^", "^sessionid=", "^phpsessid=", "^utm_source=",
                 "://casino.", ".casino.", "/wp-admin/", "/cgi-bin/*.pl^")
]

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN
    substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substring(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM h),
r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT p.page_id, p.host, p.path, p.low, (
    SELECT arg_max({'rule': r.host || r.path, 'action': r.action}, length(r.host || r.path)) FROM r
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  ) AS hit FROM p),
w(pattern, regex) AS (VALUES ('/ads/', '/ads/'), ('/tracking/', '/tracking/'),
  ('/login^', '/login([^a-z0-9_.%-]|$)'), ('^sessionid=', '[^a-z0-9_.%-]sessionid='),
  ('^phpsessid=', '[^a-z0-9_.%-]phpsessid='), ('^utm_source=', '[^a-z0-9_.%-]utm_source='),
  ('://casino.', '://casino\.'), ('.casino.', '\.casino\.'), ('/wp-admin/', '/wp-admin/'),
  ('/cgi-bin/*.pl^', '/cgi-bin/.*\.pl([^a-z0-9_.%-]|$)'))
SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit IS NOT NULL THEN hit.action
    WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM (SELECT *, CASE WHEN hit IS NULL THEN (SELECT arg_max(w.pattern, length(w.pattern)) FROM w
  WHERE regexp_matches(f.low, w.regex)) END AS pattern FROM f)"""


@query("op10_url_filter", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, HOST_RULES + WILDCARD_RULES, "allow")


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM t),
g AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i
    FROM (SELECT *, unnest([1, 2, 3, 4]) AS m FROM p))),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY 1),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
k AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (
  SELECT k.*, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
  FROM k JOIN f h ON k.lang = h.lang AND head = h.phrase JOIN f t ON k.lang = t.lang AND tail = t.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[j:j + w - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, m - w + 2)) AS j
    FROM (SELECT *, unnest(range(2, m)) AS w FROM f WHERE m > 2)) GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b LEFT JOIN i USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a) JOIN n USING (lang)
WHERE rank <= 2000"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, 30, 2000)


@query("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_align.align(docs, a, b).drop("groups")


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT row, k + j AS i, md5_number(substr(y, 2 * j + 1, 400)) AS string
  FROM (SELECT row, k, y, unnest(range(length(y) // 2 - 199)) AS j
    FROM (SELECT row, k, substr(x, 2 * k + 1, 798) AS y
      FROM (SELECT row, x, unnest(range(0, length(x) // 2 - 199, 200)) AS k FROM d WHERE length(x) >= 400)))),
r AS (
  SELECT row, i FROM s WHERE string IN (SELECT string FROM s GROUP BY 1 HAVING count(*) > 1)),
e AS (SELECT *, coalesce(i - lag(i) OVER w > 200, true) AS new FROM r WINDOW w AS (PARTITION BY row ORDER BY i)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS run FROM e),
c AS (SELECT row, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY row, run),
k AS (
  SELECT row, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b
  FROM c GROUP BY row)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE list_aggregate([
    substr(x, 2 * coalesce(b[j], 0) + 1, 2 * (coalesce(a[j + 1], length(x) // 2) - coalesce(b[j], 0)))
    for j in range(n_spans + 1)], 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (row)"""


@query("op13_suffix_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, 200).selectExpr(
        "doc_id", "n_bytes", "n_removed", "CAST(size(removed) AS LONG) AS n_spans",
        "sha2(kept, 256) AS kept_sha256",
    )
