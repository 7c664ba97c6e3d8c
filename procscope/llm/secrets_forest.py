"""Secret scanning with a random forest that removes false positives.

Patterns find candidates: runs of letters and digits that are long enough and hold both. The forest
judges each by its length, its character transitions, how much of it dictionary words cover, the
path of its document and the neighbouring words. It learns from labelled findings. Everything is
DataFrame expressions and the JVM's own forest; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.session import scratch_path

MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z0-9][+/_-][A-Za-z0-9]"
RUN = "[A-Za-z0-9+/_-]{14,}={0,2}"

# Public formats of credentials, as (name, pattern of the whole candidate).
FORMATS = [
    ("aws_access_key", "(AKIA|ASIA)[A-Z0-9]{16}"),
    ("github_token", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("stripe_key", "[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    ("slack_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_key", "AIza[A-Za-z0-9_-]{35}"),
    ("json_web_token", "eyJ[A-Za-z0-9_-]{14,}"),
]
# Words that name a secret, words of identifiers and of placeholders.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key",
                "auth", "credential", "private_key", "access_key"]
HARMLESS_WORDS = ["sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "commit", "etag",
                  "uuid", "guid", "revision", "version", "build", "integrity", "id"]
DICTIONARY = ["account", "address", "admin", "article", "client", "config", "content", "count",
              "create", "data", "default", "delete", "document", "dummy", "example", "file",
              "follow", "format", "handler", "header", "image", "index", "item", "label", "length",
              "list", "local", "message", "model", "module", "name", "number", "object", "option",
              "order", "page", "param", "path", "placeholder", "product", "profile", "query",
              "record", "report", "request", "response", "result", "sample", "search", "server",
              "service", "session", "size", "source", "status", "string", "style", "system",
              "table", "test", "text", "title", "type", "update", "user", "value", "version",
              "view", "window", "your"]
TEST_PATHS = "(?i)(test|example|sample|fixture|mock|docs?/)"

FEATURES = [
    "f_length", "f_transitions", "f_distinct", "f_digits", "f_upper", "f_hex", "f_dashes",
    "f_dictionary", "f_test_path", "f_in_path", "f_secret_near", "f_harmless_near", "f_assigned",
    "f_quoted", "f_format",
]


def _any(words: list[str]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every candidate of every text: doc_id, path, word_at (from 0), word, candidate, before,
    after. ``path`` names the column with the document's path. Null texts have none; a candidate
    in two words of a text is two rows, and so are those of repeated rows."""
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    d = docs.where(F.col("text").rlike(MIXED)).select(
        "doc_id",
        (F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")).alias("path"),
        F.expr(words).alias("words"),
    )
    # The words that may hold one come first, so that not every word becomes a row.
    d = d.withColumn(
        "hits",
        F.expr(
            "filter(transform(words, (w, i) -> struct(i AS at, w AS word)),"
            f" x -> length(x.word) >= 14 AND x.word RLIKE '{MIXED}')"
        ),
    ).withColumn(
        "hits",
        F.expr(
            "transform(hits, x -> struct(x.at, x.word,"
            " concat_ws(' ', get(words, x.at - 2), get(words, x.at - 1)) AS before,"
            " coalesce(get(words, x.at + 1), '') AS after))"
        ),
    )
    d = d.select("doc_id", "path", F.explode("hits").alias("h"))
    d = d.select(
        "doc_id", "path", F.col("h.at").cast("long").alias("word_at"), F.col("h.word").alias("word"),
        F.col("h.before").alias("before"), F.col("h.after").alias("after"),
        F.explode(F.expr(f"regexp_extract_all(h.word, '{RUN}', 0)")).alias("candidate"),
    )
    return d.where("candidate RLIKE '[0-9]' AND candidate RLIKE '[A-Za-z]'")


def with_features(found: DataFrame) -> DataFrame:
    """The forest's inputs. Missing neighbours and paths count as empty."""
    c, n = "candidate", "length(candidate)"
    classes = (
        f"regexp_replace(regexp_replace(regexp_replace({c}, '[A-Z]', 'A'), '[a-z]', 'a'),"
        " '[0-9]', '0')"
    )
    near = "concat_ws(' ', before, word)"
    own = f"substring_index(word, {c}, 1)"  # what stands before it in its word
    kind = reduce(
        lambda rest, f: f"CASE WHEN {c} RLIKE '^({f[1]})$' THEN '{f[0]}' ELSE {rest} END",
        FORMATS[::-1], "''",
    )
    left = f"regexp_replace(lower({c}), '({'|'.join(DICTIONARY)})', '')"
    share = lambda pattern: f"length(regexp_replace({c}, '{pattern}', '')) / {n}"
    out = found.withColumn("format", F.expr(kind))
    values = {
        "f_length": f"least({n}, 200)",
        "f_transitions": rf"(length(regexp_replace({classes}, '(.)\\1+', '$1')) - 1) / {n}",
        "f_distinct": f"size(array_distinct(split({c}, ''))) / {n}",
        "f_digits": share("[^0-9]"),
        "f_upper": share("[^A-Z]"),
        "f_hex": f"int({c} RLIKE '^[0-9a-f]+$')",
        "f_dashes": share("[A-Za-z0-9]"),
        "f_dictionary": f"1 - length({left}) / {n}",
        "f_test_path": f"int(coalesce(path, '') RLIKE '{TEST_PATHS}')",
        "f_in_path": "int(word RLIKE '://|^/|[.](com|net|org|html?)')",
        "f_secret_near": f"int({near} RLIKE '{_any(SECRET_WORDS)}')",
        "f_harmless_near": rf"int({near} RLIKE '{_any([rf'\\b{w}\\b' for w in HARMLESS_WORDS])}')",
        "f_assigned": f"int({own} RLIKE '[=:]' OR before RLIKE '[=:]$')",
        "f_quoted": rf"int({own} RLIKE '[\"\']')",
        "f_format": "int(format <> '')",
    }
    return out.withColumns({k: F.expr(v).cast("double") for k, v in values.items()})


def lookalikes(docs: DataFrame) -> DataFrame:
    """Findings that are surely no secrets, for training: digests, identifiers, versions and link
    parts made from the documents' own texts."""
    t = docs.where("text IS NOT NULL").selectExpr(
        "doc_id", "text", "xxhash64(doc_id, text) AS h",
        "coalesce(get(split(text, '[^A-Za-z]+'), 1), 'item') AS w",
        "coalesce(get(split(text, '[^A-Za-z]+'), 2), 'item') AS v",
    )
    made = (
        "array(struct(md5(text) AS word, concat(w, ' md5') AS before),"
        " struct(sha1(text) AS word, concat(w, ' commit') AS before),"
        " struct(md5(w) AS word, concat(v, ' ', w) AS before),"
        " struct(regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-') AS word,"
        " concat(w, ' uuid') AS before),"
        " struct(concat('user_profile_', w, '_', v, pmod(h, 100)) AS word, w AS before),"
        " struct(concat('https://example.com/', w, '/', v, '-document-', pmod(h, 99999)) AS word,"
        " w AS before),"
        " struct(concat(w, '-', v, '-version-', pmod(h, 20), '-', pmod(h, 9)) AS word, v AS before))"
    )
    rows = t.select("doc_id", F.explode(F.expr(made)).alias("m"), F.lit("").alias("after"))
    rows = rows.select(
        "doc_id", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("word_at"),
        F.col("m.word").alias("word"), F.col("m.before").alias("before"), "after",
        F.explode(F.expr(f"regexp_extract_all(m.word, '{RUN}', 0)")).alias("candidate"),
    )
    return rows.where("candidate RLIKE '[0-9]' AND candidate RLIKE '[A-Za-z]'")


def labelled_findings(docs: DataFrame, max_each: int, path: str | None = None) -> DataFrame:
    """Findings with label 1 (of a public format, or assigned to a name of a secret) and 0 (look
    alikes), at most ``max_each`` of either, chosen by hash."""
    found = with_features(candidates(docs, path))
    true = found.where(
        "format <> '' OR (f_secret_near = 1 AND f_assigned = 1 AND f_harmless_near = 0"
        " AND f_dictionary < 0.3)"
    )
    false = with_features(lookalikes(docs))
    pick = lambda d, y: (
        d.orderBy(F.xxhash64("candidate", "doc_id"), "candidate", "doc_id")
        .limit(max_each)
        .withColumn("label", F.lit(float(y)))
    )
    return pick(true, 1).unionByName(pick(false, 0))


def train(findings: DataFrame, trees: int = 30, depth: int = 6) -> PipelineModel | None:
    """A forest from labelled findings (``with_features`` and label); None unless both labels
    occur. ``f_format`` is no input: a format may be imitated, its features must agree."""
    inputs = [f for f in FEATURES if f != "f_format"]
    findings = findings.select("label", *inputs)
    if findings.select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=inputs, outputCol="_inputs")
    forest = RandomForestClassifier(
        featuresCol="_inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=11,
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    )
    # Written and read, the model is free of the training summary, which holds the session and may
    # not be sent to executors.
    path = scratch_path(findings.sparkSession, "forest")
    forest.fit(vector.transform(findings)).save(path)
    return PipelineModel([vector, RandomForestClassificationModel.load(path)])


def scan(
    docs: DataFrame, model: PipelineModel | None, path: str | None = None, cut: float = 0.5
) -> DataFrame:
    """Every candidate with the forest's score and verdict: doc_id, word_at, candidate, format,
    before, after, score, is_secret. Without a model the score is null and every candidate of a
    public format is a secret. Rows with a null doc_id are scanned like others."""
    found = with_features(candidates(docs, path))
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(found).withColumn("score", vector_to_array("_probability")[1])
    return scored.select(
        "doc_id", "word_at", "candidate", "format", "before", "after", "score",
        F.coalesce(F.col("score") >= cut, F.col("format") != "").alias("is_secret"),
    )
