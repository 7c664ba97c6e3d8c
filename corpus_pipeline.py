"""From raw documents to packed training sequences: one operator a stage.

Every stage takes (spark, docs, sf_dir) and judges all rows that the one before kept; ``run`` writes
each result to the shared folder and reads it again. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procscope.llm import catalog, line_align, mil, packing, prefix_join, wand
from procscope.session import materialize


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of ``docs``; null and
    empty texts are scored like others, and without labels everything stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = _fresh(docs, "quality_score")
    scored = mil.score(docs, mil.learn(docs, labels), name)
    return scored.where(F.col(name) >= catalog.QUALITY_CUT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has. A document of which nothing
    but white space is left goes; n_chars follows the text."""
    total, removed = _fresh(docs, "n_lines"), _fresh(docs, "n_removed")
    out = line_align.dedup_lines(docs, total=total, removed=removed)
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return prefix_join.one_of_each(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's question and answer."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = _fresh(docs, "leaks")
    marked = wand.mark_leaks(docs, items, name)
    return marked.where(F.size(name) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.best_fit(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: Trained scores and token ids have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
