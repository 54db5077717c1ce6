"""A corpus pipeline of five stages, each one operator over all that the stage before it kept.

Stages add their verdicts under names that no column has and return the columns of documents as they came, so extra
columns pass through, whatever their names.  The last stage gives doc_id, token count and digests alone.  Rows without doc_id are documents like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.llm import bpe, decontaminate, jaccard, quality_fm, repetition
from tankline.llm.common import materialize, table


def _free(docs: DataFrame, name: str) -> str:
    """A name, or beginning of names, that no column of `docs` begins with."""
    while any(c.startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    own = _free(docs, "_rules_")
    return repetition.with_verdicts(docs, prefix=own).where(F.col(f"{own}kept")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine, fitted on the labelled ones among them, scores as good."""
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "_quality_score")
    return quality_fm.with_scores(docs, machine, score).where(F.col(score) >= quality_fm.KEEP_AT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike documents one row, that with the smallest doc_id.

    Where a doc_id is missing or stands in several rows, rows are known by a number of their own, drawn once into a table."""
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = jaccard.jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct()
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    row = _free(docs, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    groups = jaccard.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text")).withColumnRenamed("doc_id", row).join(numbered.select(row, "doc_id"), row)
    first = groups.groupBy("component_id").agg(F.min_by(row, F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", row)).alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item lies."""
    leaks = _free(docs, "_leaks")
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), leaks).where(F.size(leaks) == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]
#: Suffix arrays, trained models and edit distances have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
