"""A training corpus from raw documents: five stages, each an operator of ``millrace.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

Defined cases, in every stage: a null or empty text is a text of its own kind (scored as one without words, one empty line, no
shingles, not contaminated, the end token alone), and its document stays unless the classifier rejects it; a null doc_id
sorts after all others; rows that repeat an id are told apart by their text, and equal rows share their fate; an
empty table gives an empty one; columns that are not read are passed on under their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontaminate, line_dedup, near_dedup, packing, quality
from millrace.llm.common import Scratch, apart, table
from millrace.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.quality_scores(spark, docs, table(spark, sf_dir, "labels"))
    return _columns(scored.where("predicted = 1"), docs, quality.OWN)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents that had text and have no line with any left.

    ``n_chars``, where there is such a column, is counted anew."""
    out = line_dedup.dedup_lines(spark, docs)
    left = out.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(line_dedup.STRIP))) > 0))
    left = _columns(left, docs, line_dedup.OWN)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id."""
    found = near_dedup.near_duplicates(spark, docs, words=5, percent=80)
    return _without(docs, found.where("not kept").select("doc_id", F.col("text_hash").alias("tf")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages beyond the contract's share go."""
    found = decontaminate.contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select("doc_id", F.col("row.tf").alias("tf")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path())


def _columns(out: DataFrame, docs: DataFrame, own: list[str]) -> DataFrame:
    """The columns of ``docs`` under their own names, as an operator passed them on beside its ``own``."""
    return out.select(*[F.col(f"`{new}`").alias(c) for c, new in apart(docs.columns, own).items()])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select(F.col("doc_id").alias("__id"), F.col("tf").alias("__tf")).distinct()
    return docs.join(g, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tf")), "left_anti")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Learning, similarity and packing are beyond SQL; the tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.release()
    return docs
