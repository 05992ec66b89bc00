"""The corpus pipeline: documents that are fit to train on, packed to sequences.

``STAGES`` are applied in turn; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the docs of the next.  All but the
last return the columns of ``documents``; ``n_chars`` follows the text.

A stage judges all rows of its own input, so counts, bands and groups are those
of what the stages before it kept.  Rows without an id cannot be in a group and
pass the joins; rows without text fail the quality rules.  What a stage decides
per document is a narrow written table; the texts meet it in one join.  These
tables lie in the run's folder on shared storage until ``drop_run_folder``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm import decontamination, line_dedup, ngram_join, packing, quality
from concordia.llm.columns import table
from concordia.session import Scratch, cut_lineage, drop_path, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity band keep."""
    docs = _columns(docs)
    scored = cut_lineage(quality.measured(docs), "quality-scored")
    with Scratch(spark, "quality") as scratch:
        scores = scratch.keep(quality.word_scores(docs, scratch))
    return _columns(quality.judged(scored, scores).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; no document goes."""
    docs = _columns(docs)
    with Scratch(spark, "line-dedup") as scratch:
        lost = scratch.keep(line_dedup.dropped_lines(docs, scratch))
    return line_dedup.without_lines(docs, lost).select(
        "doc_id", F.when(F.col("text").isNotNull(), F.col("kept.text")).alias("text"), "lang", "source",
        F.when(F.col("kept.n_dropped") > 0, F.length("kept.text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    docs = _columns(docs)
    with Scratch(spark, "ngram-join") as scratch:
        join = ngram_join.NgramJoin(docs, scratch)
        repeated = join.repeated
        others = scratch.keep(join.result().where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct())
    kept = docs.join(ngram_join.broadcast_ids(others), F.col("doc_id") == F.col("_id"), "left_anti")
    if repeated:  # rows of one id and text are copies too
        copy = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
        kept = (kept.withColumn("_copy", F.row_number().over(copy))
                .where((F.col("_copy") == 1) | F.col("doc_id").isNull() | F.coalesce(F.trim("text") == "", F.lit(True))))
    return _columns(kept)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    docs = _columns(docs)
    with Scratch(spark, "decontamination") as scratch:
        found = decontamination.contaminations(docs, table(spark, sf_dir, "benchmark"), scratch)
        found = scratch.keep(found.select(F.col("key").alias("_key")).distinct())
    return docs.join(ngram_join.broadcast_ids(found), decontamination.document_key() == F.col("_key"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    with Scratch(spark, "packing") as scratch:
        return scratch.keep(packing.pack(_columns(docs), scratch))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None  # perplexity, tokens and the packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        docs = cut_lineage(stage(spark, docs, sf_dir), path=path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
