"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes.

Method (Wang and Manning): a text is the set of its hashed character n-grams;
the log ratio of how often a bucket stands in toxic and in other texts scales
its feature; a logistic regression over the scaled features gives the score.

The ratios are counted over all labelled rows that may be learned from.  A
text's scaled features are brought to unit length, so long texts count like
short ones.  The regression is fitted on a bounded sample, ``FIT_PER_CLASS``
texts of each class by the hash of their id, in one task.  The broadcast model
is two floats for each of 2 ** BITS buckets (8 MB).

Defined cases
* null and empty texts are scored like any other: by the constant alone;
* several labels of one document: toxic if any says so; null labels are ignored;
* without toxic or without other labelled rows every score is the same constant;
* texts are scored whole, whatever their length; repeated rows are scored alike;
  an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, held_out, learnable, least_hashed, table, texts
from concordia.llm.features import Present, letters
from concordia.llm.ngram_join import broadcast_ids
from concordia.session import Scratch

LENGTHS = (3, 4, 5)
BITS = 20
SMOOTHING = 4.0         # texts by which a bucket's two rates are drawn to the mean rate
FIT_PER_CLASS = 2000
EPOCHS = 6
RATE = 2.0              # of the first epoch
CONSTANT_RATE = 0.1     # of the constant, as a part of the weights' rate
THRESHOLD = 0.7

_COUNTS = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    present = Present(LENGTHS, BITS)
    seen, rows = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for b in batches:
        for text, toxic in zip(texts(b.column(0)), b.column(1).to_pylist()):
            seen[toxic, present(letters(text))] += 1
            rows[toxic] += 1
    at = np.flatnonzero(seen.any(0))
    yield emit(_COUNTS, np.r_[-1, at], np.r_[rows[1], seen[1, at]], np.r_[rows[0], seen[0, at]])


def log_ratios(counts: pa.Table) -> tuple[np.ndarray, int, int]:
    """(log-count ratio of each bucket, toxic rows, other rows)."""
    at, toxic, other = (counts.column(k).to_numpy().astype(np.float64) for k in range(3))
    n, m = float(toxic[at < 0].sum()), float(other[at < 0].sum())
    ratio = np.zeros(1 << BITS, np.float32)
    if n and m:
        own = at >= 0
        at, toxic, other = at[own].astype(np.int64), toxic[own], other[own]
        ratio[at] = np.log((toxic + SMOOTHING * n / (n + m)) / n) - np.log((other + SMOOTHING * m / (n + m)) / m)
    return ratio, int(n), int(m)


def _regression(model):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ratio = model.value
        present = Present(LENGTHS, BITS)
        rows = rows.assign(text=rows["text"].fillna("")).sort_values(["order", "text"], kind="stable")
        sets = [present(letters(t)) for t in rows["text"]]
        toxic = rows["toxic"].to_numpy()
        weight, constant, step = np.zeros(1 << BITS, np.float32), 0.0, 0
        for _ in range(EPOCHS):
            for s, y in zip(sets, toxic):
                x = ratio[s]
                x /= max(np.sqrt(x @ x), 1e-6)
                z = constant + float(weight[s] @ x)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                rate = RATE / (1 + step / len(sets))
                weight[s] -= (rate * g * x).astype(np.float32)
                constant -= CONSTANT_RATE * rate * g
                step += 1
        at = np.flatnonzero(weight)
        return pd.DataFrame({"bucket": np.r_[-1, at], "weight": np.r_[constant, weight[at]]})
    return run


class Model(NamedTuple):
    ratio: np.ndarray   # log-count ratio of each bucket
    weight: np.ndarray  # of the scaled and normalised features
    constant: float

    def logit(self, present: np.ndarray) -> float:
        x = self.ratio[present]
        length = np.sqrt((x * x).sum(dtype=np.float64))
        return self.constant + float((self.weight[present] * x).sum(dtype=np.float64)) / max(length, 1e-6)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """The classifier, from the labelled documents that may be learned from."""
    known = scratch.cut(labels.where("doc_id is not null and toxic is not null").where(learnable())
                        .groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
                        .where("toxic in (0, 1)"), "known")
    train = docs.join(broadcast_ids(known), F.col("doc_id") == F.col("_id"))
    ratio, n, m = log_ratios(train.select("text", "toxic").mapInArrow(_class_counts, "bucket int, toxic long, other long")
                             .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow())
    weight = np.zeros(1 << BITS, np.float32)
    if not n or not m:
        return Model(ratio, weight, float(np.log((n + 0.5) / (m + 0.5))))
    some = (least_hashed(known, "_id", "toxic", FIT_PER_CLASS)
            .select("_id", "toxic", F.xxhash64("_id").alias("order"), F.lit(0).alias("task")))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    found = (docs.join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
             .groupBy("task", "order", "toxic", "_id").agg(F.min("text").alias("text"))  # one text of a repeated id
             .select("task", "order", "toxic", "text")
             .groupBy("task").applyInPandas(_regression(shared), "bucket int, weight double").toArrow())
    at, w = found["bucket"].to_numpy(), found["weight"].to_numpy()
    weight[at[at >= 0]] = w[at >= 0]
    return Model(ratio, weight, float(w[at < 0].sum()))


def _score(model):
    def run(text: pa.Array) -> pa.Array:
        known = model.value
        present = Present(LENGTHS, BITS)
        z = np.array([known.logit(present(letters(t))) for t in texts(text)])
        return pa.array(1 / (1 + np.exp(-z)), pa.float64())
    return run


def scored(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, between 0 and 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, scratch))
    return docs.withColumn("toxicity", F.arrow_udf(_score(model), "double")("text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    with Scratch(spark, "toxicity") as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
        return scratch.keep(scored(docs, labels, scratch).select(
            "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
            F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted")))
