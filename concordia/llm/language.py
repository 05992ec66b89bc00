"""Language identification by the nearest of several centroids per language.

Method: a text is a normalised TF-IDF vector of hashed character n-grams; per
language, spherical k-means gives ``CLUSTERS`` centroids; the language of the
centroid with the largest cosine is predicted, and a text farther from it than
nearly all texts that it was learned from is rejected.

The vectors are learned from a bounded sample, ``FIT_PER_LANGUAGE`` labelled
texts of each language by the hash of their id; each language is clustered in a
group of its own.  The model (languages x CLUSTERS x 2 ** BITS floats, 0.5 MB a
language) is what is broadcast.

Defined cases
* null text, or text without a letter: ``und`` with score 0;
* a null label is not learned from; a table without labels predicts ``und``;
* ties go to the first language in alphabetical order;
* texts are scored whole, whatever their length; repeated rows are scored alike;
  an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, held_out, learnable, least_hashed, table, texts
from concordia.llm.features import counts, has_letter, letters
from concordia.session import Scratch

FIT_PER_LANGUAGE = 1500
CLUSTERS = 4
ROUNDS = 8
LENGTHS = (1, 2, 3, 4)
BITS = 15
REJECT_QUANTILE = 0.995  # of the distances of learned texts
REJECT_MARGIN = 1.25
UNKNOWN = "und"


def vector(words: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of unit length."""
    at, n = counts(words, LENGTHS, BITS)
    w = (1 + np.log(n)) * idf[at]
    return at, (w / max(np.sqrt((w * w).sum()), 1e-12)).astype(np.float32)


def _sample(docs: DataFrame) -> DataFrame:
    """Labelled rows to learn from: the ids are chosen on narrow rows, and their
    bounded list meets the texts; of an id that is repeated one text."""
    ids = least_hashed(docs.where(learnable() & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id", "lang", FIT_PER_LANGUAGE)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    return (docs.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
            .groupBy("_id", "lang").agg(F.min("text").alias("text")).select("lang", "text"))


_BUCKETS = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for text in texts(b.column(0)):
            total[counts(letters(text), LENGTHS, BITS)[0]] += 1
            n += 1
    at = np.flatnonzero(total)
    yield emit(_BUCKETS, np.r_[-1, at], np.r_[n, total[at]])


def _centroids(idf: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = [vector(w, idf) for w in map(letters, sorted(x or "" for x in rows["text"])) if w]
        if not docs:
            return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "radius": []})
        near = np.full(len(docs), -1.0)
        centre = np.zeros((0, 1 << BITS), np.float32)
        while len(centre) < min(CLUSTERS, len(docs)) and near.min() < 1 - 1e-6:  # start from the farthest text
            at, w = docs[int(near.argmin())]
            new = np.zeros((1, 1 << BITS), np.float32)
            new[0, at] = w
            centre = np.concatenate([centre, new])
            near = np.maximum(near, [new[0, a] @ v for a, v in docs])
        for _ in range(ROUNDS):
            cosine = np.array([centre[:, a] @ v for a, v in docs])
            own = cosine.argmax(1)
            total = np.zeros_like(centre)
            for (a, v), c in zip(docs, own):
                total[c, a] += v
            length = np.sqrt((total * total).sum(1, keepdims=True))
            centre = np.where(length > 0, total / np.maximum(length, 1e-12), centre)
        cosine = np.array([centre[:, a] @ v for a, v in docs])
        own = cosine.argmax(1)
        distance = 1 - cosine.max(1)
        radius = [REJECT_MARGIN * float(np.quantile(distance[own == c], REJECT_QUANTILE)) if (own == c).any() else 0.0
                  for c in range(len(centre))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "cluster": range(len(centre)),
                             "centroid": [c.astype(np.float32).tobytes() for c in centre], "radius": radius})
    return run


def fit(docs: DataFrame, scratch: Scratch) -> tuple:
    """(languages, centroid matrix, radii, idf) from the labelled sample."""
    sample = scratch.cut(_sample(docs), "sample")
    df = (sample.select("text").mapInArrow(_document_counts, "bucket int, df long")
          .groupBy("bucket").agg(F.sum("df").alias("df")).toArrow())
    at, n = df["bucket"].to_numpy(), df["df"].to_numpy()
    rows = int(n[at < 0].sum())
    idf = np.full(1 << BITS, np.log(1 + rows))
    idf[at[at >= 0]] = np.log((1 + rows) / n[at >= 0])
    found = (sample.groupBy("lang").applyInPandas(_centroids(idf), "lang string, cluster int, centroid binary, radius double")
             .orderBy("lang", "cluster").collect())
    matrix = np.array([np.frombuffer(r["centroid"], np.float32) for r in found], np.float32).reshape(-1, 1 << BITS).T.copy()
    return [r["lang"] for r in found], matrix, np.array([r["radius"] for r in found]), idf


_FOUND = pa.struct([("nearest", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predict(model):
    def run(text: pa.Array) -> pa.Array:
        languages, matrix, radius, idf = model.value
        names, scores, far = [], [], []
        for t in texts(text):
            words = letters(t)
            name, cosine, no = UNKNOWN, 0.0, True
            if words and languages and has_letter(t):
                at, w = vector(words, idf)
                all_ = w @ matrix[at]
                best = int(all_.argmax())
                cosine = float(min(max(all_[best], 0.0), 1.0))
                name, no = languages[best], 1 - cosine > radius[best]
            names.append(name)
            scores.append(cosine)
            far.append(bool(no))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                           pa.array(far, pa.bool_())], fields=list(_FOUND))
    return run


def identify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All columns of ``docs`` and a struct ``language``: the nearest language,
    its cosine, and whether the text is too far from it (then it is ``und``
    for callers that want no guess)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, scratch))
    return docs.withColumn("language", F.arrow_udf(_predict(model), "nearest string, score double, rejected boolean")("text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    with Scratch(spark, "language") as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        return scratch.keep(identify(docs, scratch).select(
            "doc_id", held_out().alias("held_out"), F.col("language.nearest").alias("lang_pred"),
            "language.score", "language.rejected"))
