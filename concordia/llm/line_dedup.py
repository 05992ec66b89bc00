"""Line dedup: lines that many documents share are kept in one of them only.

Method: lines are exploded to the hash of their normalised key, distinct
documents are counted per hash, and lines whose hash reaches the threshold are
dropped wherever they stand, except in the document with the largest id that
holds them.  The rest is put together again by position.

Only (hash, doc_id) pairs are exploded and shuffled (24 bytes a line), distinct
per document before the shuffle; a line held by a third of all documents is
counted from partial counts and its join is one that adaptive execution can
split.  Texts are moved once, to meet the list of their own dropped hashes.

Defined cases
* null text counts as the empty text: one empty line, never dropped;
* a document that repeats a line loses all of its occurrences, or none;
* rows with the same ``doc_id`` count as one document, and each of these rows
  loses the same lines; a null ``doc_id`` neither counts nor loses lines;
* an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import WS, emit, table, texts
from concordia.session import Scratch

MIN_CHARS = 40      # shorter keys are never dropped
MIN_DOCUMENTS = 5   # documents that must hold a key

_PAIRS = pa.schema([("doc_id", pa.int64()), ("line", pa.binary())])
_KEPT = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128 bits of the line's key (white space stripped, A-Z lower-cased), or
    None where the key is too short to count."""
    key = line.strip(WS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _line_pairs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = [], []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                own = {line_hash(x, min_chars) for x in text.split("\n") if len(x) >= min_chars}
                own.discard(None)
                ids += [doc] * len(own)
                hashes += own
            yield emit(_PAIRS, ids, hashes)
    return run


def _without_lines(min_chars: int):
    def run(text: pa.Array, dropped: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for t, d in zip(texts(text), dropped):
            gone = set(d.as_py() or ())
            if gone:
                lines = t.split("\n")
                left = [x for x in lines if line_hash(x, min_chars) not in gone]
                n, t, lost = len(lines), "\n".join(left), len(lines) - len(left)
            else:
                n, lost = t.count("\n") + 1, 0
            kept.append(t)
            n_lines.append(n)
            n_dropped.append(lost)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            fields=list(_KEPT))
    return run


def dropped_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS,
                  min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, lines): the hashes that each document loses."""
    found = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    pairs = scratch.cut(found.mapInArrow(_line_pairs(min_chars), "doc_id long, line binary"), "pairs").distinct()
    shared = (pairs.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
              .where(F.col("n") >= min_documents))
    return (pairs.join(shared, "line").where("doc_id < keeper")
            .groupBy("doc_id").agg(F.collect_list("line").alias("lines")))


def dedup_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS,
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All columns of ``docs`` and a struct ``kept`` (text, n_lines, n_dropped)."""
    return without_lines(docs, dropped_lines(docs, scratch, min_chars, min_documents), min_chars)


def without_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The same, given what ``dropped_lines`` found."""
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("lines").alias("_lost")).hint("shuffle_hash")
    strip = F.arrow_udf(_without_lines(min_chars), "text string, n_lines long, n_dropped long")
    return (docs.join(lost, docs["doc_id"] == lost["_lost_id"], "left")
            .withColumn("kept", strip("text", "_lost")).drop("_lost_id", "_lost"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the deduplicated text of every document."""
    with Scratch(spark, "line-dedup") as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return scratch.keep(dedup_lines(docs, scratch).select(
            "doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256")))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
