"""Substring dedup: passages of ``LENGTH`` words or more that stand earlier in the
corpus are removed wherever they stand again.

A *window* is ``LENGTH`` consecutive words of one document.  A window that starts
earlier as well (smaller doc_id, or the same document and an earlier start) is
repeated, and every word that a repeated window covers is removed.

Method: seed and extend.
* Seeds: every window selects the anchor of least hash among its ``ANCHOR``-word
  grams (winnowing), so equal windows select equal anchors at equal places and
  the anchors, one for some seven words, find every repeat.
* Join: an anchor that stands once in the corpus is done.  The others are joined
  with the list of shared anchors; only these go on.
* Extend: the windows of one anchor are neighbours.  First an anchor is extended
  both ways over all its windows at once: where this whole run is known, every
  occurrence but the earliest is repeated.  The earliest of each different run
  is then extended to each single window: windows that agree are repeats, all
  but the earliest.  Neighbouring repeats together are the maximal repeats.

Extensions are compared by hash (of an anchor, of the words of a run or window):
two agree by chance with a probability of 2^-128 a pair, hence no texts are
joined with texts, and no pairs are made: every group is reduced to its first.
What is counted per anchor, run or window is counted from partial counts, so a
passage that a third of all documents share is one row a task.

Texts cross the network twice at most: to be extended window by window (only the
documents that need it, as long as their ids are few enough to be broadcast) and
to lose what was found.

Defined cases
* null or empty text: no words, an empty text is left;
* fewer words than a window: nothing is removed;
* rows with the same doc_id count as one document, each loses its own repeats;
  equal rows lose the same, as neither is earlier than the other;
* a null doc_id: the row is left as it is, and nothing is removed because of it;
* an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table
from concordia.session import Scratch

LENGTH = 20             # words of a window
ANCHOR = 8              # words of an anchor
BROADCAST_IDS = 1 << 20  # ids (8 bytes each) up to which they are broadcast

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Sums:
    """Hashes of stretches of a text, from sums of its words' hashes times
    powers of an odd number: equal for equal words, wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _STEP)])
            self.back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BACK)])
            self.sums = np.r_[np.uint64(0), np.add.accumulate(hashes * power[:n])]

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(sums: Sums, n: int, length: int = LENGTH, anchor: int = ANCHOR):
    """(hash of the anchor, first window, number of windows, hash of their run)
    of every anchor of a text of ``n`` words; every window has one anchor."""
    windows, width = n - length + 1, length - anchor + 1
    grams = sums(np.arange(n - anchor + 1), anchor)
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(windows)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, windows])
    run = sums(first, count + (length - 1)) + _mixed((at[first] - first + (count << 8)).astype(np.uint64))
    return grams[at[first]], first, count, run


_ANCHORS = pa.schema([("anchor", pa.int64())])
_RUNS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()),
                   ("start", pa.int32()), ("windows", pa.int32())])
_WINDOWS = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for doc, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
        yield doc, tag, (t.as_py() or b"").split()


def _seeds(length: int, with_place: bool):
    """The anchors of every text; or every anchor's run and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, tag, words in _rows(b):
                if len(words) < length:
                    continue
                hashes, first, count, runs = anchors(Sums(word_hashes(words)), len(words), length)
                n = len(first)
                found.append((hashes.astype(np.int64), runs.astype(np.int64), np.full(n, doc), np.full(n, tag), first, count)
                             if with_place else (hashes.astype(np.int64),))
            if found:
                yield emit(_RUNS if with_place else _ANCHORS, *map(np.concatenate, zip(*found)))
    return run


def _windows(length: int):
    """The single windows of the runs that a text is asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (doc, tag, words), wanted in zip(_rows(b), b.column(3)):
                anchor, start, count = (wanted.values.field(k).to_numpy() for k in range(3))
                at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                yield emit(_WINDOWS, np.repeat(anchor, count), Sums(word_hashes(words))(at, length).astype(np.int64),
                           np.full(len(at), doc), np.full(len(at), tag), at)
    return run


_KEPT = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_KEPT_DDL = "text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>"


def maximal(start: np.ndarray, windows: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered words, starts, ends) of the maximal repeats of a text of n words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + (length - 1), -1)
    covered = np.cumsum(edge)[:n] > 0
    change = np.diff(np.r_[False, covered, False].astype(np.int8))
    return covered, np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _without_repeats(length: int):
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(text.cast(pa.binary()), spans):
            words = (t.as_py() or b"").split()
            n, at = len(words), []
            if s.is_valid:
                covered, starts, ends = maximal(*(s.values.field(k).to_numpy() for k in range(2)), n, length)
                words = [w for w, gone in zip(words, covered) if not gone]
                at = [{"start": int(a), "end": int(z)} for a, z in zip(starts, ends)]
            rows.append((b" ".join(words).decode(), n, n - len(words), at))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _KEPT)],
                                          fields=list(_KEPT))
    return run


class SubstringDedup:
    """The search over one table; its steps are written tables of ``scratch``."""

    def __init__(self, docs: DataFrame, scratch: Scratch, length: int = LENGTH):
        self.docs, self.scratch, self.length = docs, scratch, length
        ids = docs.where("doc_id is not null").groupBy("doc_id").count()
        #: where an id has several rows, their texts are told apart by a hash
        self.tagged = bool(ids.where("count > 1").take(1))
        self.tag = F.xxhash64("text") if self.tagged else F.lit(0).cast("long")
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), self.tag.alias("tag"), "text")
        self.rows = rows.dropDuplicates(["doc", "tag"]) if self.tagged else rows

    def hits(self) -> DataFrame:
        """The runs of all anchors that stand more than once."""
        shared = self.scratch.cut(self.rows.mapInArrow(_seeds(self.length, False), "anchor long").groupBy("anchor").count()
                                  .where("count > 1").select("anchor"), "shared")
        places = self.rows.mapInArrow(_seeds(self.length, True),
                                      "anchor long, run long, doc long, tag long, start int, windows int")
        return self.scratch.cut(places.join(shared, "anchor"), "hits")

    def single_windows(self, runs: DataFrame) -> DataFrame:
        """The windows of these runs, one by one, each with its hash."""
        asked = self.scratch.cut(runs.groupBy("doc", "tag").agg(  # of one text
            F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted")), "asked")
        ids, rows = asked.select(F.col("doc").alias("_doc")).distinct(), self.rows
        if ids.count() <= BROADCAST_IDS:
            rows = rows.join(F.broadcast(ids), F.col("doc") == F.col("_doc"), "left_semi")
        return self.scratch.cut(rows.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(
            _windows(self.length), "anchor long, window long, doc long, tag long, start int"), "windows")

    def repeats(self) -> DataFrame:
        """(doc, tag, spans): of every text that repeats what is earlier, the
        runs of repeated windows (start, windows)."""
        place, hits = F.struct("doc", "start"), self.hits()
        runs = self.scratch.cut(hits.groupBy("anchor", "run").agg(
            F.min(place).alias("first"), F.min_by(F.struct("tag", "windows"), place).alias("of"), F.count("*").alias("n")), "runs")
        again = (hits.join(runs.where("n > 1").select("anchor", "run", "first"), ["anchor", "run"])
                 .where(place > F.col("first")).select("doc", "tag", "start", "windows"))
        various = runs.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
        windows = self.single_windows(runs.join(various, "anchor").select("anchor", "first.doc", "of.tag", "first.start", "of.windows"))
        earliest = windows.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        single = (windows.join(earliest.select("anchor", "window", "first"), ["anchor", "window"])
                  .where(place > F.col("first")).select("doc", "tag", "start", F.lit(1).alias("windows")))
        return self.scratch.cut(again.union(single).groupBy("doc", "tag").agg(
            F.collect_list(F.struct("start", "windows")).alias("spans")), "repeats")

    def result(self) -> DataFrame:
        """All columns of the table and a struct ``kept``: the text that is left,
        its words before, how many went, and the maximal repeats (word numbers)."""
        lost = self.repeats().select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
        same = (F.col("doc_id") == F.col("_doc")) & ((self.tag == F.col("_tag")) if self.tagged else F.lit(True))
        strip = F.arrow_udf(_without_repeats(self.length), _KEPT_DDL)
        return self.docs.join(lost, same, "left").withColumn("kept", strip("text", "_spans")).drop("_doc", "_tag", "_spans")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what is left of every document."""
    with Scratch(spark, "substring-dedup") as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return scratch.keep(SubstringDedup(docs, scratch).result().select(
            "doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256")))


SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), windows AS (
  SELECT doc_id, row, pos, string_agg(word, ' ') OVER w AS content, count(*) OVER w AS n
  FROM placed WINDOW w AS (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)
), judged AS (
  SELECT row, pos, doc_id IS NOT NULL AND (doc_id, pos) > first_value((doc_id, pos)) OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, pos) AS repeated
  FROM windows WHERE n = {LENGTH}
), covered AS (
  SELECT p.*, coalesce(max(CASE WHEN repeated THEN p.pos END)
                OVER (PARTITION BY p.row ORDER BY p.pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM placed p LEFT JOIN judged j ON j.row = p.row AND j.pos = p.pos
), counted AS (
  SELECT row, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY row
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counted USING (row)
"""
