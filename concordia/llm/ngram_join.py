"""N-gram Jaccard join: documents whose 5-word shingle sets have a Jaccard
similarity of 0.8 or more, and the groups that such links form.

Method: the document by n-gram incidence matrix times its transpose, in blocks
of n-gram columns, as joins on the column key.  With columns in one global
order, a pair that reaches the threshold shares a column among the first
``n - ceil(0.8 n) + 1`` of either document (size-derived bound), so only these
*head* columns are multiplied.  Overlap counts are accumulated per pair over
the head columns, and a pair goes when even a full overlap of everything behind
the heads could not reach the least overlap that its two sizes ask for.  The
few pairs left are told apart by wide sketches (below) and then compared exactly,
from their whole texts.

What keeps it whole and bounded under skew
* documents with equal shingle sets are one class, found by a 64-bit signature
  of the sorted set; only classes are joined;
* the global order puts *common* columns last.  They come from counts per slice
  of ``SLICE`` shingles, summed by Spark, and there are at most ``MAX_COMMON`` of
  them by construction (a column is common from ``shingles / MAX_COMMON``
  documents on), which bounds the broadcast.  Any order gives the same links;
  this one keeps shared passages out of the heads;
* a column of up to ``SMALL`` classes gives all its pairs (28 at most); a larger
  one links every class to its smallest class first, which is as many pairs as
  it has rows.  What is then one component needs no further pair; only classes
  that are outside their column's main component are multiplied with the rest.
  Where that would be many pairs, they first meet ``HUBS`` classes of their column,
  then 4 times as many, and what is found joins its component before the next round.
  So a large group of near copies costs pairs in proportion to its size, and no
  link between different components is left out;
* columns of the same classes count as one, and the join itself keeps the pairs
  only whose sizes, places of the column in either order, and *odd sketches* can
  belong to linked sets.  A sketch has ``SKETCH`` bits, of which every shingle
  flips one: two sketches differ in at most as many bits as the sets have
  shingles that are not shared, and linked sets have at most (n + m) / 9 of these.
  So many copies that are alike, but not alike enough, give next to no pairs
  (up to some 1,500 shingles a text, where sketches fill up).

Defined cases
* null or empty text, or no word: an empty set, linked with nothing, its own component;
* fewer than five words: the whole word sequence is the only shingle;
* repeated rows get the same component; a null ``doc_id`` is never linked and
  has a null component;
* an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table
from concordia.llm.graphs import components
from concordia.session import Scratch

WORDS = 5
PERCENT = 80            # least Jaccard similarity, in percent
SMALL = 8               # classes of a column that are paired at once
SLICE = 1 << 23         # shingles that are counted together
LOCAL = 3               # documents of a slice from which a column is reported
MAX_COMMON = 1 << 22    # most columns that can count as common
LEAST_COMMON = 16       # documents that a common column has at least
SKETCH = 1024           # bits of an odd sketch
WIDE = 16384            # bits of the sketches that pairs are told apart by before their texts are read
HUBS = 16               # classes of a column that those outside its main component meet first, then 4 times as many
CROWDED = 4             # how many times the pairs of such a round all pairs must be for it to come before them
BROADCAST_IDS = 1 << 20  # ids (8 bytes each) up to which a side is broadcast

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    m = len(h) - width + 1
    x = h[:m] + np.uint64(width)
    for k in range(1, width):
        x = (x ^ (x >> np.uint64(29))) * _MIX + h[k:k + m]
    x ^= x >> np.uint64(32)
    x *= _MIX
    return np.unique(x ^ (x >> np.uint64(29)))


def signature(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def least_share(n):
    """Shingles of a set of ``n`` that a linked set must share at least."""
    return -(-n * PERCENT // 100)


def head_size(n):
    return n - least_share(n) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


_BITS = [f"s{k}" for k in range(SKETCH // 64)]
_SETS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "sig", "col", "df", *_BITS)])


def sketch(found: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Which of the sketch's bits an odd number of shingles flips, as bytes."""
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and a row per column that a slice of documents
    shares (copies within a task counting once)."""
    seen: set[int] = set()
    parts: list[np.ndarray] = []
    size = 0

    def shared() -> pa.RecordBatch:
        nonlocal size
        col = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        first = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]) if len(col) else np.empty(0, np.int64)
        df = np.diff(np.r_[first, len(col)])
        keep = df >= LOCAL
        parts.clear()
        seen.clear()
        size = 0
        none = pa.nulls(int(keep.sum()), pa.int64())
        return emit(_SETS, none, none, none, col[first][keep].astype(np.int64), df[keep], *[none] * len(_BITS))

    for b in batches:
        n, sig, bits = [], [], np.empty((len(b), len(_BITS)), np.int64)
        for text in b.column(1).cast(pa.binary()):
            found = shingles(text.as_py() or b"")
            n.append(len(found))
            sig.append(signature(found))
            bits[len(n) - 1] = sketch(found).view(np.int64)
            if len(found) and sig[-1] not in seen:
                seen.add(sig[-1])
                parts.append(found)
                size += len(found)
                if size >= SLICE:
                    yield shared()
        none = pa.nulls(len(n), pa.int64())
        yield emit(_SETS, b.column(0), n, sig, none, none, *bits.T)
    yield shared()


_HEADS = pa.schema([("col", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _heads(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = common.value
        seen: set[int] = set()
        for b in batches:
            cols, sigs, sizes, lengths = [], [], [], []
            for text in b.column(0).cast(pa.binary()):
                found = shingles(text.as_py() or b"")
                sig = signature(found) if len(found) else None
                if sig is None or sig in seen:  # a copy in the same task has the same head
                    continue
                if len(seen) < SLICE:
                    seen.add(sig)
                k = head_size(len(found))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    late = keys[at] == found
                    if late.any():
                        order = np.argsort(rank[at[late]], kind="stable")
                        found = np.concatenate([found[~late], found[late][order]])
                cols.append(found[:k])
                sigs.append(sig)
                sizes.append(k)
                lengths.append(len(found))
            if cols:
                yield emit(_HEADS, np.concatenate(cols).astype(np.int64), np.repeat(np.array(sigs, np.int64), sizes),
                           np.repeat(lengths, sizes), np.concatenate([np.arange(1, k + 1) for k in sizes]))
    return run


def common_columns(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted column hashes, their place among common columns): at most
    ``MAX_COMMON`` of them, as each stands in shingles / MAX_COMMON documents."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COMMON, -(-total // MAX_COMMON))
    found = (sets.where("df is not null").groupBy("col").agg(F.sum("df").alias("df"))
             .where(F.col("df") >= least).toArrow())
    col = found["col"].to_numpy().astype(np.uint64)
    df = found["df"].to_numpy()
    order = np.argsort(col)
    rank = np.empty(len(col), np.int32)
    rank[np.lexsort((col, df))] = np.arange(len(col), dtype=np.int32)
    return col[order], rank[order]


def broadcast_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table) with a broadcast hint if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    out, last, left = [], None, np.empty(0, np.uint64)
    for x, y in zip(a.cast(pa.binary()), b.cast(pa.binary())):
        x = x.as_py()
        if x != last:
            last, left = x, shingles(x)
        out.append(linked(left, shingles(y.as_py())))
    return pa.array(out, pa.bool_())


def _wide(text: pa.Array) -> pa.Array:
    return pa.array([sketch(shingles(t.as_py() or b""), WIDE).view(np.int64) for t in text.cast(pa.binary())], pa.list_(pa.int64()))


def _differ(a: Column, b: Column) -> Column:
    """How many bits of two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)


def _signatures(text: pa.Array) -> pa.Array:
    return pa.array([signature(shingles(t.as_py() or b"")) for t in text.cast(pa.binary())], pa.int64())


def _may_link(n: Column, m: Column, at_n: Column, at_m: Column) -> Column:
    """Whether sets of sizes n and m can be linked and have the first column that
    they share at these positions (from 1) of their order: linked sets share ``least``
    columns, so at most ``n - least`` columns of a set come before the first of them."""
    least = F.ceil(PERCENT * (n + m) / F.lit(100.0 + PERCENT) - 1e-6)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (at_n <= n - least + 1) & (at_m <= m - least + 1)


class NgramJoin:
    """The join over one table; its steps are written tables of ``scratch``."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")
        rows = self.docs.mapInArrow(_sets, ", ".join(f"{f.name} long" for f in _SETS))
        sets = scratch.cut(rows, "sets")
        self.sets = sets.where("n is not null").select("doc_id", "n", "sig")
        self.classes = scratch.cut(sets.where("doc_id is not null and n > 0")
                                   .groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                                       *(F.max(c).alias(c) for c in _BITS)), "classes")
        self.common = docs.sparkSession.sparkContext.broadcast(common_columns(sets))

    def shared_columns(self) -> DataFrame:
        """(col, sig, n, pos, lo, lo_n, rows): the head columns of more than
        one class; lo is the column's smallest class."""
        heads = self.scratch.cut(self.docs.where("doc_id is not null").select("text")
                                 .mapInArrow(_heads(self.common), "col long, sig long, n int, pos int"), "heads")
        least = F.min(F.struct("sig", "n"))
        more = (heads.groupBy("col").agg(F.count("*").alias("rows"), least.alias("least"), F.max("sig").alias("hi"))
                .where("least.sig < hi").select("col", "rows", F.col("least.sig").alias("lo"), F.col("least.n").alias("lo_n")))
        shared = self.scratch.cut(heads.join(more, "col").distinct(), "shared")
        self.scratch.drop("heads")
        return shared

    def one_column_a_set(self, large: DataFrame) -> DataFrame:
        """Columns of the same classes (the words of one passage) as one column,
        with the least position that each class has among them: they give the same
        pairs.  Which are the same is told by the number of classes and 128 bits."""
        sets = large.groupBy("col").agg(F.count("*").alias("_rows"), F.bit_xor(F.xxhash64("sig")).alias("_h"),
                                        F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("_g"))
        kind = ["_rows", "_h", "_g"]
        sets = self.scratch.cut(sets, "column-sets")
        of = sets.join(sets.groupBy(*kind).agg(F.min("col").alias("_col")), kind).select("col", "_col")
        return (large.join(of, "col").groupBy(F.col("_col").alias("col"), "sig", "n", "lo")
                .agg(F.min("pos").alias("pos")).select("col", "sig", "n", "pos", "lo"))

    def unlinked_pairs(self, outside: DataFrame, inside: DataFrame, again: bool = False) -> DataFrame:
        """(a, b) of different components that share a column, as far as sizes,
        positions and sketches let them be linked; both sides are (col, sig, n,
        pos, root, before).  Where the column before is the same too, the pair has
        been made there, unless not all rows of a column are on a side (``again``)."""
        bits = self.classes.select("sig", *_BITS)

        def described(rows, side):
            columns = ("col", "sig", "root", "n", "pos", "before", *_BITS)
            return rows.join(bits, "sig").select(*(F.col(c).alias(f"{side}_{c}") for c in columns))
        differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _BITS), F.lit(0))
        n, m = F.col("x_n"), F.col("y_n")
        return (described(outside, "x").join(described(inside, "y"), (F.col("x_col") == F.col("y_col"))
                                             & (F.col("x_root") != F.col("y_root"))
                                             & (F.lit(again) | (F.col("x_before") != F.col("y_before")))
                                             & _may_link(n, m, F.col("x_pos"), F.col("y_pos"))
                                             & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)))
                .select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct())

    @staticmethod
    def bounded(pairs: DataFrame) -> DataFrame:
        """Drop the pairs (a, b, na, nb, overlap) that their sizes rule out; overlap
        is an upper bound of the overlap of the two heads."""
        na, nb = F.col("na"), F.col("nb")
        behind = F.greatest(*(F.floor(n * PERCENT / F.lit(100.0) + 0.999) - 1 for n in (na, nb)))
        return pairs.where((100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb))
                           & ((100 + PERCENT) * (F.col("overlap") + behind) >= PERCENT * (na + nb))).select("a", "b")

    def verified(self, pairs: DataFrame, step: str) -> DataFrame:
        """The pairs whose whole texts are linked."""
        pairs = self.scratch.cut(pairs, f"pairs-{step}")
        wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("sig")
        ids = self.scratch.cut(self.classes.join(wanted, "sig").select("sig", "n", F.col("doc_id").alias("_id")), f"ids-{step}")
        whole = self.docs.join(broadcast_ids(ids), F.col("doc_id") == F.col("_id")).select("sig", "n", "text")
        if self.repeated:  # an id may stand for several texts
            whole = (whole.where(F.arrow_udf(_signatures, "long")("text") == F.col("sig"))
                     .groupBy("sig", "n").agg(F.min("text").alias("text")))
        whole = self.scratch.cut(whole.withColumn("bits", F.arrow_udf(_wide, "array<bigint>")("text")), f"texts-{step}")
        brief, full = whole.select("sig", "n", "bits"), whole.select("sig", "text")
        near = (100 + PERCENT) * _differ(F.col("xa"), F.col("xb")) <= (100 - PERCENT) * (F.col("na") + F.col("nb"))
        close = (pairs.join(brief.toDF("a", "na", "xa"), "a")
                 .join(brief.toDF("sig", "nb", "xb"), (F.col("b") == F.col("sig")) & near))
        close = self.scratch.cut(close.select("a", "b"), f"close-{step}")
        both = close.join(full.toDF("a", "ta"), "a").join(full.toDF("b", "tb"), "b")
        links = self.scratch.cut(both.where(F.arrow_udf(_same, "boolean")("ta", "tb")).select("a", "b"), f"links-{step}")
        self.scratch.drop(*(f"{t}-{step}" for t in ("pairs", "ids", "texts", "close")))
        return links

    @property
    def repeated(self) -> bool:
        if not hasattr(self, "_repeated"):
            self._repeated = bool(self.sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
        return self._repeated

    def links(self) -> DataFrame:
        """(a, b): classes that are linked, enough of them for all components."""
        shared = self.shared_columns()
        small, large = shared.where(F.col("rows") <= SMALL), shared.where(F.col("rows") > SMALL)
        near = (small.select("col", F.col("sig").alias("a"), F.col("n").alias("na"))
                .join(small.select("col", F.col("sig").alias("b"), F.col("n").alias("nb")), "col")
                .where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("overlap")))
        to_first = (large.where("sig > lo").groupBy(F.col("lo").alias("a"), F.col("sig").alias("b"), F.col("lo_n").alias("na"),
                                                    F.col("n").alias("nb")).agg(F.lit(0).cast("long").alias("overlap")))
        busy = large.groupBy("sig").agg(F.count("*").alias("busy"))
        pairs = (near.union(to_first).groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
                 .join(busy.toDF("a", "busy_a"), "a", "left").join(busy.toDF("b", "busy_b"), "b", "left")
                 .select("a", "b", "na", "nb", (F.col("overlap") + F.least(F.coalesce("busy_a", F.lit(0)),
                                                                           F.coalesce("busy_b", F.lit(0)))).alias("overlap")))
        found = self.verified(self.bounded(pairs), "first")
        large = self.scratch.cut(self.one_column_a_set(large), "large")
        self.scratch.drop("shared")
        outside, inside = self.sides(large, components(found, self.scratch), 0)
        hubs, step = HUBS, 0
        while self.crowded(outside, inside, hubs):
            step += 1
            more = self.verified(self.unlinked_pairs(outside, self.hubs(inside, hubs, step), again=True), f"round-{step}")
            if not more.take(1):
                break
            found = self.scratch.cut(found.union(more), "found")
            outside, inside = self.sides(large, components(found, self.scratch), step)
            hubs *= 4
        return found.union(self.verified(self.unlinked_pairs(outside, inside), "cross"))

    def sides(self, large: DataFrame, comp: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
        """The rows of ``large`` that are outside their column's main component, and all rows of their columns."""
        in_order = Window.partitionBy("sig").orderBy("pos", "col")  # the columns of one text
        rows = (large.join(comp.toDF("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
                .withColumn("before", F.coalesce(F.lag("col").over(in_order), F.col("sig"))))
        rows = self.scratch.cut(rows, f"rooted-{step}")
        main = rows.where("sig = lo").select("col", F.col("root").alias("main"))
        columns = ["col", "sig", "n", "pos", "root", "before"]
        outside = self.scratch.cut(rows.join(main, "col").where("root <> main").select(*columns), f"outside-{step}")
        inside = rows.join(outside.select("col").distinct(), "col", "left_semi").select(*columns)
        return outside, self.scratch.cut(inside, f"inside-{step}")

    @staticmethod
    def crowded(outside: DataFrame, inside: DataFrame, hubs: int) -> bool:
        """Whether all pairs of the columns are many more than those with ``hubs`` classes of each."""
        counts = (outside.groupBy("col").agg(F.count("*").cast("double").alias("o"))
                  .join(inside.groupBy("col").agg(F.count("*").cast("double").alias("i")), "col"))
        pairs, rows = counts.agg(F.sum(F.col("o") * F.col("i")), F.sum("o")).first()
        return (pairs or 0) > CROWDED * hubs * (rows or 0)

    @staticmethod
    def hubs(inside: DataFrame, hubs: int, step: int) -> DataFrame:
        """``hubs`` classes of each column, others in each round: those of least hash,
        which are the same ones in columns of the same group."""
        least = Window.partitionBy("col").orderBy(F.xxhash64("sig", F.lit(step)), "sig")
        return inside.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= hubs).drop("_r")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), one row per row of the table."""
        comp = components(self.links(), self.scratch).toDF("sig", "root")
        classes = self.classes.join(comp, "sig", "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
        groups = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of = classes.join(groups, "root").select("sig", "component_id")
        none = F.col("n") == 0
        return (self.sets.join(of, "sig", "left")
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(none | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its component."""
    with Scratch(spark, "ngram-join") as scratch:
        return scratch.keep(NgramJoin(table(spark, sf_dir, "documents"), scratch).result())
