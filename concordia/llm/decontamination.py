"""Benchmark decontamination by template canonicalisation.

Method: numbers, names and units of a text become typed placeholders, and
windows of ``WIDTH`` template tokens are hash-joined between documents and
benchmark items.  Matched windows that lie on one diagonal (document position
minus item position) must fill their slots consistently: an item's value goes to
one value of the document, and back.  So a question asked anew with other
numbers or names is caught, and one that only has the same form in places is not.

An item is found in a document if consistent windows cover at least ``SHARE`` of
its windows, or ``LONG_RUN`` of them (a passage of over 50 words of a long item).

What keeps it bounded: documents are read once, and a filter of fixed size (a
bit per benchmark window, set by Spark, 16 MB at most) thins their windows in
the task that makes them; what passes meets the benchmark in a Spark join on the
window hash, with the benchmark's side repeated ``SALTS`` times so that a passage
in a third of all documents is spread over tasks.  A group of the later steps
never has more than the windows of one item.

Template tokens: words between white space without the punctuation around them,
lower-cased.  A number has a digit first (``5``, ``3.5``, ``12kg``) or is a
number word; a unit follows a number; a name starts with a capital and does not
open a sentence.  A window with more placeholders than half of it is evidence
only word for word: its hash is that of the values, and its slots say nothing of
other windows.  An item is found by ``SHARE`` of all windows, or of those with
fewer placeholders.  A character of a script without spaces is a word.

Defined cases
* null or empty text: nothing found; an item of fewer than ``WIDTH`` template
  tokens is one window; one of fewer than ``LEAST`` is found where its very words
  are a whole line or sentence (a word or two stand in any text otherwise);
* rows with the same ``doc_id`` count as one document; a row without an id is
  known by its text;
* benchmark rows without an id are not searched, repeated ones count once;
* an empty table on either side finds nothing; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table, texts
from concordia.llm.word_model import SPACELESS
from concordia.session import Scratch

WIDTH = 8
LEAST = 5
SHARE = 0.5
LONG_RUN = 43
SALTS = 16
FILTER_BITS = 20, 27     # least and most, as powers of two
REMEMBERED = 400_000     # words of a task

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&`~_-“”‘’«»¿¡…"
# Number words and units.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen
    fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty
    ninety hundred thousand million billion dozen half""".split())
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram
    kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons s sec second
    seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent
    cents euro euros percent degree degrees meter meters metre metres kilometer kilometers""".split())

_CAPITAL, _ENDS, _NUMBER, _UNIT, _EMPTY = (np.uint64(1 << k) for k in range(5))
_FLAGS = np.uint64(31)
_KINDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # number, name, unit
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EXACT = np.uint64(0x27D4EB2F165667C5)  # apart from the hashes of templates
_SENTENCE = re.compile(r"[\n\r]+|(?<=[.!?:])[\s\"')\]”»]+|(?<=[。！？])")
_NUMBER_FORM = re.compile(r"[0-9]")


def spaced(text: str) -> str:
    """The text with spaces around the characters of scripts without them."""
    return text if text.isascii() else SPACELESS.sub(r" \g<0> ", text)


_WORD = re.compile(r"\S+")


def core(word: str) -> str:
    return word.strip(PUNCTUATION)


class _Words(dict):
    """word -> hash of its core, with flags in the low bits."""

    def __missing__(self, word: str) -> int:
        own = core(word)
        low = own.lower()
        flags = (bool(own) and own[0].isupper()) * 1 | (word.rstrip("\"')]”»")[-1:] in (".", "!", "?", ":")) * 2
        flags |= (bool(_NUMBER_FORM.match(low)) or low in NUMBER_WORDS) * 4 | (low in UNITS) * 8 | (not own) * 16
        code = xxhash.xxh3_64_intdigest(low) & ~31 | flags
        if len(self) < REMEMBERED:
            self[word] = code
        return code


def _window_hashes(code: np.ndarray, at: np.ndarray, width: int, seed: np.uint64) -> np.ndarray:
    x = code[at] + seed
    for k in range(1, width):
        x = (x ^ (x >> np.uint64(29))) * _MIX + code[at + k]
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def short_units(text: str) -> Iterator[tuple[int, int, int]]:
    """(place, tokens, hash) of the lines and sentences of fewer than ``LEAST`` tokens, and of the lines."""
    place = 0
    for line in text.splitlines():
        parts = [line, *_SENTENCE.split(line)] if _SENTENCE.search(line) else [line]
        for part in parts:
            words = (core(x[0]).lower() for x in _WORD.finditer(spaced(part)))
            own = list(islice((w for w in words if w), LEAST))  # more than a few words are no short item
            if 0 < len(own) < LEAST:
                yield place, len(own), xxhash.xxh3_64_intdigest(" ".join(own), seed=len(own))
            place += 1


class Template:
    """The template tokens of a text and its windows."""

    def __init__(self, text: str, words: _Words):
        self.words = spaced(text).split()
        code = np.fromiter(map(words.__getitem__, self.words), np.uint64, len(self.words))
        self.at = np.flatnonzero((code & _EMPTY) == 0)
        code = code[self.at]
        opens = np.r_[True, (code[:-1] & _ENDS) != 0] if len(code) else np.empty(0, bool)
        number = (code & _NUMBER) != 0
        unit = ((code & _UNIT) != 0) & np.r_[False, number[:-1]][:len(code)]
        name = ((code & _CAPITAL) != 0) & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.kind = np.where(number, 0, np.where(name, 1, 2))
        self.exact = code & ~_FLAGS
        self.code = np.where(self.slot, np.array(_KINDS, np.uint64)[self.kind], self.exact)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, whether they are for the very words) of the windows."""
        m = len(self.code) - width + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        slots = np.r_[0, np.cumsum(self.slot)]
        heavy = 2 * (slots[width:] - slots[:m]) > width
        at = np.arange(m)
        x = _window_hashes(self.code, at, width, np.uint64(width))
        if heavy.any():
            x[heavy] = _window_hashes(self.exact, at[heavy], width, np.uint64(width) ^ _EXACT)
        return at, x, heavy

    def values(self, at: int, width: int) -> list[str]:
        """What fills the slots of a window, with its kind."""
        return [f"{self.kind[k]}:{core(self.words[self.at[k]]).lower()}"
                for k in range(at, at + width) if self.slot[k]]


def window_width(tokens: int) -> int:
    """The width of an item's windows; under ``LEAST`` it is searched whole."""
    return min(tokens, WIDTH)


_ITEMS = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()),
                    ("slots", pa.list_(pa.string())), ("heavy", pa.bool_()), ("n", pa.int32()),
                    ("light", pa.int32()), ("width", pa.int32())])
_HITS = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        rows = []
        for item, item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
            t = Template(text, words)
            width = window_width(len(t.code))
            if width >= LEAST:
                at, hashes, heavy = t.windows(width)
                rows += [(item, item_id, p, h, t.values(p, width), x, len(at), len(at) - int(heavy.sum()), width)
                         for p, h, x in zip(at.tolist(), hashes.astype(np.int64).tolist(), heavy.tolist())]
            elif width:
                own = [w for w in (core(x).lower() for x in t.words) if w]
                h = np.uint64(xxhash.xxh3_64_intdigest(" ".join(own), seed=len(own))).astype(np.int64)
                rows.append((item, item_id, 0, int(h), [], True, 1, 0, width))
        yield emit(_ITEMS, *(zip(*rows) if rows else [[]] * 9))


def _document_hits(filter_, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = filter_.value, _Words()
        mask = np.uint64(64 * len(bits) - 1)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                t = Template(text, words)
                for width in widths:
                    if width < LEAST:
                        continue
                    at, hashes, _ = t.windows(width)
                    bit = hashes & mask
                    hit = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
                    rows += [(key, p, h, t.values(p, width))
                             for p, h in zip(at[hit].tolist(), hashes[hit].astype(np.int64).tolist())]
                if widths and widths[0] < LEAST:
                    units = [(p, h) for p, tokens, h in short_units(text) if tokens in widths]
                    hashes = np.array([h for _, h in units], np.uint64)
                    bit = hashes & mask
                    hit = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
                    rows += [(key, units[k][0], int(hashes[k].astype(np.int64)), []) for k in np.flatnonzero(hit)]
            yield emit(_HITS, *(zip(*rows) if rows else [[]] * 4))
    return run


def _filter(items: DataFrame) -> np.ndarray:
    """A bit per window hash, as 64-bit words; at most 2 ** 27 bits whatever the
    size of the benchmark (a fuller filter thins less, and loses nothing)."""
    least, most = FILTER_BITS
    bits = min(most, max(least, int(64 * items.count() + 1).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = (items.select(F.shiftright(place, 6).alias("word"),
                          F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
    return out


def document_key() -> Column:
    """What a document is known by: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("text"), F.col("text")))


def contaminations(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, item_id, n_windows, n_matched, reparameterised) of every document
    and benchmark item found in it."""
    spark = docs.sparkSession
    rows = (benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
            .select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"]))
    items = scratch.cut(rows.mapInArrow(
        _item_windows, "item long, item_id long, pos int, hash long, slots array<string>, heavy boolean, "
        "n int, light int, width int"), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # WIDTH at most
    hits = docs.select(document_key().alias("key"), "text").mapInArrow(
        _document_hits(spark.sparkContext.broadcast(_filter(items)), widths),
        "key long, pos int, hash long, slots array<string>")
    hits = scratch.cut(hits, "hits").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = (hits.alias("d").join(salted.alias("i"), ["hash", "salt"])
             .select("key", "item", "item_id", "n", "light", "heavy", F.col("i.pos").alias("pos"),
                     (F.col("d.pos") - F.col("i.pos")).alias("diagonal"),
                     F.arrays_zip(F.col("i.slots").alias("own"), F.col("d.slots").alias("its")).alias("pairs")))
    runs = (found.groupBy("key", "item", "item_id", "n", "light", "diagonal")
            .agg(F.collect_set(F.struct("pos", "heavy", "pairs")).alias("w"))
            .withColumn("pairs", F.array_distinct(F.flatten(F.expr("filter(w, x -> not x.heavy).pairs"))))
            .withColumn("whole", (F.size("pairs") == F.size(F.array_distinct("pairs.own")))
                        & (F.size("pairs") == F.size(F.array_distinct("pairs.its")))))
    same = F.forall("x.pairs", lambda p: p["own"] == p["its"])
    cover = (runs.withColumn("x", F.explode("w")).where(F.col("whole") | same)
             .groupBy("key", "item", "item_id", "n", "light", "x.pos", "x.heavy").agg(F.max((~same).cast("int")).alias("other")))
    return (cover.groupBy("key", "item", "item_id", "n", "light")
            .agg(F.count("*").alias("m"), F.sum((~F.col("heavy")).cast("long")).alias("l"), F.max("other").alias("other"))
            .where((F.col("m") >= SHARE * F.col("n")) | (F.col("m") >= LONG_RUN)
                   | ((F.col("l") > 0) & (F.col("l") >= SHARE * F.col("light"))))
            .groupBy("key", "item_id").agg(F.max("n").cast("long").alias("n_windows"), F.max("m").alias("n_matched"),
                                           (F.max("other") > 0).alias("reparameterised")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item found in it)."""
    with Scratch(spark, "decontamination") as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        found = contaminations(docs, table(spark, sf_dir, "benchmark"), scratch)
        return scratch.keep(found.withColumnRenamed("key", "doc_id"))
