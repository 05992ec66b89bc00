"""Quality rules: fixed word and line rules, then n-gram perplexity bands.

Method: Spark counts the n-grams of every text, per language; modified
Kneser-Ney models (Chen and Goodman) are estimated from these counts; every
document gets a perplexity of its word order and one of its spelling, and a
document outside one of its language's bands is rejected.

Word order (``log_perplexity``) is judged by word trigrams, see ``word_model``:
sorted arrays of hashed keys that grow with the input, dealt by their keys, never
gathered.  A text is scored by the half of the texts that it is not in (equal
texts are in one half), so the bands lie on held-out perplexity.

Spelling is judged by n-grams of symbols: a text's words, joined by single
spaces, are mapped byte by byte to 64 classes (letters folded to lower case,
digits, sentence marks, symbol characters, other ASCII, and 32 classes for the
bytes of other scripts).  A key of ``ORDER`` symbols is an exact integer below
64 ** ORDER, which bounds both a task's counts and the broadcast model: at
order 4 no language can have more than 2 ** 24 entries (some 50,000 are seen).
The bands are median - ``LOWER`` and + ``UPPER`` robust standard deviations of
the log perplexity, over the documents of the language that pass the fixed rules.
For word order the lower one is at most ``CERTAIN``: a text with a few near copies
is left to the stages that look for copies, one that is all known phrases is not.

Defined cases
* a null or empty text has no words: it fails the word rule, has no perplexity;
* a null language is a language of its own;
* repeated rows are scored alike; an empty table gives an empty table;
* a text of any length is scored whole, in bounded slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table
from concordia.llm.word_model import NO_LANGUAGE, normal_word, text_key, word_hashes, word_scores  # noqa: F401
from concordia.llm.word_model import Words as _WordHashes  # noqa: F401
from concordia.session import Scratch

ORDER = 4
BITS = 6
LOWER, UPPER = 6.0, 10.0  # the band, in robust standard deviations below and above the median
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SLICE = 1 << 22         # symbols that are counted or scored at a time
CERTAIN = 0.25          # log perplexity of words under which the rest of the language foretells a text

SYMBOLS = b"#*$%&|<>"
SENTENCE_MARKS = b".,;:!?'\"-()"
_SYMBOL_CLASS = 29


def _classes() -> np.ndarray:
    to = np.full(256, 30, np.uint8)
    to[:33] = 0
    to[127] = 0
    for low in range(26):
        to[[65 + low, 97 + low]] = 1 + low
    to[48:58] = 27
    to[list(SENTENCE_MARKS)] = 28
    to[list(SYMBOLS)] = _SYMBOL_CLASS
    to[128:] = 32 + (np.arange(128, 256) & 31)
    return to


CLASSES = _classes()


def grams(words: bytes, order: int = ORDER) -> np.ndarray:
    """The key of the ``order`` symbols that end at each symbol of a text and
    at the space after its end; the text starts after ``order - 1`` spaces."""
    symbols = np.zeros(len(words) + order, np.int32)
    symbols[order - 1:-1] = CLASSES[np.frombuffer(words, np.uint8)]
    n = len(words) + 1
    key = symbols[:n].copy()
    for k in range(1, order):
        key <<= BITS
        key |= symbols[k:k + n]
    return key


class Sections:
    """Keys of the symbols of texts, many texts at a time; a long text in sections of ``SLICE`` symbols."""

    def __init__(self, order: int):
        self.order = order
        self.parts: list[bytes] = []
        self.texts: list[int] = []
        self.size = 0

    def add(self, i: int, words: bytes) -> Iterator[None]:
        """Waits with the text ``i``, and stops wherever enough symbols wait."""
        before = self.order - 1
        padded = b" " * before + words + b" "
        for k in range(0, len(words) + 1, SLICE):  # a section knows the symbols before it
            self.parts.append(padded[k:k + SLICE + before])
            self.texts.append(i)
            self.size += len(self.parts[-1]) - before
            if self.size >= SLICE:
                yield

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key that ends at each symbol, text of each section, start of each section).  The first
        ``order - 1`` symbols of a section belong to its first key; keys across two sections are 0."""
        before = self.order - 1
        symbols = CLASSES[np.frombuffer(b"".join(self.parts), np.uint8)].astype(np.int32)
        n = len(symbols) - before
        key = symbols[:n].copy()
        for k in range(1, self.order):
            key <<= BITS
            key |= symbols[k:k + n]
        starts = np.cumsum([0, *map(len, self.parts)])
        across = (starts[1:-1, None] - np.arange(1, before + 1)).ravel()
        texts = np.array(self.texts)
        self.parts, self.texts, self.size = [], [], 0
        key[across] = 0
        return key, texts, starts[:-1]


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, Sections] = {}

        def settle():
            for lang, sections in waiting.items():
                if not sections.parts:
                    continue
                keys, _, starts = sections.keys()
                keys, n = np.unique(keys, return_counts=True)
                n[0] -= (len(starts) - 1) * (order - 1)  # the keys across sections, which are 0 as that of a blank
                keys, n = keys[n > 0], n[n > 0]
                if lang in seen:
                    keys, n = np.concatenate([seen[lang][0], keys]), np.concatenate([seen[lang][1], n])
                    keys, n = _merge(keys, n)
                seen[lang] = keys, n

        for b in batches:
            for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                words = b" ".join((text or b"").split())
                if words:
                    for _ in waiting.setdefault(lang or NO_LANGUAGE, Sections(order)).add(0, words):
                        settle()
                if sum(w.size for w in waiting.values()) >= SLICE:
                    settle()
        settle()
        for lang, (keys, n) in seen.items():
            yield emit(_COUNTS, pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), keys, n)
    return run


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0] + [k - (k + 1) * y * b / a if a and b else 0.5 * k
                 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


class KneserNey:
    """Interpolated modified Kneser-Ney, one sorted key array per order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.row = self.rows = None  # made where they are used
        levels = {order: (keys, counts)}
        for k in range(order - 1, 0, -1):  # lower orders count the different symbols before them
            levels[k] = np.unique(levels[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        self.keys, self.logp, self.context, self.weight = {}, {}, {}, {}
        for k in range(1, order + 1):
            keys, n = levels[k]
            d = _discounts(n)
            first = np.flatnonzero(np.r_[True, np.diff(keys >> BITS) != 0])
            total = np.add.reduceat(n, first)
            spare = np.add.reduceat(d[np.minimum(n, 3)], first) / total
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            lower = (np.exp(self.score(keys & ((1 << BITS * (k - 1)) - 1), k - 1)) if k > 1
                     else np.full(len(keys), 1.0 / (1 << BITS)))
            p = (n - d[np.minimum(n, 3)]) / total[group] + spare[group] * lower
            self.keys[k], self.logp[k] = keys, np.log(p).astype(np.float32)
            self.context[k], self.weight[k] = (keys >> BITS)[first], np.log(spare).astype(np.float32)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """``score`` of many keys, looked up in rows by their contexts."""
        if self.rows is None:
            context, of = self.context[self.order], self.keys[self.order] >> BITS
            self.row = np.zeros(1 << BITS * (self.order - 1), np.int32)  # row 0: of no context
            self.row[context] = np.arange(1, len(context) + 1)
            self.rows = np.full((len(context) + 1) << BITS, np.nan, np.float32)
            self.rows[(self.row[of] << BITS) | (self.keys[self.order] & ((1 << BITS) - 1))] = self.logp[self.order]
        out = self.rows[(self.row[keys >> BITS] << BITS) | (keys & ((1 << BITS) - 1))].astype(np.float64)
        missing = np.flatnonzero(np.isnan(out))
        if len(missing):
            out[missing] = self.score(keys[missing].astype(np.int64))
        return out

    def score(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """log p of the last symbol of each key given the symbols before it."""
        k = self.order if order is None else order
        if k == 0:
            return np.full(len(keys), -BITS * np.log(2.0))
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        found = self.keys[k][at] == keys
        out = self.logp[k][at].astype(np.float64)
        if not found.all():
            rest = keys[~found]
            at = np.minimum(np.searchsorted(self.context[k], rest >> BITS), len(self.context[k]) - 1)
            back = np.where(self.context[k][at] == rest >> BITS, self.weight[k][at], 0.0)
            out[~found] = back + self.score(rest & ((1 << BITS * (k - 1)) - 1), k - 1)
        return out


def fit(docs: DataFrame, order: int = ORDER) -> dict[str, KneserNey]:
    """One model a language from the counts of all texts."""
    counts = (docs.select("text", "lang").mapInArrow(_count_grams(order), "lang string, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    lang, gram, n = (counts.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    models = {}
    for name in sorted(set(lang)):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(gram[own])]
        models[name] = KneserNey(gram[own].astype(np.int64), n[own], order)
    return models


def base_measures(text: bytes, words: list[bytes], joined: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    n = len(words)
    chars = len(joined) - max(n - 1, 0)
    if not joined.isascii():
        chars -= int(np.count_nonzero(np.frombuffer(joined, np.int8) < -64))  # bytes that begin no character
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n)
        with np.errstate(over="ignore"):
            w = (h[:-2] * np.int64(0x2545F4914F6CDD1D) ^ h[1:-1]) * np.int64(0x1B873593CC9E2D51) ^ h[2:]
        s = np.sort(w)
        if (s[1:] == s[:-1]).any():
            order = np.argsort(w)
            same = np.flatnonzero(w[order[1:]] == w[order[:-1]])
            at = np.concatenate([order[same], order[same + 1]])
            cover = np.zeros(n, bool)
            cover[at] = cover[at + 1] = cover[at + 2] = True
            repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_MEASURES = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                       ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("spelling", pa.float64()), ("text_key", pa.int64())])
_MEASURES_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                 "n_repeat_words long, spelling double, text_key long")


def _measure(models):
    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        keys_of_texts: list[int] = []
        total, length = np.zeros(len(text)), np.zeros(len(text), np.int64)
        waiting: dict[str, Sections] = {}

        def settle():
            for name, sections in waiting.items():
                if not sections.parts:
                    continue
                model = models.value[name]
                keys, of, starts = sections.keys()
                scores = model.scores(keys)
                scores[(starts[1:, None] - np.arange(1, model.order)).ravel()] = 0.0  # keys across sections
                total[:] += np.bincount(of, np.add.reduceat(scores, starts), len(total))

        for i, (t, name) in enumerate(zip(text.cast(pa.binary()).to_pylist(), lang.to_pylist())):
            t = t or b""
            words = t.split()
            joined = b" ".join(words)
            name = name or NO_LANGUAGE
            rows.append(base_measures(t, words, joined))
            keys_of_texts.append(text_key(t, name))
            if words:
                length[i] = len(joined) + 1
                for _ in waiting.setdefault(name, Sections(models.value[name].order)).add(i, joined):
                    settle()
            if sum(w.size for w in waiting.values()) >= SLICE:
                settle()
        settle()
        with np.errstate(invalid="ignore", divide="ignore"):
            perplexity = pa.array(-total / length, pa.float64(), mask=length == 0)
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
        return pa.StructArray.from_arrays([*columns, perplexity, pa.array(keys_of_texts, pa.int64())], fields=list(_MEASURES))
    return run


def measured(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality`` of the measures of each text by itself."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, order))
    return docs.withColumn("quality", F.arrow_udf(_measure(models), _MEASURES_DDL)("text", "lang"))


def judged(scored: DataFrame, scores: DataFrame, below: float = LOWER, above: float = UPPER) -> DataFrame:
    """``log_perplexity``, ``base_failed`` and ``kept`` for documents with their
    measures; ``scores`` are the ``word_scores`` of their texts.  Both are read
    more than once, so they should be written tables.  What is broadcast is a row
    per language, of which every task holds the model."""
    q = F.col("quality")
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    lang = F.coalesce("lang", F.lit(NO_LANGUAGE))
    rows = scored.join(scores, q.text_key == scores["_text"], "left").drop("_text")
    good = rows.where(~failed).select(lang.alias("_lang"), q.spelling.alias("x"), F.col("_log_perplexity").alias("w"))
    middle = good.groupBy("_lang").agg(*(F.percentile_approx(k, 0.5, 10000).alias(f"middle_{k}") for k in "xw"))
    spread = (good.join(F.broadcast(middle), "_lang").groupBy("_lang", "middle_x", "middle_w")
              .agg(*(F.percentile_approx(F.abs(F.col(k) - F.col(f"middle_{k}")), 0.5, 10000).alias(f"mad_{k}") for k in "xw")))
    sd = {k: F.greatest(F.col(f"mad_{k}") * 1.4826, F.lit(1e-6)) for k in "xw"}
    lower = {k: F.col(f"middle_{k}") - below * sd[k] for k in "xw"}
    lower["w"] = F.least(lower["w"], F.lit(CERTAIN))
    bands = spread.select("_lang", *(lower[k].alias(f"_lower_{k}") for k in "xw"),
                          *((F.col(f"middle_{k}") + above * sd[k]).alias(f"_upper_{k}") for k in "xw"))
    inside = (q.spelling.between(F.col("_lower_x"), F.col("_upper_x"))
              & F.col("_log_perplexity").between(F.col("_lower_w"), F.col("_upper_w")))
    return (rows.join(F.broadcast(bands), lang == bands["_lang"], "left")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & F.coalesce(inside, F.lit(True)))
            .withColumn("log_perplexity", F.col("_log_perplexity"))
            .drop("_lang", "_log_perplexity", *(f"_{side}_{k}" for side in ("lower", "upper") for k in "xw")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every document."""
    with Scratch(spark, "quality") as scratch:
        docs = table(spark, sf_dir, "documents")
        scored = measured(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "quality")
        scores = word_scores(docs, scratch)
        return scratch.keep(judged(scratch.cut(scored, "scored"), scores).select(
            "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
            "quality.n_repeat_words", "base_failed", "kept", "log_perplexity"))
