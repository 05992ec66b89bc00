"""Word order: held-out modified Kneser-Ney models of word trigrams.

Every text is scored by the half of the texts of its language that it is not in
(equal texts are in one half).  Words are 32-bit hashes.  The exact counts of all
trigrams of all texts lie in sorted hash arrays; none is left out or rounded.

The words of the texts are written once, as packed arrays of some 2 bytes a word
(``tokens``).  A trigram belongs to the group of its middle word: there all its
contexts and shorter grams are at home too, so a group counts and scores without
the others, but for two things: how many words stand before a word in the whole
language, which ``_totals`` adds up by that word, and the discounts, a row per language.
A middle word that fills more than ``HEAVY`` trigrams has groups of its own, dealt by
the word before it; their pairs of words are added up by ``_totals`` too.

The groups come in ``SLICES`` rounds, each a job whose shuffled trigrams are deleted
at its end, once to count and once to score: the disk holds the tokens, a slice
of the trigrams and some bytes per word, group and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.columns import emit
from concordia.session import Scratch, shuffles_dropped

NO_LANGUAGE = "und"
WORDS = 1 << 20         # words of a row of tokens
PIECE = 1 << 17         # bytes that are hashed at a time
GROUP = 1 << 19         # trigrams of a group, about
HEAVY = GROUP           # trigrams of one middle word that are split
FREQUENT = 1 << 12      # a word is looked at as heavy if it is one of so many of a row of tokens
SLICES = 6

#: scripts that are written without spaces: every character counts as a word
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
                        "\uf900-\ufaff\U00020000-\U0003ffff]")
_HIGH = re.compile(b"[\xe0-\xff]")  # bytes that begin the characters of these scripts, among others
_EDGES = ".,;:!?'\"()[]{}«»„“”‘’…。、，！？"
_DIGITS = re.compile(r"\d+")
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_GAP = re.compile(rb"[ \t-\r]")
_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)  # of the bytes of a word
_FACTOR = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_UP = np.uint64(32)
_MIX = np.uint32(0x9E3779B1)


def normal_words(words: str) -> str:
    """Of words with line feeds between them: lower case, without marks at their edges, any number as 0."""
    return _DIGITS.sub("0", "\n".join([w.strip(_EDGES) or w for w in words.lower().split("\n")]))


def normal_word(word: str) -> str:
    return normal_words(word)


class Words:
    """The hashes of the normal forms of the words of texts.  Each different word of a call is
    hashed once; it is found by a 64-bit polynomial of its bytes, computed for all words at once."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = (np.cumprod(np.full(n, x, np.uint64)) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))

    def _marks(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, polynomial) of the words of a piece of text."""
        n = len(piece)
        self._grow(n)
        space = np.ones(n + 2, bool)
        space[1:-1] = _SPACE[piece]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[piece] * self.power[:n], out=sums[1:])
        return starts, ends, (sums[ends] - sums[starts]) * self.inverse[starts]

    def _all_marks(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, k = [(np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)], 0
        while k < len(joined):  # pieces end with a word
            gap = _GAP.search(joined, min(k + PIECE, len(joined)))
            to = gap.start() if gap else len(joined)
            starts, ends, mark = self._marks(np.frombuffer(joined, np.uint8, to - k, k))
            parts.append((starts + k, ends + k, mark))
            k = to + 1
        starts, ends, mark = map(np.concatenate, zip(*parts))
        return starts, ends, mark

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, their number for each text); 0, twice before and once after a text, is its edge."""
        joined = b"\n".join(texts)
        starts, ends, mark = self._all_marks(joined)
        if not len(mark):
            return np.zeros(3 * len(texts), np.int32), np.full(len(texts), 3)
        limits = np.cumsum([len(t) + 1 for t in texts])
        n = np.diff(np.searchsorted(starts, limits), prepend=0)
        order = np.argsort(mark)
        mark = mark[order]
        new = np.ones(len(mark), bool)
        new[1:] = mark[1:] != mark[:-1]
        one = order[new]
        different = b"\n".join([joined[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())])
        normal = normal_words(different.decode("utf-8", "replace")).encode().split(b"\n")
        hashes = np.frombuffer(b"".join([blake2b(w, digest_size=4).digest() for w in normal]), "<i4")
        out = np.zeros(len(mark) + 3 * len(texts), np.int32)
        place = np.arange(len(mark)) + np.repeat(3 * np.arange(len(texts)) + 2, n)
        out[place[order]] = hashes[np.cumsum(new) - 1]
        return out, n + 3


def spaced(text: bytes) -> bytes:
    """Text of scripts without spaces with a space around each character."""
    if not text.isascii() and _HIGH.search(text):
        return SPACELESS.sub(r" \g<0> ", text.decode("utf-8", "replace")).encode()
    return text


def word_hashes(text: bytes, words: Words) -> np.ndarray:
    """The hash of every word of a text, and of its edges."""
    return words([spaced(text)])[0]


def text_key(text: bytes, lang: str) -> int:
    """Names a text of a language; the last bit is the half that it is in."""
    return int.from_bytes(blake2b(lang.encode() + b"\0" + text, digest_size=8).digest(), "little", signed=True)


# ---- arrays in rows

def pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """32-bit integers, their bytes by place, compressed; sorted ones as differences."""
    x = np.ascontiguousarray(x).astype(np.uint32)
    if sorted_:
        x = np.diff(x, prepend=np.uint32(0))
    planes = np.empty((4, len(x)), np.uint8)
    for k in range(4):
        np.right_shift(x, np.uint32(8 * k), out=planes[k], casting="unsafe")
    return len(x).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = pa.Codec("zstd").decompress(data[4:], decompressed_size=4 * n)
    x = np.zeros(n, np.uint32)
    for k, plane in enumerate(np.frombuffer(planes, np.uint8).reshape(4, n)):
        if plane.any():
            x |= plane.astype(np.uint32) << np.uint32(8 * k)
    return np.cumsum(x, dtype=np.uint32) if sorted_ else x


def _kinds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, rising; place of each key among them)."""
    order = np.argsort(key)
    rising = key[order]
    new = np.ones(len(key), bool)
    new[1:] = rising[1:] != rising[:-1]
    kind = np.empty(len(key), np.int64)
    kind[order] = np.cumsum(new) - 1
    return rising[new], kind


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << _UP) | low.astype(np.uint64)


# ---- the words of the texts

_TOKENS = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()),
                     ("vocabulary", pa.binary()), ("frequent", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
_TOKENS_DDL = ("lang string, n long, keys binary, sizes binary, codes binary, vocabulary binary, "
               "frequent array<int>, times array<long>")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to some ``WORDS`` words of texts of one language."""
    words, waiting, size = Words(), {}, {}

    def row(lang: str, keys: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in parts], np.uint32)
        vocabulary, code = _kinds(np.concatenate(parts).view(np.uint32))
        times = np.bincount(code)
        by_times = np.argsort(-times)
        rank = np.empty(len(by_times), np.uint32)
        rank[by_times] = np.arange(len(by_times))
        vocabulary, times = vocabulary[by_times], times[by_times]
        frequent = int(np.searchsorted(-times, -max(16, len(code) // FREQUENT), "right"))
        return emit(_TOKENS, [lang], [len(code) - 2 * len(sizes)], [np.array(keys, np.int64).tobytes()], [pack(sizes)],
                    [pack(rank[code])], [vocabulary.tobytes()], [vocabulary[:frequent].view(np.int32)], [times[:frequent]])

    def settled(lang: str) -> Iterator[pa.RecordBatch]:
        keys, texts = zip(*waiting.pop(lang))
        size.pop(lang)
        all_words, sizes = words(texts)
        own, parts, n = [], [], 0
        for key, i, j in zip(keys, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            if j - i == 3:  # no words
                continue
            for k in range(i, j - 2, WORDS):  # a part knows the words around it
                own.append(key)
                parts.append(all_words[k:min(k + WORDS + 2, j)])
                n += len(parts[-1])
                if n >= WORDS:
                    yield row(lang, own, parts)
                    own, parts, n = [], [], 0
        if own:
            yield row(lang, own, parts)

    for b in batches:
        for text, lang in zip(b.column(0).cast(pa.binary()), b.column(1)):
            text, lang = text.as_py() or b"", lang.as_py() or NO_LANGUAGE
            waiting.setdefault(lang, []).append((text_key(text, lang), spaced(text)))
            size[lang] = size.get(lang, 0) + len(waiting[lang][-1][1])
            if size[lang] >= 6 * WORDS:
                yield from settled(lang)
            if sum(size.values()) >= 24 * WORDS:
                for name in list(waiting):
                    yield from settled(name)
    for name in list(waiting):
        yield from settled(name)


# ---- trigrams, dealt to groups

class Plan:
    """How the trigrams of a language are dealt: ``groups`` by the middle word, then
    ``parts`` for each heavy one by the word before; totals are dealt by the last word."""

    def __init__(self, trigrams: int, heavy: dict[int, int]):
        self.groups = -(-trigrams // GROUP)
        self.shares = -(-trigrams // (4 * GROUP))
        self.heavy = np.array(sorted(heavy), np.uint32)
        self.parts = np.array([-(-heavy[int(w)] // GROUP) for w in self.heavy], np.int64)
        self.starts = self.groups + np.cumsum(self.parts) - self.parts

    def heavy_place(self, words: np.ndarray) -> np.ndarray:
        """Which heavy word each is, or -1."""
        if not len(self.heavy):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
        return np.where(self.heavy[at] == words, at, -1)

    def heavy_word(self, group: int) -> int | None:
        return None if group < self.groups else int(self.heavy[np.searchsorted(self.starts, group, "right") - 1])


_CELLS = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("blob", pa.int64()),
                    *((k, pa.binary()) for k in ("a", "b", "c", "text", "times"))])
_CELLS_DDL = "lang string, g int, blob long, a binary, b binary, c binary, text binary, times binary"


def _cells(plans: dict[str, Plan], part: int, slices: int, per_text: bool):
    """The trigrams of a row of tokens (``per_text``: of each of its texts) and how often they
    are there, for every group of a slice.  ``text`` ends with the bit of the text's half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                plan, vocabulary = plans[row["lang"]], np.frombuffer(row["vocabulary"], np.uint32)
                code, sizes = unpack(row["codes"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
                heavy = plan.heavy_place(vocabulary)
                group = (vocabulary % np.uint32(plan.groups)).astype(np.int64)
                wanted = ((group % slices == part) | (heavy >= 0))[code]
                ends = np.cumsum(sizes)
                wanted[ends - 1] = wanted[ends - sizes] = False  # edges are in no middle
                at = np.flatnonzero(wanted)
                a, b, c = (vocabulary[code[at + k]] for k in (-1, 0, 1))
                group, heavy = group[code[at]], heavy[code[at]]
                if (heavy >= 0).any():
                    own = np.flatnonzero(heavy >= 0)
                    group[own] = plan.starts[heavy[own]] + a[own] % plan.parts[heavy[own]]
                half = (np.frombuffer(row["keys"], np.int64) & 1).astype(np.uint32)
                text = np.arange(len(sizes), dtype=np.uint32) << np.uint32(1) | half if per_text else half
                text = text[np.searchsorted(ends, at, "right")]
                keep = np.flatnonzero(group % slices == part)
                if not len(keep):
                    continue
                a, b, c, text, group = (x[keep] for x in (a, b, c, text, group))
                order = np.argsort(_pairs(b, (a * _MIX ^ c) * _MIX ^ text))  # equal trigrams come together
                order = order[np.argsort(group[order] // slices, kind="stable")]
                a, b, c, text, group = (x[order] for x in (a, b, c, text, group))
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (text[1:] != text[:-1])
                new = np.flatnonzero(new)
                times = np.diff(new, append=len(a))
                a, b, c, text, group = (x[new] for x in (a, b, c, text, group))
                cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
                spans = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
                yield emit(_CELLS, [row["lang"]] * len(spans), group[cuts[:-1]], [row["blob"]] * len(spans),
                           [a[s].tobytes() for s in spans], [pack(b[s], True) for s in spans], [c[s].tobytes() for s in spans],
                           [pack(text[s]) for s in spans], [pack(times[s]) for s in spans])
    return run


class Grams:
    """The grams of a group: ``n3``, ``n2`` and ``n1`` count for the model of either half, which is made of the other."""

    def __init__(self, cells: pa.Table):
        a, c = (np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in cells.column(k)]) for k in ("a", "c"))
        b, self.text, self.times = (np.concatenate([unpack(x.as_py(), k == "b") for x in cells.column(k)]) for k in ("b", "text", "times"))
        self.rows = [len(x.as_py()) // 4 for x in cells.column("a")]
        pair, of = _kinds(_pairs(b, a))
        gram, self.gram = _kinds(_pairs(of, c))
        half = self.text & 1
        self.n3 = [np.bincount(self.gram, self.times * (half != m), len(gram)) for m in (0, 1)]
        self.context = (gram >> _UP).astype(np.int64)  # of each trigram
        two, self.shorter = _kinds((pair[self.context] & ~_LOW) | (gram & _LOW))
        self.n2 = [np.bincount(self.shorter, n > 0, len(two)) for n in self.n3]
        first = two >> _UP
        self.middle = np.cumsum(np.r_[False, first[1:] != first[:-1]])
        self.words, self.last = _kinds(two & _LOW)
        self.n1 = [np.bincount(self.last, n > 0, len(self.words)) for n in self.n2]


def _stats(*counts: np.ndarray) -> list[int]:
    """Of either model how many counts are 1, 2, 3, 4 and more than 2, and their sum; then how many grams there are."""
    return [int(x) for n in counts for x in (*((n == k).sum() for k in (1, 2, 3, 4)), (n > 2).sum(), n.sum())] + [len(counts[0])]


_COUNTED = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("q", pa.int32()), ("b", pa.int64()), ("words", pa.binary()),
                      ("n0", pa.binary()), ("n1", pa.binary()), ("level", pa.int32()), ("stats", pa.list_(pa.int64()))])
_COUNTED_DDL = "lang string, g int, q int, b long, words binary, n0 binary, n1 binary, level int, stats array<long>"
_NONE = (None,) * 9


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] or [pa.array([], f.type) for f in schema], schema=schema)


def _shares(words: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(share, places of its words) of the words of a group."""
    share = words.astype(np.int64) % plan.shares
    order = np.argsort(share, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(share[order])) + 1, len(order)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(share[order[i]]), order[i:j]


def _count(plans: dict[str, Plan]):
    """The statistics of a group, and what it adds to the totals of its words."""
    def run(key: tuple, cells: pa.Table) -> pa.Table:
        lang, g = (k.as_py() for k in key)
        grams, plan = Grams(cells), plans[lang]
        b = plan.heavy_word(g)
        n = grams.n1 if b is None else grams.n2
        rows = [(lang, g, q, b, pack(grams.words[at], True), pack(n[0][at]), pack(n[1][at]), None, None)
                for q, at in _shares(grams.words, plan)]
        rows.append((lang, *_NONE[:6], 3, _stats(*grams.n3)))
        if b is None:
            rows.append((lang, *_NONE[:6], 2, _stats(*grams.n2)))
        return _table(_COUNTED, rows)
    return run


_TOTALS = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("q", pa.int32()), ("b", pa.int64()),
                     *((k, pa.binary()) for k in ("n0", "n1", "pairs0", "pairs1")), ("level", pa.int32()), ("stats", pa.list_(pa.int64()))])
_TOTALS_DDL = ("lang string, g int, q int, b long, n0 binary, n1 binary, pairs0 binary, pairs1 binary, level int, stats array<long>")


def _totals(key: tuple, counted: pa.Table) -> pa.Table:
    """The counts of a share of the words of a language, answered to every group in the order
    of its words; with the pairs that begin with a heavy word, and their statistics (level 0: of one such word)."""
    lang, q = (k.as_py() for k in key)
    asked = counted.select(["g", "b", "words", "n0", "n1"]).to_pylist()
    words = [unpack(r["words"], True) for r in asked]
    n = [[unpack(r[k]).astype(np.int64) for r in asked] for k in ("n0", "n1")]
    cuts = np.cumsum([0, *map(len, words)])
    known, at = _kinds(np.concatenate(words))
    plain = np.repeat([r["b"] is None for r in asked], np.diff(cuts))
    n = [np.concatenate(x) for x in n]
    total = [np.bincount(at, x * plain, len(known)).astype(np.int64) for x in n]
    rows, pair_total = [], [np.zeros(len(at), np.int64)] * 2
    if not plain.all():
        own = np.flatnonzero(~plain)
        first = np.repeat([r["b"] or 0 for r in asked], np.diff(cuts))[own]
        pair, of = _kinds(_pairs(first, at[own]))
        pairs = [np.bincount(of, x[own], len(pair)).astype(np.int64) for x in n]
        for m in (0, 1):
            total[m] += np.bincount((pair & _LOW).astype(np.int64), pairs[m] > 0, len(known)).astype(np.int64)
            pair_total[m] = np.zeros(len(at), np.int64)
            pair_total[m][own] = pairs[m][of]
        rows.append((lang, *_NONE[:7], 2, _stats(*pairs)))
        for b in np.unique(pair >> _UP):
            this = pair >> _UP == b
            rows.append((lang, None, None, int(b), *_NONE[:4], 0, _stats(*(x[this] for x in pairs))))
    rows.append((lang, *_NONE[:7], 1, _stats(*total)))
    for r, i, j in zip(asked, cuts[:-1], cuts[1:]):
        pairs = [None, None] if r["b"] is None else [pack(x[i:j]) for x in pair_total]
        rows.append((lang, r["g"], q, r["b"], *(pack(x[at[i:j]]) for x in total), *pairs, None, None))
    return _table(_TOTALS, rows)


# ---- p

class Level:
    """What the grams of one length have in common."""

    def __init__(self, stats: list[int]):
        self.discounts = [self._discounts(stats[6 * m:6 * m + 4]) for m in (0, 1)]

    @staticmethod
    def _discounts(c: list[int]) -> np.ndarray:
        """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more."""
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] and c[k] else 0.5 * k for k in (1, 2, 3)]
        return np.r_[0.0, np.clip(d, 0.01, [0.99, 1.99, 2.99])]

    def p(self, m: int, n: np.ndarray, of: np.ndarray | None, below, stats: list[int] | None = None) -> np.ndarray:
        """p under a model of grams that occur ``n`` times, in the contexts ``of``; where all are in one
        context that is not whole here, ``stats`` are its own.  ``below``: p of the shorter grams."""
        d = self.discounts[m]
        if stats is None:
            many = [np.bincount(of, x) for x in (n == 1, n == 2, n > 2, n)]
        else:
            many = [np.array([stats[6 * m + k]]) for k in (0, 1, 4, 5)]
            of = np.zeros(len(n), np.int64)
        spare, total = sum(x * d[k] for k, x in enumerate(many[:3], 1))[of], many[3][of]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total > 0, (n - d[np.minimum(n, 3).astype(np.int64)] + spare * below) / total, below)


_SUMS = pa.schema([("blob", pa.int64()), ("text", pa.binary()), ("total", pa.binary())])
_SUMS_DDL = "blob long, text binary, total binary"


def _score(plans: dict[str, Plan], stats: dict[tuple, list[int]]):
    """Of the texts of each row of tokens, log p of their trigrams in a group, summed."""
    def run(key: tuple, cells: pa.Table, answers: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return _table(_SUMS, [])
        lang, g = (k.as_py() for k in key)
        grams, plan = Grams(cells), plans[lang]
        b = plan.heavy_word(g)
        places = dict(_shares(grams.words, plan))
        for r in answers.to_pylist():
            for m in (0, 1):
                grams.n1[m][places[r["q"]]] = unpack(r[f"n{m}"])
                if b is not None:  # its pairs have the order of their last words
                    grams.n2[m][places[r["q"]]] = unpack(r[f"pairs{m}"])
        one, two, three = (Level(stats[lang, k, None]) for k in (1, 2, 3))
        log_p = []
        for m in (0, 1):
            p = one.p(m, grams.n1[m], None, 1.0 / stats[lang, 1, None][12], stats[lang, 1, None])
            p = two.p(m, grams.n2[m], grams.middle, p[grams.last], None if b is None else stats[lang, 0, b])
            log_p.append(np.log(three.p(m, grams.n3[m], grams.context, p[grams.shorter])))
        own = grams.times * np.where(grams.text & 1, log_p[1][grams.gram], log_p[0][grams.gram])
        rows, start = [], 0
        for blob, n in zip(cells.column("blob").to_pylist(), grams.rows):
            text, log = grams.text[start:start + n] >> np.uint32(1), own[start:start + n]
            if text.max() < 8 * n:
                total = np.bincount(text, log)
                text = np.flatnonzero(np.bincount(text))
                total = total[text]
            else:
                text, of = _kinds(text)
                total = np.bincount(of, log)
            rows.append((blob, pack(text, True), total.tobytes()))
            start += n
        return _table(_SUMS, rows)
    return run


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    text, of = _kinds(np.concatenate([unpack(r["text"], True) for r in rows]))
    return text, np.bincount(of, np.concatenate([np.frombuffer(r["total"]) for r in rows]), len(text))


def _sum(key: tuple, sums: pa.Table) -> pa.Table:
    text, total = _added(sums.select(["text", "total"]).to_pylist())
    return _table(_SUMS, [(key[0].as_py(), pack(text, True), total.tobytes())])


_SCORED = pa.schema([("_text", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])


def _per_text(key: tuple, tokens: pa.Table, sums: pa.Table) -> pa.Table:
    row, = tokens.select(["keys", "sizes"]).to_pylist()
    text, total = _added(sums.select(["text", "total"]).to_pylist())  # every text has a trigram
    return pa.table([np.frombuffer(row["keys"], np.int64)[text], total, unpack(row["sizes"])[text].astype(np.int64) - 2], schema=_SCORED)


def _stats_of(*tables: DataFrame) -> dict[tuple, list[int]]:
    """Sums of the statistics: rows per language and per heavy word."""
    out: dict[tuple, list[int]] = {}
    for t in tables:
        sums = (t.where("level is not null").groupBy("lang", "level", "b")
                .agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(13))))
        for lang, level, b, *own in map(tuple, sums.collect()):
            out[lang, level, b] = [x + y for x, y in zip(out.get((lang, level, b), [0] * 13), own)]
    return out


def word_scores(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(``_text``, ``_log_perplexity``) of every text that has words."""
    with shuffles_dropped(docs.sparkSession):
        tokens = scratch.cut(docs.select("text", "lang").mapInArrow(_tokens, _TOKENS_DDL)
                             .withColumn("blob", F.monotonically_increasing_id()), "tokens")
        sizes = tokens.groupBy("lang").agg(F.sum("n")).collect()  # a row per language
        words = (tokens.select("lang", F.explode(F.arrays_zip("frequent", "times")).alias("x"))
                 .groupBy("lang", F.col("x.frequent").alias("w")).agg(F.sum("x.times").alias("n"))
                 .where(F.col("n") > HEAVY).collect())  # at most the words of the language over HEAVY
        plans = {lang: Plan(n, {r["w"] & 0xFFFFFFFF: r["n"] for r in words if r["lang"] == lang}) for lang, n in sizes}
        rows = tokens.select("lang", "blob", "keys", "sizes", "codes", "vocabulary")

        def cells(part: int, per_text: bool):
            return rows.mapInArrow(_cells(plans, part, SLICES, per_text), _CELLS_DDL).groupBy("lang", "g")

        def union(tables):
            return reduce(DataFrame.unionByName, tables)

        counted = union([scratch.cut(cells(k, False).applyInArrow(_count(plans), _COUNTED_DDL), "counted") for k in range(SLICES)])
        totals = scratch.cut(counted.where("level is null").groupBy("lang", "q").applyInArrow(_totals, _TOTALS_DDL), "totals")
        stats = _stats_of(counted, totals)
        scratch.drop("counted")
        answers = totals.where("level is null").select("lang", "g", "q", "n0", "n1", "pairs0", "pairs1")
        sums = union([scratch.cut(
            cells(k, True).cogroup(answers.where(F.col("g") % SLICES == k).groupBy("lang", "g"))
            .applyInArrow(_score(plans, stats), _SUMS_DDL).groupBy("blob").applyInArrow(_sum, _SUMS_DDL), "sums") for k in range(SLICES)])
        return scratch.cut(tokens.select("blob", "keys", "sizes").groupBy("blob").cogroup(sums.groupBy("blob"))
                           .applyInArrow(_per_text, "_text long, total double, n long").groupBy("_text")
                           .agg((-F.sum("total") / F.sum("n")).alias("_log_perplexity")), "words-scored")
