"""Best-fit packing of documents into sequences, by a grouping genetic algorithm.

A document is its token ids and a closing id 0.  Documents longer than a
sequence are cut into pieces of a full sequence, from the end, so the first
piece may be shorter.  Full pieces are sequences already; the others are packed.

Method (Falkenauer): an individual is a packing, its genes are bins.  Crossover
injects well-filled bins of one parent whole into the other, removes the
documents that stand twice by dissolving the bins they came from, and best-fits
the displaced ones, longest first; mutation dissolves the emptiest bins.  The
pieces are dealt to blocks of about ``BLOCK`` pieces by a hash of their row, and
each block is evolved on ``ISLANDS`` islands, a Spark group each.  After every
epoch an island's best packing (the elite) migrates to the next island of its
block.  What is not well filled in the end is dealt to fewer blocks and packed
again, until one block is left, so blocks leave no rest of their own; where most
bins fill badly (pieces of which no two fit), the fuller half of them counts as well
filled, so every round has fewer pieces than the one before.

A group never has more than a block's pieces (a few numbers each), whatever the
number of documents; nothing passes through the driver but row counts.

Tokens: the ids are those of ``tokenizers`` for the vocabulary at ``tokenizer``
(a path; on every worker).  Byte-level pieces never reach over the start of a
single space before a word, so words are encoded once and looked up after that;
a text with other runs of white space is encoded as one.

Defined cases
* null or empty text: one piece, the closing id alone;
* repeated rows and null ids are packed like any other row, each row by itself;
* an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, kept_by_worker, table, texts
from concordia.session import Scratch

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
CACHED_WORDS, CACHED_CHARS = 300_000, 40

BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
WELL_FILLED = 0.995     # of the capacity
SETTLED = 0.7           # of the pieces, that may go on to the next round
INJECTED = 0.25         # of a parent's well-filled bins, at most
DISSOLVED = 0.02        # of the bins, by a mutation


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if ids follow the order of the merges (then the
    pair of least id is always the next one to merge); else None."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary.get(a + b, -1) for a, b in merges]
    # byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    if ids != sorted(set(ids)) or any(c not in byte_of for t in vocabulary for c in t if t not in _SPECIAL):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in _SPECIAL}


#: The special string of the vocabulary, and its pattern of pieces.
_SPECIAL = ("<|endoftext|>",)
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Words(dict):
    """Ids of words (with a space before them, or not).  Two generations: what
    was not asked for since the last change of generations is forgotten."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before, self.old = encode, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(self.before + word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian 32-bit ids, words remembered.

    Words of ASCII and Latin letters are merged by ``tiktoken`` over the same
    vocabulary, which gives the same ids in a third of the time; all others, and
    texts with runs of white space, by ``tokenizers``."""

    #: a text with one of these is encoded as one: runs that hold a space, other white space, special strings
    _whole = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), *_SPECIAL)
    _newline = re.compile(r"(?<=\S)\n(?=\S)")
    _simple = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*").fullmatch

    def __init__(self, path: str):
        import os

        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        ranks = byte_ranks(path)
        self.merger = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.first, self.later = _Words(self._encode, ""), _Words(self._encode, " ")

    def _encode(self, text: str) -> bytes:
        if self.merger and self._simple(text):
            return array("I", self.merger.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._whole):
            return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        several = "\n\n" in text or text[0] == "\n" or text[-1] == "\n"
        lines = []
        for line in self._newline.split(text) if several else text.split("\n"):
            words = line.split(" ")
            first = words[0]
            words[0] = self.first[first] if first else b""
            words[1:] = map(self.later.__getitem__, words[1:])
            lines.append(b"".join(words))
        return self.first["\n"].join(lines)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_by_worker(("encoder", path), lambda: Encoder(path))
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = sorted({0, *range(n % capacity if n > capacity else 0, n, capacity)}) + [n]
                for k, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * at:4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(own), own if with_ids else None))
            yield emit(_PIECES, *(zip(*rows) if rows else [[]] * 6))
    return run


# --- the genetic algorithm on one block: lengths and bin numbers as arrays ---

def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put the items of ``order`` into the fullest bin that has room, or a new one."""
    rooms: dict[int, list[int]] = {}
    open_ = 0  # a bit for every room that a bin has
    for k, f in enumerate(fill):
        if f < capacity:
            rooms.setdefault(capacity - f, []).append(k)
            open_ |= 1 << capacity - f
    for i in order:
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i] = k
        fill[k] += n
        if room > n:
            if room - n not in rooms or not rooms[room - n]:
                rooms[room - n] = []
                open_ |= 1 << room - n
            rooms[room - n].append(k)


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fills(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared filling: larger with fewer and with fuller bins."""
    f = fills(lengths, bins)
    return float((f / capacity) @ (f / capacity)) / max(len(f), 1)


def _refill(lengths: np.ndarray, bins: np.ndarray, free: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Best-fit the items marked free into what the others leave."""
    out = bins.copy()
    out[~free] = compact(bins[~free])
    fill = list(map(int, fills(lengths[~free], out[~free]))) if not free.all() else []
    at = np.flatnonzero(free)
    at = at[np.lexsort((rng.random(len(at)), -lengths[at]))]
    best_fit(lengths, at, out, fill, capacity)
    return out


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Well-filled bins of ``b`` into ``a``."""
    good = np.flatnonzero(fills(lengths, b) >= WELL_FILLED * capacity)
    if not len(good):
        return mutate(lengths, a, capacity, rng)
    good = rng.choice(good, max(1, int(len(good) * rng.uniform(0, INJECTED))), replace=False)
    injected = np.isin(b, good)
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True  # these bins of a hold documents that now stand twice
    child = np.where(injected, a.max() + 1 + b, a)
    return _refill(lengths, child, broken[a] & ~injected, capacity, rng)


def mutate(lengths: np.ndarray, a: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Dissolve the emptiest bins and as many others."""
    f = fills(lengths, a)
    n = max(1, int(len(f) * DISSOLVED))
    gone = np.zeros(len(f), bool)
    gone[np.argsort(f, kind="stable")[:n]] = True
    gone[rng.integers(0, len(f), n)] = True
    return _refill(lengths, a, gone[a], capacity, rng)


def evolve(lengths: np.ndarray, people: list[np.ndarray], capacity: int, rng,
           generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first."""
    everything = np.ones(len(lengths), bool)
    while len(people) < POPULATION:
        first = _refill(lengths, np.zeros(len(lengths), np.int32), everything, capacity, rng)
        people = [*people, first if not people else mutate(lengths, first, capacity, rng)]
    scored = [(fitness(lengths, p, capacity), p) for p in people]
    for g in range(generations):
        i, j = rng.choice(len(scored), 2, replace=False)
        child = (crossover(lengths, scored[i][1], scored[j][1], capacity, rng) if g % 2 == 0
                 else mutate(lengths, scored[i][1], capacity, rng))
        scored.append((fitness(lengths, child, capacity), child))
        scored.sort(key=lambda x: -x[0])
        scored.pop()
    return [p for _, p in scored[:POPULATION]]


_STATE = "block long, island int, item long, length long, migrant boolean, genes array<int>"


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = key
        rows = rows.sort_values(["migrant", "item"])
        own, elite = rows[~rows["migrant"]], rows[rows["migrant"]]
        lengths = own["length"].to_numpy(np.int64)
        people = [g for part in (own, elite) if len(part)
                  for g in np.array(part["genes"].tolist(), np.int32).reshape(len(part), -1).T]
        rng = np.random.default_rng([abs(int(block)), int(island), epoch])
        people = evolve(lengths, people, capacity, rng)
        out = pd.DataFrame({"block": block, "island": island, "item": own["item"].to_numpy(), "length": lengths,
                            "migrant": False, "genes": list(np.stack(people, 1))})
        elite = out.assign(island=(island + 1) % ISLANDS, migrant=True, genes=[[int(x)] for x in people[0]])
        return pd.concat([out, elite])
    return run


def _best(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best, top = None, -1.0
        for _, own in sorted(rows.groupby("island")):
            own = own.sort_values("item")
            lengths, bins = own["length"].to_numpy(np.int64), np.array([g[0] for g in own["genes"]], np.int32)
            if (f := fitness(lengths, bins, capacity)) > top:
                best, top = (own["item"].to_numpy(), lengths, compact(bins)), f
        item, lengths, bins = best
        order = np.argsort(bins, kind="stable")
        before = np.r_[0, np.cumsum(lengths[order])[:-1]]
        first = np.r_[True, np.diff(bins[order]) > 0]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return pd.DataFrame({"item": item[order], "length": lengths[order], "block": key[0], "bin": bins[order],
                             "offset": offset, "fill": fills(lengths, bins)[bins[order]]})
    return run


def _packed(items: DataFrame, count: int, capacity: int, scratch: Scratch) -> DataFrame:
    """(item, length, block, bin, offset, fill) of one round over ``items``."""
    blocks = max(1, -(-count // BLOCK))
    state = (items.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                          "item", "length", F.lit(False).alias("migrant"), F.array().cast("array<int>").alias("genes")))
    for epoch in range(EPOCHS):
        state = scratch.cut(state.groupBy("block", "island").applyInPandas(_epoch(capacity, epoch), _STATE), "epoch")
    return scratch.cut(state.where("not migrant").groupBy("block").applyInPandas(
        _best(capacity), "item long, length long, block long, bin long, offset long, fill long"), "packed")


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, capacity: int = CAPACITY,
         with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the ids (binary, 32-bit little-endian)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = scratch.cut(rows.withColumn("item", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where(F.col("length") < capacity).select("item", "length")
    done, level, count = None, 0, rest.count()
    while count:
        packed = _packed(rest, count, capacity, scratch)
        enough, left = 0.0, 0
        if count > BLOCK:
            enough = WELL_FILLED * capacity
            left = packed.where(F.col("fill") < enough).count()
            if left > SETTLED * count:  # what fits badly: the fuller half is settled, the other goes on
                enough = packed.where(F.col("fill") < enough).agg(F.percentile_approx("fill", 0.5)).first()[0]
                left = packed.where(F.col("fill") < enough).count()
        good = packed.where(F.col("fill") >= enough).select(
            "item", "offset", (F.col("block") * (1 << 20) + F.col("bin") + level * (1 << 58)).alias("sequence_id"))
        done = good if done is None else done.union(good)
        rest = packed.where(F.col("fill") < enough).select("item", "length")
        count, level = left, level + 1
    full = pieces.where(F.col("length") == capacity).select("item", F.lit(0).cast("long").alias("offset"),
                                                            (-1 - F.col("item")).alias("sequence_id"))
    placed = full if done is None else done.union(full)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pieces.join(placed, "item").select(*keep)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    with Scratch(spark, "packing") as scratch:
        return scratch.keep(pack(table(spark, sf_dir, "documents"), scratch))
