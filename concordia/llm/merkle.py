"""Merkle manifest of a dataset: one digest that names all its rows, and for
every row the digests that prove that it belongs to it.

H is the sha256 of its inputs, concatenated, as lowercase hex.  A leaf is H of a
row's fields.  The leaves of one language, in the order of their ids, are joined
in runs of ``ARITY``, level by level, up to the language's subroot; the subroots,
in the order of the languages, are joined in the same way up to the root.

Method: content-addressed DAG descent.  Building stores a record ``digest ->
children`` for every inner node, a table row per *segment*: ``LEVELS`` levels
over at most ``ARITY ** LEVELS`` neighbouring nodes, so a tree of any size takes
a few rounds of bounded groups.  To serve leaf requests the descent starts from
the root with the digits of the leaf's rank, follows the child that a digit
names from record to record, collects the children that are not selected, and
reverses the path: what remains is the proof, from the leaf up.  The paths of a
segment's requests are joined to the one path of the segment's own root, so
nothing that all rows share is looked up row by row.

Ranks come from a range partitioning and one offset per partition; a language
with a third of all rows is spread like any other.

Defined cases
* a null field is ``-``; a null language is a language of its own, the first;
* rows with one doc_id are ordered by their leaf, a null doc_id comes first;
* a language of one row has its leaf as subroot, a table of one language its
  subroot as root; the proof is then the H of nothing, or of the rest;
* an empty table gives an empty result; columns of other names are not looked at;
* ``n_chars`` of any size can be tampered with; without doc_id nothing is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table
from concordia.operators.keys import global_row_number
from concordia.session import Scratch

ARITY = 2
LEVELS = 10             # levels of a segment: 1,024 nodes below it
TAMPERED = 7            # rows whose crc32 this divides
SMALL = 1 << 17         # rows (of some 100 bytes) up to which a table is broadcast

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(inputs) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def framed(value: Column) -> Column:
    """A field as its byte count and its value, ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    return F.sha2(F.concat(*(framed(n_chars if c == "n_chars" and n_chars is not None else F.col(c)) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): tree names the language and sorts as
    languages do; tampered is the leaf of the changed row, null where nothing
    was changed."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("leaf"), F.when(chosen & F.col("n_chars").isNotNull(), leaf(more)).alias("tampered"))


def levels_of(n: int, arity: int = ARITY) -> int:
    """Levels that join n nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def ranked(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``pos``, the rank from 0 within the tree, and ``m``, the
    nodes of the tree."""
    rows = scratch.cut(global_row_number(nodes, ["tree", *order], "_row"), "ranked")
    sizes = scratch.cut(rows.groupBy("tree").agg(F.min("_row").alias("_first"), F.count("*").alias("m")), "sizes")
    return rows.join(small(sizes), "tree").withColumn("pos", F.col("_row") - F.col("_first")).drop("_row", "_first")


_SEGMENT = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("digest", pa.string()),
                      ("height", pa.int32()), ("parents", pa.list_(pa.string())), ("children", pa.list_(pa.list_(pa.string()))),
                      ("requests", pa.list_(pa.struct([("pos", pa.int64()), ("doc_id", pa.int64()),
                                                       ("leaf", pa.string()), ("tampered", pa.string())])))])
_SEGMENT_DDL = ("tree string, block long, m long, digest string, height int, parents array<string>, "
                "children array<array<string>>, requests array<struct<pos: long, doc_id: long, leaf: string, tampered: string>>")


def _build(arity: int, levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of every segment; a row has the nodes below it, at most arity ** levels."""
    for b in batches:
        for row in b.to_pylist():
            requests = sorted(row["requests"], key=lambda r: r["pos"])
            nodes = [r["leaf"] for r in requests]
            height = min(levels, levels_of(row["m"], arity))
            parents, children = [], []
            for _ in range(height):
                runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
                nodes = [H(run) for run in runs]
                parents += nodes
                children += runs
            yield emit(_SEGMENT, [row["tree"]], [row["block"]], [-(-row["m"] // arity ** height)], nodes, [height],
                       [parents], [children], [requests])


_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()),
                    ("tampered", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
_PATHS_DDL = ("tree string, pos long, doc_id long, leaf string, tampered string, path array<string>, "
              "subroot string, root string")


def descend(children: dict[str, list[str]], node: str, pos: int, height: int, arity: int) -> tuple[str, list[str]]:
    """(the node that the digits of ``pos`` lead to, what was not selected on the
    way): of every level, from below, the digests left and right of the path."""
    path: list[str] = []
    for level in range(height - 1, -1, -1):
        run = children[node]
        digit = pos // arity ** level % arity
        path += ["".join(run[digit + 1:]), "".join(run[:digit])]
        node = run[digit]
    return node, path[::-1]


def _descend(arity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            records = dict(zip(row["parents"], row["children"]))
            out = []
            for r in row["requests"]:
                reached, path = descend(records, row["digest"], r["pos"], row["height"], arity)
                if reached != r["leaf"]:
                    raise ValueError(f"the manifest leads to {reached}, not to {r['leaf']}")
                out.append((row["tree"], r["pos"], r["doc_id"], r["leaf"], r["tampered"], path + row["above"],
                            row["subroot"], row["root"]))
            yield emit(_PATHS, *zip(*out))


class Forest:
    """The trees over ranked nodes (tree, pos, m, doc_id, leaf, tampered): a
    written table of segments per round."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, arity: int = ARITY, levels: int = LEVELS):
        self.scratch, self.arity, self.levels = scratch, arity, levels
        self.rounds: list[DataFrame] = []
        while True:
            block = F.floor(F.col("pos") / arity ** levels)
            groups = nodes.groupBy("tree", block.alias("block"), "m").agg(  # at most arity ** levels of a block
                F.collect_list(F.struct("pos", "doc_id", "leaf", "tampered")).alias("requests"))
            segments = scratch.cut(groups.mapInArrow(partial(_build, arity, levels), _SEGMENT_DDL), "segments")
            self.rounds.append(segments)
            if not segments.where("m > 1").take(1):
                break
            none = F.lit(None)
            nodes = segments.where("m > 1").select("tree", F.col("block").alias("pos"), "m", none.cast("long").alias("doc_id"),
                                                   F.col("digest").alias("leaf"), none.cast("string").alias("tampered"))

    def roots(self) -> DataFrame:
        """(tree, digest)"""
        tops = [r.where("m = 1").select("tree", "digest") for r in self.rounds]
        out = tops[0]
        for t in tops[1:]:
            out = out.union(t)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The requests of the lowest round with their whole paths; ``above`` is
        the (tree, path, subroot, root) of every tree's root."""
        reached = None
        for k, segments in reversed(list(enumerate(self.rounds))):
            top = segments.where("m = 1").join(small(above.withColumnRenamed("path", "above")), "tree")
            if reached is not None:  # the segment's root was a request of the round above
                below = reached.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
                top = top.unionByName(segments.where("m > 1").join(below, ["tree", "block"]))
            reached = top.mapInArrow(partial(_descend, self.arity), _PATHS_DDL)
            if k:
                reached = self.scratch.cut(reached, "paths")
        return reached


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(path) / 2).cast("int")), start,
                       lambda node, i: F.when(2 * i < F.size(path), F.sha2(
                           F.concat(F.get(path, 2 * i), node, F.get(path, 2 * i + 1)), 256)).otherwise(node))


def proofs(docs: DataFrame, scratch: Scratch, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Every row with its leaf, its path and the digests above it."""
    rows = scratch.cut(leaves(docs), "leaves")
    forest = Forest(ranked(rows, ["doc_id", "leaf"], scratch), scratch, arity, levels)
    subroots = scratch.cut(forest.roots().withColumnRenamed("tree", "name"), "subroots")
    named = ranked(subroots.select(F.lit("").alias("tree"), "name", F.col("digest").alias("leaf")), ["name"], scratch)
    named = scratch.cut(named, "names")
    top = Forest(named.select("tree", "pos", "m", F.lit(None).cast("long").alias("doc_id"), "leaf",
                              F.lit(None).cast("string").alias("tampered")), scratch, arity, levels)
    nothing = F.array().cast("array<string>")
    root = scratch.cut(top.roots().select("tree", nothing.alias("path"), F.lit("").alias("subroot"),
                                          F.col("digest").alias("root")), "root")
    above = scratch.cut(top.paths(root).join(named.select("pos", "name"), "pos").select(
        F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"), "root"), "above")
    return forest.paths(above)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, checked against a tampered copy."""
    with Scratch(spark, "merkle") as scratch:
        path = F.col("path")
        return scratch.keep(proofs(table(spark, sf_dir, "documents"), scratch).select(
            "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(path, ""), 256).alias("proof_sha256"),
            folded(F.coalesce("tampered", "leaf"), path).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _sql(levels: int = 18, top: int = 6) -> str:
    """Trees of up to 2 ** levels rows a language and 2 ** top languages."""
    fields = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    changed = fields.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
    ctes = [f"""docs AS (
  SELECT *, coalesce('=' || lang, '-') AS tree, sha256({fields}) AS leaf,
         CASE WHEN crc % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN sha256({changed}) END AS tampered
  FROM (SELECT d.*, {_CRC} AS crc FROM documents d))""",
            "ranks AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)",
            "a0 AS MATERIALIZED (SELECT tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS m FROM ranks)"]

    def tree(name: str, height: int):
        for k in range(height):
            ctes.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos // {ARITY} AS pos, CASE WHEN any_value(m) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node,
         (any_value(m) + {ARITY - 1}) // {ARITY} AS m FROM {name}{k} GROUP BY tree, pos // {ARITY})""")

    def siblings(name: str, height: int, base: int):
        return [f"SELECT q.tree, q.pos, {base + k} AS level, o.pos < q.pos // {ARITY ** k} AS before, o.node FROM {name}0 q "
                f"JOIN {name}{k} o ON o.tree = q.tree AND o.pos // {ARITY} = q.pos // {ARITY ** (k + 1)} AND o.pos <> q.pos // {ARITY ** k}"
                for k in range(height)]

    tree("a", levels)
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, tree AS name, node, count(*) OVER () AS m FROM a{levels})")
    tree("b", top)
    ctes.append(f"low AS MATERIALIZED ({' UNION ALL '.join(siblings('a', levels, 0))})")
    ctes.append(f"high AS MATERIALIZED ({' UNION ALL '.join(siblings('b', top, levels))})")
    ctes.append("""steps AS MATERIALIZED (SELECT tree, pos, level, before, node FROM low UNION ALL
  SELECT a.tree, a.pos, h.level, h.before, h.node FROM a0 a JOIN b0 b ON b.name = a.tree JOIN high h ON h.pos = b.pos)""")
    ctes.append("proof AS (SELECT tree, pos, sha256(string_agg(node, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, pos)")
    ctes.append(f"""f0 AS MATERIALIZED (SELECT r.*, a.m, b.node AS subroot, b.pos AS bpos, b.m AS bm, t.node AS root,
  coalesce(tampered, leaf) AS node FROM ranks r JOIN a0 a USING (tree, pos) JOIN b0 b ON b.name = r.tree CROSS JOIN b{top} t)""")
    for k in range(levels + top):
        grows = f"(m + {ARITY ** k - 1}) // {ARITY ** k} > 1" if k < levels else f"(bm + {ARITY ** (k - levels) - 1}) // {ARITY ** (k - levels)} > 1"
        ctes.append(f"""f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN {grows} THEN sha256(
  CASE WHEN s.before THEN s.node ELSE '' END || f.node || CASE WHEN s.before THEN '' ELSE coalesce(s.node, '') END)
  ELSE f.node END AS node) FROM f{k} f LEFT JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = {k})""")
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM f{levels + top} f LEFT JOIN proof p ON p.tree = f.tree AND p.pos = f.pos""")


#: crc32 of the id's decimal digits: DuckDB has none, so bit by bit over its bytes
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(d.doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL = _sql()
