"""Large CSV files read by many tasks, quoted newlines included.

A file is read as lines in splits of any size.  Whether a line starts a record
depends on how many quotes come before it in the file, so it is found in two passes:

1. every split counts its quotes, and the record starts that it would have after
   an even and after an odd number of quotes before it (one small row a split);
   prefix sums over the splits of a file tell each split its parity and how many
   records start before it;
2. every split puts its lines together to records.  What a record has in a later
   split is brought to it by its number; only these first and last records of a
   split are shuffled.

Records are numbered from the start of the file (the header is number 0), and files
in the order of their paths, so positions do not depend on how files are split.  A
quote inside a field must be doubled and its field quoted, as CSV asks.  Records of
white space only are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.session import cut_lineage

SMALL = 1 << 19  # splits (of some 100 bytes each) up to which their table is broadcast
POSITIONS = 1 << 40  # positions a file has to itself

_COUNTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())])
_PARTS = pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first row, end) of each split's rows in a batch."""
    file, block = batch.column(0), batch.column(1).to_numpy()
    change = np.flatnonzero(np.diff(block) != 0) + 1
    names = np.flatnonzero(pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(batch) > 1 else []
    cuts = sorted({0, *change.tolist(), *list(names), len(batch)})
    for a, b in zip(cuts, cuts[1:]):
        yield file[a].as_py(), int(block[a]), a, b


def _starts(lines: pa.Array, quotes: int) -> tuple[np.ndarray, int]:
    """(which lines start a record, quotes after them), given the quotes before."""
    n = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    before = quotes + np.cumsum(n) - n
    return before % 2 == 0, quotes + int(n.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, quotes, even, total = None, 0, 0, 0
    rows = []
    for b in batches:
        for file, block, a, z in _runs(b):
            if (file, block) != now:
                if now:
                    rows.append((*now, quotes, even, total - even))
                now, quotes, even, total = (file, block), 0, 0, 0
            starts, quotes = _starts(b.column(2)[a:z], quotes)
            even, total = even + int(starts.sum()), total + z - a
    if now:
        rows.append((*now, quotes, even, total - even))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _COUNTS)], schema=_COUNTS)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split: whole ones, and the parts of those that began
    before it or may go on behind it."""
    now, quotes, record = None, 0, 0
    part: list[str] = []        # lines of the record at hand
    began = False               # whether it began in this split

    def rest():
        return [(now[0], record, now[1], False, "\n".join(part))] if part else []

    for b in batches:
        out = []
        for file, block, a, z in _runs(b):
            if (file, block) != now:
                out += rest() if now else []
                now, part, began = (file, block), [], False
                quotes, record = int(b.column(3)[a].as_py()), int(b.column(4)[a].as_py()) - 1
            lines = b.column(2)[a:z]
            starts, quotes = _starts(lines, quotes)
            for line, start in zip(lines.to_pylist(), starts):
                if start:
                    if part:
                        out.append((file, record, block, began, "\n".join(part)))
                    record, part, began = record + 1, [line], True
                else:
                    part.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _PARTS)], schema=_PARTS)
    if now and part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest()), _PARTS)], schema=_PARTS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): every record of the files, numbered from 0 in each."""
    lines = _lines(spark, path)
    counts = cut_lineage(lines.mapInArrow(_count, "file string, block long, quotes long, even long, odd long"), "csv-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    at = counts.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    at = at.withColumn("n", F.when(F.col("before") % 2 == 0, F.col("even")).otherwise(F.col("odd")))
    at = at.select("file", "block", F.col("before") % 2, F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = cut_lineage(at.toDF("file", "block", "parity", "first"), "csv-starts")
    if at.count() > SMALL:  # another join would lose the order of the lines
        raise ValueError(f"{path}: more than {SMALL} splits; raise spark.sql.files.maxPartitionBytes")
    placed = lines.join(F.broadcast(at), ["file", "block"]).select("file", "block", "value", "parity", "first")
    parts = cut_lineage(placed.mapInArrow(_collect, "file string, record long, block long, whole boolean, text string"), "csv-parts")
    # at most two records of a split are not whole
    joined = (parts.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
              .select("file", "record", F.array_join(F.col("p.text"), "\n").alias("text")))
    return parts.where("whole").select("file", "record", "text").unionByName(joined)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """All-string frame named by the files' headers, and ``position``: the place of
    the row over all files.  Files may have different columns, or another order."""
    text = F.regexp_replace("text", r"\r$", "")
    records = read_records(spark, path).select("file", "record", text.alias("text")).where(F.trim("text") != "")
    records = cut_lineage(records, "csv-records")
    headers = records.where("record = 0").select("file", F.regexp_replace("text", "^\ufeff", "").alias("header"))
    files = cut_lineage(headers.withColumn("number", F.row_number().over(Window.orderBy("file")) - 1), "csv-files")  # a row per file
    files = F.broadcast(files) if files.count() <= SMALL else files
    rows = records.where("record > 0").join(files, "file").select(
        "header", (F.col("number").cast("long") * POSITIONS + F.col("record") - 1).alias("position"), "text")
    out = None
    for (header,) in headers.select("header").distinct().orderBy("header").collect():  # kinds of files, a few
        width = header.count(",") + 1
        first = spark.range(1).select(F.from_csv(F.lit(header), _columns(width), _OPTIONS).alias("r")).first().r
        part = rows.where(F.col("header") == header).select("position", F.from_csv("text", _columns(width), _OPTIONS).alias("r"))
        part = part.select("position", *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(first) if c])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "position long")


_OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}


def _columns(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))
