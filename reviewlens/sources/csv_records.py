"""CSV records from splits of a file, where quoted cells may hold line breaks.

Whether a line begins inside a quoted cell depends on everything before it in its file. But a
block of lines can only do four things to that state: keep it, turn it around, or end inside
or outside whatever it was. So every block is read once for what it does, a window over the
blocks (one row a split) tells each one's state at its start, and a second read puts lines
together to records; records that lie over the end of a block are joined from their parts.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.session import staged

QUOTE, COMMA = '"', ","
#: Complete record, end of a record that began earlier, whole block inside one cell, beginning of a record that goes on.
WHOLE, END, MIDDLE, BEGIN = 0, 1, 2, 3


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``. A quote opens a cell at its very start only; two in a cell are one character."""
    i = 0
    while True:
        if not inside:
            if line[i:i + 1] != QUOTE:
                i = line.find(COMMA + QUOTE, i)
                if i < 0:
                    return False
                i += 1
            i += 1  # past the quote
        while True:
            i = line.find(QUOTE, i)
            if i < 0:
                return True
            if line[i + 1:i + 2] != QUOTE:
                break
            i += 2
        inside, i = False, i + 1
        if line[i:i + 1] == QUOTE:
            continue
        i = line.find(COMMA, i)  # what follows a closing quote belongs to the cell
        if i < 0:
            return False
        i += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, list]]:
    """``file, block start, lines, other values`` of neighbouring rows of one block."""
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(1).to_numpy()
        file = b.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield b.column(0)[a].as_py(), int(block[a]), b.column(2).slice(a, z - a), [c[a].as_py() for c in b.columns[3:]]


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each run of lines does to the state: open after it if it began outside, if it began inside."""
    names = ["file", "block", "seq", "from_out", "from_in"]
    for n, (file, block, lines, (first,)) in enumerate(_runs(batches)):
        out, ins = False, True
        for line in lines.filter(pc.match_substring(lines, QUOTE)).to_pylist():
            out, ins = ends_inside(line, out), ends_inside(line, ins)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, block, first, out, ins)], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of each block, in order: ``file, block, n, kind, value``; ``n`` counts a block's records from 0."""
    now, inside, held, n, begun = None, False, [], 0, True

    def flush(kind: int):
        nonlocal held
        value, held = "\n".join(held), []
        return [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([kind], pa.int64()), pa.array([value])]

    def batch(columns):
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "kind", "value"])

    for file, block, lines, (start_inside,) in _runs(batches):
        if now != (file, block):
            if held:
                yield batch(flush(BEGIN if begun else MIDDLE))
            now, inside, n, begun = (file, block), start_inside, 0, not start_inside
        quoted = np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)).tolist()
        at = 0
        for q in [*quoted, len(lines)]:
            plain = lines.slice(at, q - at)
            if inside:
                held += plain.to_pylist()
            elif len(plain):
                k = len(plain)
                yield batch([pa.array([file] * k), pa.array(np.full(k, block)), pa.array(np.arange(n, n + k)),
                             pa.array(np.zeros(k, np.int64)), plain])
                n += k
            at = q + 1
            if q == len(lines):
                break
            line = lines[q].as_py()
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                yield batch(flush(WHOLE if begun else END))
                n, begun = n + begun, True
    if held:
        yield batch(flush(BEGIN if begun else MIDDLE))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, n, value``: the records of CSV files, each told by where it begins (block start, number in the block).

    Lines end with LF or CRLF; a CRLF inside a quoted cell stays as it is. Files are read in
    splits, whatever their cells hold. A cell that is never closed takes the rest of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    with_seq = lines.withColumn("seq", F.monotonically_increasing_id())
    effects = with_seq.mapInArrow(_effects, "file string, block long, seq long, from_out boolean, from_in boolean")
    # runs of a block to blocks, blocks to their state: a constant wins over what is before it, a turn flips it
    order = Window.partitionBy("file").orderBy("block", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    effects = effects.select("file", "block", "seq", "from_out", "from_in",
                             (F.col("from_out") & ~F.col("from_in")).cast("int").alias("turn"),
                             F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").cast("int")).alias("fixed"))
    counted = effects.withColumns({"so_far": F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    mark = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "so_far")), ignorenulls=True).over(before)
    state = (F.coalesce(F.col("mark.fixed"), F.lit(0)) + F.col("so_far") - F.col("turn") - F.coalesce(F.col("mark.so_far"), F.lit(0))) % 2 == 1
    states = (counted.withColumn("mark", mark).withColumn("inside", state)
              .groupBy(F.col("file").alias("_f"), F.col("block").alias("_b")).agg(F.min_by("inside", "seq").alias("inside")))
    states = staged(states, "csv-states")  # one row a split of the input: a few bytes for each 128 MB
    pieces = (lines.join(F.broadcast(states), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
              .select("file", "block", "value", "inside").mapInArrow(_pieces, "file string, block long, n long, kind long, value string"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "n", "value")
    parts = pieces.where(F.col("kind") != WHOLE)  # two a block at most
    along = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = (parts.withColumn("record", F.sum((F.col("kind") == BEGIN).cast("int")).over(along)).groupBy("file", "record")
              .agg(F.min(F.struct("block", "n")).alias("at"),
                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))), lambda x: x["value"]), "\n").alias("value")))
    return whole.unionByName(joined.select("file", "at.block", "at.n", "value")).withColumn(
        "value", F.regexp_replace("value", r"\r\z", "")).where(F.col("value") != "")


def header_names(header: str) -> list[str]:
    """Column names of a header record; empty ones by number, repeated ones with their number."""
    names = next(csv.reader([header.removeprefix("\ufeff")]), [])
    names = [n if n else f"_c{i}" for i, n in enumerate(names)]
    low = [n.lower() for n in names]
    return [n + str(i) if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _first_lines(spark: SparkSession, path: str | list[str]) -> tuple[str] | None:
    """The first line of the first file, if it is a whole record there; None sends the caller to the records."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    heads = lines.where(F.col("block") == 0).mapInArrow(_first_of_run, "file string, value string")
    top = heads.groupBy("file").agg(F.count("*").alias("n"), F.first("value").alias("value")).orderBy("file").first()
    if top is None or top.n != 1 or ends_inside(top.value, False) or not top.value.removesuffix("\r"):
        return None
    return (top.value.removesuffix("\r"),)


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, value`` of the first row of each run of a file's rows."""
    before = None
    for b in batches:
        if b.num_rows:
            files = b.column(0).to_pylist()
            keep = [i for i, f in enumerate(files) if f != (files[i - 1] if i else before)]
            before = files[-1]
            yield b.select([0, 2]).take(pa.array(keep, pa.int64()))


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, all columns as text; the header of the first file names the columns."""
    records = csv_records(spark, path)
    is_head = (F.col("block") == 0) & (F.col("n") == 0)
    top = _first_lines(spark, path) or records.where(is_head).orderBy("file").select("value").first()
    if top is None:
        return spark.createDataFrame([], T.StructType([]))
    names = header_names(top[0])
    options = {"quote": QUOTE, "escape": QUOTE, "emptyValue": "", "multiLine": "true", "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return records.where(~is_head).select(F.from_csv("value", schema, options).alias("r")).select("r.*")
