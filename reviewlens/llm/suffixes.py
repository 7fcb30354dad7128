"""Repeated byte strings across documents, by sorting suffixes (suffix-array deduplication).

A suffix for each byte would be a hundred times the text. Instead, suffixes start at *anchors*
that the text itself chooses: the place with the smallest hash of ``gram`` bytes among all
windows of ``length`` bytes that hold it. Equal windows choose the same anchor, so windows can
only be equal if their anchors' suffixes share their leading token (the ``gram`` bytes).

A *unit* is a run of neighbouring windows of one anchor, told by two tokens: ``key``, a string
that lies in each of the windows, and ``full``, the string that all of them cover. Units are
range-partitioned by their leading tokens (Spark samples the splitters), each bucket is sorted
by multikey quicksort, and neighbours are compared, across the ends of buckets, too. A unit
whose ``full`` occurs earlier is repeated as a whole; a unit that shares its ``key`` with other
units may be repeated in part and is cut into shorter units for the next round: all windows of
an anchor, then eight, then one. Tokens are 64-bit names each, so equality is on 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import textvec as V
from reviewlens.llm.common import fresh, staged, table_of

GRAM = 32
#: Longer texts are looked at in pieces of so many window starts.
PIECE = 1 << 20
#: Units in a bucket, about; a bucket is sorted in one task's memory.
BUCKET_UNITS = 500_000
#: Place of a unit in one number: start, windows less one, distance of the anchor from the start.
FIELD = 14
_MASK = (1 << FIELD) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPREAD = np.uint64(0xA0761D6478BD642F)
_AT_BITS = np.uint64(23)  # of a position in a piece
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_UNITS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "full", "doc", "row", "at")])
_DECIDED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc", "row", "at", "state", "bucket")),
                         T.StructField("edge", T.ArrayType(T.LongType()))])
REPEATED, CUT, OPEN, EDGE = 1, 2, 3, 9


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        got = _POWERS[base, inverse] = V._powers(np.uint64(pow(base, -1, 1 << 64) if inverse else base), max(n, PIECE))
    return got


class Names:
    """64-bit names of byte strings of one piece, from two running sums (``which``: 0 or 1)."""

    def __init__(self, data: np.ndarray):
        n, value = len(data), data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in _BASES:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(value * _powers(base, True, n)[:n], out=s[1:])
            self.sums.append(s)

    def __call__(self, which: int, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        s = self.sums[which]
        h = (s[ends] - s[starts]) * _powers(_BASES[which], False, len(s))[starts]
        return V.mixed(h + np.asarray(salt).astype(np.uint64) * _SPREAD)


def pieces(column: pa.Array, more: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """``(first row, bytes, offsets, start, room)``: blocks of whole texts, and long texts in overlapping pieces.

    A piece begins at byte ``start`` of its text; starts of windows below ``room`` belong to it,
    and ``more`` bytes beyond are there to complete them.
    """
    for first, data, offsets in V.blocks(column):
        if len(data) <= PIECE + more:
            yield first, data, offsets, 0, len(data)
            continue
        for start in range(0, len(data), PIECE):
            part = data[start:start + PIECE + more]
            yield first, part, np.array([0, len(part)]), start, PIECE


def anchors(data: np.ndarray, offsets: np.ndarray, names: Names, length: int, gram: int, room: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, anchor)`` of each run of window starts that have one anchor (the leftmost smallest hash)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    at = np.arange(len(data) - gram + 1)
    low = (np.uint64(1) << _AT_BITS) - np.uint64(1)
    best = (names(0, at, at + gram) & ~low) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[:len(best) - (width - have)], best[width - have:])
    anchor = (best & low).astype(np.int64)
    start = np.arange(len(anchor))
    of = V.owner(start, offsets)
    ok = (start + length <= offsets[of + 1]) & (start < room)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | ~ok[:-1]
    last = np.ones(len(anchor), bool)
    last[:-1] = new[1:] | ~ok[1:]
    first = np.flatnonzero(new & ok)
    return first, np.flatnonzero(last & ok) - first + 1, anchor[first]


def _columns(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in arrays],
                                      _UNITS.names)


def _pack(start: np.ndarray, windows: np.ndarray, off: np.ndarray) -> np.ndarray:
    return start << (2 * FIELD) | (windows - 1) << FIELD | off


def _anchor_units(length: int, gram: int) -> Callable:
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets, start, room in pieces(b.column(2), 2 * length):
                names = Names(data)
                p, n, a = anchors(data, offsets, names, length, gram, room)
                of = V.owner(p, offsets)
                yield _columns(names(0, a, a + gram), names(1, p, p + n + length - 1, n << FIELD | (a - p)),
                               doc[of + first], row[of + first], _pack(p - offsets[of] + start, n, a - p))
    return in_task


def _cut_units(length: int, width: int) -> Callable:
    """Units of ``width`` windows at most, from the places in the last column; their ends are at multiples of ``width`` before the anchor."""
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = b.column(3)
            ends, places = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for first, data, offsets, start, room in pieces(b.column(2), 2 * length):
                k = len(offsets) - 1
                mine = places[ends[first]:ends[first + k]]
                of = np.repeat(np.arange(k), np.diff(ends[first:first + k + 1]))
                p = (mine >> (2 * FIELD)) - start
                here = (p >= 0) & (p < (room if start or room < len(data) else len(data)))
                mine, of, p = mine[here], of[here], p[here]
                high = mine & _MASK                       # distance of the first window from the anchor
                low = high - (mine >> FIELD & _MASK)      # and of the last one
                count = high // width - low // width + 1
                each = np.repeat(np.arange(len(mine)), count)
                j = low[each] // width + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                a = (p + high + offsets[of])[each]
                high, low = np.minimum(high[each], j * width + width - 1), np.maximum(low[each], j * width)
                of = of[each]
                names, core, s, n = Names(data), a - j * width, a - high, high - low + 1
                yield _columns(names(0, core, core - (width - 1) + length, j), names(1, s, s + n + length - 1, n << FIELD | high),
                               doc[of + first], row[of + first], _pack(s - offsets[of] + start, n, high))
    return in_task


def multikey_order(tokens: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """Order of rows by their tokens: three-way quicksort on one token, equal rows going on to the next one.

    Parts of at most ``small`` rows are finished by one sort on the tokens left.
    """
    out = np.empty(len(tokens[0]), np.int64)
    todo = [(np.arange(len(out)), 0, 0)]
    while todo:
        rows, depth, at = todo.pop()
        if len(rows) <= small or depth == len(tokens) - 1:
            out[at:at + len(rows)] = rows[np.lexsort([t[rows] for t in tokens[:depth - 1 if depth else None:-1]])]
            continue
        value = tokens[depth][rows]
        pivot = np.sort(value[:: max(1, len(value) // 255)])
        pivot = pivot[len(pivot) // 2]
        less, more = value < pivot, value > pivot
        n, m = int(less.sum()), len(rows) - int(more.sum())
        if n:
            todo.append((rows[less], depth, at))
        todo.append((rows[~less & ~more], depth + 1, at + n))
        if m < len(rows):
            todo.append((rows[more], depth, at + m))
    return out


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row, the last index at or before it that is ``new``."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: repeated units, units to cut, units of the first group that do not repeat inside the bucket, and its edges."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    cols = [np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(5)]
    bucket = got[0].column(5)[0].as_py()
    del got
    order = multikey_order(cols)
    key, full, doc, row, at = (c[order] for c in cols)
    change = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
    new_key = change(key)
    new_group = new_key | change(full)
    new_row = new_group | change(doc) | change(row)
    repeated = (doc > doc[_starts(new_group)]) | (at > at[_starts(new_row)])
    number = np.cumsum(new_key) - 1
    several = np.bincount(number, weights=new_group)[number] > 1
    several |= (key == key[0]) | (key == key[-1])  # the neighbouring bucket may hold the same key
    first = np.cumsum(new_group) == 1
    state = np.where(repeated, REPEATED, np.where(first, OPEN, np.where(several, CUT, 0)))
    keep = np.flatnonzero(state)
    group, own = _starts(new_group)[-1], _starts(new_row)[-1]
    edge = [key[0], full[0], key[-1], full[-1], doc[group]]
    fields = [np.append(c[keep], x) for c, x in ((doc, doc[-1]), (row, row[-1]), (at, at[own]), (state, EDGE))]
    yield pa.RecordBatch.from_arrays(
        [*map(pa.array, fields), pa.array(np.full(len(keep) + 1, bucket, np.int64)),
         pa.array([None] * len(keep) + [[int(x) for x in edge]], type=pa.list_(pa.int64()))], _DECIDED.names)


def _carried(edges: list) -> list[tuple]:
    """``(bucket, first doc, doc, row, at)`` for buckets whose first group began in an earlier one: where it began, its last row."""
    out, before = [], None
    for e in edges:  # one for each bucket
        first, last, doc, at = tuple(e.edge[:2]), tuple(e.edge[2:4]), e.edge[4], e.at
        if before is not None and before[0] == first:
            _, began, seg, seg_at = before
            out.append((e.bucket, began, *seg, seg_at))
            if first == last:
                doc = began
                at = seg_at if seg == (e.doc, e.row) else at
        before = (last, doc, (e.doc, e.row), at)
    return out


def decided(units: DataFrame, buckets: int, name: str) -> DataFrame:
    """``doc, row, at, state`` of the units that are ``REPEATED`` or to be ``CUT``."""
    spark = units.sparkSession
    ranged = units.repartitionByRange(buckets, *_UNITS.names).withColumn("bucket", F.spark_partition_id().cast("long"))
    marked = staged(ranged.mapInArrow(_decide, _DECIDED), name, free_shuffles=True)
    edges = marked.filter(F.col("state") == EDGE).orderBy("bucket").collect()  # one row a bucket
    carried = table_of(spark, _carried(edges), "bucket long, began long, c_doc long, c_row long, c_at long")
    open_ = marked.filter(F.col("state") == OPEN).join(F.broadcast(carried), "bucket", "left")
    again = (F.col("doc") > F.col("began")) | ((F.col("doc") == F.col("c_doc")) & (F.col("row") == F.col("c_row"))
                                              & (F.col("at") > F.col("c_at")))
    closed = open_.withColumn("state", F.when(F.coalesce(again, F.lit(False)), F.lit(REPEATED)).otherwise(F.lit(CUT)).cast("long"))
    columns = ["doc", "row", "at", "state"]
    return marked.filter(F.col("state").isin(REPEATED, CUT)).select(*columns).unionByName(closed.select(*columns))


def _with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """The rows of ``texts`` with the list of their ``at``; the lists, not the texts, are hashed in memory."""
    lists = places.groupBy("doc", "row").agg(F.collect_set("at").alias("places"))
    return texts.join(lists.hint("shuffle_hash"), ["doc", "row"], how)


def _kept(length: int, at_text: int, schema: T.StructType) -> Callable:
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept = [], []
            places = b.column(b.num_columns - 1)
            for i, text in enumerate(b.column(at_text).cast(pa.large_binary())):
                view = memoryview(text.as_buffer() or b"")
                if not places[i].is_valid:
                    spans.append([])
                    kept.append(bytes(view))
                    continue
                units = np.sort(places[i].values.to_numpy())
                start = units >> (2 * FIELD)
                end = np.maximum.accumulate(start + (units >> FIELD & _MASK) + length)
                new = np.concatenate(([True], start[1:] > end[:-1]))
                start, end = start[new], end[np.concatenate((new[1:], [True]))]
                spans.append([{"start": s, "length": e - s} for s, e in zip(start.tolist(), end.tolist())])
                cuts = zip([0, *end.tolist()], [*start.tolist(), len(view)])
                kept.append(b"".join(view[x:y] for x, y in cuts))
            rest = [c for i, c in enumerate(b.columns[2:-1], 2) if i != at_text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, schema["spans"]), pa.array(kept, pa.binary())],
                                             [*[n for i, n in enumerate(b.schema.names[2:-1], 2) if i != at_text], "spans", "kept"])
    return in_task


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """The columns of ``docs`` but its text, with ``spans`` (removed runs: start, length in bytes) and ``kept`` (binary).

    A byte of the UTF-8 text is removed if some ``length`` bytes that cover it also start
    earlier: in a document with a smaller id, or earlier in the same one. Matches do not cross
    documents and are judged on the whole input, not on what is left. Cuts may fall inside a
    character, so ``kept`` is binary.

    ``doc_id`` is a whole number; null ids come last, as one id. Rows that share an id are told
    by their text and do not make each other repeated; equal rows get equal results. Null and
    empty texts have nothing to remove and an empty ``kept``. Columns named ``spans`` or
    ``kept`` in any case are replaced.
    """
    spark = docs.sparkSession
    gram = max(1, min(GRAM, length // 3))
    rest = [c for c in docs.columns if c != text and c.lower() not in ("spans", "kept")]
    names = fresh(docs, *[f"_{i}" for i in range(len(rest))])
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                       F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)])
    texts = rows.select("doc", "row", "text").filter(F.octet_length("text") >= length)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, 2 * size // ((length - gram + 1) * BUCKET_UNITS) + 1)

    found, last = [], None
    for width in sorted({length - gram + 1, min(8, length - gram + 1), 1}, reverse=True):
        if last is None:
            units = texts.mapInArrow(_anchor_units(length, gram), _UNITS)
        else:
            places = last.filter(F.col("state") == CUT)
            units = _with_places(texts, places, "inner").mapInArrow(_cut_units(length, width), _UNITS)
        last = decided(units, buckets, f"suffixes-{width}")
        found.append(last.filter(F.col("state") == REPEATED).select("doc", "row", "at"))
    out = _with_places(rows, reduce(DataFrame.unionByName, found), "left")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    arrow = {"spans": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))}
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in zip(rest, names)],
                           T.StructField("spans", spans), T.StructField("kept", T.BinaryType())])
    out = out.select("doc", "row", "text", *names, "places").mapInArrow(_kept(length, 2, arrow), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(rest, names)], "spans", "kept")
