"""SimHash near-duplicates: segment bit counts, a grid join in Manhattan distance, exact check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, staged
from reviewlens.llm.components import connected_components
from reviewlens.llm.forest import Forest, groups

#: Members of a grid cell that are compared in one piece; larger cells are compared piece by piece.
CHUNK = 1024
_STEP = 1 << 15
_RUN_BYTES = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the words' shingles (unsigned): a bit is set if over half of the hashes set it.

    Words are runs without ASCII white space, A-Z lower-cased; shingles count as often as they
    occur and hash with XXH64, seed 42. Fewer words than a shingle: the whole sequence is one
    shingle. No word (or null): 0.
    """
    counts, total, held = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_runs((text or "").encode().lower()):
        words = held + words
        if len(words) >= shingle:
            total += _count_bits(words, shingle, counts)
            held = words[len(words) - shingle + 1:]
        else:
            held = words
    if not total and held:
        total = _count_bits(held, len(held), counts)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs, so that a very long text is not a list of all its words at once."""
    at = 0
    while at < len(data):
        end = at + _RUN_BYTES
        if end < len(data) and (m := _WHITE.search(data, end)):
            end = m.start()
        elif end < len(data):
            end = len(data)
        yield data[at:end].split()
        at = end


def _count_bits(words: list[bytes], shingle: int, counts: np.ndarray) -> int:
    """Adds to ``counts`` how many shingle hashes have each bit; the number of shingles."""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends[:-1]], ends[shingle - 1:]
    xxh = xxhash.xxh64_intdigest
    h = np.fromiter((xxh(joined[a:b - 1], 42) for a, b in zip(starts, ends)), dtype="<u8", count=len(ends))
    for i in range(0, len(h), _STEP):
        bits = np.unpackbits(h[i:i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return len(h)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """The other columns of ``docs`` and ``fp``, the signed 64-bit fingerprint of the text."""
    rest = [c for c in docs.columns if c not in (text, "fp")]

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()), dtype=np.uint64,
                              count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*b.schema.names[:-1], "fp"])

    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    return rows.mapInArrow(in_task, docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("fp", "long"))


def embedding(fp: Column, width: int = 2) -> Column:
    """Bit counts of the segments of ``width`` bits, each written as that many low one-bits of its segment.

    The Manhattan distance of two count vectors is the number of bits in which these codes
    differ, and never more than the bit distance of the fingerprints.
    """
    out = F.lit(0).cast("long")
    for at in range(0, 64, width):
        w = min(width, 64 - at)
        count = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)))
        out = out.bitwiseOR(F.shiftleft(F.element_at(F.lit([(1 << n) - 1 for n in range(w + 1)]).cast("array<bigint>"),
                                                     count + 1), at))
    return out


def cell_masks(max_bits: int, blocks: int, width: int = 2) -> list[int]:
    """The axes that span each grid: all choices of ``blocks - max_bits`` of the blocks of segments (signed masks).

    Counts at Manhattan distance ``max_bits`` differ in that many blocks at most, so they
    agree in all others, and any such pair shares a cell of at least one grid.
    """
    segments = [(1 << min(width, 64 - at)) - 1 << at for at in range(0, 64, width)]
    parts = [sum(int(x) for x in p) for p in np.array_split(np.array(segments, dtype=object), blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(fp: np.ndarray, code: np.ndarray, part: np.ndarray, max_bits: int, cross: bool) -> list[tuple[int, int]]:
    """Links that connect what the close pairs of one unit connect: (member, root)."""
    forest = Forest()
    left, right = (part == part.min(), part == part.max()) if cross else (slice(None), slice(None))
    bits, codes = fp.view(np.uint64), code.view(np.uint64)
    near = np.bitwise_count(codes[left][:, None] ^ codes[right]) <= max_bits  # the lower bound
    if not cross:
        np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    near[a, b] = np.bitwise_count(bits[left][a] ^ bits[right][b]) <= max_bits  # the exact check
    for rows, cols in groups(near):
        forest.join([*fp[left][rows].tolist(), *fp[right][cols].tolist()])
    return forest.links()


def _link_units(max_bits: int):
    """Rows sorted by unit -> links; a unit may reach over batches and has 2 * CHUNK rows or so."""
    def flush(cols: list[np.ndarray]) -> list[tuple[int, int]]:
        _, _, i, j, part, fp, code = cols
        if i[0] != j[0] and part.min() == part.max():
            return []
        return _links(fp, code, part, max_bits, bool(i[0] != j[0]))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new)]
            links = [x for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1 for x in flush([c[s:e] for c in cols])]
            held = [c[cuts[-1]:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held is not None and len(held[0]) > 1:
            links = flush(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
    return in_task


def near_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 5, width: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` that connect exactly what all close pairs connect.

    Each fingerprint is put into one cell of each grid (``cell_masks``); cells with one member
    are left out. A cell with more than ``chunk`` members is cut into pieces by a hash, and
    each pair of pieces is a unit of its own, so no task holds more than about two pieces
    whatever a cell holds. A unit gives a spanning forest, never all its pairs.
    """
    code = embedding(F.col("fp"), width)
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("cell"))
                      for i, m in enumerate(cell_masks(max_bits, blocks, width))])
    cells = (nodes.select("fp", code.alias("code")).withColumn("x", F.explode(grids))
             .select(F.col("x.grid").alias("grid"), F.col("x.cell").alias("cell"), "fp", "code"))
    cells = staged(cells, "simhash-cells")
    sizes = staged(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = (cells.join(sizes, ["grid", "cell"]).withColumn("parts", F.ceil(F.col("n") / chunk))
             .withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
             .select("grid", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                     "part", "fp", "code"))
    return (units.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
            .mapInArrow(_link_units(max_bits), "a long, b long"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2,
                       blocks: int = 5) -> DataFrame:
    """The columns of ``docs`` but its text, ``fp`` and ``component_id``: the smallest id reachable by links.

    Fingerprints link at ``max_bits`` or fewer differing bits; documents of equal fingerprint
    are linked (those without words too: fingerprint 0). Fingerprints are written once, grouped
    to distinct ones with partial aggregation, and linked by ``near_links``; at the end each
    document finds its component by its fingerprint, in a join whose hot keys AQE splits.

    Documents without id take part in links and get their component's smallest id (null if
    all ids are null). Repeated rows stay, with one component. Columns of ``docs`` named like
    a result column, in any case, are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("fp", "component_id")])
    key, = fresh(docs, "_fp")
    prints = staged(fingerprints(docs, text, shingle), "simhash-fp")
    nodes = staged(prints.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("low")), "simhash-nodes")
    roots = connected_components(near_links(nodes, max_bits, blocks))
    rooted = (nodes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    rooted = staged(rooted, "simhash-roots")
    lows = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    named = staged(rooted.join(lows, "root").select(F.col("fp").alias(key), "component_id"), "simhash-named")
    return prints.join(named, F.col("fp") == F.col(key)).drop(key)
