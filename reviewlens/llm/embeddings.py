"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import staged
from reviewlens.llm.components import connected_components
from reviewlens.llm.forest import Forest, groups

#: Vectors of one side of a unit of work, and the mean size of a cell. Pivots: at most ``MAX_PIVOTS``.
CHUNK, MAX_PIVOTS = 4096, 1024
#: Vectors from which the pivots are picked, for each pivot.
SAMPLE = 4
_ROWS = 512
_EPS = 1e-9


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Each vector scaled to length 1, as doubles; None if null, empty, zero, or with a null or non-finite component."""
    out: list[bytes | None] = []
    for v in column:
        x = np.array(v.values.to_numpy(zero_copy_only=False) if v.is_valid else [], dtype=np.float64)
        top = np.abs(x).max() if len(x) else 0.0
        if not 0 < top < np.inf:  # also false for NaN
            out.append(None)
            continue
        x = x / top
        out.append((x / np.sqrt(x @ x)).tobytes())
    return out


def pick_pivots(sample: list[bytes], count: int) -> np.ndarray:
    """``count`` vectors of the sample, each the farthest from those picked before."""
    x = np.stack([np.frombuffer(b) for b in sample])
    picked, far = [0], 2 - 2 * (x @ x[0])
    while len(picked) < min(count, len(x)):
        i = int(far.argmax())
        picked.append(i)
        far = np.minimum(far, 2 - 2 * (x @ x[i]))
    return x[picked]


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell (nearest pivot) of each vector, and a matrix of the cells that it visits.

    A vector ``a`` with home i has a partner ``b`` with home j within ``radius`` only if
    d(a, j) <= d(b, j) + radius <= d(b, i) + radius <= d(a, i) + 2 * radius. In Euclidean
    space the distance to the plane between the two pivots tells more: it is
    (d(a, j)^2 - d(a, i)^2) / (2 * d(i, j)), and at most ``radius``. A pair of two homes is
    compared in the cell of the smaller number, so cells above the home are not visited.
    """
    square = np.maximum(0.0, 2 - 2 * (x @ pivots.T))
    home = square.argmin(axis=1)
    own = square[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))
    visits = np.sqrt(square) <= np.sqrt(own)[:, None] + 2 * radius + _EPS
    visits &= square - own[:, None] <= 2 * radius * apart[home] + _EPS
    visits &= np.arange(len(pivots))[None, :] < home[:, None]
    return home, visits


def join_unit(left: np.ndarray, right: np.ndarray, left_id: np.ndarray, right_id: np.ndarray, same: bool,
              min_cosine: float, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Links of each left and right vector (``same``: both sides are one list); ``forest`` gets what they connect."""
    n_left, n_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for at in range(0, len(left), _ROWS):
        near = left[at:at + _ROWS] @ right.T >= min_cosine
        near &= left_id[at:at + _ROWS, None] != right_id[None, :]
        if not near.any():
            continue
        n_left[at:at + _ROWS] += near.sum(axis=1)
        if not same:
            n_right += near.sum(axis=0)
        for rows, cols in groups(near):
            forest.join([*left_id[at + rows].tolist(), *right_id[cols].tolist()])
    return n_left, n_right


def _join_units(min_cosine: float):
    """Rows sorted by unit -> ``(link, a, b)``: links of the forest, and (False, uid, number of links)."""
    def flush(cols: list) -> list[tuple[bool, int, int]]:
        _, kind, i, j, side, uid, vec_id, unit = cols
        forest, out = Forest(), []
        x = np.frombuffer(b"".join(unit)).reshape(len(unit), -1)
        if kind[0] == 0 and i[0] == j[0]:
            pairs = [(np.arange(len(x)),) * 2]
        else:
            pairs = [(np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))] if side.min() != side.max() else []
        for a, b in pairs:
            n_a, n_b = join_unit(x[a], x[b], vec_id[a], vec_id[b], a is b, min_cosine, forest)
            for at, n in ((a, n_a), (b, n_b)):
                out += [(False, int(u), int(c)) for u, c in zip(uid[at[n > 0]], n[n > 0])]
        return out + [(True, a, b) for a, b in forest.links()]

    def to_batch(rows: list[tuple[bool, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.bool_(), pa.int64(), pa.int64()))], ["link", "a", "b"])

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in batches:
            cols = [*(c.to_numpy() for c in b.columns[:-1]), np.array(b.columns[-1].to_pylist(), dtype=object)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield to_batch(flush([c[s:e] for c in cols]))
            held = [c[cuts[-1]:] for c in cols]
        if held is not None and len(held[0]):
            yield to_batch(flush(held))
    return in_task


def range_join(vectors: DataFrame, min_cosine: float, chunk: int = CHUNK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``(link, a, b)`` for rows ``uid, vec_id, dim, unit``: see ``_join_units``.

    cosine >= c is Euclidean distance <= sqrt(2 - 2c) between unit vectors. Pivots (picked
    from a sample of bounded size) part the vectors of the commonest dimension into cells; each
    other dimension is a cell of its own, as vectors of different dimensions have no cosine.
    A cell's own vectors and its visitors (``cells_of``) are cut into pieces of about
    ``chunk`` by a hash; each pair of pieces with an own one is a unit, joined on its own by a
    matrix product. So a cell may hold any share of the vectors, no task holds more than two
    pieces, and no pair is written.
    """
    spark = vectors.sparkSession
    out = "link boolean, a long, b long"
    main = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if main is None:
        return spark.createDataFrame([], out)
    wanted = int(min(max_pivots, -(-main["count"] // chunk)))
    sample = (vectors.filter(F.col("dim") == main["dim"]).select("unit").orderBy(F.xxhash64("unit"), "unit")
              .limit(SAMPLE * wanted).collect())  # at most SAMPLE * max_pivots vectors
    pivots = pick_pivots([bytes(r["unit"]) for r in sample], wanted)
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    top, shared = main["dim"], spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            units = b.column("unit")
            inside = np.flatnonzero(dim == top)
            rows, cell, side = [np.flatnonzero(dim != top)], [-dim[dim != top].astype(np.int64)], [0]
            for at in range(0, len(inside), 1024):
                some = inside[at:at + 1024]
                x = np.frombuffer(b"".join(units.take(pa.array(some)).to_pylist())).reshape(len(some), -1)
                home, visits = cells_of(x, shared.value, radius)
                v, c = np.nonzero(visits)
                rows += [some, some[v]]
                cell += [home, c]
                side += [0, 1]
            side = np.concatenate([np.full(len(r), s, np.int32) for r, s in zip(rows, side)])
            got = b.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cell).astype(np.int64)), pa.array(side), got.column("uid"), got.column("vec_id"),
                 got.column("unit")], ["cell", "side", "uid", "vec_id", "unit"])

    dealt = staged(vectors.mapInArrow(deal, "cell long, side int, uid long, vec_id long, unit binary"), "vector-cells")
    one = F.count(F.when(F.col("side") == 0, 1))
    sizes = staged(dealt.groupBy("cell").agg(F.ceil(one / chunk).cast("int").alias("own_parts"),
                                             F.ceil((F.count("*") - one) / chunk).cast("int").alias("visit_parts")), "vector-sizes")
    parts = F.when(F.col("side") == 0, F.col("own_parts")).otherwise(F.col("visit_parts"))
    mine = F.pmod(F.xxhash64("uid"), parts).cast("int")
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.slice(F.sequence(F.lit(0), n), 1, n)  # noqa: E731  0 .. n-1, empty for 0
    own = F.concat(F.transform(upto(F.col("own_parts")), lambda k: unit(0, F.least("part", k), F.greatest("part", k))),
                   F.transform(upto(F.col("visit_parts")), lambda k: unit(1, F.col("part"), k)))
    visiting = F.transform(upto(F.col("own_parts")), lambda k: unit(1, k, F.col("part")))
    units = (dealt.join(sizes, "cell").withColumn("part", mine)
             .withColumn("x", F.explode(F.when(F.col("side") == 0, own).otherwise(visiting)))
             # within a unit: which of the two pieces a row is of
             .select("cell", "x.kind", "x.i", "x.j", F.when(F.col("x.kind") == 1, F.col("side"))
                     .otherwise(F.when(F.col("part") == F.col("x.i"), 0).otherwise(1)).cast("int").alias("side"),
                     "uid", "vec_id", "unit"))
    return (units.repartition("cell", "kind", "i", "j").sortWithinPartitions("cell", "kind", "i", "j")
            .mapInArrow(_join_units(min_cosine), out))


def embedding_dedup(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", min_cosine: float = 0.95,
                    chunk: int = CHUNK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings``.

    Vectors link at ``min_cosine`` or more, in double precision. ``n_links``: vectors of
    other ids linked directly; ``component_id``: the smallest id reachable; ``kept``: the id
    is its component's. Null, empty or zero vectors, vectors with null or non-finite
    components, and vectors without id link with nothing (n_links 0, their own component).
    Rows that repeat an id are vectors of one id: they do not link with each other, each
    counts for others, and they share a component.
    """
    def to_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = unit_vectors(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(u) // 8 if u else 0 for u in unit], pa.int32()),
                 pa.array(unit, pa.binary())], ["uid", "vec_id", "dim", "unit"])

    rows = embeddings.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                             F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    rows = staged(rows.mapInArrow(to_unit, "uid long, vec_id long, dim int, unit binary"), "vectors")
    found = staged(range_join(rows.filter("unit is not null and vec_id is not null"), min_cosine, chunk, max_pivots), "vector-links")
    counts = staged(found.filter("not link").groupBy(F.col("a").alias("_uid")).agg(F.sum("b").alias("n_links")), "vector-counts")
    roots = connected_components(found.filter("link"))
    return (rows.select("uid", "vec_id").join(counts, F.col("uid") == F.col("_uid"), "left")
            .join(roots, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
