"""Merkle manifest of a table: trees of digests in van Emde Boas layout.

Rows are leaves; each group of rows (a source) has a tree of its own, whose roots are the
leaves of one more tree. A tree of any size is made of *blocks*: aligned subtrees of
``FAN ** LEVELS`` leaves, built in one task each, whose roots are the leaves of the next tier.
Within a block the digests stand in van Emde Boas order: the subtree is split at half its
height, the top part first, then the bottom parts from left to right, each laid out likewise;
``addresses`` computes where a node stands. Construction, and the siblings that a proof needs,
use these addresses; a proof goes on over the block's root in the tier above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import staged

#: Children of a node, levels above the leaves of a full block.
FAN, LEVELS = 16, 3
LEAVES = FAN ** LEVELS
_HEX = 64
_KEYS = ("named", "g")


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after another: ``-`` for null, else number of UTF-8 bytes, ``:``, value."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
                             for v in parts]).cast("binary"), 256)


def _size(height: int) -> int:
    return (FAN ** height - 1) // (FAN - 1)


@lru_cache(maxsize=None)
def _by_depth(height: int) -> tuple[np.ndarray, ...]:
    if height == 1:
        return (np.zeros(1, np.int64),)
    top = height // 2
    roots = FAN ** top
    below = _size(top) + _size(height - top) * np.arange(roots)
    return (*_by_depth(top), *((below[:, None] + inner).ravel() for inner in _by_depth(height - top)))


def addresses(height: int, level: int) -> np.ndarray:
    """Where the nodes of a level (0: leaves) stand in the layout of a complete subtree with ``height`` levels."""
    return _by_depth(height)[height - 1 - level]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Block:
    """The digests of one subtree in van Emde Boas order; ``counts``: nodes of each level, leaves first."""

    height: int
    counts: list[int]
    nodes: np.ndarray

    @staticmethod
    def shape(leaves: int, height: int) -> list[int]:
        counts = [leaves]
        for _ in range(height - 1):
            counts.append(-(-counts[-1] // FAN))
        return counts

    @classmethod
    def build(cls, leaves: list[str], height: int) -> Block:
        counts = cls.shape(len(leaves), height)
        used = 1 + max(int(addresses(height, k)[:n].max()) for k, n in enumerate(counts))
        block = cls(height, counts, np.zeros((used, _HEX // 2), np.uint8))
        block.put(0, "".join(leaves))
        for k in range(1, height):
            below = block.level(k - 1)
            runs = range(0, len(below), _HEX * FAN)
            block.put(k, "".join(_digest(below[i:i + _HEX * FAN]) for i in runs))
        return block

    def put(self, level: int, digests: str) -> None:
        at = addresses(self.height, level)[:self.counts[level]]
        self.nodes[at] = np.frombuffer(bytes.fromhex(digests), np.uint8).reshape(-1, _HEX // 2)

    def level(self, level: int) -> str:
        return self.nodes[addresses(self.height, level)[:self.counts[level]]].tobytes().hex()

    @property
    def root(self) -> str:
        return self.level(self.height - 1)

    def paths(self) -> Iterator[tuple[list[str], list[str]]]:
        """For each leaf, the siblings to the left and to the right, level by level below the root."""
        levels = [self.level(k) for k in range(self.height - 1)]
        for i in range(self.counts[0]):
            left, right = [], []
            for k, digests in enumerate(levels):
                at = i // FAN ** k
                run = at // FAN * FAN * _HEX
                left.append(digests[run:at * _HEX])
                right.append(digests[(at + 1) * _HEX:run + FAN * _HEX])
            yield left, right


def fold(digest: str, left: list[str], right: list[str]) -> str:
    """The root that ``digest`` has with its siblings."""
    for a, b in zip(left, right):
        digest = _digest(a + digest + b)
    return digest


def _positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (place in their group, from 0) and ``total`` (rows of the group).

    Rows are sorted by range over all tasks, so a group of any size is spread; places follow
    from the counts of each group in each task.
    """
    columns = [*_KEYS, *order]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = staged(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}),
                    f"{name}-sorted", free_shuffles=True)
    counts = ranged.groupBy("part", *_KEYS).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    group = Window.partitionBy(*_KEYS)
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.select("part", *_KEYS, (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")),
                    f"{name}-counts")
    return (ranged.join(counts, ["part", *_KEYS])
            .withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift", *[c for c in order if c.startswith("_")]))


def _block_of(payload: list[tuple[str, pa.DataType]]) -> Callable:
    def in_group(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("pos").to_numpy())))
        total, n = table.column("total")[0].as_py(), table.num_rows
        height = LEVELS + 1
        if total <= LEAVES:  # the whole tree: as many levels as it needs
            height = 1
            while FAN ** (height - 1) < n:
                height += 1
        block = Block.build(table.column("digest").to_pylist(), height)
        one = [table.column(c)[:1] for c in (*_KEYS, "block", "total")]
        rest = [pa.array([height], pa.int32()), pa.array([n], pa.int32()), pa.array([block.nodes.tobytes()], pa.binary()),
                pa.array([block.root])]
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in payload]
        return pa.Table.from_arrays([*one, *rest, *lists],
                                    names=[*_KEYS, "block", "total", "height", "leaves", "nodes", "root", *[c for c, _ in payload]])
    return in_group


_BLOCK = "named boolean, g string, block long, total long, height int, leaves int, nodes binary, root string"


def _tiers(leaves: DataFrame, payload: list[tuple[str, str, pa.DataType]], name: str) -> list[DataFrame]:
    """Tables of blocks from the leaves up; the last blocks of each group hold its root."""
    tiers: list[DataFrame] = []
    while True:
        schema = ", ".join([_BLOCK, *[f"{c} array<{t}>" for c, t, _ in payload]])
        blocks = leaves.withColumn("block", F.floor(F.col("pos") / LEAVES)).groupBy(*_KEYS, "block").applyInArrow(
            _block_of([(c, t) for c, _, t in payload]), schema)
        tiers.append(staged(blocks, f"{name}-{len(tiers)}", free_shuffles=True))
        above = tiers[-1].filter(F.col("total") > LEAVES)
        if above.isEmpty():
            return tiers
        payload = []
        leaves = above.select(*_KEYS, F.col("block").alias("pos"), F.ceil(F.col("total") / LEAVES).alias("total"),
                              F.col("root").alias("digest"))


def _roots(tiers: list[DataFrame]) -> DataFrame:
    out = None
    for t in tiers:
        top = t.filter(F.col("total") <= LEAVES).select(*_KEYS, "root")
        out = top if out is None else out.unionByName(top)
    return out


@dataclass
class Manifest:
    """``tiers``: blocks of the groups' trees, leaves first; ``top``: of the tree over their roots; ``root``: of all (None: no rows).

    ``groups``: ``named, g`` (the group), its ``subroot`` and its place ``pos`` in the tree over the groups.
    """

    tiers: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None
    group: str
    doc_id: str


def build_manifest(docs: DataFrame, leaf: Column, doc_id: str = "doc_id", group: str = "source",
                   claimed: Column | None = None) -> Manifest:
    """The trees over ``leaf`` (hex digests of the rows of ``docs``), written to the shared folder.

    Leaves stand by ``doc_id`` (null first, then by digest: rows that repeat an id) within
    their ``group``; groups stand null first, then bytewise. ``claimed`` is a digest for
    ``audit`` to check in place of the leaf (null: the leaf itself). Texts are read once and
    never moved. Other columns play no part, whatever their names.
    """
    g, i = F.col(f"`{group}`"), F.col(f"`{doc_id}`")
    id_type = docs.schema[doc_id].dataType
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = docs.select(g.isNotNull().alias("named"), F.coalesce(g.cast("string"), F.lit("")).alias("g"), i.alias("doc"),
                         leaf.alias("digest"), claim.alias("claimed")).withColumn("_n", F.monotonically_increasing_id())
    leaves = staged(leaves.withColumn("claimed", F.nullif("claimed", "digest")), "merkle-leaves")
    payload = [("doc", id_type.simpleString(), leaves.limit(0).select("doc").toArrow().schema[0].type), ("claimed", "string", pa.string())]
    tiers = _tiers(_positions(leaves, ["doc", "digest", "_n"], "merkle"), payload, "merkle-blocks")
    subroots = _roots(tiers).select(F.lit(True).alias("named"), F.lit("").alias("g"), F.col("named").alias("c_named"),
                                    F.col("g").alias("c_g"), F.col("root").alias("digest"))
    placed = staged(_positions(subroots, ["c_named", "c_g"], "merkle-groups"), "merkle-groups")
    top = _tiers(placed.select(*_KEYS, "pos", "total", "digest"), [], "merkle-top")
    root = _roots(top).first()
    groups = placed.select(F.col("c_named").alias("named"), F.col("c_g").alias("g"), F.col("digest").alias("subroot"), "pos")
    return Manifest(tiers, top, groups, root and root["root"], group, doc_id)


def _block(height: int, leaves: int, nodes: bytes) -> Block:
    return Block(height, Block.shape(leaves, height), np.frombuffer(nodes, np.uint8).reshape(-1, _HEX // 2))


def _child_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            out = {"named": [], "g": [], "pos": [], "left": [], "right": []}
            for i, (left, right) in enumerate(_block(r["height"], r["leaves"], r["nodes"]).paths()):
                for c, v in zip(out, (r["named"], r["g"], r["block"] * LEAVES + i, left + r["left"], right + r["right"])):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["named"], pa.bool_()), pa.array(out["g"], pa.string()), pa.array(out["pos"], pa.int64()),
                 *[pa.array(out[c], pa.list_(pa.string())) for c in ("left", "right")]], list(out))


_PATHS = "named boolean, g string, pos long, left array<string>, right array<string>"


def _paths_down(tiers: list[DataFrame], paths: DataFrame, lowest: int, name: str) -> DataFrame:
    """Paths of the blocks of tier ``lowest`` (or, for -1, of the leaves of tier 0), from those of each group's top block.

    ``paths``: ``named, g, left, right``, one row a group.
    """
    below = None
    for k in range(len(tiers) - 1, lowest, -1):
        blocks = tiers[k].select(*_KEYS, "block", "total", "height", "leaves", "nodes")
        mine = blocks.filter(F.col("total") <= LEAVES).join(paths, [*_KEYS])
        if below is not None:
            more = blocks.filter(F.col("total") > LEAVES).join(below.withColumnRenamed("pos", "block"), [*_KEYS, "block"])
            mine = mine.unionByName(more)
        below = staged(mine.mapInArrow(_child_paths, _PATHS), f"{name}-{k}")
    tops = tiers[lowest].filter(F.col("total") <= LEAVES).select(*_KEYS, F.col("block").alias("pos")).join(paths, [*_KEYS]) if lowest >= 0 else None
    if tops is None:
        return below
    return tops if below is None else tops.unionByName(below)


def _audit(root: str, id_type: pa.DataType) -> Callable:
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = _block(r["height"], r["leaves"], r["nodes"])
                whole = block.level(0)
                above = "".join(a + z for a, z in zip(r["left"], r["right"]))
                leaf, proof, folded = [], [], []
                for i, (left, right) in enumerate(block.paths()):
                    leaf.append(whole[i * _HEX:(i + 1) * _HEX])
                    proof.append(_digest("".join(a + z for a, z in zip(left, right)) + above))
                    folded.append(fold(r["claimed"][i] or leaf[-1], left + r["left"], right + r["right"]))
                n = len(leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc"], id_type), pa.array([r["g"] if r["named"] else None] * n, pa.string()), pa.array(leaf),
                     pa.array([r["subroot"]] * n), pa.array([root] * n), pa.array(proof), pa.array(folded),
                     pa.array([x == root for x in folded])],
                    ["doc", "g", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return in_task


def audit(manifest: Manifest) -> DataFrame:
    """A row for each leaf: id, group, ``leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256``: digest of the siblings on the way to the root, level by level, left to
    right; ``folded_root``: the root that follows from the claimed digest and these siblings;
    ``verified``: whether that is the manifest's root. The group is a string.
    """
    m = manifest
    doc = m.tiers[0].schema["doc"].dataType.elementType
    schema = T.StructType([T.StructField("doc", doc), *[T.StructField(c, T.StringType()) for c in
                           ("g", "leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])
    spark = m.groups.sparkSession
    start = spark.createDataFrame([(True, "", [], [])], "named boolean, g string, left array<string>, right array<string>")
    of_groups = _paths_down(m.top, start, -1, "merkle-paths-top").select("pos", "left", "right")
    paths = staged(m.groups.join(of_groups, "pos").select(*_KEYS, "left", "right"), "merkle-paths")
    of_blocks = _paths_down(m.tiers, paths, 0, "merkle-paths").withColumnRenamed("pos", "block")
    blocks = (m.tiers[0].join(of_blocks, [*_KEYS, "block"]).join(m.groups.select(*_KEYS, "subroot"), [*_KEYS])
              .select(*_KEYS, "height", "leaves", "nodes", "doc", "claimed", "left", "right", "subroot"))
    arrow = m.tiers[0].limit(0).select("doc").toArrow().schema[0].type.value_type
    out = blocks.mapInArrow(_audit(m.root or "", arrow), schema)
    return out.withColumnsRenamed({"doc": m.doc_id, "g": m.group})
