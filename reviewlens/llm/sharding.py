"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, null_first_row_hash, staged


def ring_positions(n_shards: int, vnodes: int, buckets: int) -> list[list[int]]:
    """The ring positions of each shard's virtual nodes; a shard's own do not depend on the others."""
    return [sorted({zlib.crc32(f"shard-{s}/{v}".encode()) % buckets for v in range(vnodes)}) for s in range(n_shards)]


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold: with no slack an exact split, else ``(1 + slack)`` times the mean."""
    if slack <= 0:
        return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    return [-int(-(1 + slack) * rows // n_shards)] * n_shards


def shard_rows(df: DataFrame, key: str, n_shards: int = 8, slack: float = 0.0, vnodes: int = 64,
               buckets: int = 4096, salts: int = 8) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row's key is hashed to one of ``buckets`` positions of a ring and goes to the shard of
    the next virtual node clockwise. A full shard passes what overflows on to the next other
    shard clockwise, so no shard holds more than ``(1 + slack)`` times the mean; with no
    slack the row counts differ by one at most.

    Only counts decide: rows are counted per unit (bucket and salt; ``buckets * salts`` units
    at every input size), units offer what they hold to their first shard, then their next,
    and each shard accepts in ring order up to its capacity. Rows are then ranked inside
    their unit, and the rank tells the shard and the slot. The salt (a hash of the whole
    row) splits the rows of a hot key over ``salts`` window groups. The unit table is
    broadcast; its size is bounded by the parameters.

    A null key takes its position from the hash of the whole row. Equal rows are
    interchangeable, so results do not depend on the order of reading. Columns named
    ``shard`` or ``slot`` are replaced; all columns must be of types that can be ordered.
    """
    spark = df.sparkSession
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    cols = list(df.columns)
    unit, pos, rank, segments = fresh(df, "_unit", "_pos", "_rank", "_segments")
    whole = null_first_row_hash(df, cols)
    h = F.coalesce(F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.lit("key"), F.col(f"`{key}`"))), whole)
    rows = df.select(*[F.col(f"`{c}`") for c in cols], h.alias(pos),
                     (F.pmod(h, F.lit(buckets)) * salts + F.pmod(F.shiftright(whole, 17), F.lit(salts))).alias(unit))
    rows = staged(rows, "shard-rows")

    ring = F.lit(ring_positions(n_shards, vnodes, buckets))
    bucket = F.floor(F.col("unit") / salts).cast("int")
    # shards in clockwise order from the bucket, by the distance to their nearest virtual node
    order = F.transform(F.array_sort(F.transform(
        ring, lambda ps, s: F.struct(F.array_min(F.transform(ps, lambda p: F.pmod(p - bucket, F.lit(buckets)))).alias("d"),
                                     s.alias("s")))), lambda x: x["s"])
    units = staged(rows.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n"))
                   .withColumn("order", order), "shard-units")
    total = units.agg(F.sum("n")).first()[0] or 0
    used, cap = [0] * n_shards, capacities(total, n_shards, slack)
    state = units.withColumn("left", F.col("n")).withColumn("segments", F.expr(
        "cast(array() as array<struct<first: bigint, shard: int, slot: bigint>>)"))
    for r in range(n_shards):
        if sum(used) == total:
            break
        by = W.partitionBy("to").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
        state = (state.withColumn("to", F.element_at("order", r + 1))
                 .withColumn("before", F.coalesce(F.sum("left").over(by), F.lit(0)))
                 .withColumn("room", F.element_at(F.lit([c - u for c, u in zip(cap, used)]).cast("array<bigint>"),
                                                  F.col("to") + 1))
                 .withColumn("got", F.greatest(F.lit(0), F.least("left", F.col("room") - F.col("before"))))
                 .withColumn("slot", F.element_at(F.lit(list(used)).cast("array<bigint>"), F.col("to") + 1)
                             + F.least("before", "room"))
                 .withColumn("segments", F.when(F.col("got") > 0, F.concat("segments", F.array(F.struct(
                     (F.col("n") - F.col("left")).alias("first"), F.col("to").alias("shard"), F.col("slot").alias("slot")))))
                     .otherwise(F.col("segments")))
                 .withColumn("left", F.col("left") - F.col("got")))
        state = staged(state.select("unit", "n", "order", "left", "segments", "to", "got"), "shard-round")
        for x in state.groupBy("to").agg(F.sum("got").alias("got")).collect():  # one row a shard
            used[x["to"]] += x["got"]
        state = state.drop("to", "got")

    placed = (rows.withColumn(rank, F.row_number().over(
        W.partitionBy(unit).orderBy(pos, *[F.col(f"`{c}`") for c in cols])) - 1)
        .join(F.broadcast(state.select(F.col("unit").alias(unit), F.col("segments").alias(segments))), unit))
    seg = F.element_at(F.filter(F.col(segments), lambda x: x["first"] <= F.col(rank)), -1)
    return placed.withColumn(pos, seg).select(
        *[F.col(f"`{c}`") for c in cols], F.col(pos)["shard"].alias("shard"),
        (F.col(pos)["slot"] + F.col(rank) - F.col(pos)["first"]).alias("slot"))
