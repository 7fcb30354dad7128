"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, staged

#: Above this many sources the rates are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def source_rates(sizes: DataFrame, source: str, size: str, weights: tuple[float, ...] = (1, 2, 3),
                 max_rate: float = 3.0) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target`` and ``rate`` = target / size.

    Sources in code-point order (null last) take ``weights`` in turn and share the total of
    all sizes by weight. A target stops at ``max_rate`` times its source's size; the excess
    is shared again by weight until no target is above. With the sources sorted by
    size / weight, the first ones are at the limit, and one pass of running sums finds
    where they end. The table has one row per source, so its windows are as small as the
    mixing recipe itself. A source of size 0 gets target 0 and rate 0; an empty table no row.
    """
    w = F.element_at(F.lit([float(x) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = (sizes.groupBy(F.col(f"`{source}`").alias("_source"))
           .agg(F.sum(f"`{size}`").alias("source_size"))
           .withColumn("_rank", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1)
           .withColumn("weight", w)
           .withColumn("_cap", F.col("source_size") * F.lit(float(max_rate))))
    by_ratio = W.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_rank").asc())
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        / F.sum("weight").over(onward)
    per = (per.withColumn("_level", level)
           .withColumn("_free", F.col("_cap") / F.col("weight") >= F.col("_level"))
           # the level of the first source below its limit holds for it and all that follow
           .withColumn("_water", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(everything))
           .withColumn("_free", F.max("_free").over(by_ratio.rowsBetween(W.unboundedPreceding, 0))))
    target = F.when(F.col("_free"), F.col("_water") * F.col("weight")).otherwise(F.col("_cap"))
    return per.select("_source", "source_size", "weight", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def unit_interval(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of ``key`` and ``seed`` (52 bits, the same in SQL)."""
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def mix_sources(docs: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id", text: str = "text",
                weights: tuple[float, ...] = (1, 2, 3), max_rate: float = 3.0, seed: int = 0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    A document is taken floor(rate) times, and once more if a number in [0, 1) hashed from
    its id and ``seed`` is below the fraction of the rate: reruns agree, and no document is
    taken more than ``max_rate`` times. Rows without id use their text as key; rows that repeat
    an id are drawn alike, all or none. Sizes are
    summed per source before any shuffle; ``docs`` is not shuffled (the rates, one row per
    source, are broadcast after a count of their rows, else joined by a shuffle whose skewed
    sources AQE splits). Null sources are one source. Columns of ``docs`` named like a
    result column are replaced.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    keep = [c for c in docs.columns if c.lower() not in new]
    key, out_source = fresh(docs, "_key", "_src")
    sized = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rates = staged(source_rates(sized, source, "size", weights, max_rate), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates.select(F.col("_source").alias(out_source), "source_size", "target", "rate"),
                        F.col(f"`{source}`").eqNullSafe(F.col(out_source)), "left")
    whole = F.floor("rate")
    u = unit_interval(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"), F.lit("")), seed)
    copies = whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", "rate",
                         copies.cast("int").alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of ``mixed`` as often as its ``copies`` say (0: not at all)."""
    n, = fresh(mixed, "_n")
    return (mixed.filter(F.col("copies") > 0)
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(n))
