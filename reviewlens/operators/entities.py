"""Per-entity (business) review counts, top-k and the histogram of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_count(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct non-null entities."""
    return df.agg(F.count_distinct(F.col(id_col)).cast("bigint").alias("entity_count"))


def entity_review_counts(df: DataFrame, id_col: str) -> DataFrame:
    """Reviews per entity, count descending then key ascending; null keys dropped.

    ``groupBy`` with partial aggregation: a hot entity is pre-counted in every map task,
    so the shuffle carries one row per (task, entity) whatever the skew.
    """
    return (df.where(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("review_count"))
            .orderBy(F.col("review_count").desc(), F.col(id_col).asc()))


def top_entities(df: DataFrame, id_col: str, n: int = 20) -> DataFrame:
    """The ``n`` most reviewed entities (a top-k: TakeOrderedAndProject, no global sort)."""
    return entity_review_counts(df, id_col).limit(n)


def entity_count_histogram(df: DataFrame, id_col: str, bins: int = 50) -> DataFrame:
    """Histogram of per-entity review counts with ``bins`` equal-width bins (numpy rules).

    Bins are left-closed, the last one also holds the maximum; when all counts are equal
    the range is widened by 0.5 on each side. Empty bins are present with count 0. The
    table is read once: per-entity counts are reduced to (count, entities) pairs, of which
    there are at most about the square root of twice the rows, and bounds and bins come
    from those. Lazy; no entity, no row.
    """
    per_entity = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("x"))
    pairs = per_entity.groupBy("x").agg(F.count(F.lit(1)).alias("e"))
    one = pairs.agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"),
                    F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "e")).alias("pairs"))
    same = F.col("lo") == F.col("hi")
    one = one.where(F.col("lo").isNotNull()).select(
        "pairs", F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("mn"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("mx"))
    binned = F.transform("pairs", lambda p: F.struct(
        F.least(F.floor((p["x"] - F.col("mn")) * F.lit(float(bins)) / (F.col("mx") - F.col("mn"))).cast("bigint"),
                F.lit(bins - 1).cast("bigint")).alias("bin"), p["e"].alias("e")))
    hist = one.select("mn", ((F.col("mx") - F.col("mn")) / bins).alias("width"), binned.alias("binned"))
    count = lambda b: F.aggregate(F.filter("binned", lambda p: p["bin"] == b), F.lit(0).cast("bigint"),
                                  lambda acc, p: acc + p["e"])
    rows = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda b: F.struct(
        b.alias("bin"), (F.col("mn") + b * F.col("width")).alias("bin_start"),
        (F.col("mn") + (b + 1) * F.col("width")).alias("bin_end"), count(b).alias("count")))
    return hist.select(F.inline(rows)).orderBy("bin")
