"""Sampling and per-label heads, all keyed by an explicit order column.

``limit`` without an order is arbitrary in Spark, so every operator takes the key that
defines "first".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the reference's quota for the combined prompt (label, rows) -----------
DEFAULT_QUOTA = (("positive", 2), ("negative", 2), ("neutral", 1))
# ------------------------------------------------------------------------------------------


def preview(df: DataFrame, key_col: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by ``key_col`` (top-k, no global sort)."""
    return df.orderBy(key_col).limit(n)


def random_sample(df: DataFrame, n: int, key_col: str, seed: int = 0) -> DataFrame:
    """``min(n, rows)`` rows without replacement, reproducible for a given seed.

    Rows are ranked by ``md5('<key>:<seed>')`` and the ``n`` smallest taken: a distributed
    top-k (each task keeps n candidates), uniform over rows with distinct keys. MD5 of the
    key's text is computed identically by SQL engines, so a sample can be re-drawn (and
    checked) outside Spark.
    """
    h = F.md5(F.concat(F.col(key_col).cast("string"), F.lit(f":{seed}")))
    return (df.withColumn("_h", h).orderBy(F.col("_h").asc_nulls_last(), F.col(key_col).asc_nulls_last())
            .limit(n).drop("_h"))


def stratified_head(df: DataFrame, key_col: str, quota: Sequence[tuple[str, int]] = DEFAULT_QUOTA,
                    label_col: str = "sentiment") -> DataFrame:
    """First rows per label by ``key_col`` with a quota per label, in quota order.

    ``row_number() ≤ k`` is planned with a partial WindowGroupLimit, so each map task sends
    at most k rows per label to the shuffle even when one label holds most rows.
    """
    labels = [lab for lab, _ in quota]
    kmax = max(k for _, k in quota)
    q = F.create_map(*[x for lab, k in quota for x in (F.lit(lab), F.lit(k))])
    order = F.create_map(*[x for i, (lab, _) in enumerate(quota) for x in (F.lit(lab), F.lit(i))])
    w = Window.partitionBy(label_col).orderBy(key_col)
    ranked = (df.where(F.col(label_col).isin(labels))
              .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= kmax)
              .withColumn("_rank", F.col("_rank").cast("bigint")))
    return (ranked.where(F.col("_rank") <= F.element_at(q, F.col(label_col)))
            .withColumn("_order", F.element_at(order, F.col(label_col)))
            .orderBy("_order", "_rank").drop("_order"))


def concat_samples(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames, duplicates kept (``unionByName``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def head_per_label(df: DataFrame, key_col: str, label: str, n: int,
                   label_col: str = "sentiment") -> DataFrame:
    return df.where(F.col(label_col) == label).orderBy(key_col).limit(n)
