"""Rating column statistics, distribution and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N
from reviewlens.operators.quantiles import quantile_exprs


def _r(col: str):
    return N.nan_to_null(col)


def rating_overview(df: DataFrame, rating_col: str) -> DataFrame:
    """Mean and sample std, 2 dp (half-even)."""
    r = _r(rating_col)
    return df.agg(N.round_half_even(F.avg(r), 2).alias("avg_rating"),
                  N.round_half_even(F.stddev_samp(r), 2).alias("rating_std"))


def rating_distribution(df: DataFrame, rating_col: str) -> DataFrame:
    """Count per rating value, ascending; missing ratings dropped."""
    r = _r(rating_col)
    return (df.select(r.alias("rating")).where(F.col("rating").isNotNull())
            .groupBy("rating").agg(F.count(F.lit(1)).alias("count")).orderBy("rating"))


def rating_range(df: DataFrame, rating_col: str) -> DataFrame:
    r = _r(rating_col)
    return df.agg(F.min(r).alias("rating_min"), F.max(r).alias("rating_max"))


def rating_statistics(df: DataFrame, rating_col: str) -> DataFrame:
    """mean (2 dp), median, mode (smallest of ties), std (2 dp), min, max."""
    r = _r(rating_col)
    return df.agg(N.round_half_even(F.avg(r), 2).alias("mean"),
                  F.median(r).cast("double").alias("median"),
                  F.mode(r, True).alias("mode"),
                  N.round_half_even(F.stddev_samp(r), 2).alias("std"),
                  F.min(r).alias("min"), F.max(r).alias("max"))


def rating_percentiles(df: DataFrame, rating_col: str, accuracy: int | None = None) -> DataFrame:
    """Exact 25/50/75/90th percentiles with linear interpolation."""
    q = quantile_exprs(_r(rating_col), [0.25, 0.5, 0.75, 0.9], accuracy)
    return df.agg(q.alias("_q")).select(F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                                        F.col("_q")[2].alias("p75"), F.col("_q")[3].alias("p90"))


def rating_concentration(df: DataFrame, rating_col: str, high: float = 4.0, low: float = 2.0
                         ) -> DataFrame:
    """% ≥ high and % ≤ low (1 dp) and |high−low|/total (2 dp); all rows count in the total.

    No row is returned for an empty table.
    """
    r = _r(rating_col)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(r >= high).alias("_h"),
                 F.count_if(r <= low).alias("_l"))
    return agg.where(F.col("_n") > 0).select(
        N.pct(F.col("_h"), F.col("_n"), 1).alias("high_rating_pct"),
        N.pct(F.col("_l"), F.col("_n"), 1).alias("low_rating_pct"),
        N.round_half_even(F.abs(F.col("_h") - F.col("_l")) / F.col("_n"), 2).alias("polarization_index"))


def rating_analysis(df: DataFrame, rating_col: str) -> DataFrame:
    """Statistics, percentiles and concentration in one pass (one row)."""
    r = _r(rating_col)
    q = quantile_exprs(r, [0.25, 0.5, 0.75, 0.9])
    a = df.agg(F.avg(r).alias("_mean"), F.median(r).alias("_median"), F.mode(r, True).alias("mode"),
               F.stddev_samp(r).alias("_std"), F.min(r).alias("min"), F.max(r).alias("max"),
               q.alias("_q"), F.count(F.lit(1)).alias("_n"), F.count_if(r >= 4).alias("_h"),
               F.count_if(r <= 2).alias("_l"))
    return a.select(
        N.round_half_even("_mean", 2).alias("mean"), F.col("_median").cast("double").alias("median"),
        "mode", N.round_half_even("_std", 2).alias("std"), "min", "max",
        F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"),
        F.col("_q")[3].alias("p90"),
        N.pct(F.col("_h"), F.col("_n"), 1).alias("high_rating_pct"),
        N.pct(F.col("_l"), F.col("_n"), 1).alias("low_rating_pct"),
        N.round_half_even(F.try_divide(F.abs(F.col("_h") - F.col("_l")), F.col("_n")), 2)
        .alias("polarization_index"))
