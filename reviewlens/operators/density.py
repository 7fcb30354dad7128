"""Kernel density of a score per label: the curve of a violin chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N

#: Bins of the grid between the smallest and the largest score of a label.
BINS = 2048


def bandwidth(n: Column, std: Column, span: Column) -> Column:
    """Normal-reference rule from spread and count, at least a hundredth of the span; 1 if all scores are equal."""
    rule = F.lit(1.059) * std * F.pow(n.cast("double"), F.lit(-0.2))
    return F.when(span == 0, F.lit(1.0)).otherwise(F.greatest(rule, span / 100.0))


def error_bound(bins: int = BINS) -> float:
    """What ``score_density`` may differ from the direct sum, as a part of ``1 / bandwidth``.

    A bin stands for its scores by their count and mean. Inside a bin of width w the scores'
    variance is at most w²/4, and the kernel's second derivative at most ``1 / sqrt(2 pi)`` over
    the bandwidth squared; w is at most 100 / ``bins`` bandwidths.
    """
    return (100 / bins) ** 2 / 8 / (2 * 3.141592653589793) ** 0.5


def score_density(df: DataFrame, label_col: str = "sentiment", score_col: str = "sentiment_score", bins: int = BINS) -> DataFrame:
    """``label_col, x, density`` with a Gaussian kernel, from two bandwidths below to two above each label's scores.

    Points are at most a third of a bandwidth apart (so at most 312 a label). Two reads: one
    aggregation for count, spread and ends of each label, one that counts and averages the
    scores of each bin; the kernel sums run over the bins, so their cost does not depend on the
    number of rows. Scores that have a bin to themselves are exact; otherwise see
    ``error_bound``. Missing labels and scores (null or NaN) are left out; a label with one
    score has bandwidth 1. Labels should be few: there are ``bins`` rows a label at most.
    """
    rows = df.select(F.col(label_col).alias("label"), N.nan_to_null(score_col).cast("double").alias("s")).where(
        F.col("label").isNotNull() & F.col("s").isNotNull())
    stats = rows.groupBy("label").agg(F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"),
                                      F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("std"))
    span = F.col("high") - F.col("low")
    stats = stats.withColumn("h", bandwidth(F.col("n"), F.col("std"), span))
    # at most one row a label: the charts' labels are few by contract
    at = F.least(F.floor((F.col("s") - F.col("low")) * F.try_divide(F.lit(float(bins)), span)), F.lit(bins - 1))
    binned = (rows.join(F.broadcast(stats.select("label", "low", "high")), "label")
              .groupBy("label", F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("s").alias("k"), F.avg("s").alias("m")))
    grid = binned.groupBy("label").agg(F.collect_list(F.struct("k", "m")).alias("grid"))  # ``bins`` entries at most
    start, dist = F.col("low") - 2 * F.col("h"), span + 4 * F.col("h")
    steps = F.ceil(dist / (F.col("h") / 3.0)).cast("int")
    points = (stats.join(grid, "label").withColumns({"steps": steps, "start": start, "step": dist / steps})
              .select("label", "n", "h", "grid", "start", "step", F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("i"))
              .withColumn("x", F.col("start") + F.col("i") * F.col("step")))
    kernel = F.aggregate("grid", F.lit(0.0), lambda acc, b: acc + b["k"] * F.exp(
        -(F.col("x") - b["m"]) * (F.col("x") - b["m"]) / (2.0 * F.col("h") * F.col("h"))))
    root = (2 * 3.141592653589793) ** 0.5
    return points.select(F.col("label").alias(label_col), "x", (kernel / (F.col("n") * F.col("h") * F.lit(root))).alias("density"))
