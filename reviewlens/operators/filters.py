"""Row filters, projections and rating/sentiment mismatch flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N

MISMATCH_COLUMNS = ("mismatch_high_negative", "mismatch_low_positive", "has_mismatch")


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*list(columns))


def filter_sentiment_in(df: DataFrame, labels: Iterable[str] = ("negative",),
                        label_col: str = "sentiment") -> DataFrame:
    """Rows whose label is in ``labels`` (pushed to the scan when the label is stored)."""
    return df.where(F.col(label_col).isin(list(labels)))


def filter_sentiment_eq(df: DataFrame, label: str, label_col: str = "sentiment") -> DataFrame:
    return df.where(F.col(label_col) == F.lit(label))


def drop_null_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.dropna(subset=[text_col])


def row_by_key(df: DataFrame, key_col: str, key) -> DataFrame:
    """The row with ``key_col == key`` (explicit key instead of a positional index)."""
    return df.where(F.col(key_col) == F.lit(key))


def detect_mismatches(df: DataFrame, rating_col: str, high: float = 4.0, low: float = 2.0,
                      label_col: str = "sentiment") -> DataFrame:
    """Add non-null boolean flags: high rating & negative, low rating & positive, either.

    A missing rating compares false (as NaN does in pandas), so flags are never NULL.
    """
    r = N.nan_to_null(rating_col)
    lab = F.col(label_col)
    hn = F.coalesce((r >= high) & (lab == "negative"), F.lit(False))
    lp = F.coalesce((r <= low) & (lab == "positive"), F.lit(False))
    return df.withColumns({"mismatch_high_negative": hn, "mismatch_low_positive": lp,
                           "has_mismatch": hn | lp})


def remove_mismatches(df: DataFrame, rating_col: str, high: float = 4.0, low: float = 2.0,
                      label_col: str = "sentiment") -> DataFrame:
    """Keep rows without a mismatch; rows with a missing rating are kept."""
    flagged = detect_mismatches(df, rating_col, high, low, label_col)
    return flagged.where(~F.col("has_mismatch")).drop(*MISMATCH_COLUMNS)


def mismatch_counts(df: DataFrame, rating_col: str, high: float = 4.0, low: float = 2.0,
                    label_col: str = "sentiment") -> DataFrame:
    f = detect_mismatches(df, rating_col, high, low, label_col)
    return f.agg(F.count_if("mismatch_high_negative").cast("bigint").alias("high_negative"),
                 F.count_if("mismatch_low_positive").cast("bigint").alias("low_positive"),
                 (F.count_if("mismatch_high_negative") + F.count_if("mismatch_low_positive"))
                 .cast("bigint").alias("total"))


def removed_share(df: DataFrame, rating_col: str, high: float = 4.0, low: float = 2.0,
                  label_col: str = "sentiment") -> DataFrame:
    """Rows removed by ``remove_mismatches`` and their % of the input (2 dp)."""
    f = detect_mismatches(df, rating_col, high, low, label_col)
    a = f.agg(F.count(F.lit(1)).alias("_n"), F.count_if("has_mismatch").alias("_r"))
    return a.select(F.col("_n").cast("bigint").alias("input_rows"),
                    F.col("_r").cast("bigint").alias("removed_rows"),
                    (F.col("_n") - F.col("_r")).cast("bigint").alias("kept_rows"),
                    N.pct(F.col("_r"), F.col("_n")).alias("removed_pct"))
