"""Date parsing and time aggregates. Run the session with time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import numeric as N


def parse_dates_col(c: Column | str, fmt: str | None = None) -> Column:
    """String → timestamp; unparseable values → NULL (never an ANSI error).

    Any ISO form is accepted by default; other layouts through ``fmt``. Timestamp and date
    columns pass through.
    """
    c = F.col(c) if isinstance(c, str) else c
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt))
    return F.try_to_timestamp(c)


def parse_dates(df: DataFrame, date_col: str, out: str = "parsed_date", fmt: str | None = None
                ) -> DataFrame:
    t = df.schema[date_col].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(out, F.col(date_col))
    if isinstance(t, T.DateType):
        return df.withColumn(out, F.col(date_col).cast("timestamp"))
    return df.withColumn(out, parse_dates_col(F.col(date_col).cast("string"), fmt))


def drop_null_dates(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """Rows whose date parses (the parsed value replaces nothing; it is a filter)."""
    return parse_dates(df, date_col, "_ts", fmt).where(F.col("_ts").isNotNull()).drop("_ts")


def date_range(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """First and last day (yyyy-MM-dd), whole elapsed days, rows/(span+1) (2 dp).

    No row when no date parses. Elapsed days count 24-hour periods (``timestampdiff``),
    not calendar boundaries.
    """
    p = parse_dates(df, date_col, "_ts", fmt)
    a = p.agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"), F.count("_ts").alias("_n"))
    span = F.expr("timestampdiff(DAY, _lo, _hi)")
    return a.where(F.col("_n") > 0).select(
        F.date_format("_lo", "yyyy-MM-dd").alias("start"), F.date_format("_hi", "yyyy-MM-dd").alias("end"),
        span.cast("bigint").alias("span_days"),
        N.round_half_even(F.col("_n") / (span + 1), 2).alias("daily_avg"))


def daily_average(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    return date_range(df, date_col, fmt).select("daily_avg")


def day_of_week_counts(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """Count per English weekday name, descending (ties by name)."""
    p = parse_dates(df, date_col, "_ts", fmt).where(F.col("_ts").isNotNull())
    return (p.groupBy(F.date_format("_ts", "EEEE").alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "day_of_week"))


def monthly_trend(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """Count per ``yyyy-MM``, ascending; empty months are absent."""
    p = parse_dates(df, date_col, "_ts", fmt).where(F.col("_ts").isNotNull())
    return (p.groupBy(F.date_format("_ts", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("month"))


def temporal_patterns(df: DataFrame, date_col: str, fmt: str | None = None) -> DataFrame:
    """Range, weekday and month counts as tidy ``(section, key, value)`` rows."""
    rng = date_range(df, date_col, fmt)
    r = rng.select(F.inline(F.array(
        F.struct(F.lit("date_range").alias("section"), F.lit("start").alias("key"), F.col("start").alias("value")),
        F.struct(F.lit("date_range").alias("section"), F.lit("end").alias("key"), F.col("end").alias("value")),
        F.struct(F.lit("date_range").alias("section"), F.lit("span_days").alias("key"),
                 F.col("span_days").cast("string").alias("value")),
        F.struct(F.lit("frequency").alias("section"), F.lit("daily_avg").alias("key"),
                 F.col("daily_avg").cast("string").alias("value")))))
    d = day_of_week_counts(df, date_col, fmt).select(
        F.lit("day_of_week_distribution").alias("section"), F.col("day_of_week").alias("key"),
        F.col("count").cast("string").alias("value"))
    m = monthly_trend(df, date_col, fmt).select(
        F.lit("monthly_trend").alias("section"), F.col("month").alias("key"), F.col("count").cast("string").alias("value"))
    return r.unionByName(d).unionByName(m)


def sentiment_timeline(df: DataFrame, date_col: str, label_col: str = "sentiment",
                       fmt: str | None = None) -> DataFrame:
    """Count per (calendar day, label); absent pairs are absent.

    The day is a private column ``day`` — an input column named ``date`` is untouched.
    """
    p = parse_dates(df, date_col, "_ts", fmt).where(F.col("_ts").isNotNull())
    return (p.groupBy(F.to_date("_ts").alias("day"), F.col(label_col).alias("sentiment"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("day", "sentiment"))
