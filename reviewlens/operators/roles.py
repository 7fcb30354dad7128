"""Column-role detection (text / rating / id / date), normalisation and validation.

Detection is a metadata step over all rows: ``detect_roles`` takes one aggregation for all
rules (one row, bounded by the number of columns, comes back to the driver) and an exact
second one only for columns near a limit; the chosen roles are a small ``ColumnRoles`` value.
The ``*_table`` variants return the evidence per column as a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import numeric as N
from reviewlens.functions import text as X

# --- fixed values: role-detection rules -------------------------------------------------
TEXT_MIN_AVG_LENGTH = 50
RATING_NAME_WORDS = ("star", "rating", "score", "review")
RATING_MAX_DISTINCT = 10
ID_NAME_WORDS = ("id", "business", "user", "customer")
ID_MIN_UNIQUE_RATIO = 0.1
DATE_NAME_WORDS = ("date", "time")
# Columns this library adds; they never count as a date column.
DERIVED_COLUMNS = ("sentiment", "sentiment_score", "clean_text", "clean_text_advanced",
                   "text_length", "word_count", "mismatch_high_negative", "mismatch_low_positive",
                   "has_mismatch")
# ------------------------------------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class ColumnRoles:
    text: str | None = None
    rating: str | None = None
    id: str | None = None
    date: str | None = None

    def override(self, **choices: str) -> ColumnRoles:
        """A user choice replaces a detected role unless it is ``'Auto'``."""
        return replace(self, **{k: v for k, v in choices.items() if v is not None and v != "Auto"})


def _spark(df: DataFrame):
    return df.sparkSession


def detect_text_table(df: DataFrame, key_col: str | None = None,
                      sample_size: int | None = None) -> DataFrame:
    """Per string column: mean ``len(str(x))`` over all rows (with ``sample_size``, the first ones by ``key_col``).

    ``chosen`` marks the longest mean above 50 (ties → earlier column).
    """
    strings = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    schema = "column_name string, position int, avg_length double, chosen boolean"
    if not strings:
        return _spark(df).createDataFrame([], schema)
    if sample_size is not None:
        df = (df.orderBy(key_col) if key_col else df).limit(sample_size)
    a = df.agg(*[F.avg(X.text_length(c)).alias(f"_l{i}") for i, c in strings])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                              F.col(f"_l{i}").cast("double").alias("avg_length")) for i, c in strings])
    t = a.select(F.inline(rows))
    best = t.where(F.col("avg_length") > TEXT_MIN_AVG_LENGTH).orderBy(
        F.col("avg_length").desc(), "position").limit(1).select(F.col("position").alias("_best"))
    return t.join(best, t["position"] == best["_best"], "left").select(
        "column_name", "position", "avg_length", F.col("_best").isNotNull().alias("chosen"))


def _numeric(df: DataFrame) -> list[tuple[int, str]]:
    return [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, _NUMERIC)]


def _rating_name(c: str) -> bool:
    return any(w in c.lower() for w in RATING_NAME_WORDS)


def detect_rating_table(df: DataFrame) -> DataFrame:
    """Per numeric column: exact distinct values, min, max and both rating rules.

    ``by_name``: ≤10 distinct, min ≥ 0, max ≤ 10 and a rating-like name. ``by_range``
    (used only when no column passes by name): 3..10 distinct, min ≥ 1, max ≤ 10.
    ``chosen`` marks the first column of the rule that applies. Distinct values are counted
    after a partial aggregation on (column, value), one read for all columns.
    """
    schema = ("column_name string, position int, n_distinct bigint, min_value double, max_value double, "
              "name_match boolean, by_name boolean, by_range boolean, chosen boolean")
    cols = _numeric(df)
    if not cols:
        return _spark(df).createDataFrame([], schema)
    # whole and decimal numbers are told by their digits: a double does not tell all of them apart
    digits = lambda c: F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, (T.LongType, T.DecimalType)) else F.lit(None)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), N.nan_to_null(c).alias("v"), digits(c).cast("string").alias("d"))
                                         for i, c in cols])))
    each = (cells.groupBy("i", "v", "d").agg(F.count(F.lit(1)).alias("_c")).groupBy("i")
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    # one entry per numeric column; a table without rows still lists its columns
    one = each.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "lo", "hi")))).alias("m"))
    entries = []
    for i, c in cols:
        m = F.try_element_at(F.col("m"), F.lit(i))
        n, lo, hi, named = F.coalesce(m["n"], F.lit(0)).cast("bigint"), m["lo"], m["hi"], _rating_name(c)
        by_name = F.lit(named) & (n <= RATING_MAX_DISTINCT) & (lo >= 0) & (hi <= 10)
        by_range = (n >= 3) & (n <= RATING_MAX_DISTINCT) & (lo >= 1) & (hi <= 10)
        entries.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), n.alias("n_distinct"),
                                lo.alias("min_value"), hi.alias("max_value"), F.lit(named).alias("name_match"),
                                F.coalesce(by_name, F.lit(False)).alias("by_name"),
                                F.coalesce(by_range, F.lit(False)).alias("by_range")))
    first = lambda rule: F.array_min(F.transform(F.filter("rows", lambda x: x[rule]), lambda x: x["position"]))
    t = one.select(F.array(*entries).alias("rows"))
    t = t.withColumn("pick", F.coalesce(first("by_name"), first("by_range")))
    return t.select("pick", F.inline("rows")).select(
        "column_name", "position", "n_distinct", "min_value", "max_value", "name_match", "by_name", "by_range",
        F.coalesce(F.col("position") == F.col("pick"), F.lit(False)).alias("chosen"))


def detect_id_table(df: DataFrame) -> DataFrame:
    """Per column with an id-like name: distinct / rows; first with ratio > 0.1 is chosen."""
    cands = [(i, f.name) for i, f in enumerate(df.schema.fields)
             if any(w in f.name.lower() for w in ID_NAME_WORDS)]
    schema = "column_name string, position int, unique_ratio double, chosen boolean"
    if not cands:
        return _spark(df).createDataFrame([], schema)
    a = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.count_distinct(F.col(c)).alias(f"_d{i}") for i, c in cands])
    t = a.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.try_divide(F.col(f"_d{i}").cast("double"), F.col("_n")).alias("unique_ratio"))
        for i, c in cands])))
    best = t.where(F.col("unique_ratio") > ID_MIN_UNIQUE_RATIO).orderBy("position").limit(1) \
        .select(F.col("position").alias("_best"))
    return t.join(best, t["position"] == best["_best"], "left").select(
        "column_name", "position", "unique_ratio", F.col("_best").isNotNull().alias("chosen"))


def _date_candidates(df: DataFrame) -> list[tuple[int, str]]:
    return [(i, f.name) for i, f in enumerate(df.schema.fields)
            if any(w in f.name.lower() for w in DATE_NAME_WORDS) and f.name not in DERIVED_COLUMNS
            and not isinstance(f.dataType, _NUMERIC + (T.BooleanType,))]


def _parsed(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(c)
    return F.try_to_timestamp(F.col(c).cast("string"))


def detect_date_candidates(df: DataFrame) -> DataFrame:
    """Per date/time-named column (derived and numeric ones excluded), in column order: share of values that parse."""
    cands = _date_candidates(df)
    if not cands:
        return _spark(df).createDataFrame([], "column_name string, position int, parsed_share double")
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_parsed(df, c)).alias(f"_p{i}") for i, c in cands])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.try_divide(F.col(f"_p{i}").cast("double"), F.col("_n")).alias("parsed_share"))
        for i, c in cands])))


def detect_date_table(df: DataFrame) -> DataFrame:
    """``detect_date_candidates`` with ``chosen``: the first candidate with some parseable value."""
    t = detect_date_candidates(df)
    best = t.where(F.col("parsed_share") > 0).orderBy("position").limit(1).select(F.col("position").alias("_best"))
    return t.join(best, t["position"] == best["_best"], "left").select(
        "column_name", "position", "parsed_share", F.col("_best").isNotNull().alias("chosen"))


def detect_roles(df: DataFrame, key_col: str | None = None, sample_size: int | None = None) -> ColumnRoles:
    """All four roles, by the rules of the ``detect_*_table`` functions.

    One aggregation over all rows serves every rule; distinct counts are approximate in it,
    and those within a fifth of a limit (or small enough to be a rating) are counted exactly in a
    second one. ``sample_size`` limits the text rule to the first rows by ``key_col``.
    """
    strings = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    numbers = _numeric(df)
    ids = [(i, f.name) for i, f in enumerate(df.schema.fields) if any(w in f.name.lower() for w in ID_NAME_WORDS)]
    dates = _date_candidates(df)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.avg(X.text_length(c)).alias(f"_l{i}") for i, c in strings]
    for i, c in numbers:
        v = N.nan_to_null(c)
        aggs += [F.approx_count_distinct(v).alias(f"_a{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    aggs += [F.approx_count_distinct(F.col(c), 0.02).alias(f"_u{i}") for i, c in ids]
    aggs += [F.count(_parsed(df, c)).alias(f"_p{i}") for i, c in dates]
    r = df.agg(*aggs).first()

    rated = [(i, c) for i, c in numbers if r[f"_lo{i}"] is not None and r[f"_a{i}"] <= 2 * RATING_MAX_DISTINCT
             and r[f"_lo{i}"] >= 0 and r[f"_hi{i}"] <= 10]
    limit = ID_MIN_UNIQUE_RATIO * r["_n"]
    near = [(i, c) for i, c in ids if 0.8 * limit <= r[f"_u{i}"] <= 1.2 * limit]
    exact = [F.size(F.collect_set(N.nan_to_null(c))).alias(f"_a{i}") for i, c in rated]  # a few values each
    exact += [F.count_distinct(F.col(c)).alias(f"_u{i}") for i, c in near]
    got = {**r.asDict(), **(df.agg(*exact).first().asDict() if exact else {})}

    if sample_size is not None:
        text = _chosen(detect_text_table(df, key_col, sample_size))
    else:
        long = [(-r[f"_l{i}"], i, c) for i, c in strings if (r[f"_l{i}"] or 0) > TEXT_MIN_AVG_LENGTH]
        text = min(long)[2] if long else None
    few = [(i, c) for i, c in rated if got[f"_a{i}"] <= RATING_MAX_DISTINCT]
    named = [c for _, c in few if _rating_name(c)]
    ranged = [c for i, c in few if got[f"_a{i}"] >= 3 and got[f"_lo{i}"] >= 1]
    return ColumnRoles(text=text, rating=next(iter(named + ranged), None),
                       id=next((c for i, c in ids if got[f"_u{i}"] > limit), None),
                       date=next((c for i, c in dates if r[f"_p{i}"] > 0), None))


def _chosen(t: DataFrame) -> str | None:
    r = t.where("chosen").select("column_name").first()
    return r[0] if r else None


def normalize_columns(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Rename role columns to text / rating / id / date, one rename at a time.

    If the standard name already exists the column becomes ``<name>_detected``. A column
    holding two roles is renamed once, to the last role's name.
    """
    plan: dict[str, str] = {}
    for old, new in ((roles.text, "text"), (roles.rating, "rating"), (roles.id, "id"), (roles.date, "date")):
        if old:
            plan[old] = new
    out = df
    for old, new in plan.items():
        if old != new and old in out.columns:
            if new in out.columns:
                new = f"{new}_detected"
            out = out.withColumnRenamed(old, new)
    return out


def validate_table(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Validation findings as ``(level, code, value)`` rows.

    One aggregation for every scalar finding, one ``groupBy`` for the rating distribution
    (one row per distinct rating), and the fingerprint duplicate check.

    error ``no_text_column``; warnings ``null_texts``, ``short_texts`` (mean length < 20),
    ``duplicate_rows``; info ``rating_range``, ``rating_distribution`` (``value:count``
    pairs in value order) and ``table_mb``. ``is_valid`` is a row of its own.
    """
    from reviewlens.operators.profile import _bytes_expr, duplicate_rows

    spark = _spark(df)
    parts = []
    if roles.text is None:
        parts.append(spark.createDataFrame([("error", "no_text_column", "No text column detected")],
                                           "level string, code string, value string"))
    # every scalar finding from one aggregation (one read of the table)
    aggs = [sum((_bytes_expr(f) for f in df.schema.fields), F.lit(0)).cast("bigint").alias("_bytes")]
    rows = []
    if roles.text is not None:
        t = F.col(roles.text)
        aggs += [F.count_if(t.isNull()).alias("_nulls"), F.avg(X.text_length(roles.text)).alias("_avg")]
        rows += [("warning", "null_texts", F.when(F.col("_nulls") > 0, F.col("_nulls").cast("string"))),
                 ("warning", "short_texts", F.when(F.col("_avg") < 20,
                                                   F.rint(F.col("_avg")).cast("bigint").cast("string")))]
    if roles.rating is not None:
        r = N.nan_to_null(roles.rating)
        aggs.append(F.concat_ws(" - ", F.min(r).cast("string"), F.max(r).cast("string")).alias("_range"))
        rows.append(("info", "rating_range", F.col("_range")))
    mb = N.round_half_even(F.col("_bytes") / F.lit(1024.0 ** 2), 2)
    rows.append(("info", "table_mb", F.format_string("%.2f MB", mb)))
    parts.append(df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.lit(code).alias("code"), v.alias("value")) for lv, code, v in rows]))))
    if roles.rating is not None:
        r = N.nan_to_null(roles.rating)
        dist = (df.where(r.isNotNull()).groupBy(r.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_v", "_c"))),
                                              lambda s: F.concat(s["_v"].cast("string"), F.lit(":"),
                                                                 s["_c"].cast("string"))), ", ").alias("value"))
                .select(F.lit("info").alias("level"), F.lit("rating_distribution").alias("code"), "value"))
        parts.append(dist)
    dups = duplicate_rows(df).select(F.lit("warning").alias("level"), F.lit("duplicate_rows").alias("code"),
                                     F.when(F.col("duplicate_rows") > 0, F.col("duplicate_rows").cast("string"))
                                     .alias("value"))
    parts.append(dups)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("value").isNotNull())
    valid = spark.createDataFrame([("info", "is_valid", str(roles.text is not None).lower())],
                                  "level string, code string, value string")
    return out.unionByName(valid)
