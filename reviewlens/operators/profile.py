"""Table profiling and data quality, fused into as few passes as possible.

One aggregation computes every per-column count, and duplicate detection is one ``groupBy``
over a hash of the whole row (partial aggregation map-side, so a heavily duplicated row is
combined before the shuffle).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import numeric as N
from reviewlens.functions import text as X
from reviewlens.operators.quantiles import quantile_exprs, wide_quantiles, wide_summary
from reviewlens.session import staged


def _missing_expr(df: DataFrame, name: str) -> Column:
    return N.is_missing(F.col(name), df.schema[name].dataType)


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns pandas would call numeric (``np.number``): integers and floats, not booleans."""
    ok = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DecimalType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, ok)]
    if columns is not None:
        names = [c for c in columns if c in names]
    return names


def _positive_zero(c: Column, t: T.DataType) -> Column:
    """``c`` with 0.0 for -0.0 at any depth."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c + F.lit(0.0).cast(t)
    if isinstance(t, T.ArrayType) and any(x in t.simpleString() for x in ("float", "double")):
        return F.transform(c, lambda x: _positive_zero(x, t.elementType))
    if isinstance(t, T.StructType) and any(x in t.simpleString() for x in ("float", "double")):
        return F.when(c.isNotNull(), F.struct(*[_positive_zero(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.MapType) and any(x in t.valueType.simpleString() for x in ("float", "double")):
        return F.transform_values(c, lambda k, v: _positive_zero(v, t.valueType))
    return c


def _canonical(f: T.StructField) -> Column:
    """A cell as text that equals another cell's only if the cells are equal (nulls too; -0.0 is 0.0, NaN is NaN)."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, T.StringType):
        s = F.concat(F.length(c).cast("string"), F.lit(":"), c)
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        s = F.when(F.isnan(c), F.lit("NaN")).otherwise((c + F.lit(0.0)).cast("string"))
    elif isinstance(t, T.TimestampType):
        s = F.unix_micros(c).cast("string")
    elif isinstance(t, T.BinaryType):
        s = F.hex(c)
    elif isinstance(t, T.MapType):
        s = F.to_json(F.array_sort(F.map_entries(_positive_zero(c, t))), {"ignoreNullFields": "false"})
    elif isinstance(t, (T.ArrayType, T.StructType)):
        s = F.to_json(_positive_zero(c, t), {"ignoreNullFields": "false"})
    else:
        s = c.cast("string")
    return F.coalesce(F.concat(s, F.lit(";")), F.lit("-;"))


def row_counts(df: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row: ``total_rows``, ``distinct_rows`` (nulls and NaN compare equal) and the totals of ``sums``.

    Rows are told by the SHA-256 of their canonical text, so 32 bytes per distinct row are
    shuffled instead of whole rows, and copies of one row, however many, are combined in
    each map task. ``sums`` are integer expressions per row that ride along, so a profile
    that needs cell counts and duplicates reads the table once. Nothing runs until the
    result is used.
    """
    sums = sums or {}
    names = {f"_x{i}": e for i, e in enumerate(sums.values())}
    h = _row_hash(df).alias("_h")
    groups = (df.select(h, *[e.cast("bigint").alias(n) for n, e in names.items()]).groupBy("_h")
              .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in names]))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"),
                      *[F.coalesce(F.sum(n), F.lit(0)).alias(out) for n, out in zip(names, sums)])


def _missing_in_row(df: DataFrame) -> Column:
    """Missing cells of one row (as ``_missing_expr`` counts them)."""
    return sum((F.when(_missing_expr(df, c), F.lit(1)).otherwise(F.lit(0)) for c in df.columns), F.lit(0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row on all columns (nulls and NaN compare equal).

    One row: ``total_rows``, ``distinct_rows``, ``duplicate_rows`` (see ``row_counts``).
    """
    return row_counts(df).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def _row_hash(df: DataFrame) -> Column:
    return F.unhex(F.sha2(F.concat(*[_canonical(f) for f in df.schema.fields]), 256))


def _has_places(df: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file as it is: a scan under projections that give the same values each time."""
    plan = df._jdf.queryExecution().analyzed()
    nodes = [line.strip(" :+-") for line in plan.toString().splitlines() if line.strip()]
    return (all(re.match(r"(Project|SubqueryAlias|Relation)\b", n) for n in nodes) and plan.deterministic()
            and any(n.startswith("Relation") and n.endswith("parquet") for n in nodes))


def repeated_places(df: DataFrame) -> DataFrame:
    """``_file, _row``: the places (file, row number) of rows that equal an earlier one, for a plain scan of Parquet files.

    The first place of each row hash wins. Shuffled are hash and place, about 50 bytes a row,
    and copies are combined in each task first; no row moves.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    keyed = staged(df.select(_row_hash(df).alias("_h"), F.xxhash64("_metadata.file_path").alias("_file"), place["row"].alias("_row")), "row-places")
    at = F.struct("_file", "_row")
    first = keyed.groupBy("_h").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return keyed.join(first.select(F.col("_h").alias("_g"), "_first"), F.col("_h") == F.col("_g")).where(at != F.col("_first")).select("_file", "_row")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row of each group of equal rows (nulls and NaN compare equal); columns of any type, maps too.

    A scan of Parquet files keeps the first place of each row: the places of the others, few
    as a rule, are taken out of a second scan (sent to the tasks if Spark finds them small
    enough), so whole rows do not move. Other inputs are grouped by the row's hash, of which
    each task passes on one row.
    """
    if _has_places(df):
        gone = staged(repeated_places(df), "row-repeats")
        names = [f"_c{i}" for i in range(len(df.columns))]
        rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], F.xxhash64("_metadata.file_path").alias("_at_file"),
                         F.col("_metadata.row_index").alias("_at_row"))
        rows = rows.join(gone, (F.col("_at_file") == F.col("_file")) & (F.col("_at_row") == F.col("_row")), "left_anti")
        return rows.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)])
    whole = F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)])
    one = df.groupBy(_row_hash(df).alias("_h")).agg(F.first(whole).alias("_r"))
    return one.select(*[F.col("_r")[f"_c{i}"].alias(c) for i, c in enumerate(df.columns)])


def _cells(df: DataFrame) -> DataFrame:
    """One pass: row count and missing cells (per column and total)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(_missing_expr(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    return df.agg(*aggs)


def table_overview(df: DataFrame) -> DataFrame:
    """total_rows, total_columns, missing_values, duplicate_rows (one row, one read of the table)."""
    r = row_counts(df, {"missing_values": _missing_in_row(df)})
    return r.select("total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), "missing_values",
                    (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Per column with any missing cell: count, % of rows (2 dp), Spark type."""
    cells = _cells(df)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                     F.col(f"_m{i}").cast("bigint").alias("missing_count"),
                     N.pct(F.col(f"_m{i}"), F.col("_rows")).alias("missing_pct"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("data_type"))
            for i, c in enumerate(df.columns)]
    return cells.select(F.inline(F.array(*rows))).where(F.col("missing_count") > 0)


def schema_table(df: DataFrame) -> DataFrame:
    """Per column: position, name, Spark type, non-null count (one pass)."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                     F.col(f"_c{i}").cast("bigint").alias("non_null"))
            for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*rows)))


# bytes per value of fixed-width types (Spark's own default sizes)
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
          T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
          T.TimestampNTZType: 8, T.DecimalType: 16}
_FIXED_WIDTH = tuple(_WIDTH)


def _width(t) -> int:
    return _WIDTH[type(t)]


def _bytes_expr(f: T.StructField) -> Column:
    c = F.col(f.name)
    t = f.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    if isinstance(t, _FIXED_WIDTH):
        return F.count(F.lit(1)) * F.lit(_width(t))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, _FIXED_WIDTH):
        return F.coalesce(F.sum(F.size(c)), F.lit(0)) * F.lit(_width(t.elementType))
    return F.coalesce(F.sum(F.octet_length(F.to_json(c))), F.lit(0))


def table_bytes(df: DataFrame) -> DataFrame:
    """Approximate data size: string bytes plus fixed widths × rows (not a heap footprint)."""
    total = sum((_bytes_expr(f) for f in df.schema.fields), F.lit(0))
    return df.agg(total.cast("bigint").alias("table_bytes")).select(
        "table_bytes", N.round_half_even(F.col("table_bytes") / F.lit(1024.0 ** 2), 2).alias("table_mb"))


def quality_report(df: DataFrame, text_col: str | None = None, rating_col: str | None = None
                   ) -> DataFrame:
    """One row with every data-quality metric.

    completeness (total_cells, missing_cells, completeness_score), consistency
    (duplicate_rows, unique_ratio), validity (text_empty_count, text_valid_pct,
    rating_valid_pct) and overall_quality_score. Percentages are rounded to 2 dp before
    they are weighted, the score to 1 dp; without a text column the two remaining weights
    are renormalised (divided by 0.7). The cell counts are summed inside the duplicate
    check's aggregation (one lazy read of the table); the arithmetic is on one row.
    """
    k = len(df.columns)
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    sums = {"_missing": _missing_in_row(df)}
    if text_col:
        sums["_blank"] = one(X.is_blank(F.coalesce(F.col(text_col), F.lit("nan"))))
    if rating_col:
        sums["_rvalid"] = one(N.nan_to_null(rating_col).isNotNull())
    j = row_counts(df, sums).withColumnsRenamed({"total_rows": "_rows", "distinct_rows": "_distinct"})
    total_cells = F.col("_rows") * F.lit(k)
    completeness = N.round_half_even(
        (F.lit(1.0) - F.try_divide(F.col("_missing").cast("double"), total_cells)) * 100.0, 2)
    unique_ratio = N.pct(F.col("_distinct"), F.col("_rows"))
    cols = {
        "total_cells": total_cells.cast("bigint"),
        "missing_cells": F.col("_missing").cast("bigint"),
        "completeness_score": completeness,
        "duplicate_rows": (F.col("_rows") - F.col("_distinct")).cast("bigint"),
        "unique_ratio": unique_ratio,
    }
    score = completeness * 0.4 + unique_ratio * 0.3
    if text_col:
        valid = N.round_half_even(
            (F.lit(1.0) - F.try_divide(F.col("_blank").cast("double"), F.col("_rows"))) * 100.0, 2)
        cols["text_empty_count"] = F.col("_blank").cast("bigint")
        cols["text_valid_pct"] = valid
        score = score + valid * 0.3
    else:
        score = score / 0.7
    if rating_col:
        cols["rating_valid_pct"] = N.pct(F.col("_rvalid"), F.col("_rows"))
    cols["overall_quality_score"] = N.round_half_even(score, 1)
    return j.select(*[v.alias(n) for n, v in cols.items()])


def completeness(df: DataFrame) -> DataFrame:
    """total_cells, missing_cells and their score, from map-side counts (no row is shuffled)."""
    missing = F.coalesce(F.sum(_missing_in_row(df)), F.lit(0)).cast("bigint")
    one = df.agg((F.count(F.lit(1)) * F.lit(len(df.columns))).cast("bigint").alias("total_cells"), missing.alias("missing_cells"))
    return one.withColumn("completeness_score", N.round_half_even(
        (F.lit(1.0) - F.try_divide(F.col("missing_cells").cast("double"), F.col("total_cells"))) * 100.0, 2))


def consistency(df: DataFrame) -> DataFrame:
    return quality_report(df).select("duplicate_rows", "unique_ratio")


def text_validity(df: DataFrame, text_col: str) -> DataFrame:
    """Blank-after-strip texts (a null text is the string 'nan', not blank) and valid %."""
    n = F.count(F.lit(1))
    blank = F.count_if(X.is_blank(F.coalesce(F.col(text_col), F.lit("nan"))))
    return df.agg(blank.cast("bigint").alias("text_empty_count"),
                  N.round_half_even((F.lit(1.0) - F.try_divide(blank.cast("double"), n)) * 100.0, 2)
                  .alias("text_valid_pct"))


def rating_validity(df: DataFrame, rating_col: str, lo: float | None = None,
                    hi: float | None = None) -> DataFrame:
    """% of rows inside [lo, hi]; by default the column's own min..max, i.e. % non-missing."""
    r = N.nan_to_null(rating_col)
    ok = r.isNotNull()
    if lo is not None:
        ok = ok & (r >= lo)
    if hi is not None:
        ok = ok & (r <= hi)
    return df.agg(N.pct(F.count_if(ok), F.count(F.lit(1))).alias("rating_valid_pct"))


def quality_score(df: DataFrame, text_col: str | None = None) -> DataFrame:
    return quality_report(df, text_col).select("overall_quality_score")


def describe_numeric(df: DataFrame, columns: list[str] | None = None,
                     accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per numeric column (exact quantiles by default).

    Two reads (``wide_summary``): moments, ends and brackets first, then the ranks inside the
    brackets, so no task holds a column's distinct values. ``accuracy`` switches to
    ``percentile_approx``, all in one read.
    """
    cols = numeric_columns(df, columns)
    schema = "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    probs = [0.25, 0.5, 0.75]
    if accuracy is not None:
        aggs = []
        for i, c in enumerate(cols):
            v = N.nan_to_null(c)
            aggs += [F.count(v).alias(f"_n{i}"), F.avg(v).alias(f"_a{i}"), F.stddev_samp(v).alias(f"_s{i}"),
                     F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), quantile_exprs(v, probs, accuracy).alias(f"_q{i}")]
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean"), F.col(f"_s{i}").alias("std"),
                         F.col(f"_lo{i}").alias("low"), F.col(f"_hi{i}").alias("high"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(cols)]
        stats = df.agg(*aggs).select(F.inline(F.array(*rows)))
    else:
        stats = wide_summary(df, cols, probs)
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_ord int, _name string")
    # one row per column on either side; columns without a value are listed, too
    out = names.join(F.broadcast(stats), F.col("_name") == F.col("column_name"), "left")
    return out.orderBy("_ord").select(
        F.col("_name").alias("column_name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"), "mean", "std",
        F.col("low").cast("double").alias("min"), *[F.col("q")[j].alias(q) for j, q in enumerate(("p25", "p50", "p75"))],
        F.col("high").cast("double").alias("max"))


def iqr_bounds(df: DataFrame, columns: list[str] | None = None,
               accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    """Pass 1 of ``iqr_outliers``: Q1−1.5·IQR and Q3+1.5·IQR per column (two numbers each)."""
    cols = numeric_columns(df, columns)
    if not cols:
        return {}
    if accuracy is not None:
        row = df.agg(*[quantile_exprs(N.nan_to_null(c), [0.25, 0.75], accuracy).alias(f"_q{i}")
                       for i, c in enumerate(cols)]).first()
        qs = {c: row[f"_q{i}"] for i, c in enumerate(cols)}
    else:
        qs = {}
        # at most 2 rows per column reach the driver
        for r in wide_quantiles(df, cols, [0.25, 0.75]).collect():
            qs.setdefault(r.column_name, [None, None])[0 if r.p == 0.25 else 1] = r.value
    out = {}
    for c in cols:
        q = qs.get(c)
        if q is None or q[0] is None:
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - 1.5 * iqr, q[1] + 1.5 * iqr)
    return out


def iqr_outliers(df: DataFrame, columns: list[str] | None = None,
                 accuracy: int | None = None) -> DataFrame:
    """Per numeric column with outliers: count outside the IQR fences, % of all rows, fences."""
    bounds = iqr_bounds(df, columns, accuracy)
    schema = ("column_name string, outlier_count bigint, outlier_pct double, "
              "lower_bound double, upper_bound double")
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    names = list(bounds)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(names):
        lo, hi = bounds[c]
        v = N.nan_to_null(c).cast("double")  # Spark sorts NaN above every number
        aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"_o{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_o{i}").cast("bigint").alias("outlier_count"),
                     N.pct(F.col(f"_o{i}"), F.col("_rows")).alias("outlier_pct"),
                     N.round_half_even(F.lit(bounds[c][0]), 2).alias("lower_bound"),
                     N.round_half_even(F.lit(bounds[c][1]), 2).alias("upper_bound"))
            for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows))).where(F.col("outlier_count") > 0)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise Pearson correlation over numeric columns, as ``(col_a, col_b, corr)`` rows.

    Pairwise-complete rows (as pandas), NULL for a constant column, empty for < 2 columns.

    Two passes of plain sums instead of one Welford aggregate per pair: pass 1 gets each
    column's mean and missing count (one small row on the driver); pass 2 sums products of
    mean-shifted values, which is numerically stable and cheap to code-generate. Columns
    without missing values share their per-column sums; only pairs that involve a column
    with missing values get pair-specific sums over their complete rows.
    """
    cols = numeric_columns(df, columns)
    schema = "col_a string, col_b string, corr double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    v = {c: N.nan_to_null(c) for c in cols}
    p1 = df.agg(*[F.avg(v[c]).alias(f"_m{i}") for i, c in enumerate(cols)],
                *[F.count(v[c]).alias(f"_n{i}") for i, c in enumerate(cols)],
                F.count(F.lit(1)).alias("_rows")).first()
    rows = p1["_rows"]
    mean = {c: (p1[f"_m{i}"] or 0.0) for i, c in enumerate(cols)}
    full = {c: p1[f"_n{i}"] == rows for i, c in enumerate(cols)}
    # shifted values as plain columns: the aggregate then reads k inputs (keeps the
    # generated code small enough to compile)
    shifted = df.select(*[(v[c] - F.lit(float(mean[c]))).alias(f"_x{i}") for i, c in enumerate(cols)])
    x = {c: F.col(f"_x{i}") for i, c in enumerate(cols)}
    v = x
    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    for i, c in enumerate(cols):
        if full[c]:
            aggs[f"_s{i}"] = F.sum(x[c])
            aggs[f"_q{i}"] = F.sum(x[c] * x[c])
    pairs = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            key = f"{i}_{j}"
            aggs[f"_p{key}"] = F.sum(x[a] * x[b])
            if not (full[a] and full[b]):
                both = v[a].isNotNull() & v[b].isNotNull()
                aggs[f"_c{key}"] = F.count_if(both)
                aggs[f"_sa{key}"] = F.sum(F.when(both, x[a]))
                aggs[f"_sb{key}"] = F.sum(F.when(both, x[b]))
                aggs[f"_qa{key}"] = F.sum(F.when(both, x[a] * x[a]))
                aggs[f"_qb{key}"] = F.sum(F.when(both, x[b] * x[b]))
            pairs.append((i, j, a, b, key))
    for i, c in enumerate(cols):  # diagonal of a column with missing values
        if not full[c]:
            aggs[f"_c{i}_{i}"] = F.count(v[c])
            aggs[f"_sa{i}_{i}"] = F.sum(x[c])
            aggs[f"_qa{i}_{i}"] = F.sum(x[c] * x[c])
    # one row of O(k²) sums; the correlations are finished from it on the driver
    r = shifted.agg(*[e.alias(k) for k, e in aggs.items()]).first()

    def corr_of(n, sa, sb, qa, qb, p):
        if not n or sa is None or sb is None:
            return None
        va, vb = qa - sa * sa / n, qb - sb * sb / n
        if va <= 0 or vb <= 0:
            return None
        return (p - sa * sb / n) / math.sqrt(va * vb)

    def diag(i, c):
        if full[c]:
            n, s1, q1 = r["_n"], r[f"_s{i}"], r[f"_q{i}"]
        else:
            n, s1, q1 = r[f"_c{i}_{i}"], r[f"_sa{i}_{i}"], r[f"_qa{i}_{i}"]
        return 1.0 if n and s1 is not None and q1 - s1 * s1 / n > 0 else None

    val = {}
    for i, j, a, b, key in pairs:
        if full[a] and full[b]:
            e = corr_of(float(r["_n"]), r[f"_s{i}"], r[f"_s{j}"], r[f"_q{i}"], r[f"_q{j}"], r[f"_p{key}"])
        else:
            e = corr_of(float(r[f"_c{key}"]), r[f"_sa{key}"], r[f"_sb{key}"], r[f"_qa{key}"], r[f"_qb{key}"],
                        r[f"_p{key}"])
        val[(i, j)] = val[(j, i)] = e
    out = [(a, b, diag(i, a) if i == j else val[(i, j)]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, schema)
