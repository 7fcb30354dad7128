"""Scans and sinks: CSV with pandas-like typing, JSON, Excel, dispatch by extension.

Reads are lazy Spark scans. CSV typing takes one aggregation pass over the string columns
(the same cost as Spark's ``inferSchema``) and then a ``try_cast`` projection; a caller
that passes a schema skips that pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.session import path_state, staged
from reviewlens.sources.csv_records import read_csv_records

# --- fixed values: pandas' default missing-value tokens for read_csv ----------------------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# pandas' boolean spellings
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# numbers as they are written in a table
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
# -------------------------------------------------------------------------------------------

SUPPORTED = ("csv", "json", "xlsx", "xls", "parquet")


def _na_to_null(c: str, na_tokens) -> F.Column:
    col = F.col(c)
    return F.when(col.isin(list(na_tokens)) | col.isNull(), F.lit(None).cast("string")).otherwise(col)


def infer_csv_types(df: DataFrame, na_tokens=NA_TOKENS) -> dict[str, str]:
    """Per string column: bigint, double, boolean or string, from one aggregation pass.

    A column is integer when every non-missing value is written as an integer and fits
    BIGINT, double when every one is a plain decimal number (not ``1d`` or ``2f``, which Java
    would take) and not all are integers, boolean when every one is a pandas boolean spelling.
    Anything else, such as ids of 20 digits, stays a string, so no value is lost.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        v = _na_to_null(c, na_tokens)
        begins = F.substring(F.ltrim(v), 1, 1).isin(list("+-.0123456789iI"))  # as any number does: a text is not searched
        aggs += [F.count(v).alias(f"_n{i}"),
                 F.count_if(begins & F.trim(v).rlike(INTEGER)).alias(f"_i{i}"),
                 F.count(F.when(begins & F.trim(v).rlike(INTEGER), F.trim(v).try_cast("bigint"))).alias(f"_f{i}"),
                 F.count_if(begins & F.trim(v).rlike(NUMBER)).alias(f"_d{i}"),
                 F.count_if(v.isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"_b{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = r[f"_n{i}"]
        if n == 0:
            out[c] = "double"  # an all-missing column reads as float NaN in pandas
        elif r[f"_b{i}"] == n:
            out[c] = "boolean"
        elif r[f"_i{i}"] == n:
            out[c] = "bigint" if r[f"_f{i}"] == n else "string"
        elif r[f"_d{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def _typed(df: DataFrame, types: dict[str, str], na_tokens) -> DataFrame:
    cols = []
    for c in df.columns:
        v = _na_to_null(c, na_tokens)
        t = types.get(c, "string")
        if t == "boolean":
            e = F.when(v.isin(list(TRUE_TOKENS)), F.lit(True)).when(v.isin(list(FALSE_TOKENS)), F.lit(False))
        elif t == "string":
            e = v
        else:
            number = F.regexp_replace(F.trim(v), "^\\+", "") if t == "bigint" else F.trim(v)
            e = number.try_cast(t)
        cols.append(e.alias(c))
    return df.select(*cols)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_tokens=NA_TOKENS, infer: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with header and doubled quotes; pandas NA tokens → NULL.

    Files are split, so a large one is read by many tasks. Files whose quoted cells hold line
    breaks must be declared with ``multi_line=True``: they are split, too, and read twice, once
    to tell where records begin (see ``csv_records``). With ``schema`` the columns are cast to it;
    otherwise types are inferred (see ``infer_csv_types``) unless ``infer=False`` (all strings).
    """
    raw = read_csv_records(spark, path) if multi_line else (spark.read.option("header", True).option("escape", '"')
           .option("quote", '"').option("mode", "PERMISSIVE").option("emptyValue", "")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("inferSchema", False).csv(path))
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        types = {f.name: f.dataType.simpleString() for f in st.fields}
        return _typed(raw, types, na_tokens)
    if multi_line and infer and raw.columns:
        raw = staged(raw, "csv-cells")  # records are put together once, for their types and for the caller
    if not infer:
        return raw.select(*[_na_to_null(c, na_tokens).alias(c) for c in raw.columns])
    return _typed(raw, infer_csv_types(raw, na_tokens), na_tokens)


JSON_LAYOUTS = ("lines", "records", "columns")


def _layout(first: str, alone: bool) -> str:
    """A layout, or ``lines of objects`` / ``object`` (several lines, one line) if all values on the first line are objects."""
    import json

    if first.startswith("["):
        return "records"
    try:
        row = json.loads(first)
    except ValueError:
        return "columns"
    if not (isinstance(row, dict) and row and all(isinstance(v, dict) for v in row.values())):
        return "lines"
    return "object" if alone else "lines of objects"


def json_layouts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each layout in ``JSON_LAYOUTS`` (blank files: none), each told by its own first line that is not blank.

    ``[`` opens an array of records; a whole object on the first line with another line
    after it is JSON lines; one object over several lines is a column-oriented file, as is a
    single line whose values are all objects, unless a file of several lines beside it shows
    that the rows themselves are such objects. One aggregation by file; file names come to
    the driver.
    """
    lines = (spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                          F.col("_metadata.file_block_start").alias("block"))
             .withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("row")))
             .where(F.col("value").rlike(r"\S")))
    heads = (lines.groupBy("file").agg(F.min_by("value", "at").alias("first"), F.count("*").alias("n"))
             .withColumn("first", F.regexp_replace("first", r"^\s+|\s+$", "")))
    told = F.udf(lambda first, alone: _layout(first, alone), "string")(F.col("first"), F.col("n") == 1)
    found: dict[str, list[str]] = {}
    for r in heads.select("file", told.alias("layout")).orderBy("file").collect():
        found.setdefault(r.layout, []).append(r.file)
    rows = found.pop("lines of objects", [])
    ones = found.pop("object", [])
    out = {"lines": found.get("lines", []) + rows + (ones if rows else []), "records": found.get("records", []),
           "columns": found.get("columns", []) + ([] if rows else ones)}
    return {k: v for k, v in out.items() if v}


def _literal_path(uri: str) -> str:
    """The path of a file's URI, with the characters that Spark would take for a pattern escaped."""
    from urllib.parse import unquote

    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def _union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name, no value changed.

    A column of whole and decimal numbers is double if double holds each of its whole numbers
    exactly (one look at those columns), and text if it does not; one of other types is text.
    """
    types: dict[str, set[str]] = {}
    for p in parts:
        for c, t in p.dtypes:
            types.setdefault(c, set()).add(t)
    number = {c for c, t in types.items() if t == {"bigint", "double"}}
    for p in parts:
        whole = [c for c, t in p.dtypes if t == "bigint" and c in number]
        if whole:
            exact = p.agg(*[F.coalesce(F.bool_and(F.abs(F.col(f"`{c}`").cast("decimal(20,0)")) <= 2 ** 53), F.lit(True)) for c in whole]).first()
            number -= {c for c, ok in zip(whole, exact) if not ok}
    out = None
    for p in parts:
        cols = []
        for f in p.schema.fields:
            v = F.col(f"`{f.name}`")
            if len(types[f.name]) > 1:
                if f.name in number:
                    v = v.cast("double")
                else:
                    v = F.to_json(v) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else v.cast("string")
            cols.append(v.alias(f.name))
        p = p.select(*cols)
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def scan_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
              layout: str = "lines") -> DataFrame:
    """JSON ``lines`` (splittable), an array of ``records`` per file, or ``columns`` per file.

    A column-oriented file (``{"col": {"0": v, "1": w}, ...}``) is read as maps, exploded to
    (file, row, column, value) cells and pivoted back to rows, which are told by file and
    row; columns are typed as in ``scan_csv`` (numbers in quotes too, as pandas does) unless
    ``schema`` names their types. Such a file is one task, as its rows are complete only at
    its end; an array of records is one task, too. ``auto`` asks ``json_layouts``; files of
    several layouts are read by layout and their rows put together by column name.
    """
    if layout == "auto":
        found = json_layouts(spark, path)
        if len(found) > 1:
            return _union([scan_json(spark, [_literal_path(f) for f in files], schema, kind) for kind, files in found.items()])
        layout = next(iter(found), "lines")
    if layout not in JSON_LAYOUTS:
        raise ValueError(f"layout must be auto or one of {JSON_LAYOUTS}")
    if layout != "columns":
        reader = spark.read.option("multiLine", layout == "records")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), "value")
    cells = (text.select("_file", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("_col", "_vals"))
             .select("_file", "_col", F.explode("_vals").alias("_row", "_value")))
    names = [r[0] for r in cells.select("_col").distinct().orderBy("_col").collect()]  # the columns of the table
    typed = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema) if schema else None
    if typed is not None:
        names = [f.name for f in typed.fields]
    wide = cells.groupBy("_file", "_row").pivot("_col", names).agg(F.first("_value")).select(*[F.col(f"`{n}`") for n in names])
    if typed is not None:
        return _typed(wide, {f.name: f.dataType.simpleString() for f in typed.fields}, ())
    if not names:
        return _typed(wide, {}, ())
    wide = staged(wide, "json-columns")  # rows are put together once, for their types and for the caller
    return _typed(wide, infer_csv_types(wide, ()), ())


def sink_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Write with a header and no index; one file only when asked (``coalesce(1)``)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def read_table(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on the lower-cased extension; an unsupported one raises ``ValueError``."""
    name = path.rstrip("/").split("/")[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext == "csv":
        return scan_csv(spark, path, **kw)
    if ext == "json":
        return scan_json(spark, path, **{"layout": "auto", **kw})
    if ext in ("xlsx", "xls"):
        if ext == "xls":
            raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
        from reviewlens.sources.excel import scan_excel

        return scan_excel(spark, path, **kw)
    if ext == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for files that end in {ext!r}; there is one for {', '.join(SUPPORTED)}")


#: Bytes of input that a task of heavy per-row text work gets, about.
TASK_BYTES = 24 << 20


def balanced(df: DataFrame, key_col: str, min_partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Spread a scan that has fewer partitions than its per-row text work needs.

    A single-file table arrives as one task; per-row text work then runs on one core. At least
    as many partitions as the cluster has cores are made, and with ``path`` (the scanned file or
    folder) one for each ``TASK_BYTES`` of its files, so tasks stay short however large the
    input is. A scan that has enough of them is left untouched; another one is hash-partitioned
    on ``key_col`` (deterministic on retry).
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if path is not None:
        target = max(target, sum(size for _, size, _ in path_state(spark, path) or ()) // TASK_BYTES)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key_col)
