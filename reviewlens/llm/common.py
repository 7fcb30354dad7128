"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import shared_dir

#: A word is a run of characters other than ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark removes the shuffle files of a finished query at once if this is set.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, free_shuffles: bool = False) -> DataFrame:
    """``df`` written to the shared folder (``spark.checkpoint.dir``) and read back.

    Cuts the lineage: a lost executor re-reads files instead of running ``df`` again, and
    several consumers read one result. With ``free_shuffles`` the executors' shuffle files of
    the write go when it is done, so a chain of large steps needs the disk of one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, name)}/t.parquet"
    before = spark.conf.get(FREE_SHUFFLES)
    if free_shuffles:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of values that the driver has (also of no rows)."""
    return spark.createDataFrame(rows, schema)


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0): one letter stands for each word, and white space is dropped."""
    return F.coalesce(F.char_length(F.translate(F.regexp_replace(text, WORD_RE, "x"), WHITE, "")), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that do not clash with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_first_row_hash(df: DataFrame, cols: list[str]) -> Column:
    """A 64-bit hash of ``cols`` that tells a null from an empty value."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)
