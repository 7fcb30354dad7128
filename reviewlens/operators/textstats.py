"""Text statistics: lengths, word counts, cardinality (one aggregation each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N
from reviewlens.functions import text as X


def add_text_length(df: DataFrame, text_col: str, out: str = "text_length",
                    null_as: str | None = "nan") -> DataFrame:
    """Characters of ``str(text)``; a null text is the string 'nan' (length 3) by default."""
    return df.withColumn(out, X.text_length(text_col, null_as))


def add_word_count(df: DataFrame, text_col: str, out: str = "word_count",
                   null_as: str | None = "nan") -> DataFrame:
    """Whitespace tokens of ``str(text)`` (Python ``split()``), 0 for blank text."""
    c = F.coalesce(F.col(text_col), F.lit(null_as)) if null_as is not None else F.col(text_col)
    return df.withColumn(out, X.word_count(c))


def text_overview(df: DataFrame, text_col: str) -> DataFrame:
    """avg_text_length (truncated to int) and empty_texts (null count)."""
    return df.agg(N.trunc_int(F.avg(X.text_length(text_col))).alias("avg_text_length"),
                  F.count_if(F.col(text_col).isNull()).cast("bigint").alias("empty_texts"))


def count_values(df: DataFrame, values: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, kind, n, c)``: how often each value ``n`` of each kind occurs.

    Lengths and word counts have a few thousand distinct values, so after this one partial
    aggregation every statistic, medians too, is taken over a small table: no task merges
    the values of all rows.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("bigint").alias("n")) for k, v in values.items()])
    return df.select(*keys, F.inline(kinds)).groupBy(*keys, "kind", "n").agg(F.count(F.lit(1)).alias("c"))


class Counted:
    """Statistics of one kind of a ``count_values`` table, as aggregate expressions."""

    def __init__(self, kind: str):
        this = F.col("kind") == kind
        self.n, self.c = F.when(this, F.col("n")), F.when(this & F.col("n").isNotNull(), F.col("c"))

    def count(self) -> Column:
        return F.coalesce(F.sum(self.c), F.lit(0)).cast("bigint")

    def mean(self) -> Column:
        return F.try_divide(F.sum(self.n * self.c).cast("double"), F.sum(self.c))

    def quantiles(self, probs: Sequence[float]) -> Column:
        return F.percentile(self.n.cast("double"), list(probs), self.c)

    def median(self) -> Column:
        return F.percentile(self.n.cast("double"), 0.5, self.c)

    def std(self, ddof: int = 1) -> Column:
        """From exact integer sums, so large means do not cancel small deviations."""
        whole = lambda x: F.sum(x.cast("decimal(38,0)")).cast("decimal(38,0)")
        n, s1 = F.sum(self.c).cast("decimal(38,0)"), whole(self.n * self.c)
        s2 = whole(self.n * self.n * self.c)
        top = (n * s2).cast("decimal(38,0)") - (s1 * s1).cast("decimal(38,0)")
        return F.sqrt(F.try_divide(top.cast("double"), n.cast("double") * (n.cast("double") - ddof)))


def _words(text_col: str) -> Column:
    return X.word_count(F.coalesce(F.col(text_col), F.lit("nan")))


def text_length_stats(df: DataFrame, text_col: str) -> DataFrame:
    """mean, median, min, max, std (sample) of text length, each truncated to int."""
    s = Counted("length")
    return count_values(df, {"length": X.text_length(text_col)}).agg(
        N.trunc_int(s.mean()).alias("mean"), N.trunc_int(s.median()).alias("median"),
        F.min(s.n).alias("min"), F.max(s.n).alias("max"), N.trunc_int(s.std()).alias("std"))


def word_count_stats(df: DataFrame, text_col: str) -> DataFrame:
    """mean, median, min, max of the word count, each truncated to int."""
    s = Counted("words")
    return count_values(df, {"words": _words(text_col)}).agg(
        N.trunc_int(s.mean()).alias("mean"), N.trunc_int(s.median()).alias("median"),
        F.min(s.n).alias("min"), F.max(s.n).alias("max"))


def length_overview(df: DataFrame, text_col: str) -> DataFrame:
    """Average, median and max text length as displayed (unrounded)."""
    s = Counted("length")
    return count_values(df, {"length": X.text_length(text_col)}).agg(
        s.mean().alias("average_length"), s.median().alias("median_length"), F.max(s.n).alias("max_length"))


def text_cardinality(df: DataFrame, text_col: str) -> DataFrame:
    """Null texts and distinct non-null texts, exact: 32-byte hashes are shuffled instead of texts."""
    from reviewlens.operators.profile import row_counts

    empty = F.when(F.col(text_col).isNull(), 1).otherwise(0)
    r = row_counts(df.select(text_col), {"empty_count": empty})
    # null texts are one distinct row of their own
    return r.select("empty_count", (F.col("distinct_rows") - F.when(F.col("empty_count") > 0, 1).otherwise(0))
                    .cast("bigint").alias("unique_count"))


def text_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """All text statistics in one row (lengths, word counts, nulls, distinct texts)."""
    n, w = Counted("length"), Counted("words")
    stats = count_values(df, {"length": X.text_length(text_col), "words": _words(text_col)}).agg(
        N.trunc_int(n.mean()).alias("length_mean"), N.trunc_int(n.median()).alias("length_median"),
        F.min(n.n).alias("length_min"), F.max(n.n).alias("length_max"), N.trunc_int(n.std()).alias("length_std"),
        N.trunc_int(w.mean()).alias("words_mean"), N.trunc_int(w.median()).alias("words_median"),
        F.min(w.n).alias("words_min"), F.max(w.n).alias("words_max"))
    both = stats.unionByName(text_cardinality(df, text_col), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])  # two one-row frames folded into one
