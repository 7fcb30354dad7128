"""Sentiment statistics and the datasets behind each chart (no figures are drawn).

Every per-label metric is one ``groupBy(sentiment)`` — the reference filters the table
three times, once per label.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N
from reviewlens.functions import text as X
from reviewlens.functions.sentiment import LABELS
from reviewlens.operators.quantiles import group_quantiles, group_summary
from reviewlens.operators.textstats import Counted, count_values


def sentiment_counts(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Count per label, descending (ties by label)."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("sentiment"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("sentiment")))


def sentiment_percentages(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Count and % of all rows for each of the three labels; an absent label gets 0."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(label_col) == lab).alias(f"_c{i}") for i, lab in enumerate(LABELS)])
    rows = [F.struct(F.lit(lab).alias("sentiment"), F.col(f"_c{i}").cast("bigint").alias("count"),
                     (F.try_divide(F.col(f"_c{i}").cast("double"), F.col("_n")) * 100.0).alias("percentage"))
            for i, lab in enumerate(LABELS)]
    return agg.select(F.inline(F.array(*rows)))


def _median(df: DataFrame, score_col: str) -> DataFrame:
    """Exactly one row ``(median_sentiment_score)``, NULL when every score is missing.

    ``group_quantiles`` gives at most one row; a global ``max`` over it always yields one.
    """
    m = group_quantiles(df.select(F.col(score_col)), [], score_col, [0.5])
    return m.agg(F.max("value").alias("median_sentiment_score"))


def sentiment_score_overview(df: DataFrame, score_col: str = "sentiment_score") -> DataFrame:
    s = group_summary(df.select(F.col(score_col).alias("s")), [], "s", [0.5])
    return s.agg(F.max("mean").alias("average_sentiment_score"), F.max(F.col("q")[0]).alias("median_sentiment_score"))


def confidence_by_sentiment(df: DataFrame, label_col: str = "sentiment",
                            score_col: str = "sentiment_score") -> DataFrame:
    """Mean confidence per label present."""
    return (df.where(F.col(label_col).isin(list(LABELS))).groupBy(F.col(label_col).alias("sentiment"))
            .agg(F.avg(score_col).alias("avg_confidence")))


def sentiment_statistics(df: DataFrame, label_col: str = "sentiment",
                         score_col: str = "sentiment_score") -> DataFrame:
    """All sentiment statistics as tidy ``(metric, key, value)`` rows, from one aggregation.

    total_reviews; count and percentage per label present; average and median score;
    average confidence per label present.
    """
    lab, s = F.col(label_col), F.col(score_col)
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(s).alias("_avg")]
    for i, name in enumerate(LABELS):
        aggs += [F.count_if(lab == name).alias(f"_c{i}"), F.avg(F.when(lab == name, s)).alias(f"_a{i}")]
    a = df.agg(*aggs)
    rows = [F.struct(F.lit("total_reviews").alias("metric"), F.lit(None).cast("string").alias("key"),
                     F.col("_n").cast("double").alias("value"))]
    for i, name in enumerate(LABELS):
        rows += [
            F.struct(F.lit("sentiment_counts").alias("metric"), F.lit(name).alias("key"),
                     F.when(F.col(f"_c{i}") > 0, F.col(f"_c{i}").cast("double")).alias("value")),
            F.struct(F.lit("sentiment_percentages").alias("metric"), F.lit(name).alias("key"),
                     F.when(F.col(f"_c{i}") > 0, F.col(f"_c{i}") / F.col("_n") * 100.0).alias("value")),
            F.struct(F.lit("avg_confidence").alias("metric"), F.lit(name).alias("key"),
                     F.col(f"_a{i}").alias("value")),
        ]
    rows += [F.struct(F.lit("average_sentiment_score").alias("metric"), F.lit(None).cast("string").alias("key"),
                      F.col("_avg").alias("value"))]
    tidy = a.select(F.inline(F.array(*rows))).where(
        F.col("value").isNotNull() | (F.col("metric") == "average_sentiment_score"))
    # the median row is always present (NULL when no score), like the average
    med = _median(df, score_col).select(F.lit("median_sentiment_score").alias("metric"),
                                        F.lit(None).cast("string").alias("key"),
                                        F.col("median_sentiment_score").alias("value"))
    return tidy.unionByName(med)


def stars_by_sentiment(df: DataFrame, rating_col: str, label_col: str = "sentiment") -> DataFrame:
    """Mean rating per label (missing ratings skipped)."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("sentiment"))
            .agg(F.avg(N.nan_to_null(rating_col)).alias("avg_stars")))


def rating_sentiment_crosstab(df: DataFrame, rating_col: str, label_col: str = "sentiment"
                              ) -> DataFrame:
    """Rating × label counts; columns negative, neutral, positive, missing cells 0.

    A single aggregation with conditional counts (no pivot pass, no null cells); rows with a
    missing rating or label are dropped.
    """
    r = N.nan_to_null(rating_col)
    lab = F.col(label_col)
    return (df.where(r.isNotNull() & lab.isNotNull()).groupBy(r.alias("rating"))
            .agg(*[F.count_if(lab == name).cast("bigint").alias(name) for name in LABELS])
            .orderBy("rating"))


def confidence_distribution(df: DataFrame, label_col: str = "sentiment",
                            score_col: str = "sentiment_score") -> DataFrame:
    """Per label: count, min, Q1, median, Q3, max, mean of the score (box / violin data).

    Scores are unbounded doubles and one label may hold most rows, so the quartiles come
    from ``group_summary`` (two reads), not a per-label value map.
    """
    base = (df.where(F.col(label_col).isin(list(LABELS)))
            .select(F.col(label_col).alias("sentiment"), F.col(score_col).cast("double").alias("s")))
    return group_summary(base, ["sentiment"], "s", (0.25, 0.5, 0.75)).select(
        "sentiment", F.col("n").alias("count"), F.col("low").alias("min"), *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))],
        F.col("high").alias("max"), "mean")


def length_distribution(df: DataFrame, text_col: str, label_col: str = "sentiment") -> DataFrame:
    """Per label: the same summary of text length, plus its population std (box ``sd``)."""
    rows = df.where(F.col(label_col).isin(list(LABELS))).select(F.col(label_col).alias("sentiment"), text_col)
    s = Counted("length")
    real = lambda c: c.cast("double")
    return (count_values(rows, {"length": X.text_length(text_col)}, ["sentiment"]).groupBy("sentiment")
            .agg(s.count().alias("count"), real(F.min(s.n)).alias("min"), s.quantiles((0.25, 0.5, 0.75)).alias("_q"),
                 real(F.max(s.n)).alias("max"), s.mean().alias("mean"), s.std(ddof=0).alias("std"))
            .select("sentiment", "count", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), "max", "mean", "std"))


def _stop_list(stopwords: Iterable[str] | None) -> list[str]:
    if stopwords is None:
        from reviewlens.functions.stopwords import ENGLISH

        stopwords = ENGLISH
    return list(stopwords)


def _filtered_tokens(text_col: str, stopwords: Iterable[str] | None, cleaned: bool = False):
    """Token array without stop-words (for pairing adjacent tokens)."""
    stop = _stop_list(stopwords)
    if cleaned:  # one array filter over a plain split, no whitespace regex
        return F.filter(X.split_clean(text_col), lambda x: (x != "") & ~x.isin(stop))
    toks = X.tokens(X.clean_advanced(F.col(text_col)))
    return F.filter(toks, lambda x: ~x.isin(stop)) if stop else toks


def _words(df: DataFrame, keys: list[str], text_col: str, stopwords: Iterable[str] | None,
           cleaned: bool) -> DataFrame:
    """One row per kept token. The stop-word test runs after ``explode`` as a codegen'd
    ``InSet`` instead of an interpreted array lambda."""
    stop = _stop_list(stopwords)
    toks = X.split_clean(text_col) if cleaned else X.tokens(X.clean_advanced(F.col(text_col)))
    w = F.col("word")
    keep = (w != "") & ~w.isin(stop) if stop else (w != "")
    return df.select(*keys, F.explode(toks).alias("word")).where(keep)


def _top_per_group(counts: DataFrame, item: str, top_n: int, by: str | None) -> DataFrame:
    if by is None:
        return counts.orderBy(F.col("count").desc(), F.col(item)).limit(top_n)
    # row_number ≤ k is planned with a partial WindowGroupLimit before the shuffle
    w = Window.partitionBy(by).orderBy(F.col("count").desc(), F.col(item))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def word_frequencies(df: DataFrame, text_col: str, top_n: int = 100,
                     stopwords: Iterable[str] | None = None, by: str | None = None,
                     cleaned: bool = False) -> DataFrame:
    """Top ``top_n`` words of the cleaned text, stop-words removed, count desc then word.

    With ``by`` (e.g. ``sentiment``) the top words are computed per group in the same job.
    Counting is a partial-aggregated ``groupBy(word)``: frequent words are combined in each
    map task before the shuffle. ``cleaned=True`` when ``text_col`` already holds
    ``clean_advanced`` output (e.g. ``clean_text_advanced``), which skips a second cleaning.
    """
    keys = [by] if by else []
    words = _words(df, keys, text_col, stopwords, cleaned)
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))
    return _top_per_group(counts, "word", top_n, by)


def bigram_frequencies(df: DataFrame, text_col: str, top_n: int = 100,
                       stopwords: Iterable[str] | None = None, by: str | None = None,
                       cleaned: bool = False) -> DataFrame:
    """Top two-word collocations of adjacent (stop-word-filtered) tokens."""
    keys = [by] if by else []
    toks = df.select(*keys, _filtered_tokens(text_col, stopwords, cleaned).alias("_toks"))
    # explode the (left, right) neighbours and join each pair after the explode, where
    # the concatenation is code-generated (no per-row array lambda)
    n = F.greatest(F.size("_toks") - 1, F.lit(0))
    pairs = toks.select(*keys, F.explode(F.arrays_zip(F.slice("_toks", 1, n).alias("l"),
                                                      F.slice("_toks", 2, n).alias("r"))).alias("_p"))
    grams = pairs.select(*keys, F.concat_ws(" ", F.col("_p.l"), F.col("_p.r")).alias("bigram"))
    counts = grams.groupBy(*keys, "bigram").agg(F.count(F.lit(1)).alias("count"))
    return _top_per_group(counts, "bigram", top_n, by)


def dashboard_bundle(df: DataFrame, rating_col: str | None = None, label_col: str = "sentiment",
                     score_col: str = "sentiment_score") -> DataFrame:
    """Tagged union: label counts, score summary per label, rating distribution (if any).

    Rows ``(panel, key, metric, value)``.
    """
    lab = F.col(label_col)
    counts = (df.where(lab.isNotNull()).groupBy(lab.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
              .select(F.lit("sentiment_distribution").alias("panel"), F.col("key"),
                      F.lit("count").alias("metric"), "value"))
    box = confidence_distribution(df, label_col, score_col)
    box_rows = box.select(F.lit("confidence_scores").alias("panel"), F.col("sentiment").alias("key"),
                          F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                             for m in ("count", "min", "q1", "median", "q3", "max", "mean")])))
    out = counts.unionByName(box_rows)
    if rating_col:
        r = N.nan_to_null(rating_col)
        dist = (df.where(r.isNotNull()).groupBy(r.cast("string").alias("key"))
                .agg(F.count(F.lit(1)).cast("double").alias("value"))
                .select(F.lit("rating_distribution").alias("panel"), "key", F.lit("count").alias("metric"), "value"))
        out = out.unionByName(dist)
    return out
