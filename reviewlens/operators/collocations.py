"""Word pairs that belong together, and the word table of a word cloud.

A pair counts as a collocation if it is *associated*: Dunning's log-likelihood ratio of its
contingency table (pair, left word, right word, total) is above a threshold. In the cloud a
collocation is an entry of its own, its occurrences are taken off both words, and plurals are
counted with their singular.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import text as X
from reviewlens.operators.charts import _stop_list, _top_per_group
from reviewlens.session import staged

#: Pairs with a log-likelihood ratio above this are collocations.
THRESHOLD = 30.0


def log_likelihood_ratio(pair: Column, left: Column, right: Column, total: Column) -> Column:
    """Dunning's G² of "right follows left", from counts; 0 if a word makes up all words.

    -2 times the log of the likelihood under one rate of the right word everywhere, over that
    under a rate of its own after the left word.
    """
    def likelihood(k: Column, n: Column, p: Column) -> Column:
        low = F.lit(1e-10)
        return k * F.log(F.greatest(p, low)) + (n - k) * F.log(F.greatest(F.lit(1.0) - p, low))

    k, a, b, n = (c.cast("double") for c in (pair, left, right, total))
    everywhere = b / n
    after, elsewhere = F.try_divide(k, a), F.try_divide(b - k, n - a)
    ratio = (likelihood(k, a, everywhere) + likelihood(b - k, n - a, everywhere)
             - likelihood(k, a, after) - likelihood(b - k, n - a, elsewhere))
    return F.when((n <= a) | (n <= b), F.lit(0.0)).otherwise(-2.0 * ratio)


def neighbour_counts(df: DataFrame, text_col: str, stopwords: Iterable[str] | None = None, by: str | None = None,
                     cleaned: bool = False) -> DataFrame:
    """``group, word, next, n``: how often a word is followed by ``next`` (null: a stop-word or the end).

    One aggregation over all tokens serves words and pairs: every kept token is the left one
    once. Neighbours are those of the text itself, so a pair never bridges a dropped word or
    two rows. ``group`` is the value of ``by`` (null without it).
    """
    stop = _stop_list(stopwords)
    toks = X.split_clean(text_col) if cleaned else X.tokens(X.clean_advanced(F.col(text_col)))
    rows = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("group"), toks.alias("_toks"))
    word = F.explode(F.arrays_zip(F.col("_toks").alias("word"), F.slice("_toks", 2, F.greatest(F.size("_toks"), F.lit(1))).alias("next")))
    pairs = rows.select("group", word.alias("_p")).select("group", "_p.word", "_p.next")
    kept = lambda c: (c != "") & ~c.isin(stop) if stop else c != ""
    return (pairs.where(kept(F.col("word"))).withColumn("next", F.when(kept(F.col("next")), F.col("next")))
            .groupBy("group", "word", "next").agg(F.count(F.lit(1)).alias("n")))


def _base(word: Column, plurals: bool) -> Column:
    """A word in -s (not -ss) without it. No base ends in -s but those in -ss, so a base stands for itself and for its plural only."""
    return F.when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.char_length(word) - 1)).otherwise(word) if plurals else word


def _folded(counts: DataFrame, keys: list[str], word: str, plurals: bool) -> DataFrame:
    """``keys, base, itself, n`` of ``counts`` by base, ``itself``: the base occurs, not its plural only. One aggregation."""
    base = _base(F.col(word), plurals)
    return counts.groupBy(*keys, base.alias("base")).agg(F.sum("n").alias("n"), F.bool_or(F.col(word) == base).alias("itself"))


def _form(base: str = "base", itself: str = "itself") -> Column:
    return F.when(F.col(itself), F.col(base)).otherwise(F.concat(base, F.lit("s")))


def _tables(df: DataFrame, text_col: str, stopwords: Iterable[str] | None, by: str | None, cleaned: bool,
            plurals: bool) -> tuple[DataFrame, DataFrame]:
    """Words (``group, base, form, n``) and pairs (``group, word, next, n, left, right, total, score`` and the forms of both words)."""
    near = staged(neighbour_counts(df, text_col, stopwords, by, cleaned), "collocation-neighbours")
    words = staged(_folded(near, ["group"], "word", plurals).select("group", "base", _form().alias("form"), "n"), "collocation-words")
    pairs = _folded(near.where(F.col("next").isNotNull()), ["group", "word"], "next", plurals)
    totals = words.groupBy(F.col("group").alias("_g")).agg(F.sum("n").alias("total"))
    for key, out in ((_base(F.col("word"), plurals), "left"), (F.col("base"), "right")):
        side = words.select(F.col("group").alias("_g"), F.col("base").alias("_b"), F.col("form").alias(f"{out}_form"), F.col("n").alias(out))
        # the word first: rows are sorted by it, and there are few groups
        pairs = pairs.join(side, (key == F.col("_b")) & F.col("group").eqNullSafe(F.col("_g"))).drop("_g", "_b")
    pairs = pairs.join(totals, F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    return words, pairs.withColumn("next", _form()).withColumn("score", log_likelihood_ratio(F.col("n"), F.col("left"), F.col("right"), F.col("total")))


def collocations(df: DataFrame, text_col: str, threshold: float = THRESHOLD, stopwords: Iterable[str] | None = None,
                 by: str | None = None, cleaned: bool = False, plurals: bool = True) -> DataFrame:
    """Associated pairs: ``word, next, count, left_count, right_count, total, score`` (and ``by``).

    ``count``: how often ``next`` follows ``word``; the two word counts include plurals; ``total``
    is the number of kept words of the group. All pairs above ``threshold`` are returned, in no
    order. The vocabulary is never broadcast by hand: words and pairs meet in joins that are
    the optimizer's choice. Null and empty texts have no words.
    """
    _, pairs = _tables(df, text_col, stopwords, by, cleaned, plurals)
    return pairs.where(F.col("score") > threshold).select(
        *([F.col("group").alias(by)] if by else []), "word", "next", F.col("n").alias("count"), F.col("left").alias("left_count"),
        F.col("right").alias("right_count"), "total", "score")


def cloud_words(df: DataFrame, text_col: str, top_n: int = 100, threshold: float = THRESHOLD,
                stopwords: Iterable[str] | None = None, by: str | None = None, cleaned: bool = False,
                plurals: bool = True) -> DataFrame:
    """The ``top_n`` entries of a word cloud: words and collocations (``"word next"``) with ``count``, count descending then entry.

    A word's count is that of its forms less its occurrences in collocations; words that
    nothing is left of are dropped. With ``by``, per group, with ``rank``.
    """
    words, pairs = _tables(df, text_col, stopwords, by, cleaned, plurals)
    found = staged(pairs.where(F.col("score") > threshold)
                   .select("group", "word", "next", "n", "left_form", "right_form"), "collocation-found")
    entries = words.select("group", F.col("form").alias("word"), F.col("n").alias("count"))
    for side in ("left_form", "right_form"):
        entries = entries.unionByName(found.select("group", F.col(side).alias("word"), (-F.col("n")).alias("count")))
    entries = (entries.groupBy("group", "word").agg(F.sum("count").alias("count")).where(F.col("count") > 0)
               .unionByName(found.select("group", F.concat_ws(" ", "word", "next").alias("word"), F.col("n").alias("count"))))
    if by:
        entries = entries.withColumnRenamed("group", by)
    return _top_per_group(entries if by else entries.drop("group"), "word", top_n, by)
