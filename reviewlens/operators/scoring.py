"""Sentiment scoring operators: the cleaning pipeline and pluggable scorers.

A scorer is either

* a ``Column``-builder ``text_column -> struct<sentiment, sentiment_score>`` (runs inside
  whole-stage codegen, e.g. ``LexiconScorer``), or
* a ``BatchScorer``: a pandas function ``Series[str] -> DataFrame[sentiment, sentiment_score]``
  applied with ``mapInPandas`` in Arrow batches; the model is loaded once per task by the
  ``load`` callable.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import sentiment as S
from reviewlens.functions import text as X
from reviewlens.operators.linear import WORDS, pieces
from reviewlens.session import shared_dir


def clean_pipeline(df: DataFrame, text_col: str, keep_original: bool = True) -> DataFrame:
    """Add ``clean_text`` = basic(text) and ``clean_text_advanced`` = advanced(clean_text).

    ``keep_original`` is accepted for API parity and ignored (the input column stays).
    """
    out = df.withColumn("clean_text", X.clean_basic(text_col))
    return X.clean_advanced_df(out, "clean_text", "clean_text_advanced", collapsed=True)


@dataclass(frozen=True)
class LexiconScorer:
    """Column scorer: logits (negative hits, 0.5, positive hits) → softmax arg-max."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    neutral_logit: float = S.NEUTRAL_LOGIT

    def __call__(self, text: Column) -> Column:
        return S.lexicon_struct(text, self.positive, self.negative, self.neutral_logit)

    def apply(self, df: DataFrame, text_col: str) -> DataFrame:
        """Staged form used by ``score_sentiment``: cleaned text, then hit counts, then softmax.

        Each stage is its own projection, so the regex cleaning runs once per row and the
        hit counts (referenced several times by the softmax) are computed once. When the
        frame already holds ``clean_text_advanced`` derived from ``clean_text`` (the
        ``clean_pipeline`` contract), it is reused. Hits are tokens of that text, which is
        whitespace-normalised; the tokens themselves are not made.
        """
        if text_col == "clean_text" and "clean_text_advanced" in df.columns:
            t = df.withColumn("_lx_text", F.col("clean_text_advanced"))
        else:
            t = df.withColumn("_lx_text", X.clean_advanced(text_col))
        t = t.withColumns({"_lx_neg": X.count_in_clean("_lx_text", self.negative),
                           "_lx_pos": X.count_in_clean("_lx_text", self.positive)})
        res = S.neutral_on_empty(text_col, S.sentiment_from_logits("_lx_neg", F.lit(self.neutral_logit), "_lx_pos"))
        t = t.withColumn("_lx", res)
        return t.withColumns({"sentiment": F.col("_lx.sentiment"),
                              "sentiment_score": F.col("_lx.sentiment_score")}) \
            .drop("_lx_text", "_lx_neg", "_lx_pos", "_lx")


@dataclass(frozen=True)
class BatchScorer:
    """pandas scorer run with ``mapInPandas``.

    ``load()`` is called once per task and returns ``predict(texts: pd.Series) ->
    (labels: Sequence[str], scores: Sequence[float])`` for non-empty texts. Empty or null
    texts get ('neutral', 0.0) without reaching the model, and a batch that raises is
    retried row by row so that one failing text scores ('neutral', 0.0) alone.
    """

    load: Callable[[], Callable[[pd.Series], tuple]]
    batch_size: int = 200
    extra: dict = field(default_factory=dict)


def _batch_score_fn(scorer: BatchScorer, text_col: str, out_schema: T.StructType):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = scorer.load()
        for pdf in batches:
            for start in range(0, len(pdf), scorer.batch_size):
                chunk = pdf.iloc[start:start + scorer.batch_size].copy()
                texts = chunk[text_col]
                empty = texts.isna() | (texts == "")
                labels = pd.Series(S.LABELS[1], index=chunk.index, dtype=object)
                scores = pd.Series(0.0, index=chunk.index, dtype="float64")
                todo = texts[~empty]
                if len(todo):
                    try:
                        lab, sc = predict(todo)
                        labels.loc[todo.index] = list(lab)
                        scores.loc[todo.index] = [float(v) for v in sc]
                    except Exception:  # one bad text must not fail the batch
                        for idx, t in todo.items():
                            try:
                                lab, sc = predict(pd.Series([t]))
                                labels.loc[idx], scores.loc[idx] = lab[0], float(sc[0])
                            except Exception:
                                labels.loc[idx], scores.loc[idx] = S.LABELS[1], 0.0
                chunk["sentiment"] = labels
                chunk["sentiment_score"] = scores
                yield chunk[out_schema.fieldNames()]
    return run


def score_sentiment(df: DataFrame, text_col: str = "clean_text",
                    scorer: LexiconScorer | BatchScorer | Callable[[Column], Column] | None = None
                    ) -> DataFrame:
    """Add ``sentiment`` and ``sentiment_score`` computed from ``text_col``."""
    if scorer is None:
        raise ValueError("a scorer is required (LexiconScorer, BatchScorer or a Column builder)")
    if isinstance(scorer, BatchScorer):
        out_schema = T.StructType(
            [f for f in df.schema.fields if f.name not in ("sentiment", "sentiment_score")]
            + [T.StructField("sentiment", T.StringType()),
               T.StructField("sentiment_score", T.DoubleType())])
        base = df.drop("sentiment", "sentiment_score")
        return base.mapInPandas(_batch_score_fn(scorer, text_col, out_schema), out_schema)
    base = df.drop("sentiment", "sentiment_score")
    if hasattr(scorer, "apply"):
        return scorer.apply(base, text_col)
    s = scorer(F.col(text_col))
    return base.withColumn("_scored", s).withColumns(
        {"sentiment": F.col("_scored.sentiment"), "sentiment_score": F.col("_scored.sentiment_score")}).drop("_scored")


@dataclass(frozen=True)
class WordModel:
    """Multinomial naive Bayes: ``words`` has ``word, n0, n1, n2`` (one row per word and label counts in
    the order of ``LABELS``); ``documents`` and ``tokens`` are totals per label, ``vocabulary`` the number of words."""

    words: DataFrame
    documents: tuple[int, int, int]
    tokens: tuple[int, int, int]
    vocabulary: int


def _rows_on_disk(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession, name)}/rows.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_word_model(train: DataFrame, text_col: str, label_col: str) -> WordModel:
    """Optional second scorer, learned from all labelled rows in one pass of word counts.

    ``label_col`` holds 0/1/2 for negative/neutral/positive; rows with other labels or null
    are left out. Words are lower-cased whitespace tokens, counted with partial aggregation.
    The word table stays distributed (written once to the shared folder); seven totals come
    to the driver.
    """
    rows = train.where(F.col(label_col).isin(0, 1, 2)).select(F.col(label_col).alias("y"), F.lower(text_col).alias("t"))
    words = rows.select("y", F.explode(X.tokens("t")).alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(3)])
    words = _rows_on_disk(words, "word-model")
    total = words.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(3)]).first()
    docs = rows.agg(*[F.count_if(F.col("y") == k).alias(f"d{k}") for k in range(3)]).first()
    return WordModel(words, tuple(docs), (total.n0, total.n1, total.n2), total.v)


@F.arrow_udf(T.StructType([T.StructField("word", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType()))]))
def _word_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct words of each list, and how often each is in it."""
    for lists in batches:
        done = []
        for a, rows in pieces(lists, WORDS):
            part = lists.slice(a, rows)
            coded = part.flatten().dictionary_encode()
            width = max(len(coded.dictionary), 1)
            of = np.repeat(np.arange(rows), np.diff(part.offsets.to_numpy()))
            pair, n = np.unique(of * width + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(rows + 1) * width), pa.int32())
            words = coded.dictionary.take(pa.array(pair % width))
            done.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(n))], ["word", "n"]))
        yield pa.concat_arrays(done) if done else pa.array([], pa.struct({"word": pa.list_(pa.string()), "n": pa.list_(pa.int64())}))


def trained_score(df: DataFrame, model: WordModel, text_col: str = "clean_text") -> DataFrame:
    """Add ``sentiment`` (likeliest label, ties to the first) and ``sentiment_score`` (its probability).

    The log-odds of a label are its prior (add-one) and, for each token, log((count + 1) /
    (tokens + vocabulary)); words that no labelled text has count 0. Rows get a generated id
    and are written once; words are counted where a row is read, and the (row, word) counts
    meet the word table in a join whose hot words AQE splits, and are summed per row. The sums
    meet the rows' ids and whatever columns are asked for; a text that is not asked for stays
    where it is. Null and empty texts are ('neutral', 0.0).
    """
    names = [c for c in df.columns if c not in ("sentiment", "sentiment_score")]
    rid = "_ws_id"
    rows = _rows_on_disk(df.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias(rid)), "scored-rows")
    toks = X.tokens(F.lower(text_col))
    words = rows.select(rid, F.coalesce(toks, F.array().cast("array<string>")).alias("_toks")).select(rid, _word_counts("_toks").alias("_w"))
    counted = words.select(rid, F.explode(F.arrays_zip("_w.word", "_w.n")).alias("_p")).select(rid, "_p.word", "_p.n")
    sums = counted.join(model.words, "word").groupBy(F.col(rid).alias("_ws_key")).agg(
        *[F.sum(F.col("n") * F.log(F.col(f"n{k}") + 1.0)).alias(f"_s{k}") for k in range(3)])
    every = sum(model.documents) + 3.0
    logit = lambda k: (F.lit(math.log((model.documents[k] + 1.0) / every)) + F.coalesce(f"_s{k}", F.lit(0.0))
                       - F.col("_len") * F.lit(math.log(max(model.tokens[k] + model.vocabulary, 1))))
    out = rows.withColumns({"_len": F.size(toks), "_text": F.substring(text_col, 1, 1)}).join(sums, F.col(rid) == F.col("_ws_key"), "left")
    out = out.withColumns({f"_l{k}": logit(k) for k in range(3)})
    res = S.neutral_on_empty("_text", S.sentiment_from_logits("_l0", "_l1", "_l2"))
    return out.withColumn("_ws", res).select(*[F.col(f"`{c}`") for c in names], F.col("_ws.sentiment").alias("sentiment"),
                                             F.col("_ws.sentiment_score").alias("sentiment_score"))
