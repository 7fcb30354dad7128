"""A discriminative scorer: softmax regression on hashed words, by full-batch gradient steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import text as X
from reviewlens.functions.sentiment import LABELS
from reviewlens.session import staged

#: Buckets of hashed words; the model is three numbers for each.
BUCKETS = 1 << 15
#: Partial gradients that reach the driver in a step.
SUMS = 8
#: Words that a task works on at a time (one text, if it has more).
WORDS = 1 << 18
K = len(LABELS)


def hashed_words(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each lower-cased white-space token, as an array."""
    return F.transform(X.tokens(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def features(words: pa.ListArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket, value)`` of a batch: the root of each bucket's share of the text's words (vectors of length one)."""
    size, ids = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
    of = np.repeat(np.arange(len(size)), size)
    pair, count = np.unique(of * buckets + ids, return_counts=True)
    of, ids = pair // buckets, pair % buckets
    return of, ids, np.sqrt(count / size[of])


def pieces(words: pa.ListArray, limit: int) -> Iterator[tuple[int, int]]:
    """``start, rows`` of neighbouring texts with at most ``limit`` words together, or of one text."""
    ends, a = words.offsets.to_numpy(), 0
    while a < len(words):
        z = max(int(np.searchsorted(ends, ends[a] + limit, "right")) - 1, a + 1)
        yield a, z - a
        a = z


@dataclass(frozen=True)
class LinearModel:
    """``weights[label, bucket]`` and ``bias[label]``; a text's logit is the sum of its features' weights plus the bias."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, n: int, of: np.ndarray, ids: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A row for each of ``n`` texts: the probability of each label."""
        logits = np.stack([np.bincount(of, weights=w[ids] * value, minlength=n) for w in self.weights], axis=1) + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _gradient(model: LinearModel) -> Callable:
    """Sum over a task's rows of the gradient of the log-likelihood loss, and the number of rows."""
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = model.weights.shape[1]
        total, slot = np.zeros(K * buckets + K + 1), None
        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column(2)[0].as_py()
            for a, n in pieces(b.column(0), WORDS):
                of, ids, value = features(b.column(0).slice(a, n), buckets)
                back = model.probabilities(n, of, ids, value)
                back[np.arange(n), b.column(1).slice(a, n).to_numpy()] -= 1.0
                for k in range(K):
                    total[k * buckets:(k + 1) * buckets] += np.bincount(ids, weights=back[of, k] * value, minlength=buckets)
                total[-K - 1:-1] += back.sum(axis=0)
                total[-1] += n
        if slot is not None:
            yield pa.RecordBatch.from_pydict({"slot": [slot % SUMS], "task": [slot], "total": [total.tobytes()]})
    return in_task


def _add(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("task").to_numpy())
    total = sum(np.frombuffer(table.column("total")[int(i)].as_buffer()) for i in order)
    return pa.Table.from_pydict({"slot": table.column("slot")[:1].to_pylist(), "total": [total.tobytes()]})


def fit_linear_model(train: DataFrame, text_col: str, label_col: str, steps: int = 40, rate: float = 2.0, momentum: float = 0.9,
                     decay: float = 1e-4, buckets: int = BUCKETS) -> LinearModel:
    """The model after ``steps`` full-batch gradient steps from zero on all labelled rows.

    ``label_col`` holds 0/1/2 for negative/neutral/positive; other rows are left out. Words are
    hashed once and written to the shared folder; a step is one job whose tasks add up their
    rows' gradients (as large as the model, whatever the rows), which are added in a fixed order
    in ``SUMS`` groups. A step goes on with ``momentum`` of the one before; ``decay`` pulls the
    weights to zero. Without a labelled row the model
    is zero.
    """
    rows = train.where(F.col(label_col).isin(*range(K))).select(
        hashed_words(F.coalesce(F.col(text_col), F.lit("")), buckets).alias("words"), F.col(label_col).cast("int").alias("y"))
    rows = staged(rows, "linear-rows").withColumn("task", F.spark_partition_id().cast("long"))
    model = LinearModel(np.zeros((K, buckets)), np.zeros(K))
    move, shift = np.zeros((K, buckets)), np.zeros(K)
    for _ in range(steps):
        parts = rows.mapInArrow(_gradient(model), "slot long, task long, total binary")
        sums = parts.groupBy("slot").applyInArrow(_add, "slot long, total binary").collect()  # ``SUMS`` rows at most
        if not sums:
            break
        total = sum(np.frombuffer(r.total) for r in sorted(sums, key=lambda r: r.slot))
        n = total[-1]
        move = momentum * move - rate * (total[:K * buckets].reshape(K, buckets) / n + decay * model.weights)
        shift = momentum * shift - rate * total[-K - 1:-1] / n
        model = LinearModel(model.weights + move, model.bias + shift)
    return model


def linear_score(df: DataFrame, model: LinearModel, text_col: str = "clean_text") -> DataFrame:
    """``df`` with ``sentiment`` (likeliest label, ties to the first) and ``sentiment_score`` (its probability).

    Rows are scored where they are read: no id, no join, no shuffle. Only hashed words go to
    Python, ``WORDS`` are worked on at a time. Null and empty texts are ('neutral', 0.0). Columns named like the two, in any case, are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("sentiment", "sentiment_score")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # as large as the parameter ``buckets`` says
    result = T.StructType([T.StructField("sentiment", T.StringType()), T.StructField("sentiment_score", T.DoubleType())])

    @F.arrow_udf(result)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LinearModel(*shared.value)
        for column in batches:
            empty = column.is_null().to_numpy(zero_copy_only=False)
            words = column.fill_null([]) if empty.any() else column
            p = np.concatenate([np.zeros((0, K)), *(m.probabilities(n, *features(words.slice(a, n), m.weights.shape[1]))
                                                    for a, n in pieces(words, WORDS))])
            label, best = np.where(empty, 1, p.argmax(axis=1)), np.where(empty, 0.0, p.max(axis=1))
            yield pa.StructArray.from_arrays([pa.array(LABELS, pa.string()).take(pa.array(label)), pa.array(best, pa.float64())],
                                             ["sentiment", "sentiment_score"])

    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                     F.when(text != "", hashed_words(text, model.weights.shape[1])).alias("_words"))
    out = rows.withColumn("_scored", score("_words"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "_scored.sentiment", "_scored.sentiment_score")
