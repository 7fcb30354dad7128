"""Quality classifier: supervised subword embeddings (hashed words and character n-grams)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import textvec as V
from reviewlens.llm.common import staged

N_GRAMS = (3, 4)
#: Buckets of the learned vectors; with ``DIM`` numbers each, the model has 4 MB.
BUCKET_BITS, DIM = 16, 16
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents that the model is trained on at most (those with the smallest hash of their id).
TRAIN_DOCUMENTS = 6_000


def features(data: np.ndarray, offsets: np.ndarray, before: np.uint64 | None = None
             ) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.uint64 | None]:
    """``(buckets, byte positions)`` of the features of a block of texts, by kind of feature, and its last word's hash.

    ``before`` is the hash of the word before a part of a long text.

    Words and pairs of neighbouring equal words (bucket 0 stands for all such pairs), and the
    n-grams of bytes inside words, where one white-space byte on either side marks the word's
    edge. Case and punctuation are kept: shouting and symbols are signs of quality.
    """
    starts, ends = V.words(data, offsets)
    of = V.owner(starts, offsets)
    word = V.word_hashes(data, starts, ends)
    pair = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
    if before is not None and len(word):
        pair = np.concatenate(([0] if word[0] == before else [], pair)).astype(np.int64)
    out = [((word % np.uint64(BUCKETS)).astype(np.int32), starts), (np.zeros(len(pair), np.int32), starts[pair])]
    space = V._SPACE[data]
    byte = np.where(space, np.uint8(0x20), data)
    for size in N_GRAMS:  # 2 to 4 bytes fit a 32-bit code
        n = len(data) - size + 1
        if n <= 0:
            continue
        code, ok = np.full(n, size, np.uint32), np.ones(n, bool)
        for k in range(size):
            code = code * np.uint32(0x01000193) ^ byte[k:k + n]
            if 0 < k < size - 1:
                ok &= ~space[k:k + n]
            if k:
                cut = offsets[1:-1] - k  # an n-gram does not reach into the next text
                ok[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(ok)
        code = code[at]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        out.append(((code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), at))
    return out, word[-1] if len(word) else before


def part_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(buckets, byte positions, offsets)`` of each kind of feature, by parts of a long text; the parts have what the whole has."""
    last = None
    for part, cut in V.parts(data, offsets):
        kinds, last = features(part, cut, last)
        for ids, at in kinds:
            yield ids, at, cut


@dataclass
class Model:
    """``margin[b]``: what bucket ``b`` adds to the log-odds of label 1 (its vector times the softmax weights)."""

    margin: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; a text without words or n-grams gets the bias alone."""
        out = []
        for _, data, offsets in V.blocks(column):
            n = len(offsets) - 1
            total, count = np.zeros(n), np.zeros(n, np.int64)
            for ids, at, cut in part_features(data, offsets):  # sums add up over the parts of a long text
                cuts = np.searchsorted(at, cut)
                sums = np.concatenate(([0.0], np.cumsum(self.margin[ids], dtype=np.float64)))
                total += np.diff(sums[cuts])
                count += np.diff(cuts)
            mean = total / np.maximum(count, 1)
            out.append(1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str | None], labels: np.ndarray, dim: int = DIM, epochs: int = 8,
          min_steps: int = 8_000, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, on the softmax of the averaged vectors.

    ``epochs`` rounds over the documents, or as many as make ``min_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, data, offsets in V.blocks(pa.array(texts, type=pa.string())):
        if len(offsets) == 2:
            ids = np.concatenate([f for f, _, _ in part_features(data, offsets)])
            cuts = np.array([0, len(ids)])
        else:
            ids, at = (np.concatenate(x) for x in zip(*features(data, offsets)[0]))
            order = np.argsort(at, kind="stable")
            ids, cuts = ids[order], np.searchsorted(at[order], offsets)
        for a, b in zip(cuts[:-1], cuts[1:]):
            unique, count = np.unique(ids[a:b], return_counts=True)
            rows.append((unique, (count / max(b - a, 1)).astype(np.float32)))
    vectors = (rng.uniform(-1, 1, (BUCKETS, dim)) / dim).astype(np.float32)
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-min_steps // max(len(rows), 1)))
    steps, done = epochs * max(len(rows), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            mine = vectors[ids]
            hidden = share @ mine
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1.0
            back = weights @ p
            weights -= step * np.outer(hidden, p)
            bias -= np.float32(0.01) * step * p
            if len(ids):
                vectors[ids] = mine - np.outer(step * share, back)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _id_key(doc_id: Column) -> Column:
    return doc_id.cast("string")


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, in_training: Column,
                  limit: int) -> DataFrame:
    """``text, label`` of at most ``limit`` labelled documents, one row an id, chosen by a hash of the id.

    An id that ``labels`` holds several times has its smallest label; one that ``docs`` holds
    several times, the text with the smallest hash. The chosen ids (at most ``limit`` rows) are
    broadcast, so documents are not shuffled; of the chosen ones, one text an id leaves a task.
    """
    chosen = (labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_label"))
              .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & in_training)
              .groupBy("_id").agg(F.min("_label").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(limit))
    chosen = staged(chosen, "classifier-ids")
    rows = docs.select(F.col(f"`{doc_id}`").alias("_d"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(chosen), F.col("_d") == F.col("_id"))
    first = F.min(F.struct(F.xxhash64("_text"), F.col("_text").alias("_text"))).alias("_first")
    return rows.groupBy("_id", "_label").agg(first).select("_id", F.col("_first._text").alias("_text"), "_label")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        in_training: Column | None = None, limit: int = TRAIN_DOCUMENTS) -> Model:
    """The model learned from labelled documents (``in_training`` is a condition on ``_id``).

    The sample is gathered by all tasks; training runs in one task on it (``limit`` rows at
    most), and only the margins (4 bytes a bucket) come to the driver. Without any labelled document every score is 0.5.
    """
    rows = training_rows(docs, labels, doc_id, text, label, F.lit(True) if in_training is None else in_training, limit)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (str(r[0]), r[1] or "", r[2]))  # the same model whatever the order of reading
        if got:
            m = train([t for _, t, _ in got], np.array([y for _, _, y in got]))
            yield pa.RecordBatch.from_pydict({"margin": [m.margin.tobytes()], "bias": [m.bias]})

    # a shuffle of at most `limit` rows: what is before it (the scan of the corpus) stays in as many tasks as it has
    model = rows.repartition(1).mapInArrow(in_task, "margin binary, bias double").first()
    if model is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(model["margin"], np.float32), model["bias"])


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 if score >= threshold).

    Only the text is read for the score. Null and empty texts get the score of no features.
    Columns of ``docs`` named like the two, in any case, are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")])
    at = docs.columns.index(text)
    cast = model.margin, model.bias
    shared = docs.sparkSession.sparkContext.broadcast(cast)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            s = m.score(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(in_task, schema)
