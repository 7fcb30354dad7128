"""Language identification: mixture of n-gram models per document, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Languages that a model may have (64 KB each), so that it can be broadcast.
MAX_LANGUAGES = 1000
#: Log-likelihood that a further language must gain, in units of log(number of n-grams).
PENALTY = 3.0
#: n-grams overlap: so many of them count as one observation in the confidence.
OVERLAP = 3.0
UNKNOWN = "und"
_STEP = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str) -> np.ndarray | None:
    """How often each bucket of three-letter n-grams of the lower-cased text occurs; None without a letter.

    Everything but letters is one kind of edge; an n-gram may begin or end with an edge but
    does not reach over one. A long text is counted in steps.
    """
    text, total = text.lower(), None
    for at in range(0, len(text), _STEP):
        # each character of the step between its neighbours
        piece = f"{text[at - 1] if at else ' '}{text[at:at + _STEP + 1]}"
        if at + _STEP >= len(text):
            piece += " "
        code = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, np.uint32(0x20))
        ok = np.flatnonzero(letter[1:-1])
        if not len(ok):
            continue
        h = (code[:-2][ok] * np.uint32(0x9E3779B1) ^ code[1:-1][ok]) * np.uint32(0x85EBCA6B) ^ code[2:][ok]
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        count = np.bincount((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
        total = count if total is None else total + count
    return total


def mixture(likelihood: np.ndarray, count: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the models (columns) that make the n-grams (rows, with counts) likeliest, and the log-likelihood."""
    n, part = count.sum(), np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    for _ in range(rounds):
        joint = likelihood * part
        new = (count / joint.sum(axis=1)) @ joint / n
        moved, part = np.abs(new - part).max(), new
        if moved < 1e-3:
            break
    return part, float(count @ np.log(likelihood @ part))


def proportions(text: str | None, model: np.ndarray, languages: list[str],
                penalty: float = PENALTY) -> tuple[list[tuple[str, float]], float]:
    """The languages of a text with their proportions, largest first (none: no letter), and a score in [0, 1].

    The set of languages grows by the one that helps most while its gain in log-likelihood is
    above ``penalty * log(number of n-grams)``; the proportions are those of the set. The score
    is the largest proportion; of one language, how sure it is against the other single ones.
    """
    count = ngram_counts(text or "")
    if count is None or not languages:
        return [], 0.0
    seen = np.flatnonzero(count)
    count, p = count[seen].astype(np.float64), model[seen]
    single = count @ np.log(p)
    chosen = [int(single.argmax())]
    sure = np.exp(np.maximum((single - single.max()) / OVERLAP, -700.0))
    part, best = np.ones(1), float(single.max())
    while len(chosen) < len(languages):
        now = p[:, chosen] @ part
        gain = count @ np.log(0.9 * now[:, None] + 0.1 * p)
        gain[chosen] = -np.inf
        tried = [*chosen, int(gain.argmax())]
        new_part, level = mixture(p[:, tried], count)
        if level - best <= penalty * np.log(count.sum() + 1):
            break
        chosen, part, best = tried, new_part, level
    found = [(languages[chosen[i]], float(min(1.0, part[i]))) for i in np.argsort(-part, kind="stable")]
    return found, found[0][1] if len(chosen) > 1 else float(sure[chosen[0]] / sure.sum())


def identify(text: str | None, model: np.ndarray, languages: list[str], penalty: float = PENALTY) -> tuple[str, float]:
    """The main language of ``proportions`` and its score; ``und`` and 0 without a letter."""
    found, score = proportions(text, model, languages, penalty)
    return (found[0][0] if found else UNKNOWN), score


def fit(docs: DataFrame, in_training: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities (a column each) from all documents that ``in_training`` holds for.

    Each task counts its n-grams by language, counts are added up by (language, bucket), and
    each language's smoothed probabilities (64 KB) come to the driver.
    """
    rows = docs.filter(in_training & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, value in zip(*(c.to_pylist() for c in b.columns)):
                got = ngram_counts(value)
                if got is not None:
                    total[name] = total[name] + got if name in total else got
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])],
                                             ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def smooth(t: pa.Table) -> pa.Table:  # one language: BUCKETS rows at most
        c = np.full(BUCKETS, 0.1)
        c[t.column("bucket").to_numpy()] += t.column("n").to_numpy()
        return pa.table({"lang": [t.column("lang")[0].as_py()], "p": pa.array([(c / c.sum()).astype(np.float32).tobytes()], pa.binary())})

    found = counts.groupBy("lang").applyInArrow(smooth, "lang string, p binary").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    probabilities = [np.frombuffer(r["p"], np.float32) for r in found]
    return [r["lang"] for r in found], np.stack(probabilities, axis=1) if found else np.zeros((BUCKETS, 0), np.float32)


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``languages``, ``lang_pred`` and ``score``.

    ``languages``: the chosen set as an array of ``lang, share``, largest share first;
    ``lang_pred`` its first; ``score`` as in ``proportions``. A text that is null or has no
    letter has an empty array, ``und`` and 0. Only the text is read for the prediction.
    Columns named like the three, in any case, are replaced.
    """
    new = ("languages", "lang_pred", "score")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast((languages, model))
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        p = p.astype(np.float64)
        for b in batches:
            got = [proportions(t, p, names) for t in b.column(at).to_pylist()]
            found = pa.array([[{"lang": n, "share": x} for n, x in g[0]] for g in got], pairs)
            yield pa.RecordBatch.from_arrays([*b.columns, found, pa.array([g[1] for g in got], pa.float64())],
                                             [*b.schema.names, "languages", "score"])

    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    out = docs.mapInArrow(in_task, T.StructType([*docs.schema, T.StructField("languages", T.ArrayType(pair)),
                                                 T.StructField("score", T.DoubleType())]))
    main = F.coalesce(F.get("languages", F.lit(0))["lang"], F.lit(UNKNOWN))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "languages", main.alias("lang_pred"), "score")
