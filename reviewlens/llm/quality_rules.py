"""Quality rules on single documents, and on lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import textvec as V
from reviewlens.llm.common import fresh, staged

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Result columns of the rules on single documents.
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def _repeated(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (group, value): whether it occurs twice, and whether it occurred before."""
    order = np.lexsort((values, groups))  # stable: equal ones stay in text order
    g, v = groups[order], values[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    again, twice = np.zeros(len(g), bool), np.zeros(len(g), bool)
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, again


def document_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``RULES`` for each text of a block."""
    n = len(offsets) - 1
    space = V._SPACE[data]
    starts, ends = V.spans(~space, offsets)
    of = V.owner(starts, offsets)

    line_starts, line_ends = V.spans(data != 0x0A, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_of, view = V.owner(line_starts, offsets), memoryview(data)
    lines = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(line_starts.tolist(), line_ends.tolist())),
                        dtype=np.uint64, count=len(line_starts))
    _, again = _repeated(line_of, lines)

    window, first = V.windows(V.word_hashes(data, starts, ends), of, WINDOW)
    twice, _ = _repeated(of[first], window)
    edges = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(edges, first[twice], 1)
    np.add.at(edges, first[twice] + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return {
        "n_words": np.bincount(of, minlength=n),
        "word_chars": V.per_text(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": V.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_of[again], minlength=n),
        "n_repeat_words": np.bincount(of[covered], minlength=n),
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        parts = [document_counts(data, off) for _, data, off in V.blocks(text)]
        cols = {c: np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for c in RULES}
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, cols.values())],
                                         [*batch.schema.names[:-1], *RULES])


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and the counts of ``RULES`` of each text (null: all 0).

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line;
    ``n_repeat_words``: words inside a window of 8 words that the text has twice or more.
    Columns named like a count, in any case, are replaced.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in RULES]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c in RULES:
        schema = schema.add(c, "long")
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(_count_batches, schema)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where it is used several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_key(line: Column) -> Column:
    """Hash of a line without case, with runs of white space as one space; null if it has no word."""
    norm = _norm(line)
    return F.when(norm != "", F.xxhash64(norm))


def line_facts(line: Column) -> Column:
    """``line``: see ``line_key``; ``words``; null if the line has no word."""
    return _bind(_norm(line), lambda x: F.when(x != "", F.struct(
        F.xxhash64(x).alias("line"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "))) + 1).cast("long").alias("words"))))


def text_key(text: Column, host: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text on a host (nulls told from empty ones)."""
    both = [text.isNull(), F.coalesce(text, F.lit("")), host.isNull(), F.coalesce(host, F.lit(""))]
    return [F.xxhash64(*both), F.xxhash64(F.lit("2"), *both)]


def shared_lines(docs: DataFrame, host: str = "source", text: str = "text", min_documents: int = 20,
                 copies: DataFrame | None = None) -> DataFrame:
    """The lines over the limits: ``_k1, _k2`` (see ``text_key``), ``_line`` and its ``_words``, a row per place.

    Per host the distinct documents that hold a line are counted; a line in more than
    ``min_documents`` of them is over the limit, however large the host is. A document is a
    distinct text. A caller that wants near copies to count once gives ``copies``: ``_k1, _k2``
    (from ``text_key``) and ``document``; texts with one ``document`` count as one.

    Equal rows are reduced map-side before any shuffle, so a text or line that a third of the
    rows hold is small when it is shuffled. Null hosts are one host; null texts and blank lines
    hold no line.
    """
    h, t = F.col(f"`{host}`"), F.col(f"`{text}`")
    k1, k2 = text_key(t, h)
    lines = F.transform(F.split(t, "\n"), line_facts)
    places = (docs.select(k1.alias("_k1"), k2.alias("_k2"), h.alias("_host"), lines.alias("_lines"))
              .select("_k1", "_k2", "_host", F.posexplode("_lines").alias("_at", "_x"))
              .filter(F.col("_x").isNotNull())
              .select("_k1", "_k2", "_host", "_at", F.col("_x.line").alias("_line"), F.col("_x.words").alias("_words")))
    places = staged(places.distinct(), "rule-lines")

    def counted(held: DataFrame, name: str) -> DataFrame:
        """The lines that more than ``min_documents`` of the first columns hold."""
        return staged(held.distinct().groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_documents)
                      .select(F.col("_host").alias("_h"), F.col("_line").alias("_l")), name)

    same = F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_l"))
    over = counted(places.select("_k1", "_k2", "_host", "_line"), "rule-over")
    found = places.join(over, same).select("_k1", "_k2", "_host", "_line", "_words")
    if copies is None:
        return found.select("_k1", "_k2", "_line", "_words")
    # no line has more documents than texts, so only these lines are counted again
    found = staged(found, "rule-found")
    group = copies.select("_k1", "_k2", F.xxhash64("document").alias("_d1"), F.xxhash64(F.lit("2"), "document").alias("_d2")).distinct()
    held = found.join(group, ["_k1", "_k2"], "left").select(
        F.coalesce("_d1", "_k1").alias("_k1"), F.coalesce("_d2", "_k2").alias("_k2"), "_host", "_line")
    return found.join(counted(held, "rule-counted"), same).select("_k1", "_k2", "_line", "_words")


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", min_documents: int = 20,
                  min_words: int = 20, max_repeat_percent: int = 30,
                  min_left: float = 0.3, with_text: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` but its text, the counts of ``RULES``, ``base_failed``, ``removed_words``, ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of
    them in repeated windows. Lines over the limits (``shared_lines``) are removed; a document
    is depleted if that leaves less than ``min_left`` of its words (a short document that
    keeps most of its own words is not). ``kept``: neither. With ``with_text`` the text comes too, without the removed lines.
    ``copies``: texts that count as one document (see ``shared_lines``).

    Null or empty texts have no words, fail and stay null or empty. Repeated rows get equal
    verdicts. Columns of ``docs`` named like a result column, in any case, are replaced.
    """
    new = (*RULES, "base_failed", "removed_words", "kept")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    rest = [c for c in docs.columns if c != text]
    k1, k2, j1, j2, removed, copy = fresh(docs, "_key1", "_key2", "_join1", "_join2", "_removed", "_copy")
    t, h = F.col(f"`{text}`"), F.col(f"`{host}`")
    keys = dict(zip((k1, k2), text_key(t, h)))
    over = (shared_lines(docs, host, text, min_documents, copies).groupBy(F.col("_k1").alias(j1), F.col("_k2").alias(j2))
            .agg(F.sum("_words").alias("removed_words"), F.collect_set("_line").alias(removed)))
    rows = docs.withColumns({**keys, **({copy: t} if with_text else {})})
    out = (rule_counts(rows, text).join(over, (F.col(k1) == F.col(j1)) & (F.col(k2) == F.col(j2)), "left")
           .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
           .withColumn("base_failed", base_failed(min_words, max_repeat_percent)))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (left < min_left * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    cols = [F.col(f"`{c}`") for c in rest] + [F.col(c) for c in new]
    if with_text:
        kept_lines = F.filter(F.split(F.col(copy), "\n"),
                              lambda x: ~F.coalesce(F.array_contains(F.col(removed), line_key(x)), F.lit(False)))
        cols.append(F.when(F.col(removed).isNull(), F.col(copy)).otherwise(F.array_join(kept_lines, "\n")).alias(text))
    return out.select(*cols)
