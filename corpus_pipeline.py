"""Corpus pipeline: documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import classifier, mixing, packing, quality_rules, simhash
from reviewlens.llm import common as C
from reviewlens.llm.queries import SIMHASH, THRESHOLD
from reviewlens.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words a document must have before and after the quality rules take lines out of it.
MIN_WORDS = 20


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject."""
    model = classifier.fit(docs, C.table(spark, sf_dir, "labels"))
    return classifier.classify(docs.select(*COLUMNS), model, threshold=THRESHOLD).filter("predicted = 1").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines over the limits; what is left has ``MIN_WORDS``, too.

    Near copies (SimHash groups, as the next stage finds them) count as one document of their
    host, so the lines of a group of copies are not taken for lines that many documents share.
    """
    docs = docs.select(*COLUMNS)
    row = F.struct(*[k.alias(n) for k, n in zip(quality_rules.text_key(F.col("text"), F.col("source")), ("_k1", "_k2"))])
    groups = simhash.simhash_components(docs.select(row.alias("_row"), "text"), doc_id="_row", **SIMHASH)
    copies = C.staged(groups.select("_row._k1", "_row._k2", F.xxhash64("component_id").alias("document")).distinct(), "rule-copies")
    out = quality_rules.quality_rules(docs, min_words=MIN_WORDS, with_text=True, copies=copies)
    out = out.filter(F.col("kept") & (F.col("n_words") - F.col("removed_words") >= MIN_WORDS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null last), then the smallest row hash.

    A row is told by its id and a hash of all its columns, so an id may occur with several
    texts, and documents without id are in groups like others.
    """
    parts = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    rows = docs.select(*COLUMNS, F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit("2"), *parts).alias("_k2"))
    row = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_k1", "_k2").alias("_row")
    groups = simhash.simhash_components(rows.select(row, "text"), doc_id="_row", **SIMHASH)
    first = groups.select(F.col("component_id._k1").alias("_f1"), F.col("component_id._k2").alias("_f2")).distinct()
    first = C.staged(first, "dedup-first")
    kept = rows.join(first, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate (some dropped, none more than three times)."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), C.n_words(F.col("text")))
    return mixing.emit_copies(mixed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences (see ``packing.pack_documents``).

    ``row_key``, a hash of all columns, tells the pieces of two documents that share an id, or
    have none; equal rows (copies that the mix emits) share it and are interchangeable.
    """
    key = F.lower(F.lpad(F.hex(C.null_first_row_hash(docs, list(COLUMNS))), 16, "0"))
    sizes = docs.select("doc_id", key.alias("row_key"), C.n_words(F.col("text")).alias("n_tokens"))
    return packing.pack_documents(sizes, F.col("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("simhash near-dedup", dedup),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: The first stage trains a model and SimHash has no SQL form: no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written to the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark, f'pipeline-{i}')}/documents.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
