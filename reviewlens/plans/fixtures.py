"""The ``reviews`` view over the driver's ``documents`` table, and the fixture lexicon.

``reviews`` gives the shape of a review file (id, business, stars, date, text) with
injected null ratings, unparseable dates and null texts; every row of ``documents`` is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.scoring import LexiconScorer, clean_pipeline, score_sentiment
from reviewlens.session import path_state, shared_dir
from reviewlens.sources.io import balanced

# --- fixed values: the fixture lexicon (words that occur in the generated prose) -------
POSITIVE_WORDS = ("best",)
NEGATIVE_WORDS = ("worthless", "idiot", "stupid")
# ---------------------------------------------------------------------------------------

LEXICON = LexiconScorer(positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The view; ``spread`` deals a scan of few partitions over the cores before per-row text work."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    if spread:
        d = balanced(d, "doc_id", path=f"{sf_dir.rstrip('/')}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("business_id"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(1) + F.col("doc_id") % 5).cast("double")).alias("stars"),
        F.when(F.col("doc_id") % 37 == 0, F.lit("junk"))
         .otherwise(F.date_add(F.lit("2024-01-01").cast("date"),
                               (F.col("doc_id") % 90).cast("int")).cast("string")).alias("review_date"),
        F.when(F.col("doc_id") % 101 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("text"),
    )


def scored_plan(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``reviews`` + clean_text, clean_text_advanced, sentiment, sentiment_score (one plan)."""
    return score_sentiment(clean_pipeline(reviews(spark, sf_dir, spread), "text"), "clean_text", LEXICON)


_STAGED: dict[tuple, str] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored reviews as a stage output: written once to the shared checkpoint folder.

    Scoring is the expensive per-row step and every chart, filter and prompt reads its
    result; a Spark pipeline writes such a stage to a table instead of recomputing it per
    query. The written table also cuts the lineage (a lost executor re-reads files instead
    of re-running the text work), and label filters become parquet pushdown predicates
    rather than being pushed, with the whole scoring expression, below the scoring
    projection. Keyed by session, input folder and input file state.
    """
    state = path_state(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), state)
    path = _STAGED.get(key)
    if path is None or path_state(spark, path) is None:  # new input, or the scratch folder was cleaned up
        path = shared_dir(spark, "scored") + "/scored.parquet"
        scored_plan(spark, sf_dir, spread=True).write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(path)


# DuckDB twins of the two views, inlined as CTEs by the oracle statements.
REVIEWS_SQL = """
reviews AS (
  SELECT doc_id AS review_id,
         source AS business_id,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(1 + doc_id % 5 AS DOUBLE) END AS stars,
         CASE WHEN doc_id % 37 = 0 THEN 'junk'
              ELSE CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS DATE) AS VARCHAR) END AS review_date,
         CASE WHEN doc_id % 101 = 0 THEN NULL ELSE text END AS text
  FROM documents
)"""
