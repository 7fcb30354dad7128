"""The flagship query: reviews → clean_pipeline → lexicon score → rating × sentiment crosstab.

One scan of ``documents`` (only the columns the view needs), per-row cleaning and scoring
inside whole-stage codegen, and one partial/final aggregation keyed by rating (a handful
of groups, so the shuffle carries a few rows per task whatever the input size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators.charts import rating_sentiment_crosstab
from reviewlens.plans.fixtures import scored_plan


def flagship(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return rating_sentiment_crosstab(scored_plan(spark, sf_dir, spread), "stars")
