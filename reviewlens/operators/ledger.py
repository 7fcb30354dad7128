"""Completions that are asked for once: a ledger of answers by request."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.prompts import map_completions
from reviewlens.session import path_state

LEDGER = "request_id string, response string"


def request_id(request) -> F.Column:
    """What tells a request: the SHA-256 of its text."""
    return F.sha2(F.col(request).cast("binary") if isinstance(request, str) else request, 256)


def answers(spark, ledger: str) -> DataFrame:
    """The ledger's answers, one a request; no rows if there is none yet."""
    if not path_state(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).groupBy("request_id").agg(F.first("response").alias("response"))


def ask_open(df: DataFrame, request_col: str, fn: Callable[[pd.Series], pd.Series], ledger: str, batch_size: int = 32,
             tasks: int | None = None) -> None:
    """Ask for what ``ledger`` has no answer to: each distinct request of ``df`` once, dealt over ``tasks`` tasks.

    Every task appends its answers when it ends (the committer moves a task's files at once),
    so after a lost executor, a failed job or a stopped driver the next call asks only for
    what was open. A request without an answer (null) is not entered and is asked again next time.
    """
    spark = df.sparkSession
    requests = (df.where(F.col(request_col).isNotNull()).groupBy(request_id(request_col).alias("request_id"))
                .agg(F.first(request_col).alias("_request")))
    todo = requests.join(answers(spark, ledger).select("request_id"), "request_id", "left_anti")
    # by another key than the grouping's, so that the optimizer keeps this many tasks
    todo = todo.repartition(tasks or spark.sparkContext.defaultParallelism, F.xxhash64("request_id"))
    done = map_completions(todo, "_request", fn, "response", batch_size).where(F.col("response").isNotNull()).select("request_id", "response")
    (done.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .option("mapreduce.fileoutputcommitter.cleanup-failures.ignored", "true").parquet(ledger))


def complete_requests(df: DataFrame, request_col: str, fn: Callable[[pd.Series], pd.Series], ledger: str, out: str = "response",
                      batch_size: int = 32, tasks: int | None = None) -> DataFrame:
    """``df`` with the answer to each row's request (null: no request, or no answer) from ``ledger``, after asking what is open.

    Equal requests are asked once, in this run and over all runs with the same ledger. Rows
    find their answer by the request's hash; ``out`` replaces a column of that name in any case.
    """
    ask_open(df, request_col, fn, ledger, batch_size, tasks)
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()])
    found = answers(df.sparkSession, ledger).select(F.col("request_id").alias("_rid"), F.col("response").alias("_answer"))
    return (rows.withColumn("_key", request_id(request_col)).join(found, F.col("_key") == F.col("_rid"), "left")
            .select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_answer").alias(out)))
