"""LLM request assembly and answer parsing as columns.

Only the table work is done here: prompts are ``concat`` expressions, conversations are
``array<struct>`` columns, requests are ``to_json``, answers are parsed with ``from_json``.
The network call is the caller's function, applied per Arrow batch by ``map_completions``.
The fields and their order are those of a two-step analysis chain (analyse, then act);
sections and requests are parameters with short defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import numeric as N
from reviewlens.functions.sentiment import LABELS
from reviewlens.operators.sampling import DEFAULT_QUOTA, stratified_head

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
                        T.StructField("reasoning_details", T.StringType())])
RESPONSE_SCHEMA = T.StructType([T.StructField("choices", T.ArrayType(T.StructType([
    T.StructField("message", T.StructType([T.StructField("content", T.StringType()),
                                           T.StructField("reasoning_details", T.StringType())]))])))])

#: Defaults; every operator takes its own sections or request.
ANALYSIS_SECTIONS = (
    "Topics the customer mentions, each with a verdict and a short quote",
    "Problems, most urgent first",
    "Praise worth keeping",
    "Conclusion in two sentences",
)
ACTIONS_REQUEST = "Turn this analysis into a dated list of actions, each with an owner and a measure of success."
EXECUTIVE_REQUEST = "Summarise these figures for the management in half a page: state, causes, decisions to take."
CORPUS_REQUEST = "Describe what these reviews have in common, where they disagree, and what to change first."


def numbered(sections: Sequence[str]) -> str:
    return "\n".join(f"{i}. {s}" for i, s in enumerate(sections, 1))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def review_header(text: Column | str, label: Column | str, score: Column | str,
                  score_name: str = "Confidence") -> Column:
    return F.concat(F.lit("Review:\n"), F.coalesce(_c(text).cast("string"), F.lit("")),
                    F.lit("\n\nSentiment: "), _c(label), F.lit(f"\n{score_name}: "), N.format_percent(score),
                    F.lit("\n"))


def review_prompt_col(text: Column | str, label: Column | str, score: Column | str,
                      sections: Sequence[str] = ANALYSIS_SECTIONS) -> Column:
    """Step-1 analysis prompt: the review, its label and confidence (as %), the numbered ``sections``."""
    return F.concat(F.lit("You analyse customer feedback for a business.\n\n"),
                    review_header(text, label, score),
                    F.lit("\nWork through these steps:\n" + numbered(sections)
                          + "\nAnswer with headed sections and bullet points."))


def review_prompt(df: DataFrame, text_col: str, label_col: str = "sentiment",
                  score_col: str = "sentiment_score", out: str = "prompt",
                  sections: Sequence[str] = ANALYSIS_SECTIONS) -> DataFrame:
    return df.withColumn(out, review_prompt_col(text_col, label_col, score_col, sections))


def message(role: str | Column, content: Column, reasoning: Column | None = None) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.cast("string").alias("content"),
                    (reasoning if reasoning is not None else F.lit(None)).cast("string").alias("reasoning_details"))


def first_conversation(df: DataFrame, prompt_col: str = "prompt", out: str = "messages") -> DataFrame:
    return df.withColumn(out, F.array(message("user", F.col(prompt_col))))


def followup_conversation(df: DataFrame, text_col: str, answer_col: str, reasoning_col: str | None = None,
                          label_col: str = "sentiment", score_col: str = "sentiment_score",
                          out: str = "messages", request: str = ACTIONS_REQUEST) -> DataFrame:
    """user(review) → assistant(answer 1, with its reasoning if any) → user(``request``)."""
    reasoning = F.col(reasoning_col) if reasoning_col else None
    return df.withColumn(out, F.array(
        message("user", review_header(text_col, label_col, score_col)),
        message("assistant", F.coalesce(F.col(answer_col), F.lit("")), reasoning),
        message("user", F.lit(request))))


def request_payload(df: DataFrame, messages_col: str = "messages", model: str = "model-name",
                    reasoning: bool = True, out: str = "request") -> DataFrame:
    """JSON request body ``{model, messages[, reasoning: {enabled: true}]}``; null fields omitted."""
    fields = [F.lit(model).alias("model"), F.col(messages_col).alias("messages")]
    if reasoning:
        fields.append(F.struct(F.lit(True).alias("enabled")).alias("reasoning"))
    return df.withColumn(out, F.to_json(F.struct(*fields)))


def parse_response_cols(resp: Column | str) -> tuple[Column, Column]:
    """(content, reasoning) of ``choices[0].message``.

    No ``choices`` (or invalid JSON) → NULL content; ``choices`` without content → ''.
    """
    p = F.from_json(_c(resp), RESPONSE_SCHEMA)
    m = F.get(p["choices"], 0)["message"]
    has = p["choices"].isNotNull() & (F.size(p["choices"]) > 0)
    content = F.when(has, F.coalesce(m["content"], F.lit("")))
    reasoning = F.when(has, m["reasoning_details"])
    return content, reasoning


def parse_response(df: DataFrame, response_col: str, content_out: str = "content",
                   reasoning_out: str = "reasoning_details") -> DataFrame:
    c, r = parse_response_cols(response_col)
    return df.withColumns({content_out: c, reasoning_out: r})


def chain_result(df: DataFrame, response1_col: str, response2_col: str, failed: str = "no recommendations: the request failed") -> DataFrame:
    """Outcome of the two-step chain as columns ``analysis``, ``recommendations``,
    ``reasoning_trace`` and ``ok``.

    Step 1 without an answer → every field NULL and ok = false. Step 2 without an answer →
    the text ``failed`` and no reasoning trace.
    """
    c1, r1 = parse_response_cols(response1_col)
    c2, _ = parse_response_cols(response2_col)
    ok1 = c1.isNotNull()
    return df.withColumns({
        "analysis": F.when(ok1, c1),
        "recommendations": F.when(ok1, F.coalesce(c2, F.lit(failed))),
        "reasoning_trace": F.when(ok1 & c2.isNotNull(), r1),
        "ok": ok1,
    })


def map_completions(df: DataFrame, request_col: str, fn: Callable[[pd.Series], pd.Series],
                    out: str = "response", batch_size: int = 32) -> DataFrame:
    """Apply the caller's completion function to each request, in batches per task.

    ``fn`` maps a Series of JSON requests to a Series of JSON responses (or None on
    failure). A batch that raises, or answers another number of requests, is retried request
    by request, so only a request that fails alone has a NULL response. Rows stay Arrow data;
    only ``batch_size`` requests at a time become Python objects.
    """
    at = df.columns.index(request_col)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])

    def answers(requests: pd.Series) -> list:
        res = list(fn(requests))
        if len(res) != len(requests):
            raise ValueError("the number of responses differs from the number of requests")
        return res

    def alone(request) -> object:
        try:
            return answers(pd.Series([request], dtype=object))[0]
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch_size):
                chunk = b.slice(s, batch_size)
                requests = pd.Series(chunk.column(at).to_pylist(), dtype=object)
                try:
                    res = answers(requests)
                except Exception:
                    res = [alone(r) for r in requests]
                yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(res, pa.string(), from_pandas=True)], [*chunk.schema.names, out])
    return df.mapInArrow(run, schema)


def corpus_prompt(df: DataFrame, key_col: str, text_col: str, label_col: str = "sentiment",
                  score_col: str = "sentiment_score", quota: Sequence[tuple[str, int]] = DEFAULT_QUOTA,
                  request: str = CORPUS_REQUEST) -> DataFrame:
    """One row: the quota sample numbered ``Review i (Sentiment: s, Score: p%)`` joined by
    ``---`` into one prompt, with the sample size and the label counts of the sample."""
    head = stratified_head(df, key_col, quota, label_col)
    qorder = F.create_map(*[x for i, (lab, _) in enumerate(quota) for x in (F.lit(lab), F.lit(i))])
    rows = head.select(F.element_at(qorder, F.col(label_col)).alias("_o"), F.col("_rank"),
                       F.col(label_col).alias("_l"), F.col(score_col).alias("_s"), F.col(text_col).alias("_t"))
    w = Window.orderBy("_o", "_rank")
    numbered = rows.withColumn("_i", F.row_number().over(w))  # at most sum(quota) rows
    item = F.concat(F.lit("Review "), F.col("_i").cast("string"), F.lit(" (Sentiment: "), F.col("_l"),
                    F.lit(", Score: "), N.format_percent("_s"), F.lit("):\n"),
                    F.coalesce(F.col("_t").cast("string"), F.lit("")))
    agg = numbered.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i"), item.alias("_x")))),
                                 lambda s: s["_x"]), "\n\n---\n\n").alias("_body"),
        F.count(F.lit(1)).alias("sample_size"),
        *[F.count_if(F.col("_l") == lab).alias(f"{lab}_count") for lab in LABELS])
    prompt = F.concat(F.lit("You advise a business on its customer feedback.\n\nHere are "),
                      F.col("sample_size").cast("string"),
                      F.lit(" reviews from different sentiment groups:\n\n"), F.col("_body"),
                      F.lit("\n\n" + request))
    return agg.select(prompt.alias("prompt"), F.col("sample_size").cast("bigint").alias("sample_size"),
                      *[F.col(f"{lab}_count").cast("bigint").alias(f"{lab}_count") for lab in LABELS])


def executive_stats_block(df: DataFrame, label_col: str = "sentiment",
                          score_col: str = "sentiment_score") -> DataFrame:
    """One row: totals, count and % per label (missing label → 0), mean confidence, as text."""
    lab = F.col(label_col)
    a = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(score_col).alias("_avg"),
               *[F.count_if(lab == name).alias(f"_c{i}") for i, name in enumerate(LABELS)])
    lines = [F.lit("Reviews analysed: "), N.format_thousands("_n"), F.lit("\nLabels:\n")]
    for name in ("positive", "neutral", "negative"):
        i = LABELS.index(name)
        pctv = F.coalesce(F.try_divide(F.col(f"_c{i}").cast("double"), F.col("_n")) * 100.0, F.lit(0.0))
        lines += [F.lit(f"- {name.title()}: "), N.format_thousands(f"_c{i}"), F.lit(" ("),
                  N.format_fixed(pctv, 1), F.lit("%)\n")]
    lines += [F.lit("Mean confidence: "), F.coalesce(N.format_percent("_avg"), F.lit("n/a")), F.lit("\n")]
    return a.select(F.concat(*lines).alias("stats_block"))


def executive_prompt(df: DataFrame, label_col: str = "sentiment", score_col: str = "sentiment_score",
                     request: str = EXECUTIVE_REQUEST) -> DataFrame:
    """Stats block + instructions; sent with reasoning off."""
    s = executive_stats_block(df, label_col, score_col)
    return s.select(F.concat(F.lit("You report customer-feedback results to the leadership team.\n"),
                             F.col("stats_block"), F.lit("\n" + request)).alias("prompt"))
