"""Queries of the second scorer and of the request ledger (see ``catalog``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import text as X
from reviewlens.operators import ledger, linear, prompts
from reviewlens.plans import oracle_views as O
from reviewlens.plans.catalog import ORACLE, R, T, W, _stub_completion, q, reviews, scored
from reviewlens.session import shared_dir


@q("linear_score")
def linear_score(spark, sf):
    """Learn from documents ⋈ labels (toxic → negative, quality → positive, else neutral), score every review."""
    train = T(spark, sf, "documents").select("doc_id", "text").join(T(spark, sf, "labels"), "doc_id").select(
        "text", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("label"))
    model = linear.fit_linear_model(train, "text", "label")
    rows = reviews(spark, sf).select("review_id", X.clean_basic("text").alias("clean_text"))
    return linear.linear_score(rows, model).select("review_id", "sentiment", R("sentiment_score").alias("sentiment_score"))


@q("complete_requests", ORACLE["map_completions"])
def complete_requests(spark, sf):
    p = prompts.first_conversation(prompts.review_prompt(scored(spark, sf), "text"))
    req = prompts.request_payload(p, "messages", model="analysis-model").select("review_id", "request")
    done = ledger.complete_requests(req, "request", _stub_completion, shared_dir(spark, "ledger"))
    return prompts.parse_response(done, "response").select("review_id", "content")


# Forms from the documents' own words: a quarter of those of four letters or more (by MD5) lose their last letter.
_FORM_SQL = "len({w}) >= 4 AND substr(md5({w}), 1, 1) IN ('0', '1', '2', '3')"


@q("lemmatize_table", W(f"""SELECT review_id, array_to_string(list_transform({O.tokens('clean_text_advanced')},
  lambda t: CASE WHEN {_FORM_SQL.format(w='t')} THEN left(t, len(t) - 1) ELSE t END), ' ') AS text FROM scored"""))
def lemmatize_table(spark, sf):
    s = scored(spark, sf).select("review_id", F.col("clean_text_advanced").alias("text"))
    word = F.col("form")
    forms = s.select(F.explode(X.tokens("text")).alias("form")).distinct().where(
        (F.char_length(word) >= 4) & F.substring(F.md5(word.cast("binary")), 1, 1).isin("0", "1", "2", "3"))
    return X.lookup_tokens_table(s, "text", forms.select("form", F.substring(word, F.lit(1), F.char_length(word) - 1).alias("replacement")))
