"""Sentiment math as Column expressions: softmax arg-max, the empty-text rule, lexicon logits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions import text as T

# --- fixed values: the label order of the three-class sentiment model -----------------
LABELS = ("negative", "neutral", "positive")
# Neutral logit of the built-in lexicon scorer: one lexicon hit outweighs it.
NEUTRAL_LOGIT = 0.5
# ---------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_from_logits(neg: Column | str, neu: Column | str, pos: Column | str) -> Column:
    """Softmax over three logits → struct(label, score).

    Arg-max ties go to the first label (numpy ``argmax``); the score is the largest
    probability, computed as ``1 / sum(exp(l_i - max))`` for numerical stability. A null or
    NaN logit means that the text was not scored: ('neutral', 0.0).
    """
    a, b, c = _c(neg).cast("double"), _c(neu).cast("double"), _c(pos).cast("double")
    m = F.greatest(a, b, c)
    total = F.exp(a - m) + F.exp(b - m) + F.exp(c - m)
    label = (F.when((a >= b) & (a >= c), F.lit(LABELS[0]))
             .when(b >= c, F.lit(LABELS[1]))
             .otherwise(F.lit(LABELS[2])))
    ok = F.lit(True)
    for x in (a, b, c):
        ok = ok & x.isNotNull() & ~F.isnan(x)
    return F.struct(F.when(ok, label).otherwise(F.lit(LABELS[1])).alias("sentiment"),
                    F.when(ok, F.lit(1.0) / total).otherwise(F.lit(0.0)).alias("sentiment_score"))


def neutral_on_empty(text: Column | str, scored: Column) -> Column:
    """null or '' text → ('neutral', 0.0); otherwise the scorer's struct."""
    t = _c(text)
    empty = F.struct(F.lit(LABELS[1]).alias("sentiment"), F.lit(0.0).alias("sentiment_score"))
    return F.when(t.isNull() | (t == ""), empty).otherwise(scored)


def lexicon_struct(text: Column | str, positive: Iterable[str], negative: Iterable[str],
                   neutral_logit: float = NEUTRAL_LOGIT) -> Column:
    """Built-in scorer: logits (negative hits, neutral_logit, positive hits).

    Hits are counted on whole tokens of the fully cleaned text (``clean_advanced``), so
    the result does not depend on regex word-boundary rules.
    """
    toks = T.tokens(T.clean_advanced(text))
    neg = T.count_in(toks, negative)
    pos = T.count_in(toks, positive)
    return neutral_on_empty(text, sentiment_from_logits(neg, F.lit(neutral_logit), pos))
