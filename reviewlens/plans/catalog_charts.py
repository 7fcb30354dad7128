"""Queries of the word cloud and the violin chart (see ``catalog``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import collocations as CL
from reviewlens.operators import density
from reviewlens.plans import oracle_views as O
from reviewlens.plans.catalog import R, STOPWORDS, W, q, scored

_STOP = O.in_list(STOPWORDS)
_SINGULAR = "CASE WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, len({w}) - 1) END"


def _likelihood(k: str, n: str, p: str) -> str:
    return f"({k} * ln(greatest({p}, 1e-10)) + ({n} - {k}) * ln(greatest(1.0 - {p}, 1e-10)))"


def _score_sql(k="CAST(n AS DOUBLE)", a="CAST(lc AS DOUBLE)", b="CAST(rc AS DOUBLE)", n="CAST(total AS DOUBLE)") -> str:
    return (f"CASE WHEN total <= lc OR total <= rc THEN 0.0 ELSE -2.0 * ({_likelihood(k, a, f'({b} / {n})')} "
            f"+ {_likelihood(f'({b} - {k})', f'({n} - {a})', f'({b} / {n})')} - {_likelihood(k, a, f'({k} / {a})')} "
            f"- {_likelihood(f'({b} - {k})', f'({n} - {a})', f'(({b} - {k}) / ({n} - {a}))')}) END")


COLLOCATION_SQL = f""", tk AS (SELECT review_id, sentiment, {O.tokens('clean_text_advanced')} AS toks FROM scored),
tp AS (SELECT review_id, sentiment, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM tk),
tn AS (SELECT sentiment, w, lead(w) OVER (PARTITION BY review_id ORDER BY i) AS x FROM tp),
nb AS MATERIALIZED (SELECT sentiment, w, CASE WHEN x IN {_STOP} THEN NULL ELSE x END AS x, count(*) AS n FROM tn WHERE NOT (w IN {_STOP}) GROUP BY ALL),
wd AS MATERIALIZED (SELECT sentiment, w, sum(n) AS n FROM nb GROUP BY ALL),
fm AS MATERIALIZED (SELECT a.sentiment, a.w, a.n, coalesce(b.w, a.w) AS form
  FROM (SELECT *, {_SINGULAR.format(w='w')} AS one FROM wd) a LEFT JOIN wd b ON a.sentiment = b.sentiment AND b.w = a.one),
fc AS MATERIALIZED (SELECT sentiment, form, sum(n) AS c FROM fm GROUP BY ALL),
pr AS (SELECT * FROM nb WHERE x IS NOT NULL),
pf AS MATERIALIZED (SELECT a.sentiment, a.w, coalesce(b.x, a.x) AS x, sum(a.n) AS n
  FROM (SELECT *, {_SINGULAR.format(w='x')} AS one FROM pr) a LEFT JOIN pr b ON a.sentiment = b.sentiment AND a.w = b.w AND b.x = a.one GROUP BY ALL),
fw AS MATERIALIZED (SELECT fm.sentiment || ' ' || fm.w AS key, fm.form, fc.c FROM fm JOIN fc
  ON fm.sentiment || ' ' || fm.form = fc.sentiment || ' ' || fc.form),
sl AS MATERIALIZED (SELECT pf.*, l.form AS lf, l.c AS lc FROM pf JOIN fw l ON l.key = pf.sentiment || ' ' || pf.w),
sc AS MATERIALIZED (SELECT sl.*, r.form AS rf, r.c AS rc, t.total FROM sl JOIN fw r ON r.key = sl.sentiment || ' ' || sl.x
  JOIN (SELECT sentiment, sum(n) AS total FROM wd GROUP BY sentiment) t ON t.sentiment = sl.sentiment),
co AS MATERIALIZED (SELECT *, {_score_sql()} AS score FROM sc WHERE {_score_sql()} > {CL.THRESHOLD})
"""


@q("collocations", W(COLLOCATION_SQL + """SELECT sentiment, w AS word, x AS next, CAST(n AS BIGINT) AS count, CAST(lc AS BIGINT) AS left_count,
  CAST(rc AS BIGINT) AS right_count, CAST(total AS BIGINT) AS total, round_even(score, 3) AS score FROM co"""))
def collocations(spark, sf):
    c = CL.collocations(scored(spark, sf), "clean_text_advanced", stopwords=STOPWORDS, by="sentiment", cleaned=True)
    return c.withColumn("score", R("score", 3))


@q("cloud_words", W(COLLOCATION_SQL + """, en AS (SELECT sentiment, form AS word, n FROM fm UNION ALL SELECT sentiment, lf, -n FROM co
  UNION ALL SELECT sentiment, rf, -n FROM co),
al AS (SELECT sentiment, word, sum(n) AS count FROM en GROUP BY ALL HAVING sum(n) > 0
  UNION ALL SELECT sentiment, w || ' ' || x, n FROM co)
SELECT sentiment, word, CAST(count AS BIGINT) AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, word) AS rank
  FROM al) WHERE rank <= 100"""))
def cloud_words(spark, sf):
    return CL.cloud_words(scored(spark, sf), "clean_text_advanced", 100, stopwords=STOPWORDS, by="sentiment", cleaned=True)


@q("score_density", W("""SELECT sentiment, round_even(x, 6) AS x, round_even(density, 6) AS density FROM (
WITH st AS (SELECT sentiment, count(sentiment_score) AS n, min(sentiment_score) AS low, max(sentiment_score) AS high,
    coalesce(stddev_samp(sentiment_score), 0.0) AS std FROM scored WHERE sentiment_score IS NOT NULL GROUP BY sentiment),
bw AS (SELECT *, CASE WHEN high = low THEN 1.0 ELSE greatest(1.059 * std * pow(CAST(n AS DOUBLE), -0.2), (high - low) / 100.0) END AS h FROM st),
pt AS (SELECT *, low - 2 * h AS start, CAST(ceil((high - low + 4 * h) / (h / 3.0)) AS INTEGER) AS steps FROM bw),
xs AS (SELECT sentiment, n, h, start + i * ((high - low + 4 * h) / steps) AS x
  FROM (SELECT *, unnest(range(steps + 1)) AS i FROM pt)),
vs AS (SELECT sentiment, sentiment_score AS s, count(*) AS k FROM scored WHERE sentiment_score IS NOT NULL GROUP BY ALL)
SELECT xs.sentiment, x, sum(k * exp(-(x - s) * (x - s) / (2.0 * h * h))) / any_value(n * h * sqrt(2 * pi())) AS density
FROM xs JOIN vs ON xs.sentiment = vs.sentiment GROUP BY xs.sentiment, x)"""))
def score_density(spark, sf):
    d = density.score_density(scored(spark, sf))
    return d.select("sentiment", R("x").alias("x"), R("density").alias("density"))
