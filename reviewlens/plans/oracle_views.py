"""DuckDB twins of the Spark views, used by the oracle statements in ``catalog``.

RE2 (DuckDB) differs from Java regex: ``\\s`` is ASCII without ``\\v``, and ``\\b`` is
ASCII-only, so the whitespace class is spelled out. The am/pm step uses RE2's ``\\b``;
the generated prose contains no am/pm words, so both engines agree on the test tables.
"""

from reviewlens.plans.fixtures import NEGATIVE_WORDS, POSITIVE_WORDS, REVIEWS_SQL

# Python str.split() whitespace, spelled out for RE2.
WS_CLASS_RE2 = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS_CLASS_RE2}+', ' ', 'g'))"


def clean_basic(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN '' ELSE {collapse(expr)} END"


def clean_advanced(expr: str) -> str:
    e = f"lower({expr})"
    e = f"regexp_replace({e}, 'http\\S+|www\\S+|https\\S+', '', 'g')"
    e = f"regexp_replace({e}, '\\S+@\\S+', '', 'g')"
    e = f"regexp_replace({e}, '\\b(am|pm|AM|PM)\\b', '', 'g')"
    e = f"regexp_replace({e}, '\\p{{Nd}}+', '', 'g')"
    e = f"translate({e}, {PUNCT_SQL}, '')"
    e = collapse(e)
    return f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN '' ELSE {e} END"


def tokens(expr: str) -> str:
    return (f"CASE WHEN {collapse(expr)} = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE string_split({collapse(expr)}, ' ') END")


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


SCORED_SQL = REVIEWS_SQL + f""",
cleaned AS (
  SELECT *, {clean_basic('text')} AS clean_text FROM reviews
),
cleaned2 AS (
  SELECT *, {clean_advanced('clean_text')} AS clean_text_advanced FROM cleaned
),
hits AS (
  SELECT *,
         CAST(len(list_filter({tokens('clean_text_advanced')}, lambda x: x IN {in_list(NEGATIVE_WORDS)})) AS DOUBLE) AS _neg,
         CAST(len(list_filter({tokens('clean_text_advanced')}, lambda x: x IN {in_list(POSITIVE_WORDS)})) AS DOUBLE) AS _pos
  FROM cleaned2
),
scored AS (
  SELECT review_id, business_id, stars, review_date, text, clean_text, clean_text_advanced,
         CASE WHEN clean_text IS NULL OR clean_text = '' THEN 'neutral'
              WHEN _neg >= 0.5 AND _neg >= _pos THEN 'negative'
              WHEN 0.5 >= _pos THEN 'neutral' ELSE 'positive' END AS sentiment,
         CASE WHEN clean_text IS NULL OR clean_text = '' THEN 0.0
              ELSE 1.0 / (exp(_neg - greatest(_neg, 0.5, _pos)) + exp(0.5 - greatest(_neg, 0.5, _pos))
                          + exp(_pos - greatest(_neg, 0.5, _pos))) END AS sentiment_score
  FROM hits
)"""


def with_reviews(body: str) -> str:
    return "WITH " + REVIEWS_SQL + "\n" + body


def with_scored(body: str) -> str:
    return "WITH " + SCORED_SQL + "\n" + body
