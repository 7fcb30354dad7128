"""Query catalog: one Spark query and (where SQL can express it) one DuckDB oracle per
operator key of the survey inventory.

Every query reads the driver's tables (or data Spark derives from them) in full. Computed
doubles are rounded half-even to a fixed number of decimals on both sides (6 for
percentages and means of lengths, 9 for scores and correlations) so that two engines'
last-bit differences do not decide the comparison; counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N
from reviewlens.functions import phrases as P
from reviewlens.functions import sentiment as S
from reviewlens.functions import text as X
from reviewlens.functions.stopwords import ENGLISH as ENGLISH_STOPWORDS
from reviewlens.operators import charts, entities, filters, profile, prompts, rating, roles
from reviewlens.operators import sampling, scoring, temporal, textstats
from reviewlens.plans import fixtures as FX
from reviewlens.plans import oracle_views as O
from reviewlens.session import shared_dir
from reviewlens.sources import io

# --- fixed values: small lookup dictionaries used by the token-lookup queries -------------
# Contractions as they look after apostrophes were stripped.
CONTRACTIONS = {"cant": "cannot", "dont": "do not", "doesnt": "does not", "didnt": "did not",
                "im": "i am", "isnt": "is not", "ive": "i have", "its": "it is", "thats": "that is",
                "theyre": "they are", "wont": "will not", "youre": "you are"}
# A small English lemma table (form → lemma).
LEMMAS = {"are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "has": "have",
          "had": "have", "does": "do", "did": "do", "done": "do", "reviews": "review",
          "things": "thing", "others": "other", "ones": "one", "better": "good", "best": "good"}
SAMPLE_SEED = 42
# --------------------------------------------------------------------------------------------

STOPWORDS = ENGLISH_STOPWORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def q(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def R(c, d: int = 6):
    return N.round_half_even(c, d)


def r(expr: str, d: int = 6) -> str:
    return f"round_even(CAST({expr} AS DOUBLE), {d})"


def T(spark, sf, name):
    return FX.table(spark, sf, name)


def reviews(spark, sf):
    return FX.reviews(spark, sf)


def scored(spark, sf):
    return FX.scored(spark, sf)


def body(spark, sf):
    return reviews(spark, sf).select("business_id", "stars", "text")


W, WS, WR = O.with_scored, O.SCORED_SQL, O.with_reviews
BODY = "(SELECT business_id, stars, text FROM reviews)"
LEN_NAN = "length(coalesce(text, 'nan'))"


def words_nan_sql(expr: str) -> str:
    c = O.collapse(f"coalesce({expr}, 'nan')")
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def pct_sql(part: str, whole: str, d: int = 2) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / NULLIF({whole}, 0) * 100.0, {d})"


def fmt_pct_sql(x: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f%%', ({x}) * 100.0)"


def fmt_fixed_sql(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {x})"


def fmt_thousands_sql(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def case_lookup_sql(tok: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items()))
    return f"CASE {tok} {whens} ELSE {tok} END"


def lookup_sql(expr: str, mapping: dict[str, str]) -> str:
    return f"array_to_string(list_transform({O.tokens(expr)}, lambda t: {case_lookup_sql('t', mapping)}), ' ')"


def stop_filter_sql(expr: str, stop=STOPWORDS) -> str:
    return f"list_filter({O.tokens(expr)}, lambda x: NOT (x IN {O.in_list(stop)}))"


AMPM_RE2 = r"\b(am|pm|AM|PM)\b"
NOT_LETTER_WS_RE2 = (r"[^a-zA-Z\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def letters_only_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{AMPM_RE2}', '', 'g'), '{NOT_LETTER_WS_RE2}', '', 'g')"


# ============================================================================================
# 2.1 scans, sources, sinks
# ============================================================================================

NA_IN = O.in_list(io.NA_TOKENS)
REVIEWS_AFTER_CSV = f"""SELECT review_id, business_id, stars,
  CASE WHEN review_date IN {NA_IN} THEN NULL ELSE review_date END AS review_date,
  CASE WHEN text IN {NA_IN} THEN NULL ELSE text END AS text FROM reviews"""


def _reviews_csv(spark, sf) -> str:
    path = shared_dir(spark, "reviews-csv") + "/reviews.csv"
    io.sink_csv(reviews(spark, sf), path)
    return path


@q("scan_csv", WR(REVIEWS_AFTER_CSV))
def scan_csv(spark, sf):
    return io.scan_csv(spark, _reviews_csv(spark, sf), multi_line=True)


@q("scan_json", WR("SELECT review_id, business_id, stars, review_date, text FROM reviews"))
def scan_json(spark, sf):
    path = shared_dir(spark, "reviews-json") + "/reviews.json"
    io.sink_json(reviews(spark, sf), path)
    return io.scan_json(spark, path)


@q("scan_any", WR(REVIEWS_AFTER_CSV))
def scan_any(spark, sf):
    return io.read_table(spark, _reviews_csv(spark, sf), multi_line=True)


REVIEW_COLUMNS = ("review_id", "business_id", "stars", "review_date", "text")


def _files(df: DataFrame, path: str) -> str:
    """Rows ``file, value`` as one text file each."""
    df.repartition("file").write.partitionBy("file").text(path)
    return path


def _json_files(spark, sf, name: str, content) -> str:
    """The reviews in JSON files of 100 reviews each; ``content`` makes a file's text from its rows."""
    rows = reviews(spark, sf).withColumn("file", F.floor(F.col("review_id") / 100))
    files = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*REVIEW_COLUMNS))).alias("rows"))
    return _files(files.select("file", content.alias("value")), f"{shared_dir(spark, name)}/reviews.json")


@q("scan_json_records", WR("SELECT review_id, business_id, stars, review_date, text FROM reviews"))
def scan_json_records(spark, sf):
    """Files that each hold one indented array."""
    records = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("  "), F.to_json(x))), ",\n")
    path = _json_files(spark, sf, "reviews-records", F.concat(F.lit("[\n"), records, F.lit("\n]")))
    return io.read_table(spark, path).select(*REVIEW_COLUMNS)


@q("scan_json_columns", WR("SELECT review_id, business_id, stars, review_date, text FROM reviews"))
def scan_json_columns(spark, sf):
    """Files that each hold their columns, rows numbered from 0 in every file."""
    column = lambda c: F.to_json(F.map_from_arrays(
        F.transform("rows", lambda x, i: i.cast("string")), F.transform("rows", lambda x: x[c])))
    parts = [F.concat(F.lit(f'  "{c}": '), column(c)) for c in REVIEW_COLUMNS]
    path = _json_files(spark, sf, "reviews-columns", F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit("\n}")))
    return io.read_table(spark, path).select(*REVIEW_COLUMNS)


@q("sink_csv", W("SELECT review_id, sentiment, round_even(sentiment_score, 9) AS sentiment_score FROM scored"))
def sink_csv(spark, sf):
    path = shared_dir(spark, "scored-csv") + "/scored.csv"
    io.sink_csv(scored(spark, sf).select("review_id", "sentiment", "sentiment_score"), path)
    back = io.scan_csv(spark, path)
    return back.select("review_id", "sentiment", R("sentiment_score", 9).alias("sentiment_score"))


@q("preview", WR("SELECT * FROM reviews ORDER BY review_id LIMIT 10"))
def preview(spark, sf):
    return sampling.preview(reviews(spark, sf), "review_id", 10)


# ============================================================================================
# 2.2 role detection
# ============================================================================================

def _text_table_sql() -> str:
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, "
             f"round_even(avg(length(coalesce({c}, 'nan'))), 6) AS avg_length FROM s"
             for i, c in ((1, "business_id"), (3, "review_date"), (4, "text"))]
    return WR(f""", s AS (SELECT * FROM reviews),
t AS ({' UNION ALL '.join(parts)})
SELECT column_name, position, avg_length,
  coalesce(position = (SELECT position FROM t WHERE avg_length > 50 ORDER BY avg_length DESC, position LIMIT 1), false) AS chosen
FROM t""")


@q("detect_text_column", _text_table_sql())
def detect_text_column(spark, sf):
    t = roles.detect_text_table(reviews(spark, sf))
    return t.withColumn("avg_length", R("avg_length"))


def _rating_sql(table: str, cols: list[tuple[int, str]]) -> str:
    parts = []
    for i, c in cols:
        v = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
        named = any(w in c.lower() for w in roles.RATING_NAME_WORDS)
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, "
                     f"count(DISTINCT {v}) AS n_distinct, "
                     f"min({v}) AS min_value, max({v}) AS max_value, {str(named).lower()} AS name_match FROM {table}")
    return f""", t AS ({' UNION ALL '.join(parts)}),
f AS (SELECT *, coalesce(n_distinct <= 10 AND min_value >= 0 AND max_value <= 10 AND name_match, false) AS by_name,
             coalesce(n_distinct BETWEEN 3 AND 10 AND min_value >= 1 AND max_value <= 10, false) AS by_range FROM t)
SELECT *, coalesce(position = coalesce((SELECT min(position) FROM f WHERE by_name),
                                       (SELECT min(position) FROM f WHERE by_range)), false) AS chosen
FROM f"""


LINEITEM_NUM = [(0, "l_orderkey"), (1, "l_partkey"), (2, "l_suppkey"), (3, "l_linenumber"),
                (4, "l_quantity"), (5, "l_extendedprice"), (6, "l_discount"), (7, "l_tax")]


@q("detect_rating_by_name", WR(_rating_sql("reviews", [(0, "review_id"), (2, "stars")])))
def detect_rating_by_name(spark, sf):
    return roles.detect_rating_table(reviews(spark, sf))


@q("detect_rating_by_range", "WITH x AS (SELECT 1)" + _rating_sql("lineitem", LINEITEM_NUM))
def detect_rating_by_range(spark, sf):
    return roles.detect_rating_table(T(spark, sf, "lineitem"))


@q("detect_id_column", """WITH t AS (
  SELECT 'event_id' AS column_name, 0 AS position, round_even(count(DISTINCT event_id) / count(*), 6) AS unique_ratio FROM events
  UNION ALL
  SELECT 'user_id', 2, round_even(count(DISTINCT user_id) / count(*), 6) FROM events)
SELECT *, coalesce(position = (SELECT min(position) FROM t WHERE unique_ratio > 0.1), false) AS chosen FROM t""")
def detect_id_column(spark, sf):
    return roles.detect_id_table(T(spark, sf, "events")).withColumn("unique_ratio", R("unique_ratio"))


@q("detect_date_column", WR(""", t AS (
  SELECT 'review_date' AS column_name, 3 AS position,
         round_even(count(try_cast(review_date AS TIMESTAMP)) / count(*), 6) AS parsed_share FROM reviews)
SELECT *, coalesce(position = (SELECT min(position) FROM t WHERE parsed_share > 0), false) AS chosen FROM t"""))
def detect_date_column(spark, sf):
    return roles.detect_date_table(reviews(spark, sf)).withColumn("parsed_share", R("parsed_share"))


@q("detect_date_candidates", W("""SELECT 'review_date' AS column_name, 3 AS position,
  round_even(count(try_cast(review_date AS TIMESTAMP)) / count(*), 6) AS parsed_share FROM scored"""))
def detect_date_candidates(spark, sf):
    return roles.detect_date_candidates(scored(spark, sf)).withColumn("parsed_share", R("parsed_share"))


def _roles_df(spark, rl: roles.ColumnRoles) -> DataFrame:
    return spark.createDataFrame([("text", rl.text), ("rating", rl.rating), ("id", rl.id), ("date", rl.date)],
                                 "role string, column_name string")


# the detected text, rating and date columns, and the id that the user chose
@q("override_roles", f"""SELECT 'text' AS role, (SELECT max(column_name) FROM ({ORACLE["detect_text_column"]}) WHERE chosen) AS column_name
UNION ALL SELECT 'rating', (SELECT max(column_name) FROM ({ORACLE["detect_rating_by_name"]}) WHERE chosen)
UNION ALL SELECT 'id', 'business_id'
UNION ALL SELECT 'date', (SELECT max(column_name) FROM ({ORACLE["detect_date_column"]}) WHERE chosen)""")
def override_roles(spark, sf):
    rl = roles.detect_roles(reviews(spark, sf)).override(text="Auto", id="business_id")
    return _roles_df(spark, rl)


@q("normalize_columns", WR("SELECT review_id AS id, business_id, stars AS rating, review_date AS date, text FROM reviews"))
def normalize_columns(spark, sf):
    df = reviews(spark, sf)
    return roles.normalize_columns(df, roles.detect_roles(df))


def _validate_sql() -> str:
    ws = O.WS_CLASS_RE2
    nbytes = ("(sum(strlen(business_id)) + sum(strlen(review_date)) + coalesce(sum(strlen(text)), 0) "
              "+ 16 * count(*))")
    return WR(f""", parts AS (
  SELECT 'warning' AS level, 'null_texts' AS code,
         CASE WHEN count(*) FILTER (WHERE text IS NULL) > 0 THEN CAST(count(*) FILTER (WHERE text IS NULL) AS VARCHAR) END AS value
  FROM reviews
  UNION ALL
  SELECT 'warning', 'short_texts', CASE WHEN avg({LEN_NAN}) < 20 THEN CAST(CAST(round_even(avg({LEN_NAN}), 0) AS BIGINT) AS VARCHAR) END FROM reviews
  UNION ALL
  SELECT 'info', 'rating_range', CAST(min(stars) AS VARCHAR) || ' - ' || CAST(max(stars) AS VARCHAR) FROM reviews
  UNION ALL
  SELECT 'info', 'rating_distribution', string_agg(CAST(stars AS VARCHAR) || ':' || CAST(c AS VARCHAR), ', ' ORDER BY stars)
  FROM (SELECT stars, count(*) AS c FROM reviews WHERE stars IS NOT NULL GROUP BY stars)
  UNION ALL
  SELECT 'warning', 'duplicate_rows', CASE WHEN count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM reviews)) > 0
         THEN CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM reviews)) AS VARCHAR) END FROM reviews
  UNION ALL
  SELECT 'info', 'table_mb', printf('%.2f MB', round_even({nbytes} / 1048576.0, 2)) FROM reviews
)
SELECT * FROM parts WHERE value IS NOT NULL
UNION ALL SELECT 'info', 'is_valid', 'true'""")


@q("validate_table", _validate_sql())
def validate_table(spark, sf):
    df = reviews(spark, sf)
    return roles.validate_table(df, roles.detect_roles(df))


@q("schema_table", WR(""", c AS (
  SELECT count(review_id) AS c0, count(business_id) AS c1, count(stars) AS c2, count(review_date) AS c3,
         count(text) AS c4 FROM reviews)
SELECT v.position, v.column_name, v.data_type,
  CASE v.position WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS non_null
FROM (VALUES (0, 'review_id', 'bigint'), (1, 'business_id', 'string'), (2, 'stars', 'double'),
             (3, 'review_date', 'string'), (4, 'text', 'string')) AS v(position, column_name, data_type), c"""))
def schema_table(spark, sf):
    return profile.schema_table(reviews(spark, sf))


# ============================================================================================
# 2.3 projections and filters
# ============================================================================================

@q("add_text_length", WR(f"SELECT review_id, {LEN_NAN} AS text_length FROM reviews"))
def add_text_length(spark, sf):
    return textstats.add_text_length(reviews(spark, sf), "text").select("review_id", "text_length")


@q("add_word_count", WR(f"SELECT review_id, {words_nan_sql('text')} AS word_count FROM reviews"))
def add_word_count(spark, sf):
    return textstats.add_word_count(reviews(spark, sf), "text").select("review_id", "word_count")


@q("select_columns", W("SELECT review_id, clean_text, sentiment, round_even(sentiment_score, 9) AS sentiment_score FROM scored"))
def select_columns(spark, sf):
    s = filters.select_columns(scored(spark, sf), ["review_id", "clean_text", "sentiment", "sentiment_score"])
    return s.withColumn("sentiment_score", R("sentiment_score", 9))


FILTER_COLS = "review_id, business_id, stars, sentiment, round_even(sentiment_score, 9) AS sentiment_score"


def _filter_out(df):
    return df.select("review_id", "business_id", "stars", "sentiment", R("sentiment_score", 9).alias("sentiment_score"))


@q("filter_sentiment_in", W(f"SELECT {FILTER_COLS} FROM scored WHERE sentiment IN ('negative')"))
def filter_sentiment_in(spark, sf):
    return _filter_out(filters.filter_sentiment_in(scored(spark, sf), ["negative"]))


@q("filter_sentiment_eq", W(f"SELECT {FILTER_COLS} FROM scored WHERE sentiment = 'positive'"))
def filter_sentiment_eq(spark, sf):
    return _filter_out(filters.filter_sentiment_eq(scored(spark, sf), "positive"))


@q("drop_null_dates", WR("SELECT review_id, review_date FROM reviews WHERE try_cast(review_date AS TIMESTAMP) IS NOT NULL"))
def drop_null_dates(spark, sf):
    return temporal.drop_null_dates(reviews(spark, sf), "review_date").select("review_id", "review_date")


@q("drop_null_text", WR("SELECT review_id, business_id FROM reviews WHERE text IS NOT NULL"))
def drop_null_text(spark, sf):
    return filters.drop_null_text(reviews(spark, sf), "text").select("review_id", "business_id")


@q("row_by_key", W("SELECT review_id, text, sentiment, round_even(sentiment_score, 9) AS sentiment_score FROM scored WHERE review_id = 15"))
def row_by_key(spark, sf):
    s = filters.row_by_key(scored(spark, sf), "review_id", 15)
    return s.select("review_id", "text", "sentiment", R("sentiment_score", 9).alias("sentiment_score"))


MISMATCH_SQL = """coalesce(stars >= 4.0 AND sentiment = 'negative', false) AS mismatch_high_negative,
  coalesce(stars <= 2.0 AND sentiment = 'positive', false) AS mismatch_low_positive"""


@q("detect_mismatches", W(f"""SELECT *, mismatch_high_negative OR mismatch_low_positive AS has_mismatch FROM (
  SELECT review_id, stars, sentiment, {MISMATCH_SQL} FROM scored)"""))
def detect_mismatches(spark, sf):
    d = filters.detect_mismatches(scored(spark, sf), "stars")
    return d.select("review_id", "stars", "sentiment", *filters.MISMATCH_COLUMNS)


@q("remove_mismatches", W("""SELECT review_id, stars, sentiment FROM scored
WHERE NOT (coalesce(stars >= 4.0 AND sentiment = 'negative', false) OR coalesce(stars <= 2.0 AND sentiment = 'positive', false))"""))
def remove_mismatches(spark, sf):
    return filters.remove_mismatches(scored(spark, sf), "stars").select("review_id", "stars", "sentiment")


@q("mismatch_counts", W(f"""SELECT count(*) FILTER (WHERE mismatch_high_negative) AS high_negative,
  count(*) FILTER (WHERE mismatch_low_positive) AS low_positive,
  count(*) FILTER (WHERE mismatch_high_negative) + count(*) FILTER (WHERE mismatch_low_positive) AS total
FROM (SELECT {MISMATCH_SQL} FROM scored)"""))
def mismatch_counts(spark, sf):
    return filters.mismatch_counts(scored(spark, sf), "stars")


@q("removed_share", W(f"""SELECT count(*) AS input_rows, count(*) FILTER (WHERE m) AS removed_rows,
  count(*) - count(*) FILTER (WHERE m) AS kept_rows, {pct_sql('count(*) FILTER (WHERE m)', 'count(*)')} AS removed_pct
FROM (SELECT coalesce(stars >= 4.0 AND sentiment = 'negative', false) OR coalesce(stars <= 2.0 AND sentiment = 'positive', false) AS m FROM scored)"""))
def removed_share(spark, sf):
    return filters.removed_share(scored(spark, sf), "stars")


# ============================================================================================
# 2.5 profiling and quality
# ============================================================================================

@q("table_overview", WR(f"""SELECT count(*) AS total_rows, CAST(3 AS BIGINT) AS total_columns,
  count(*) FILTER (WHERE stars IS NULL OR isnan(stars)) + count(*) FILTER (WHERE text IS NULL)
    + count(*) FILTER (WHERE business_id IS NULL) AS missing_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {BODY})) AS duplicate_rows
FROM {BODY}"""))
def table_overview(spark, sf):
    return profile.table_overview(body(spark, sf))


@q("table_bytes", WR("""SELECT CAST(sum(strlen(business_id)) + sum(strlen(review_date)) + coalesce(sum(strlen(text)), 0)
    + 16 * count(*) AS BIGINT) AS table_bytes,
  round_even((sum(strlen(business_id)) + sum(strlen(review_date)) + coalesce(sum(strlen(text)), 0) + 16 * count(*))
    / 1048576.0, 2) AS table_mb FROM reviews"""))
def table_bytes(spark, sf):
    return profile.table_bytes(reviews(spark, sf))


@q("duplicate_rows", WR(f"""SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {BODY})) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {BODY})) AS duplicate_rows FROM {BODY}"""))
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(body(spark, sf))


@q("distinct_rows", WR(f"SELECT DISTINCT * FROM {BODY}"))
def distinct_rows(spark, sf):
    return profile.distinct_rows(body(spark, sf))


@q("missing_by_column", WR(f"""SELECT * FROM (
  SELECT 2 AS position, 'stars' AS column_name, count(*) FILTER (WHERE stars IS NULL OR isnan(stars)) AS missing_count,
         {pct_sql("count(*) FILTER (WHERE stars IS NULL OR isnan(stars))", "count(*)")} AS missing_pct, 'double' AS data_type FROM reviews
  UNION ALL
  SELECT 4, 'text', count(*) FILTER (WHERE text IS NULL), {pct_sql("count(*) FILTER (WHERE text IS NULL)", "count(*)")}, 'string' FROM reviews
  UNION ALL
  SELECT 3, 'review_date', count(*) FILTER (WHERE review_date IS NULL), {pct_sql("count(*) FILTER (WHERE review_date IS NULL)", "count(*)")}, 'string' FROM reviews
  UNION ALL
  SELECT 1, 'business_id', count(*) FILTER (WHERE business_id IS NULL), {pct_sql("count(*) FILTER (WHERE business_id IS NULL)", "count(*)")}, 'string' FROM reviews
  UNION ALL
  SELECT 0, 'review_id', count(*) FILTER (WHERE review_id IS NULL), {pct_sql("count(*) FILTER (WHERE review_id IS NULL)", "count(*)")}, 'bigint' FROM reviews
) WHERE missing_count > 0"""))
def missing_by_column(spark, sf):
    return profile.missing_by_column(reviews(spark, sf))


@q("text_overview", WR(f"""SELECT CAST(trunc(avg({LEN_NAN})) AS BIGINT) AS avg_text_length,
  count(*) FILTER (WHERE text IS NULL) AS empty_texts FROM reviews"""))
def text_overview(spark, sf):
    return textstats.text_overview(reviews(spark, sf), "text")


@q("rating_overview", WR("SELECT round_even(avg(stars), 2) AS avg_rating, round_even(stddev_samp(stars), 2) AS rating_std FROM reviews"))
def rating_overview(spark, sf):
    return rating.rating_overview(reviews(spark, sf), "stars")


@q("text_length_stats", WR(f"""SELECT CAST(trunc(avg({LEN_NAN})) AS BIGINT) AS mean, CAST(trunc(median({LEN_NAN})) AS BIGINT) AS median,
  CAST(min({LEN_NAN}) AS BIGINT) AS min, CAST(max({LEN_NAN}) AS BIGINT) AS max,
  CAST(trunc(stddev_samp({LEN_NAN})) AS BIGINT) AS std FROM reviews"""))
def text_length_stats(spark, sf):
    return textstats.text_length_stats(reviews(spark, sf), "text")


WC = words_nan_sql("text")


@q("word_count_stats", WR(f"""SELECT CAST(trunc(avg({WC})) AS BIGINT) AS mean, CAST(trunc(median({WC})) AS BIGINT) AS median,
  CAST(min({WC}) AS BIGINT) AS min, CAST(max({WC}) AS BIGINT) AS max FROM reviews"""))
def word_count_stats(spark, sf):
    return textstats.word_count_stats(reviews(spark, sf), "text")


@q("length_overview", WR(f"""SELECT round_even(avg({LEN_NAN}), 6) AS average_length,
  round_even(CAST(median({LEN_NAN}) AS DOUBLE), 6) AS median_length, CAST(max({LEN_NAN}) AS BIGINT) AS max_length FROM reviews"""))
def length_overview(spark, sf):
    o = textstats.length_overview(reviews(spark, sf), "text")
    return o.select(R("average_length").alias("average_length"), R("median_length").alias("median_length"), "max_length")


@q("text_cardinality", WR("SELECT count(*) FILTER (WHERE text IS NULL) AS empty_count, count(DISTINCT text) AS unique_count FROM reviews"))
def text_cardinality(spark, sf):
    return textstats.text_cardinality(reviews(spark, sf), "text")


@q("rating_distribution", WR("SELECT stars AS rating, count(*) AS count FROM reviews WHERE stars IS NOT NULL GROUP BY stars ORDER BY stars"))
def rating_distribution(spark, sf):
    return rating.rating_distribution(reviews(spark, sf), "stars")


@q("rating_range", WR("SELECT min(stars) AS rating_min, max(stars) AS rating_max FROM reviews"))
def rating_range(spark, sf):
    return rating.rating_range(reviews(spark, sf), "stars")


@q("rating_statistics", WR("""SELECT round_even(avg(stars), 2) AS mean, CAST(median(stars) AS DOUBLE) AS median,
  (SELECT stars FROM reviews WHERE stars IS NOT NULL GROUP BY stars ORDER BY count(*) DESC, stars LIMIT 1) AS mode,
  round_even(stddev_samp(stars), 2) AS std, min(stars) AS min, max(stars) AS max FROM reviews"""))
def rating_statistics(spark, sf):
    return rating.rating_statistics(reviews(spark, sf), "stars")


@q("rating_percentiles", WR("""SELECT round_even(quantile_cont(stars, 0.25), 9) AS p25, round_even(quantile_cont(stars, 0.5), 9) AS p50,
  round_even(quantile_cont(stars, 0.75), 9) AS p75, round_even(quantile_cont(stars, 0.9), 9) AS p90 FROM reviews"""))
def rating_percentiles(spark, sf):
    p = rating.rating_percentiles(reviews(spark, sf), "stars")
    return p.select(*[R(c, 9).alias(c) for c in p.columns])


@q("rating_concentration", WR(f"""SELECT {pct_sql("count(*) FILTER (WHERE stars >= 4)", "count(*)", 1)} AS high_rating_pct,
  {pct_sql("count(*) FILTER (WHERE stars <= 2)", "count(*)", 1)} AS low_rating_pct,
  round_even(abs(count(*) FILTER (WHERE stars >= 4) - count(*) FILTER (WHERE stars <= 2)) / count(*), 2) AS polarization_index
FROM reviews HAVING count(*) > 0"""))
def rating_concentration(spark, sf):
    return rating.rating_concentration(reviews(spark, sf), "stars")


def _iqr_sql() -> str:
    cols = [("event_id", 0), ("user_id", 2), ("value", 4)]
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}"
                   for c, _ in cols)
    parts = []
    for c, _ in cols:
        lo = f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))"
        hi = f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
        n = f"count(*) FILTER (WHERE CAST({c} AS DOUBLE) < {lo} OR CAST({c} AS DOUBLE) > {hi})"
        parts.append(f"SELECT '{c}' AS column_name, {n} AS outlier_count, {pct_sql(n, 'count(*)')} AS outlier_pct, "
                     f"round_even(any_value({lo}), 2) AS lower_bound, round_even(any_value({hi}), 2) AS upper_bound "
                     f"FROM events, b")
    return f"WITH b AS (SELECT {qs} FROM events)\nSELECT * FROM ({' UNION ALL '.join(parts)}) WHERE outlier_count > 0"


@q("iqr_outliers", _iqr_sql())
def iqr_outliers(spark, sf):
    return profile.iqr_outliers(T(spark, sf, "events"))


def _corr_sql() -> str:
    cols = [c for _, c in LINEITEM_NUM]
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                e = f"CASE WHEN var_pop(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END"
            else:
                aa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
                bb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
                den = f"sqrt(var_pop({aa}) * var_pop({bb}))"
                e = f"CASE WHEN {den} > 0 THEN covar_pop({aa}, {bb}) / {den} END"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even({e}, 9) AS corr FROM lineitem")
    return " UNION ALL ".join(parts)


@q("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf):
    c = profile.correlation_matrix(T(spark, sf, "lineitem"))
    return c.withColumn("corr", R("corr", 9))


QUALITY_CTE = f""", g AS (SELECT business_id, stars, text, review_id, review_date, count(*) AS n FROM reviews
    GROUP BY ALL),
m AS (SELECT sum(n) AS rows, count(*) AS distinct_rows,
    sum(n) FILTER (WHERE stars IS NULL OR isnan(stars)) AS m_stars, coalesce(sum(n) FILTER (WHERE text IS NULL), 0) AS m_text,
    coalesce(sum(n) FILTER (WHERE {O.collapse("coalesce(text, 'nan')")} = ''), 0) AS blank,
    sum(n) FILTER (WHERE stars IS NOT NULL AND NOT isnan(stars)) AS rvalid FROM g),
q AS (SELECT *, rows * 5 AS total_cells, m_stars + m_text AS missing_cells,
    round_even((1.0 - (m_stars + m_text) / (rows * 5.0)) * 100.0, 2) AS completeness_score,
    {pct_sql('distinct_rows', 'rows')} AS unique_ratio,
    round_even((1.0 - blank / rows) * 100.0, 2) AS text_valid_pct,
    {pct_sql('rvalid', 'rows')} AS rating_valid_pct FROM m)"""


@q("completeness", WR(QUALITY_CTE + "\nSELECT CAST(total_cells AS BIGINT) AS total_cells, CAST(missing_cells AS BIGINT) AS missing_cells, completeness_score FROM q"))
def completeness(spark, sf):
    return profile.completeness(reviews(spark, sf))


@q("consistency", WR(QUALITY_CTE + "\nSELECT CAST(rows - distinct_rows AS BIGINT) AS duplicate_rows, unique_ratio FROM q"))
def consistency(spark, sf):
    return profile.consistency(reviews(spark, sf))


@q("text_validity", WR(QUALITY_CTE + "\nSELECT CAST(blank AS BIGINT) AS text_empty_count, text_valid_pct FROM q"))
def text_validity(spark, sf):
    return profile.text_validity(reviews(spark, sf), "text")


@q("rating_validity", WR(QUALITY_CTE + "\nSELECT rating_valid_pct FROM q"))
def rating_validity(spark, sf):
    return profile.rating_validity(reviews(spark, sf), "stars")


@q("quality_score", WR(QUALITY_CTE + """
SELECT CAST(total_cells AS BIGINT) AS total_cells, CAST(missing_cells AS BIGINT) AS missing_cells, completeness_score,
  CAST(rows - distinct_rows AS BIGINT) AS duplicate_rows, unique_ratio, CAST(blank AS BIGINT) AS text_empty_count,
  text_valid_pct, rating_valid_pct,
  round_even(completeness_score * 0.4 + unique_ratio * 0.3 + text_valid_pct * 0.3, 1) AS overall_quality_score FROM q"""))
def quality_score(spark, sf):
    return profile.quality_report(reviews(spark, sf), "text", "stars")


def _describe_sql() -> str:
    parts = []
    for _, c in LINEITEM_NUM:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, count({v}) AS count, round_even(avg({v}), 9) AS mean, "
                     f"round_even(stddev_samp({v}), 9) AS std, min({v}) AS min, "
                     f"round_even(quantile_cont({v}, 0.25), 6) AS p25, round_even(quantile_cont({v}, 0.5), 6) AS p50, "
                     f"round_even(quantile_cont({v}, 0.75), 6) AS p75, max({v}) AS max FROM lineitem")
    return " UNION ALL ".join(parts)


@q("describe_numeric", _describe_sql())
def describe_numeric(spark, sf):
    d = profile.describe_numeric(T(spark, sf, "lineitem"))
    return d.select("column_name", "count", *[R(c, 9).alias(c) for c in ("mean", "std")], "min",
                    *[R(c).alias(c) for c in ("p25", "p50", "p75")], "max")


@q("entity_count", WR("SELECT count(DISTINCT business_id) AS entity_count FROM reviews"))
def entity_count(spark, sf):
    return entities.entity_count(reviews(spark, sf), "business_id")


@q("entity_review_counts", """SELECT o_custkey, count(*) AS review_count FROM orders WHERE o_custkey IS NOT NULL
GROUP BY o_custkey ORDER BY review_count DESC, o_custkey""")
def entity_review_counts(spark, sf):
    return entities.entity_review_counts(T(spark, sf, "orders"), "o_custkey")


@q("entity_count_histogram", """WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
r0 AS (SELECT min(x) AS mn0, max(x) AS mx0 FROM c),
r AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn, CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM r0),
h AS (SELECT least(CAST(floor((x - mn) * 50.0 / (mx - mn)) AS BIGINT), 49) AS bin, count(*) AS cnt FROM c, r GROUP BY 1)
SELECT b.range AS bin, round_even(mn + b.range * ((mx - mn) / 50.0), 9) AS bin_start,
  round_even(mn + (b.range + 1) * ((mx - mn) / 50.0), 9) AS bin_end, coalesce(h.cnt, 0) AS count
FROM range(50) b CROSS JOIN r LEFT JOIN h ON h.bin = b.range ORDER BY bin""")
def entity_count_histogram(spark, sf):
    h = entities.entity_count_histogram(T(spark, sf, "orders"), "o_custkey")
    return h.select("bin", R("bin_start", 9).alias("bin_start"), R("bin_end", 9).alias("bin_end"), "count")


# the entry points that return all statistics of one subject

@q("text_statistics", f"""SELECT a.mean AS length_mean, a.median AS length_median, a.min AS length_min, a.max AS length_max, a.std AS length_std,
  b.mean AS words_mean, b.median AS words_median, b.min AS words_min, b.max AS words_max, c.empty_count, c.unique_count
FROM ({ORACLE["text_length_stats"]}) a, ({ORACLE["word_count_stats"]}) b, ({ORACLE["text_cardinality"]}) c""")
def text_statistics(spark, sf):
    return textstats.text_statistics(reviews(spark, sf), "text")


@q("rating_analysis", f"""SELECT a.*, b.*, c.* FROM ({ORACLE["rating_statistics"]}) a, ({ORACLE["rating_percentiles"]}) b,
  ({ORACLE["rating_concentration"]}) c""")
def rating_analysis(spark, sf):
    a = rating.rating_analysis(reviews(spark, sf), "stars")
    return a.withColumns({c: R(c, 9) for c in ("p25", "p50", "p75", "p90")})


# ============================================================================================
# 2.6 sentiment statistics and chart data
# ============================================================================================

@q("sentiment_counts", W("SELECT sentiment, count(*) AS count FROM scored WHERE sentiment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"))
def sentiment_counts(spark, sf):
    return charts.sentiment_counts(scored(spark, sf))


@q("sentiment_percentages", W("""SELECT l.sentiment, count(s.sentiment) AS count,
  round_even(count(s.sentiment) * 100.0 / (SELECT count(*) FROM scored), 6) AS percentage
FROM (VALUES ('negative'), ('neutral'), ('positive')) AS l(sentiment) LEFT JOIN scored s ON s.sentiment = l.sentiment
GROUP BY l.sentiment"""))
def sentiment_percentages(spark, sf):
    return charts.sentiment_percentages(scored(spark, sf)).withColumn("percentage", R("percentage"))


@q("sentiment_score_overview", W("""SELECT round_even(avg(sentiment_score), 9) AS average_sentiment_score,
  round_even(median(sentiment_score), 9) AS median_sentiment_score FROM scored"""))
def sentiment_score_overview(spark, sf):
    o = charts.sentiment_score_overview(scored(spark, sf))
    return o.select(*[R(c, 9).alias(c) for c in o.columns])


@q("confidence_by_sentiment", W("""SELECT sentiment, round_even(avg(sentiment_score), 9) AS avg_confidence FROM scored
WHERE sentiment IN ('negative', 'neutral', 'positive') GROUP BY sentiment"""))
def confidence_by_sentiment(spark, sf):
    return charts.confidence_by_sentiment(scored(spark, sf)).withColumn("avg_confidence", R("avg_confidence", 9))


@q("sentiment_statistics", W("""SELECT metric, key, round_even(value, 9) AS value FROM (
  SELECT 'total_reviews' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM scored
  UNION ALL SELECT 'sentiment_counts', sentiment, CAST(count(*) AS DOUBLE) FROM scored WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment
  UNION ALL SELECT 'sentiment_percentages', sentiment, count(*) * 100.0 / (SELECT count(*) FROM scored) FROM scored
    WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment
  UNION ALL SELECT 'avg_confidence', sentiment, avg(sentiment_score) FROM scored WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment
  UNION ALL SELECT 'average_sentiment_score', NULL, avg(sentiment_score) FROM scored
  UNION ALL SELECT 'median_sentiment_score', NULL, CAST(median(sentiment_score) AS DOUBLE) FROM scored)"""))
def sentiment_statistics(spark, sf):
    return charts.sentiment_statistics(scored(spark, sf)).withColumn("value", R("value", 9))


@q("stars_by_sentiment", W("SELECT sentiment, round_even(avg(stars), 9) AS avg_stars FROM scored WHERE sentiment IS NOT NULL GROUP BY sentiment"))
def stars_by_sentiment(spark, sf):
    return charts.stars_by_sentiment(scored(spark, sf), "stars").withColumn("avg_stars", R("avg_stars", 9))


@q("rating_sentiment_crosstab", W("""SELECT stars AS rating, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'positive') AS positive
FROM scored WHERE stars IS NOT NULL AND sentiment IS NOT NULL GROUP BY stars ORDER BY stars"""))
def rating_sentiment_crosstab(spark, sf):
    return charts.rating_sentiment_crosstab(scored(spark, sf), "stars")


def _box_sql(v: str, extra: str = "") -> str:
    return (f"count({v}) AS count, round_even(min({v}), 9) AS min, round_even(quantile_cont({v}, 0.25), 9) AS q1, "
            f"round_even(quantile_cont({v}, 0.5), 9) AS median, round_even(quantile_cont({v}, 0.75), 9) AS q3, "
            f"round_even(max({v}), 9) AS max, round_even(avg({v}), 9) AS mean{extra}")


@q("confidence_distribution", W(f"""SELECT sentiment, {_box_sql('sentiment_score')} FROM scored
WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment"""))
def confidence_distribution(spark, sf):
    d = charts.confidence_distribution(scored(spark, sf))
    return d.select("sentiment", "count", *[R(c, 9).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")])


@q("length_distribution", W(f"""SELECT sentiment, {_box_sql("CAST(" + LEN_NAN + " AS DOUBLE)", ", round_even(stddev_pop(CAST(" + LEN_NAN + " AS DOUBLE)), 6) AS std")}
FROM scored WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment"""))
def length_distribution(spark, sf):
    d = charts.length_distribution(scored(spark, sf), "text")
    return d.select("sentiment", "count", *[R(c, 9).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")],
                    R("std").alias("std"))


WORDS_SQL = W(f""", w AS (SELECT sentiment, unnest({stop_filter_sql('clean_text_advanced')}) AS word FROM scored),
c AS (SELECT sentiment, word, count(*) AS count FROM w GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, word) AS rank FROM c) WHERE rank <= 100""")


@q("word_frequencies", WORDS_SQL)
def word_frequencies(spark, sf):
    return charts.word_frequencies(scored(spark, sf), "clean_text_advanced", 100, STOPWORDS, by="sentiment",
                                   cleaned=True)


BIGRAMS_SQL = W(f""", t AS (SELECT sentiment, {stop_filter_sql('clean_text_advanced')} AS toks FROM scored),
b AS (SELECT sentiment, unnest(CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])
                                     ELSE CAST([] AS VARCHAR[]) END) AS bigram FROM t),
c AS (SELECT sentiment, bigram, count(*) AS count FROM b GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, bigram) AS rank FROM c) WHERE rank <= 100""")


@q("bigram_frequencies", BIGRAMS_SQL)
def bigram_frequencies(spark, sf):
    return charts.bigram_frequencies(scored(spark, sf), "clean_text_advanced", 100, STOPWORDS, by="sentiment",
                                     cleaned=True)


@q("dashboard_bundle", W("""SELECT panel, key, metric, round_even(value, 9) AS value FROM (
  SELECT 'sentiment_distribution' AS panel, sentiment AS key, 'count' AS metric, CAST(count(*) AS DOUBLE) AS value
  FROM scored WHERE sentiment IS NOT NULL GROUP BY sentiment
  UNION ALL
  SELECT 'confidence_scores', sentiment, unnest(['count','min','q1','median','q3','max','mean']),
    unnest([CAST(count(sentiment_score) AS DOUBLE), min(sentiment_score), quantile_cont(sentiment_score, 0.25),
            quantile_cont(sentiment_score, 0.5), quantile_cont(sentiment_score, 0.75), max(sentiment_score), avg(sentiment_score)])
  FROM scored WHERE sentiment IN ('negative','neutral','positive') GROUP BY sentiment
  UNION ALL
  SELECT 'rating_distribution', CAST(stars AS VARCHAR), 'count', CAST(count(*) AS DOUBLE) FROM scored WHERE stars IS NOT NULL GROUP BY stars)"""))
def dashboard_bundle(spark, sf):
    return charts.dashboard_bundle(scored(spark, sf), "stars").withColumn("value", R("value", 9))


# ============================================================================================
# 2.7 dates
# ============================================================================================

TS = "try_cast(review_date AS TIMESTAMP)"


@q("parse_dates", WR(f"SELECT review_id, strftime({TS}, '%Y-%m-%d %H:%M:%S') AS parsed_date FROM reviews"))
def parse_dates(spark, sf):
    p = temporal.parse_dates(reviews(spark, sf), "review_date")
    return p.select("review_id", F.date_format("parsed_date", "yyyy-MM-dd HH:mm:ss").alias("parsed_date"))


RANGE_SQL = f"""SELECT strftime(min({TS}), '%Y-%m-%d') AS start, strftime(max({TS}), '%Y-%m-%d') AS "end",
  CAST(date_sub('day', min({TS}), max({TS})) AS BIGINT) AS span_days,
  round_even(count({TS}) / (date_sub('day', min({TS}), max({TS})) + 1), 2) AS daily_avg
FROM reviews HAVING count({TS}) > 0"""


@q("date_range", WR(RANGE_SQL))
def date_range(spark, sf):
    return temporal.date_range(reviews(spark, sf), "review_date")


@q("daily_average", WR(f"SELECT daily_avg FROM ({RANGE_SQL})"))
def daily_average(spark, sf):
    return temporal.daily_average(reviews(spark, sf), "review_date")


@q("day_of_week_counts", WR(f"SELECT dayname({TS}) AS day_of_week, count(*) AS count FROM reviews WHERE {TS} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"))
def day_of_week_counts(spark, sf):
    return temporal.day_of_week_counts(reviews(spark, sf), "review_date")


@q("monthly_trend", WR(f"SELECT strftime({TS}, '%Y-%m') AS month, count(*) AS count FROM reviews WHERE {TS} IS NOT NULL GROUP BY 1 ORDER BY 1"))
def monthly_trend(spark, sf):
    return temporal.monthly_trend(reviews(spark, sf), "review_date")


@q("temporal_patterns", f"""SELECT 'date_range' AS section, unnest(['start', 'end', 'span_days']) AS key,
  unnest(["start", "end", CAST(span_days AS VARCHAR)]) AS value FROM ({ORACLE["date_range"]})
UNION ALL SELECT 'frequency', 'daily_avg', CAST(daily_avg AS VARCHAR) FROM ({ORACLE["date_range"]})
UNION ALL SELECT 'day_of_week_distribution', day_of_week, CAST(count AS VARCHAR) FROM ({ORACLE["day_of_week_counts"]})
UNION ALL SELECT 'monthly_trend', month, CAST(count AS VARCHAR) FROM ({ORACLE["monthly_trend"]})""")
def temporal_patterns(spark, sf):
    return temporal.temporal_patterns(reviews(spark, sf), "review_date")


@q("sentiment_timeline", W(f"""SELECT strftime(CAST({TS} AS DATE), '%Y-%m-%d') AS day, sentiment, count(*) AS count FROM scored
WHERE {TS} IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2"""))
def sentiment_timeline(spark, sf):
    t = temporal.sentiment_timeline(scored(spark, sf), "review_date")
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "sentiment", "count")


# ============================================================================================
# 2.8 / 2.9 sort, limit, top-k, sampling, set operations
# ============================================================================================

@q("top_entities", """SELECT o_custkey, count(*) AS review_count FROM orders WHERE o_custkey IS NOT NULL
GROUP BY o_custkey ORDER BY review_count DESC, o_custkey LIMIT 20""")
def top_entities(spark, sf):
    return entities.top_entities(T(spark, sf, "orders"), "o_custkey", 20)


@q("top_entities_100", """SELECT o_custkey, count(*) AS review_count FROM orders WHERE o_custkey IS NOT NULL
GROUP BY o_custkey ORDER BY review_count DESC, o_custkey LIMIT 100""")
def top_entities_100(spark, sf):
    return entities.top_entities(T(spark, sf, "orders"), "o_custkey", 100)


@q("random_sample", W(f"""SELECT review_id, sentiment, round_even(sentiment_score, 9) AS sentiment_score FROM scored
WHERE sentiment = 'negative' ORDER BY md5(CAST(review_id AS VARCHAR) || ':{SAMPLE_SEED}') NULLS LAST, review_id NULLS LAST
LIMIT 3"""))
def random_sample(spark, sf):
    neg = filters.filter_sentiment_in(scored(spark, sf), ["negative"])
    s = sampling.random_sample(neg, 3, "review_id", SAMPLE_SEED)
    return s.select("review_id", "sentiment", R("sentiment_score", 9).alias("sentiment_score"))


HEAD_SQL = W("""SELECT review_id, sentiment, _rank FROM (
  SELECT review_id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY review_id) AS _rank FROM scored
  WHERE sentiment IN ('positive', 'negative', 'neutral'))
WHERE _rank <= CASE sentiment WHEN 'positive' THEN 2 WHEN 'negative' THEN 2 ELSE 1 END""")


@q("stratified_head", HEAD_SQL)
def stratified_head(spark, sf):
    return sampling.stratified_head(scored(spark, sf), "review_id").select("review_id", "sentiment", "_rank")


@q("concat_samples", W("""SELECT review_id, sentiment FROM (SELECT * FROM scored WHERE sentiment = 'positive' ORDER BY review_id LIMIT 2)
UNION ALL SELECT review_id, sentiment FROM (SELECT * FROM scored WHERE sentiment = 'negative' ORDER BY review_id LIMIT 2)
UNION ALL SELECT review_id, sentiment FROM (SELECT * FROM scored WHERE sentiment = 'neutral' ORDER BY review_id LIMIT 1)"""))
def concat_samples(spark, sf):
    s = scored(spark, sf)
    parts = [sampling.head_per_label(s, "review_id", lab, k).select("review_id", "sentiment")
             for lab, k in sampling.DEFAULT_QUOTA]
    return sampling.concat_samples(parts)


# ============================================================================================
# 2.10 text scalar functions
# ============================================================================================

CT = O.clean_basic("text")


@q("clean_basic", WR(f"SELECT review_id, {CT} AS clean_text FROM reviews"))
def clean_basic(spark, sf):
    return reviews(spark, sf).select("review_id", X.clean_basic("text").alias("clean_text"))


@q("clean_advanced", WR(f"SELECT review_id, {O.clean_advanced(CT)} AS clean_text_advanced FROM reviews"))
def clean_advanced(spark, sf):
    return reviews(spark, sf).select("review_id", X.clean_advanced(X.clean_basic("text")).alias("clean_text_advanced"))


PAGE_CT = O.clean_basic("html")


@q("strip_urls", f"SELECT page_id, regexp_replace({PAGE_CT}, 'http\\S+|www\\S+|https\\S+', '', 'g') AS stripped FROM pages")
def strip_urls(spark, sf):
    return T(spark, sf, "pages").select("page_id", X.strip_urls(X.clean_basic("html")).alias("stripped"))


@q("strip_emails", WR(f"SELECT review_id, regexp_replace({CT}, '\\S+@\\S+', '', 'g') AS stripped FROM reviews"))
def strip_emails(spark, sf):
    return reviews(spark, sf).select("review_id", X.strip_emails(X.clean_basic("text")).alias("stripped"))


@q("strip_ampm", WR(f"SELECT review_id, regexp_replace(lower({CT}), '{AMPM_RE2}', '', 'g') AS stripped FROM reviews"))
def strip_ampm(spark, sf):
    return reviews(spark, sf).select("review_id", X.strip_ampm(F.lower(X.clean_basic("text"))).alias("stripped"))


@q("strip_digits", WR(f"SELECT review_id, regexp_replace({CT}, '\\p{{Nd}}+', '', 'g') AS stripped FROM reviews"))
def strip_digits(spark, sf):
    return reviews(spark, sf).select("review_id", X.strip_digits(X.clean_basic("text")).alias("stripped"))


@q("strip_punctuation", WR(f"SELECT review_id, translate({CT}, {O.PUNCT_SQL}, '') AS stripped FROM reviews"))
def strip_punctuation(spark, sf):
    return reviews(spark, sf).select("review_id", X.strip_punctuation(X.clean_basic("text")).alias("stripped"))


@q("clean_pipeline", W("SELECT review_id, clean_text, clean_text_advanced FROM scored"))
def clean_pipeline(spark, sf):
    return scoring.clean_pipeline(reviews(spark, sf), "text").select("review_id", "clean_text", "clean_text_advanced")


@q("newline_to_space", WR("SELECT review_id, replace(text, chr(10), ' ') AS text FROM reviews"))
def newline_to_space(spark, sf):
    return reviews(spark, sf).select("review_id", X.newline_to_space("text").alias("text"))


@q("letters_only", WR(f"SELECT review_id, {letters_only_sql('text')} AS text FROM reviews"))
def letters_only(spark, sf):
    return reviews(spark, sf).select("review_id", X.letters_only("text").alias("text"))


# The prose has no apostrophes: contractions are put in place of some of its words.
_CONTRACTED = ((" of ", " I'd've ", " I would have "), (" der ", " won’t ", " will not "), (" de ", " they'll ", " they will "))


def _contracted_sql(which: int) -> str:
    e = "text"
    for row in _CONTRACTED:
        e = f"replace({e}, '{row[0]}', '{row[which]}')"
    return e


@q("expand_contractions", WR(f"SELECT review_id, {_contracted_sql(2)} AS text FROM reviews"))
def expand_contractions(spark, sf):
    text = F.col("text")
    for word, short, _ in _CONTRACTED:
        text = F.replace(text, F.lit(word), F.lit(short))
    raw = reviews(spark, sf).select("review_id", text.alias("text"))
    return raw.select("review_id", P.replace_phrases("text", P.contractions()).alias("text"))


# Phrases that begin with or hold one another: the longer one wins wherever it is there.
_PHRASES = {"of the": "<1>", "of": "<2>", "the": "<3>", "and the": "<4>", "and": "<5>", "in der": "<6>", "der": "<7>", "in": "<8>"}


def _phrases_sql() -> str:
    near, e = r"[^\p{L}\p{M}\p{N}_]", "text"
    for phrase, value in sorted(_PHRASES.items(), key=lambda x: -len(x[0])):
        p = phrase.replace(" ", r"\s+")
        for _ in range(2):  # a match takes the character after it, so every other one of a row is found at first
            e = f"regexp_replace({e}, '(?i)(^|{near}){p}($|{near})', '\\1{value}\\2', 'g')"
    return e


@q("replace_phrases", WR(f"SELECT review_id, {_phrases_sql()} AS text FROM reviews"))
def replace_phrases(spark, sf):
    return reviews(spark, sf).select("review_id", P.replace_phrases("text", _PHRASES, keep_case=False).alias("text"))


@q("lowercase", WR("SELECT review_id, lower(text) AS text FROM reviews"))
def lowercase(spark, sf):
    return reviews(spark, sf).select("review_id", X.lowercase("text").alias("text"))


@q("remove_stopwords", W(f"SELECT review_id, array_to_string({stop_filter_sql('clean_text_advanced')}, ' ') AS text FROM scored"))
def remove_stopwords(spark, sf):
    return scored(spark, sf).select("review_id", X.remove_stopwords("clean_text_advanced", STOPWORDS).alias("text"))


@q("lemmatize", W(f"SELECT review_id, {lookup_sql('clean_text_advanced', LEMMAS)} AS text FROM scored"))
def lemmatize(spark, sf):
    return scored(spark, sf).select("review_id", X.lookup_tokens("clean_text_advanced", LEMMAS).alias("text"))


def notebook_clean_col(text: str):
    """The notebook's order: newline → letters only → contractions → lower → punctuation →
    stop-words → lower → lemmas."""
    c = X.letters_only(X.newline_to_space(text))
    c = X.lookup_tokens(c, CONTRACTIONS)
    c = X.strip_punctuation(F.lower(c))
    c = X.remove_stopwords(c, STOPWORDS)
    return X.lookup_tokens(F.lower(c), LEMMAS)


def _notebook_sql() -> str:
    c = letters_only_sql("replace(text, chr(10), ' ')")
    c = lookup_sql(c, CONTRACTIONS)
    c = f"translate(lower({c}), {O.PUNCT_SQL}, '')"
    c = f"array_to_string({stop_filter_sql(c)}, ' ')"
    return lookup_sql(f"lower({c})", LEMMAS)


@q("notebook_clean", WR(f"SELECT review_id, {_notebook_sql()} AS text FROM reviews"))
def notebook_clean(spark, sf):
    return reviews(spark, sf).select("review_id", notebook_clean_col("text").alias("text"))


@q("format_percent", W(f"SELECT review_id, {fmt_pct_sql('sentiment_score')} AS confidence FROM scored"))
def format_percent(spark, sf):
    return scored(spark, sf).select("review_id", N.format_percent("sentiment_score").alias("confidence"))


@q("format_thousands", f"SELECT o_orderkey, {fmt_thousands_sql('trunc(o_totalprice)')} AS total FROM orders")
def format_thousands(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", N.format_thousands(F.col("o_totalprice")).alias("total"))


@q("title_case", W("""SELECT sentiment, upper(left(sentiment, 1)) || lower(substr(sentiment, 2)) AS label, count(*) AS count
FROM scored GROUP BY sentiment"""))
def title_case(spark, sf):
    c = charts.sentiment_counts(scored(spark, sf))
    return c.select("sentiment", X.title_case("sentiment").alias("label"), "count")


# ============================================================================================
# 2.11 sentiment scoring
# ============================================================================================

@q("score_sentiment", W("SELECT review_id, sentiment, round_even(sentiment_score, 9) AS sentiment_score FROM scored"))
def score_sentiment(spark, sf):
    s = FX.scored_plan(spark, sf)
    return s.select("review_id", "sentiment", R("sentiment_score", 9).alias("sentiment_score"))


LOGITS = ("l_discount * 10", "l_tax * 10", "l_quantity / 25")


@q("sentiment_from_logits", f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS sentiment,
  round_even(1.0 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 9) AS sentiment_score
FROM (SELECT l_orderkey, l_linenumber, CAST({LOGITS[0]} AS DOUBLE) AS a, CAST({LOGITS[1]} AS DOUBLE) AS b,
             CAST({LOGITS[2]} AS DOUBLE) AS c FROM lineitem)""")
def sentiment_from_logits(spark, sf):
    li = T(spark, sf, "lineitem")
    s = S.sentiment_from_logits(F.expr(LOGITS[0]), F.expr(LOGITS[1]), F.expr(LOGITS[2]))
    return li.select("l_orderkey", "l_linenumber", s["sentiment"].alias("sentiment"),
                     R(s["sentiment_score"], 9).alias("sentiment_score"))


@q("neutral_on_empty", W("""SELECT clean_text = '' AS is_empty, sentiment, count(*) AS count,
  round_even(avg(sentiment_score), 9) AS avg_score FROM scored GROUP BY 1, 2"""))
def neutral_on_empty(spark, sf):
    s = scored(spark, sf)
    return (s.groupBy((F.col("clean_text") == "").alias("is_empty"), "sentiment")
            .agg(F.count(F.lit(1)).alias("count"), R(F.avg("sentiment_score"), 9).alias("avg_score")))


@q("truncate_tokens", W(f"""SELECT review_id, array_to_string({O.tokens('clean_text')}[1:512], ' ') AS model_input,
  least(len({O.tokens('clean_text')}), 512) AS n_tokens FROM scored"""))
def truncate_tokens(spark, sf):
    s = scored(spark, sf)
    return s.select("review_id", X.truncate_tokens("clean_text", 512).alias("model_input"),
                    F.least(F.size(X.tokens("clean_text")), F.lit(512)).cast("bigint").alias("n_tokens"))


@q("lexicon_score", W("""SELECT review_id, CAST(_neg AS BIGINT) AS negative_hits, CAST(_pos AS BIGINT) AS positive_hits, sentiment,
  round_even(sentiment_score, 9) AS sentiment_score
FROM scored JOIN (SELECT review_id AS rid, _neg, _pos FROM hits) ON rid = review_id"""))
def lexicon_score(spark, sf):
    s = FX.scored_plan(spark, sf)
    toks = X.tokens("clean_text_advanced")
    return s.select("review_id", X.count_in(toks, FX.NEGATIVE_WORDS).cast("bigint").alias("negative_hits"),
                    X.count_in(toks, FX.POSITIVE_WORDS).cast("bigint").alias("positive_hits"), "sentiment",
                    R("sentiment_score", 9).alias("sentiment_score"))


LABEL_SQL = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END"
LOGIT_SQL = ", ".join(f"ln((d{k} + 1.0) / (d0 + d1 + d2 + 3.0)) + coalesce(s{k}, 0.0) - len * ln(w{k} + v) AS l{k}" for k in range(3))


@q("trained_score", W(f""", train AS (
  SELECT {LABEL_SQL} AS y, lower({O.clean_basic('d.text')}) AS t FROM documents d JOIN labels USING (doc_id)),
tw AS (SELECT y, unnest({O.tokens('t')}) AS word FROM train),
wc AS (SELECT word, {", ".join(f"count(*) FILTER (WHERE y = {k}) AS n{k}" for k in range(3))} FROM tw GROUP BY word),
tot AS (SELECT count(*) AS v, {", ".join(f"sum(n{k}) AS w{k}" for k in range(3))} FROM wc),
pri AS (SELECT {", ".join(f"count(*) FILTER (WHERE y = {k}) AS d{k}" for k in range(3))} FROM train),
rw AS (SELECT review_id, clean_text, {O.tokens('lower(clean_text)')} AS toks FROM cleaned),
rc AS (SELECT review_id, word, count(*) AS n FROM (SELECT review_id, unnest(toks) AS word FROM rw) GROUP BY ALL),
sm AS (SELECT review_id, {", ".join(f"sum(n * ln(n{k} + 1.0)) AS s{k}" for k in range(3))} FROM rc JOIN wc USING (word) GROUP BY review_id),
lg AS (SELECT review_id, clean_text, {LOGIT_SQL} FROM (SELECT *, len(toks) AS len FROM rw) LEFT JOIN sm USING (review_id), tot, pri)
SELECT review_id, CASE WHEN clean_text = '' THEN 'neutral' WHEN l0 >= l1 AND l0 >= l2 THEN 'negative' WHEN l1 >= l2 THEN 'neutral' ELSE 'positive' END AS sentiment,
  CASE WHEN clean_text = '' THEN 0.0 ELSE round_even(1.0 / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) END AS sentiment_score
FROM lg"""))
def trained_score(spark, sf):
    """Learn from documents ⋈ labels (toxic → negative, quality → positive, else neutral),
    score every review."""
    train = T(spark, sf, "documents").select("doc_id", "text").join(T(spark, sf, "labels"), "doc_id").select(
        X.clean_basic("text").alias("clean_text"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("label"))
    model = scoring.fit_word_model(train, "clean_text", "label")
    rev = reviews(spark, sf).select("review_id", X.clean_basic("text").alias("clean_text"))
    out = scoring.trained_score(rev, model, "clean_text")
    return out.select("review_id", "sentiment", R("sentiment_score").alias("sentiment_score"))


# ============================================================================================
# 2.12 LLM data work
# ============================================================================================

def _header_sql(text: str, label: str, score: str) -> str:
    return (f"'Review:' || chr(10) || coalesce({text}, '') || chr(10) || chr(10) || 'Sentiment: ' || {label} || chr(10) "
            f"|| 'Confidence: ' || {fmt_pct_sql(score)} || chr(10)")


def _lit_sql(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _review_prompt_sql(sections) -> str:
    return W(f"""SELECT review_id,
  {_lit_sql("You analyse customer feedback for a business.\n\n")} || {_header_sql('text', 'sentiment', 'sentiment_score')}
  || {_lit_sql(chr(10) + "Work through these steps:" + chr(10) + prompts.numbered(sections) + chr(10) + "Answer with headed sections and bullet points.")} AS prompt
FROM scored""")


@q("review_prompt", _review_prompt_sql(prompts.ANALYSIS_SECTIONS))
def review_prompt(spark, sf):
    return prompts.review_prompt(scored(spark, sf), "text").select("review_id", "prompt")


SHORT_SECTIONS = ("Main complaint", "Main praise", "Mood of the writer", "Next step for the business")


@q("review_prompt_sections", _review_prompt_sql(SHORT_SECTIONS))
def review_prompt_sections(spark, sf):
    """The prompt with the caller's own sections."""
    return prompts.review_prompt(scored(spark, sf), "text", sections=SHORT_SECTIONS).select("review_id", "prompt")


def _answers(spark, sf) -> DataFrame:
    """A synthetic first answer per review, derived from its cleaned text."""
    s = scored(spark, sf)
    return s.withColumn("answer", F.concat(F.lit("Themes: "), F.col("clean_text_advanced"))) \
        .withColumn("reasoning", F.when(F.col("sentiment") == "negative", F.lit("checked negative words")))


@q("followup_conversation", W(f""", a AS (SELECT *, 'Themes: ' || clean_text_advanced AS answer,
  CASE WHEN sentiment = 'negative' THEN 'checked negative words' END AS reasoning FROM scored)
SELECT review_id, 1 AS turn, 'user' AS role, {_header_sql('text', 'sentiment', 'sentiment_score')} AS content,
  CAST(NULL AS VARCHAR) AS reasoning_details FROM a
UNION ALL SELECT review_id, 2, 'assistant', coalesce(answer, ''), reasoning FROM a
UNION ALL SELECT review_id, 3, 'user', {_lit_sql(prompts.ACTIONS_REQUEST)}, NULL FROM a"""))
def followup_conversation(spark, sf):
    conv = prompts.followup_conversation(_answers(spark, sf), "text", "answer", "reasoning")
    return conv.select("review_id", F.posexplode("messages").alias("turn", "m")).select(
        "review_id", (F.col("turn") + 1).alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"), F.col("m.reasoning_details").alias("reasoning_details"))


def _corpus_sql() -> str:
    item = ("'Review ' || CAST(i AS VARCHAR) || ' (Sentiment: ' || sentiment || ', Score: ' || "
            f"{fmt_pct_sql('sentiment_score')} || '):' || chr(10) || coalesce(text, '')")
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return W(f""", h AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY review_id) AS rk FROM scored
    WHERE sentiment IN ('positive','negative','neutral')),
k AS (SELECT *, CASE sentiment WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END AS o FROM h
    WHERE rk <= CASE sentiment WHEN 'positive' THEN 2 WHEN 'negative' THEN 2 ELSE 1 END),
n AS (SELECT *, row_number() OVER (ORDER BY o, rk) AS i FROM k)
SELECT 'You advise a business on its customer feedback.' || chr(10) || chr(10) || 'Here are ' || CAST(count(*) AS VARCHAR)
    || ' reviews from different sentiment groups:' || chr(10) || chr(10) || string_agg({item}, {sep} ORDER BY i)
    || chr(10) || chr(10) || {_lit_sql(prompts.CORPUS_REQUEST)} AS prompt,
  count(*) AS sample_size, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count, count(*) FILTER (WHERE sentiment = 'positive') AS positive_count
FROM n""")


@q("corpus_prompt", _corpus_sql())
def corpus_prompt(spark, sf):
    return prompts.corpus_prompt(scored(spark, sf), "review_id", "text")


def _stats_block_sql() -> str:
    lines = ["'Reviews analysed: '", fmt_thousands_sql("count(*)"), "chr(10) || 'Labels:' || chr(10)"]
    for name in ("positive", "neutral", "negative"):
        c = f"count(*) FILTER (WHERE sentiment = '{name}')"
        lines += [f"'- {name.title()}: '", fmt_thousands_sql(c), "' ('",
                  fmt_fixed_sql(f"({c} * 100.0 / count(*))", 1), "'%)' || chr(10)"]
    lines += ["'Mean confidence: '", f"coalesce({fmt_pct_sql('avg(sentiment_score)')}, 'n/a')", "chr(10)"]
    return " || ".join(lines)


@q("executive_stats_block", W(f"SELECT {_stats_block_sql()} AS stats_block FROM scored"))
def executive_stats_block(spark, sf):
    return prompts.executive_stats_block(scored(spark, sf))


@q("executive_prompt", W(f"""SELECT {_lit_sql("You report customer-feedback results to the leadership team.\n")} || {_stats_block_sql()}
  || chr(10) || {_lit_sql(prompts.EXECUTIVE_REQUEST)} AS prompt FROM scored"""))
def executive_prompt(spark, sf):
    return prompts.executive_prompt(scored(spark, sf))


@q("request_payload", f"""WITH rp AS ({ORACLE["review_prompt"]})
SELECT review_id, CAST(to_json({{'model': 'analysis-model', 'messages': [{{'role': 'user', 'content': prompt}}],
  'reasoning': {{'enabled': true}}}}) AS VARCHAR) AS request FROM rp""")
def request_payload(spark, sf):
    p = prompts.first_conversation(prompts.review_prompt(scored(spark, sf), "text"))
    return prompts.request_payload(p, "messages", model="analysis-model", reasoning=True).select("review_id", "request")


def _responses(spark, sf) -> DataFrame:
    """Response JSON built from the conversations table: each assistant turn is an answer;
    turn numbers pick the malformed variants (no choices, no content, invalid JSON)."""
    c = T(spark, sf, "conversations").where(F.col("role") == "assistant")
    msg = F.struct(F.col("text").alias("content"),
                   F.when(F.col("turn") % 4 == 1, F.concat(F.lit("r-"), F.col("conv_id").cast("string")))
                   .alias("reasoning_details"))
    full = F.to_json(F.struct(F.array(F.struct(msg.alias("message"))).alias("choices")))
    no_content = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("x").alias("role")).alias("message"))).alias("choices")))
    resp = (F.when(F.col("conv_id") % 7 == 3, F.lit('{"error": "rate limited"}'))
            .when(F.col("conv_id") % 7 == 5, no_content)
            .when(F.col("conv_id") % 11 == 6, F.lit("{not json"))
            .otherwise(full))
    return c.select("conv_id", "turn", resp.alias("response"))


RESP_SQL = """r AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 1 THEN 'r-' || CAST(conv_id AS VARCHAR) END AS reasoning,
  CASE WHEN conv_id % 7 = 3 THEN 'error' WHEN conv_id % 7 = 5 THEN 'no_content' WHEN conv_id % 11 = 6 THEN 'invalid' ELSE 'full' END AS kind
  FROM conversations WHERE role = 'assistant')"""


@q("parse_response", f"""WITH {RESP_SQL}
SELECT conv_id, turn, CASE kind WHEN 'full' THEN text WHEN 'no_content' THEN '' END AS content,
  CASE kind WHEN 'full' THEN reasoning END AS reasoning_details FROM r""")
def parse_response(spark, sf):
    return prompts.parse_response(_responses(spark, sf), "response").select(
        "conv_id", "turn", "content", "reasoning_details")


@q("chain_result", f"""WITH {RESP_SQL},
p AS (SELECT conv_id, turn, CASE kind WHEN 'full' THEN text WHEN 'no_content' THEN '' END AS content,
  CASE kind WHEN 'full' THEN reasoning END AS reasoning FROM r),
pairs AS (SELECT a.conv_id, a.turn, a.content AS c1, a.reasoning AS r1, b.content AS c2
  FROM p a LEFT JOIN p b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2)
SELECT conv_id, turn, c1 AS analysis,
  CASE WHEN c1 IS NOT NULL THEN coalesce(c2, 'no recommendations: the request failed') END AS recommendations,
  CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN r1 END AS reasoning_trace, c1 IS NOT NULL AS ok FROM pairs""")
def chain_result(spark, sf):
    r = _responses(spark, sf)
    nxt = r.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("response").alias("response2"))
    pairs = r.join(nxt, ["conv_id", "turn"], "left")
    return prompts.chain_result(pairs, "response", "response2").select(
        "conv_id", "turn", "analysis", "recommendations", "reasoning_trace", "ok")


def _stub_completion(requests):
    """A pure stand-in for an HTTP client: answers with the request's size."""
    import json

    out = []
    for req in requests:
        body = json.loads(req)
        out.append(json.dumps({"choices": [{"message": {"content": f"chars={len(body['messages'][0]['content'])}"}}]}))
    return out


@q("map_completions", f"""WITH rp AS ({ORACLE["review_prompt"]})
SELECT review_id, 'chars=' || CAST(length(prompt) AS VARCHAR) AS content FROM rp""")
def map_completions(spark, sf):
    p = prompts.first_conversation(prompts.review_prompt(scored(spark, sf), "text"))
    req = prompts.request_payload(p, "messages", model="analysis-model").select("review_id", "request")
    done = prompts.map_completions(req, "request", _stub_completion)
    return prompts.parse_response(done, "response").select("review_id", "content")


def _register() -> None:
    """The other modules of queries register theirs when they are imported."""
    from reviewlens.plans import catalog_charts, catalog_scoring  # noqa: F401


def queries() -> dict[str, Query]:
    _register()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(ORACLE)
