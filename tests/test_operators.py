"""Operator semantics on the hand-made edge tables (FIXTURES.md §3) and trap rules (§2.14)."""

import math
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import numeric as N
from reviewlens.functions import sentiment as S
from reviewlens.operators import charts, entities, filters, profile, prompts, quantiles, rating, roles
from reviewlens.operators import sampling, scoring, temporal, textstats
from reviewlens.sources import io


def test_sentiment_from_logits_first_wins(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 2.0, 2.0), (0.0, 0.0, 3.0), (2.0, 0.5, 2.0)], "a double, b double, c double")
    rows = df.select(S.sentiment_from_logits("a", "b", "c").alias("s")).collect()
    labels = [r.s.sentiment for r in rows]
    assert labels == ["negative", "neutral", "positive", "negative"]
    assert math.isclose(rows[0].s.sentiment_score, 1 / 3)
    e = [math.exp(x) for x in (0.0, 0.0, 3.0)]
    assert math.isclose(rows[2].s.sentiment_score, e[2] / sum(e))


def test_lexicon_scorer_rules(spark):
    sc = scoring.LexiconScorer(positive=("good",), negative=("bad",))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "good good bad"), (4, "bad, GOOD!"), (5, "nothing")], "id int, text string")
    out = {r.id: (r.sentiment, r.sentiment_score) for r in
           scoring.score_sentiment(scoring.clean_pipeline(df, "text"), "clean_text", sc).collect()}
    assert out[1] == ("neutral", 0.0) and out[2] == ("neutral", 0.0)
    assert out[3][0] == "positive" and out[4][0] == "negative"   # tie between 1 and 1 → first label
    assert out[5][0] == "neutral" and 1 / 3 <= out[5][1] <= 1


def test_batch_scorer_isolates_failures(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failure")
            return ["positive"] * len(texts), [0.9] * len(texts)
        return predict

    df = spark.createDataFrame([(1, "fine"), (2, "boom"), (3, ""), (4, None)], "id int, clean_text string")
    out = {r.id: (r.sentiment, r.sentiment_score) for r in
           scoring.score_sentiment(df, "clean_text", scoring.BatchScorer(load=load, batch_size=2)).collect()}
    assert out == {1: ("positive", 0.9), 2: ("neutral", 0.0), 3: ("neutral", 0.0), 4: ("neutral", 0.0)}


EDGE_RATING = [(1, None, "negative"), (2, 5.0, "negative"), (3, 2.0, "positive"), (4, 4.0, "negative"),
               (5, 3.0, "neutral"), (6, float("nan"), "positive")]


def test_mismatch_flags_never_null_and_null_rating_kept(spark):
    df = spark.createDataFrame(EDGE_RATING, "id int, stars double, sentiment string")
    f = {r.id: (r.mismatch_high_negative, r.mismatch_low_positive, r.has_mismatch)
         for r in filters.detect_mismatches(df, "stars").collect()}
    assert f[1] == (False, False, False) and f[6] == (False, False, False)
    assert f[2] == (True, False, True) and f[3] == (False, True, True) and f[4] == (True, False, True)
    kept = sorted(r.id for r in filters.remove_mismatches(df, "stars").collect())
    assert kept == [1, 5, 6]
    share = filters.removed_share(df, "stars").first()
    assert (share.input_rows, share.removed_rows, share.kept_rows) == (6, 3, 3) and share.removed_pct == 50.0


def test_rating_statistics_mode_tie_and_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (5.0,), (None,)], "x double")
    s = rating.rating_statistics(df, "x").first()
    assert s.mode == 2.0 and s.median == 2.0 and s.min == 1.0 and s.max == 5.0
    assert s.std == round(1.8708286933869707, 2)
    p = rating.rating_percentiles(df, "x").first()
    assert p.p90 == 5.0 and p.p25 == 2.0
    c = rating.rating_concentration(df, "x").first()
    assert c.high_rating_pct == 33.3 and c.low_rating_pct == 50.0 and c.polarization_index == 0.17
    assert rating.rating_concentration(df.limit(0), "x").count() == 0


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 3.0, None), (3.0, 3.0, 5.0), (4.0, 3.0, 2.0)], "a double, b double, e double")
    m = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(df).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] is None and m[("a", "a")] == 1.0
    # exact: complete rows (1,1), (3,5), (4,2) → 24 / sqrt(42 · 78)
    assert math.isclose(m[("a", "e")], 24 / math.sqrt(3276), rel_tol=1e-12)
    pdf = pd.DataFrame({"a": [1, 2, 3, 4.0], "e": [1, None, 5, 2.0]})
    assert math.isclose(m[("e", "a")], pdf.corr().loc["e", "a"], rel_tol=1e-12)
    assert profile.correlation_matrix(df.select("a")).count() == 0


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    probs = [0.25, 0.5, 0.75, 0.9]
    want = df.agg(F.percentile("v", probs).alias("q")).first().q
    got = {r.p: r.value for r in quantiles.exact_quantiles(df, "v", probs).collect()}
    for p, w in zip(probs, want):
        assert math.isclose(got[p], w, rel_tol=1e-12)


def test_group_quantiles_match_percentile_with_hot_group(spark):
    # group "hot" holds ~90% of rows and one value repeated 2000 times; "one" has a single
    # value, "gone" only NULL/NaN (no output row), as pandas skips missing values
    base = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("g"),
        F.when(F.col("id") < 2000, F.lit(42.5)).otherwise(((F.col("id") * 7919) % 4099) / 7.0).alias("v"))
    odd = spark.createDataFrame([("one", 3.0), ("gone", None), ("gone", float("nan")), ("hot", float("nan"))],
                                "g string, v double")
    df = base.unionByName(odd)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {r.g: r.q for r in df.where(~F.isnan("v")).groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    got = {}
    for r in quantiles.group_quantiles(df, ["g"], "v", probs).collect():
        got.setdefault(r.g, {})[r.p] = r.value
    assert set(got) == {"hot", "cold", "one"} and want["gone"] is None
    for g in got:
        for p, w in zip(probs, want[g]):
            assert math.isclose(got[g][p], w, rel_tol=1e-12), (g, p, got[g][p], w)


@pytest.mark.parametrize("small", [quantiles.SMALL, 2000])
@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("aqe", ["true", "false"])
def test_quantiles_do_not_depend_on_the_optimizer(spark, monkeypatch, aqe, reuse, small):
    if small == 2000:  # a coarse sketch and brackets that are cut into steps
        monkeypatch.setattr(quantiles, "SMALL", small)
        monkeypatch.setattr(quantiles, "SKETCH", 512)
        monkeypatch.setattr(quantiles, "MARGIN", 4 * 2.296 / 512 ** 0.9021 + 1e-3)
        monkeypatch.setattr(quantiles, "STEPS", 7)
    # hot values, a long tail, infinities in a group of their own
    df = spark.range(0, 60_000).select(
        F.when(F.col("id") % 5 == 0, F.lit("a")).otherwise(F.lit("b")).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.25)).when(F.col("id") % 1009 == 0, F.exp(F.col("id") % 500))
        .otherwise((F.col("id") * 7919 % 60_013) / 7.0 - 100).alias("v"))
    df = df.unionByName(spark.createDataFrame([("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))], "g string, v double"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.exchange.reuse")}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got = quantiles.group_quantiles(df, ["g"], "v", probs).collect()
        whole = quantiles.group_quantiles(df.where("g = 'b'"), [], "v", probs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 18 and len(whole) == 6
    for r in got:
        assert r.value == want[r.g][probs.index(r.p)] or math.isclose(r.value, want[r.g][probs.index(r.p)], rel_tol=1e-12), r
    assert all(math.isclose(r.value, want["b"][probs.index(r.p)], rel_tol=1e-12) for r in whole)


def test_quantiles_of_many_groups_and_of_nothing(spark):
    df = spark.range(0, 500).select((F.col("id") % 50).alias("g"), (F.col("id") * 13 % 101).cast("double").alias("v"))
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", [0.1, 0.5]).alias("q")).collect()}
    got = quantiles.group_quantiles(df, ["g"], "v", [0.1, 0.5]).collect()
    assert len(got) == 100 and all(math.isclose(r.value, want[r.g][r.p == 0.5], rel_tol=1e-12) for r in got)
    assert quantiles.group_quantiles(df.where("v < 0"), ["g"], "v", [0.5]).count() == 0
    assert quantiles.exact_quantiles(df.where("v < 0"), "v", [0.5]).count() == 0


def test_wide_quantiles_one_pass_per_column(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, None), (2.0, 30), (5.0, 40), (None, 50)], "a double, b int")
    got = {(r.column_name, r.p): r.value for r in quantiles.wide_quantiles(df, ["a", "b"], [0.5, 0.75]).collect()}
    want = df.agg(F.percentile("a", [0.5, 0.75]).alias("a"), F.percentile("b", [0.5, 0.75]).alias("b")).first()
    for c in ("a", "b"):
        for p, w in zip((0.5, 0.75), want[c]):
            assert math.isclose(got[(c, p)], w, rel_tol=1e-12)


def test_dates_and_elapsed_days(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("junk",), (None,)], "d string")
    p = [r.parsed_date for r in temporal.parse_dates(df, "d").collect()]
    assert p[2] is None and p[3] is None and p[0] is not None and p[1] is not None
    span = spark.createDataFrame([("2024-01-01 23:00:00",), ("2024-01-03 01:00:00",)], "d string")
    r = temporal.date_range(span, "d").first()
    assert r.span_days == 1 and r.start == "2024-01-01" and r.end == "2024-01-03" and r.daily_avg == 1.0
    assert temporal.date_range(df.where("d = 'junk'"), "d").count() == 0


def test_roles_detection(spark):
    df = spark.createDataFrame(
        [(i, "x" * 60 + str(i), float(1 + i % 5), f"2024-01-{1 + i % 28:02d}", i % 3, "provider") for i in range(40)],
        "user_id long, body string, stars double, created_date string, level int, provider string")
    r = roles.detect_roles(df, "user_id")
    assert r == roles.ColumnRoles(text="body", rating="stars", id="user_id", date="created_date")
    df2 = df.drop("stars")
    assert roles.detect_roles(df2, "user_id").rating is None   # 3 distinct (0..2) but min 0 < 1
    df3 = df.select("user_id", "body", (F.col("level") + 1).alias("level"))
    assert roles.detect_roles(df3, "user_id").rating == "level"
    scored_like = df.withColumn("sentiment", F.lit("neutral")).withColumn("sentiment_score", F.lit(0.5))
    cands = [r.column_name for r in roles.detect_date_candidates(scored_like).collect()]
    assert cands == ["created_date"]
    norm = roles.normalize_columns(df.withColumn("text", F.lit("t")), roles.ColumnRoles(text="body", rating="stars"))
    assert "text_detected" in norm.columns and "rating" in norm.columns
    assert r.override(id="provider", text="Auto").id == "provider"


def test_quality_report(spark):
    perfect = spark.createDataFrame([(1, "some text"), (2, "more text")], "id int, text string")
    q = profile.quality_report(perfect, "text").first()
    assert q.overall_quality_score == 100.0 and q.completeness_score == 100.0
    q2 = profile.quality_report(perfect.select("id")).first()
    assert q2.overall_quality_score == 100.0          # renormalised, not ×100
    empty = profile.quality_report(perfect.limit(0), "text").first()
    assert empty.completeness_score is None
    blanks = spark.createDataFrame([(1, "  "), (2, None), (3, "x")], "id int, text string")
    v = profile.text_validity(blanks, "text").first()
    assert v.text_empty_count == 1                     # null counts as 'nan', not blank


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "a int, b string")
    d = profile.duplicate_rows(df).first()
    assert (d.total_rows, d.distinct_rows, d.duplicate_rows) == (5, 2, 3)
    o = profile.table_overview(df).first()
    assert o.missing_values == 2 and o.duplicate_rows == 3


def test_histogram_numpy_rules(spark):
    df = spark.createDataFrame([(k,) for k, n in [("a", 1), ("b", 1), ("c", 2), ("d", 4), ("e", 10)] for _ in range(n)], "k string")
    h = [r["count"] for r in entities.entity_count_histogram(df, "k", bins=3).collect()]
    assert h == [3, 1, 1]
    same = spark.createDataFrame([("a",), ("b",)], "k string")
    h2 = [r["count"] for r in entities.entity_count_histogram(same, "k", bins=3).collect()]
    assert h2 == [0, 2, 0]


def test_parse_response_edges(spark):
    rows = [(1, '{"choices":[{"message":{"content":"hi","reasoning_details":[{"t":1}]}}]}'),
            (2, '{"error":"x"}'), (3, '{"choices":[{"message":{"role":"a"}}]}'), (4, "{bad json")]
    df = spark.createDataFrame(rows, "id int, response string")
    out = {r.id: (r.content, r.reasoning_details) for r in prompts.parse_response(df, "response").collect()}
    assert out[1][0] == "hi" and out[1][1] is not None
    assert out[2] == (None, None) and out[3] == ("", None) and out[4] == (None, None)


def test_chain_result(spark):
    ok = '{"choices":[{"message":{"content":"A","reasoning_details":"R"}}]}'
    df = spark.createDataFrame([(1, ok, ok), (2, ok, None), (3, None, ok)], "id int, r1 string, r2 string")
    out = {r.id: (r.analysis, r.recommendations, r.reasoning_trace, r.ok) for r in prompts.chain_result(df, "r1", "r2").collect()}
    assert out[1] == ("A", "A", "R", True)
    assert out[2] == ("A", "no recommendations: the request failed", None, True)
    assert out[3] == (None, None, None, False)


def test_format_helpers(spark):
    df = spark.createDataFrame([(0.98765,), (0.0,), (1.0,), (None,), (-0.001,)], "x double")
    got = [r.p for r in df.select(N.format_percent("x").alias("p")).collect()]
    assert got == [f"{0.98765:.2%}", "0.00%", "100.00%", None, f"{-0.001:.2%}"]
    n = spark.createDataFrame([(1234567,), (0,)], "n long").select(N.format_thousands("n").alias("t")).collect()
    assert [r.t for r in n] == ["1,234,567", "0"]


def test_stratified_head_and_plan(spark):
    df = spark.createDataFrame([(i, ["positive", "negative", "neutral"][i % 3]) for i in range(30)], "id long, sentiment string")
    got = [(r.id, r.sentiment) for r in sampling.stratified_head(df, "id").collect()]
    assert got == [(0, "positive"), (3, "positive"), (1, "negative"), (4, "negative"), (2, "neutral")]
    plan = sampling.stratified_head(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_random_sample_reproducible(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in sampling.random_sample(df, 5, "k", seed=7).collect()]
    b = [r.k for r in sampling.random_sample(df, 5, "k", seed=7).collect()]
    assert a == b and len(set(a)) == 5 and sampling.random_sample(df, 500, "k").count() == 100


def test_word_and_bigram_frequencies(spark):
    df = spark.createDataFrame([("The cat sat. The cat ran!", "a"), ("cat", "b")], "t string, g string")
    w = {(r.word, r["count"]) for r in charts.word_frequencies(df, "t", 10).collect()}
    assert ("cat", 3) in w and not any(x == "the" for x, _ in w)
    b = {r.bigram: r["count"] for r in charts.bigram_frequencies(df, "t", 10).collect()}
    assert b["cat sat"] == 1 and "cat ran" in b


def test_crosstab_fills_zero(spark):
    df = spark.createDataFrame(EDGE_RATING, "id int, stars double, sentiment string")
    ct = {r.rating: (r.negative, r.neutral, r.positive) for r in charts.rating_sentiment_crosstab(df, "stars").collect()}
    assert ct == {5.0: (1, 0, 0), 2.0: (0, 0, 1), 4.0: (1, 0, 0), 3.0: (0, 1, 0)}


def test_text_stats_null_as_nan(spark):
    df = spark.createDataFrame([("abcd",), (None,)], "t string")
    s = textstats.text_length_stats(df, "t").first()
    assert (s.min, s.max, s.mean) == (3, 4, 3)


def test_csv_scan_pandas_like(spark, tmp_path):
    p = tmp_path / "edge.csv"
    p.write_text('id,text,score,flag,note\n1,"line one\nline two",1.5,True,NA\n2,"say ""hi""",2,False,\n3,plain,,true,null\n')
    df = io.scan_csv(spark, str(p), multi_line=True)
    pdf = pd.read_csv(p)
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "score": "double", "flag": "boolean", "note": "double"}
    got = df.orderBy("id").collect()
    assert [r.text for r in got] == list(pdf.text)
    assert got[2].score is None and got[0].note is None
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "x.txt"))


def _write_xlsx(path, header, rows):
    def cell(ref, v):
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    cols = "ABCDEFGHIJ"
    xml_rows = []
    for i, r in enumerate([header] + rows, start=1):
        xml_rows.append(f'<row r="{i}">' + "".join(cell(f"{cols[j]}{i}", v) for j, v in enumerate(r) if v is not None) + "</row>")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(xml_rows)}</sheetData></worksheet>')


def test_excel_scan(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    _write_xlsx(d / "a.xlsx", ["id", "text", "stars"], [[1, "good place", 5], [2, "bad", None]])
    _write_xlsx(d / "b.xlsx", ["id", "text", "stars"], [[3, "ok", 3]])
    df = io.read_table(spark, str(d / "a.xlsx"))
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "stars": "bigint"}
    from reviewlens.sources.excel import scan_excel

    both = scan_excel(spark, str(d))
    assert sorted(r.id for r in both.collect()) == [1, 2, 3]


def test_json_records_and_columns(spark, tmp_path):
    rec = tmp_path / "rec.json"
    rec.write_text('[{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]')
    assert io.scan_json(spark, str(rec), layout="records").count() == 2
    col = tmp_path / "col.json"
    col.write_text('{"id": {"0": 1, "1": 2}, "text": {"0": "a", "1": "b"}}')
    out = io.scan_json(spark, str(col), layout="columns").collect()
    assert [(r.id, r.text) for r in out] == [(1, "a"), (2, "b")]


def test_streaming_timeline(spark, tmp_path):
    from reviewlens.streaming.timeline import run_to_memory, streaming_sentiment_timeline

    src = tmp_path / "src"
    spark.createDataFrame([("2024-01-01", "positive"), ("2024-01-01", "negative"), ("2024-01-02", "positive"),
                           ("2024-01-09", "neutral")], "review_date string, sentiment string").write.parquet(str(src))
    stream = spark.readStream.schema("review_date string, sentiment string").parquet(str(src))
    out = run_to_memory(streaming_sentiment_timeline(stream, "review_date"), "tl_test",
                        checkpoint=str(tmp_path / "ck"))
    rows = {(str(r.day), r.sentiment): r["count"] for r in out.collect()}
    assert rows.get(("2024-01-01", "positive")) == 1 and rows.get(("2024-01-02", "positive")) == 1


def test_duplicates_normalise_floats_and_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, "a"), (nan, "a"), (-0.0, "b"), (0.0, "b"), (1.0, None), (None, "1.0")],
                               "x double, s string")
    d = profile.duplicate_rows(df).first()
    assert (d.total_rows, d.distinct_rows, d.duplicate_rows) == (6, 4, 2)
    big = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.lit("x").alias("v"))
    assert profile.duplicate_rows(big).first().duplicate_rows == 2000


def test_distinct_count_exact_with_hot_copy(spark):
    from reviewlens.operators import textstats

    rows = [("a",)] * 500 + [("b",), ("c",), (None,), (None,)] + [(f"t{i}",) for i in range(100)]
    df = spark.createDataFrame(rows, "text string")
    # a, b, c, NULL (NULLs group together, as in pandas duplicated) and 100 singletons
    assert tuple(profile.row_counts(df).first()) == (len(rows), 104)
    r = textstats.text_cardinality(df, "text").first()
    assert (r.empty_count, r.unique_count) == (2, 103)
    assert profile.duplicate_rows(df).first().duplicate_rows == len(rows) - 104


def test_duplicates_of_odd_types_and_completeness_of_maps(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (map('a', 1, 'b', 2), array(1, null), named_struct('x', cast(null as string)), x'00', 'a:1'),
        (map('b', 2, 'a', 1), array(1, null), named_struct('x', cast(null as string)), x'00', 'a:1'),
        (map('b', 2, 'a', 1), array(1), named_struct('x', cast(null as string)), x'00', 'a:1'),
        (null, array(1, null), null, x'00', null),
        (null, array(1, null), named_struct('x', 'null'), x'00', '-') AS t(m, a, s, b, t)""")
    d = profile.duplicate_rows(df).first()
    assert (d.total_rows, d.distinct_rows, d.duplicate_rows) == (5, 4, 1)
    c = profile.completeness(df).first()
    assert (c.total_cells, c.missing_cells) == (25, 4)
    empty = profile.table_overview(df.limit(0)).first()
    assert tuple(empty) == (0, 5, 0, 0)


def test_profiles_are_lazy_and_read_the_table_once(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "plans only")
    plans = [profile.duplicate_rows(df), profile.table_overview(df), profile.quality_report(df, "text"),
             profile.consistency(df), textstats.text_cardinality(df, "text"), profile.completeness(df),
             textstats.text_length_stats(df, "text"), entities.entity_count_histogram(df, "source")]
    assert not seen.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan parquet", text)) == 1
    assert "hashpartitioning" not in plans[5]._jdf.queryExecution().executedPlan().toString()


def test_outliers_ignore_nan(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(50)] + [(float("nan"),)] * 5, "v double")
    assert profile.iqr_outliers(df).count() == 0


def test_histogram_of_counts_edges(spark):
    one = entities.entity_count_histogram(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k", 4).collect()
    assert [r["count"] for r in one] == [0, 0, 2, 0] and one[0].bin_start == 0.5 and one[-1].bin_end == 1.5
    assert entities.entity_count_histogram(spark.createDataFrame([(None,)], "k string"), "k").count() == 0


def test_text_role_uses_every_row(spark):
    # the long texts come after the first hundred rows
    df = spark.range(400).select("id", F.when(F.col("id") < 200, "short").otherwise(F.repeat(F.lit("x"), 300)).alias("body"),
                                 F.lit("y" * 60).alias("note"))
    assert roles.detect_roles(df).text == "body"
    assert [r.column_name for r in roles.detect_text_table(df).where("chosen").collect()] == ["body"]
    assert roles.detect_roles(df, "id", sample_size=100).text == "note"


def test_rating_table_counts_exactly_and_lists_empty_columns(spark):
    df = spark.createDataFrame([(i, float(i % 31), None, float("nan")) for i in range(200)], "a int, stars double, b double, c double")
    got = {r.column_name: r for r in roles.detect_rating_table(df).collect()}
    assert (got["a"].n_distinct, got["stars"].n_distinct, got["b"].n_distinct, got["c"].n_distinct) == (200, 31, 0, 0)
    assert not any(r.chosen for r in got.values())
    assert roles.detect_rating_table(df.limit(0)).count() in (0, 4)
    assert roles.detect_roles(df.limit(0)) == roles.ColumnRoles()


def test_one_failing_request_loses_one_answer(spark):
    def client(requests):
        if any(r == "bad" for r in requests):
            raise RuntimeError("refused")
        return [r.upper() for r in requests]

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"r{i}") for i in range(40)], "i int, request string").coalesce(1)
    got = {r.i: r.response for r in prompts.map_completions(df, "request", client).collect()}
    assert got == {i: None if i == 5 else f"R{i}" for i in range(40)}


def test_missing_logits_are_neutral(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (float("nan"), 1.0, 0.0), (2.0, 1.0, 0.0)], "a double, b double, c double")
    got = [tuple(r.s) for r in df.select(S.sentiment_from_logits("a", "b", "c").alias("s")).collect()]
    assert got[:2] == [("neutral", 0.0)] * 2 and got[2][0] == "negative"


def test_csv_loses_no_value_and_is_split(spark, tmp_path):
    p = tmp_path / "codes.csv"
    p.write_text("id,code,num,mixed,plus\n12345678901234567890,1d,1.5,7,+1\n12345678901234567891,2f,-2e3,x,2\n3,3,inf,,3\n")
    df = io.scan_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "string", "code": "string", "num": "double", "mixed": "string", "plus": "bigint"}
    got = [tuple(r) for r in df.collect()]
    assert got == [("12345678901234567890", "1d", 1.5, "7", 1), ("12345678901234567891", "2f", -2000.0, "x", 2),
                   ("3", "3", float("inf"), None, 3)]
    big = tmp_path / "big.csv"
    big.write_text("a,b\n" + "".join(f"{i},{'x' * 50}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        assert io.scan_csv(spark, str(big), infer=False).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert io.scan_csv(spark, str(big)).agg(F.count("*"), F.sum("a")).first()[:] == (4000, 7998000)


def test_json_layouts(spark, tmp_path):
    def folder(name, *texts):
        d = tmp_path / f"{name}.json"
        d.mkdir()
        for i, t in enumerate(texts):
            (d / f"f{i}.json").write_text(t)
        return str(d)

    # rows of the same number in two files stay apart; numbers are typed, also in quotes; a cell may be missing or null
    cols = folder("columns", '{\n "id": {"0": 1, "1": 2},\n "t": {"0": "a", "1": null}}', '{\n "id": {"0": "3", "5": 4}, "t": {"0": "c"}, "x": {"5": 1.5}}')
    df = io.read_table(spark, cols)
    assert dict(df.dtypes) == {"id": "bigint", "t": "string", "x": "double"}
    assert sorted(df.collect(), key=str) == [(1, "a", None), (2, None, None), (3, "c", None), (4, None, 1.5)]
    # an indented array; records whose columns are all objects; lines
    assert [tuple(r) for r in io.read_table(spark, folder("array", '[\n  {"a": 1, "b": "x"},\n  {"a": 2}\n]')).collect()] == [(1, "x"), (2, None)]
    objects = io.read_table(spark, folder("objects", '[{"p": {"x": 1}, "q": {"y": 2}}, {"p": {"x": 3}, "q": {"y": 4}}]'))
    assert [(r.p.x, r.q.y) for r in objects.collect()] == [(1, 2), (3, 4)]
    lines = io.read_table(spark, folder("lines", '{"p": {"x": 1}}\n{"p": {"x": 2}}\n'))
    assert sorted(r.p.x for r in lines.collect()) == [1, 2]
    one = io.read_table(spark, folder("oneline", '{"id": {"0": 1}, "t": {"0": "a"}}'))
    assert [tuple(r) for r in one.collect()] == [(1, "a")]


def test_json_layout_is_told_per_file(spark, tmp_path):
    def folder(name, *texts):
        d = tmp_path / f"{name}.json"
        d.mkdir()
        for i, t in enumerate(texts):
            (d / f"f {i}.json").write_text(t)
        return str(d)

    def rows(path):
        return sorted([r.id, r.t] for r in io.read_table(spark, path).select("id", "t").collect())

    columns = ['{"id": {"0": 1, "1": 2}, "t": {"0": "a", "1": "b"}}', '{"id": {"0": 3, "1": 4}, "t": {"0": "c", "1": "d"}}']
    assert rows(folder("one-line", *columns)) == [[1, "a"], [2, "b"], [3, "c"], [4, "d"]]
    mixed = [columns[0], '\n[\n {"id": 3, "t": "c"}, {"id": 4, "t": "d"}\n]', '{"id": 5, "t": "e"}\n{"id": 6, "t": "f"}\n',
             '{"t": "g", "id": 7}', '{\n "id": {"0": 8},\n "t": {"0": "h"}\n}', "", " \n"]
    want = [[i, "_abcdefgh"[i]] for i in range(1, 9)]
    assert rows(folder("mixed", *mixed)) == rows(folder("mixed2", *mixed[::-1])) == want
    assert rows(folder("types", columns[0], '{"id": "x", "t": "y"}\n{"id": "z", "t": "z"}')) == [["1", "a"], ["2", "b"], ["x", "y"], ["z", "z"]]
    # a file of one row beside files of more rows like it is JSON lines, too
    nested = io.read_table(spark, folder("nested", '{"p": {"x": 1}}', '{"p": {"x": 2}}\n{"p": {"x": 3}}'))
    assert sorted(r.p.x for r in nested.collect()) == [1, 2, 3]


def test_excel_with_another_header_fails(spark, tmp_path):
    from reviewlens.sources.excel import scan_excel

    d = tmp_path / "books2"
    d.mkdir()
    _write_xlsx(d / "a.xlsx", ["id", "text"], [[1, "x"]])
    _write_xlsx(d / "b.xlsx", ["text", "id"], [["y", 2]])
    with pytest.raises(Exception, match="header"):
        scan_excel(spark, str(d)).collect()
    _write_xlsx(d / "b.xlsx", ["id", "text"], [[2, "y", 3]])
    with pytest.raises(Exception, match="beyond the header"):
        scan_excel(spark, str(d)).collect()


def test_word_model(spark):
    train = spark.createDataFrame([("bad awful bad", 0), ("fine ok", 1), ("great good great", 2), (None, 2), ("x", None), ("y", 7)], "t string, y int")
    m = scoring.fit_word_model(train, "t", "y")
    assert m.documents == (1, 1, 2) and m.tokens == (3, 2, 3) and m.vocabulary == 6
    df = spark.createDataFrame([(1, "Bad bad"), (1, "great"), (2, "unseen"), (3, ""), (4, None), (1, "great")], "id int, t string")
    got = sorted(((r.id, r.t or "", r.sentiment, r.sentiment_score) for r in scoring.trained_score(df, m, "t").collect()), key=str)
    assert [g[:3] for g in got] == [(1, "Bad bad", "negative"), (1, "great", "positive"), (1, "great", "positive"),
                                    (2, "unseen", "positive"), (3, "", "neutral"), (4, "", "neutral")]
    a, b, c = (math.log((d + 1) / 7) + n * math.log(k + 1) - 2 * math.log(w + 6) for d, n, k, w in ((1, 2, 2, 3), (1, 0, 0, 2), (2, 0, 0, 3)))
    assert math.isclose(got[0][3], math.exp(a) / (math.exp(a) + math.exp(b) + math.exp(c)), rel_tol=1e-12)
    assert got[4][3] == 0.0 and got[5][3] == 0.0
    nothing = scoring.fit_word_model(train.limit(0), "t", "y")
    assert {r.sentiment for r in scoring.trained_score(df, nothing, "t").collect()} == {"negative", "neutral"}


def test_scratch_is_removed_and_inputs_are_told_by_their_files(spark, tmp_path):
    from reviewlens import session

    p = session.shared_dir(spark, "probe") + "/t.parquet"
    spark.range(3).write.parquet(p)
    first = session.path_state(spark, p)
    assert first and session.path_state(spark, str(tmp_path / "none")) is None
    spark.range(4).write.mode("overwrite").parquet(p)
    assert session.path_state(spark, p) != first
    kept, session._MADE[:] = session._MADE[:-1], session._MADE[-1:]
    session.remove_scratch(spark)
    assert session.path_state(spark, p) is None
    session._MADE[:] = kept
