"""The linear scorer against a plain version, the request ledger, exact distinct counts of whole numbers, blank texts."""

import math
import os

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from reviewlens.functions import text as X
from reviewlens.operators import ledger, linear, profile, roles
from reviewlens.plans import catalog


# ---------------------------------------------------------------- linear scorer
def test_linear_model_equals_plain_gradient_descent(spark):
    texts = ["good good fine", "bad awful", "so so", "", "Good bad words", None, "fine"] * 3
    labels = [2, 0, 1, 1, 0, 2, 2] * 3
    rows = list(zip(texts, labels)) + [("left out", None), ("left out", 7)]
    df = spark.createDataFrame(rows, "t string, y int").repartition(4)
    m = linear.fit_linear_model(df, "t", "y", steps=7, rate=0.5, momentum=0.8, decay=0.01, buckets=64)
    seen = {r.t: r.w for r in df.select("t", linear.hashed_words(F.coalesce("t", F.lit("")), 64).alias("w")).collect()}
    value = {t: {i: math.sqrt(ids.count(i) / len(ids)) for i in ids} for t, ids in seen.items()}
    w, bias, move, shift = np.zeros((3, 64)), np.zeros(3), np.zeros((3, 64)), np.zeros(3)

    def probability(t):
        logits = np.array([sum(w[k, i] * x for i, x in value[t].items()) + bias[k] for k in range(3)])
        return np.exp(logits) / np.exp(logits).sum()

    for _ in range(7):
        slope, down = 0.01 * w, np.zeros(3)
        for t, y in zip(texts, labels):
            p = probability(t)
            p[y] -= 1
            down += p / len(texts)
            for i, x in value[t].items():
                slope[:, i] += p * x / len(texts)
        move, shift = 0.8 * move - 0.5 * slope, 0.8 * shift - 0.5 * down
        w, bias = w + move, bias + shift
    assert np.allclose(m.weights, w, atol=1e-12) and np.allclose(m.bias, bias, atol=1e-12)
    out = linear.linear_score(df.select("t", F.lit("x").alias("Sentiment"), F.lit(1).alias("odd name")), m, "t").collect()
    for r in out:
        if not r.t:
            assert (r.sentiment, r.sentiment_score) == ("neutral", 0.0)
        elif r.t in seen:
            p = probability(r.t)
            assert r.sentiment == ("negative", "neutral", "positive")[int(p.argmax())] and math.isclose(r.sentiment_score, p.max(), abs_tol=1e-9)
    assert len(out) == len(rows)


def test_linear_model_of_nothing(spark):
    empty = spark.createDataFrame([], "t string, y int")
    m = linear.fit_linear_model(empty, "t", "y", buckets=16)
    assert not m.weights.any() and linear.linear_score(empty, m, "t").count() == 0
    r = linear.linear_score(spark.createDataFrame([("a b",)], "t string"), m, "t").first()
    assert (r.sentiment, r.sentiment_score) == ("negative", pytest.approx(1 / 3))  # a tie goes to the first label


def test_linear_scorer_learns_and_does_not_shuffle_what_it_scores(spark):
    out = catalog.queries()["linear_score"](spark, "/root/testdata/sf0.01")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(
        F.col("doc_id").alias("review_id"), F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("want"))
    got = out.where("sentiment_score > 0").join(labels, "review_id").agg(F.avg((F.col("want") == F.col("sentiment")).cast("double"))).first()[0]
    assert got > 0.9


# ---------------------------------------------------------------- ledger
def test_each_distinct_request_is_asked_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def client(requests):
        calls.add(len(requests))
        return [None if r == "silent" else r.upper() for r in requests]

    rows = [(i, x, "c") for i, x in enumerate(["a", "b", "a", None, "c", "b", "silent", ""])]
    df = spark.createDataFrame(rows, "i int, request string, Response string").repartition(4)
    path = str(tmp_path / "ledger")
    want = {i: None if x in (None, "silent") else x.upper() for i, x, _ in rows}
    got = {r.i: r.response for r in ledger.complete_requests(df, "request", client, path, tasks=3).collect()}
    assert got == want and calls.value == 5
    got = {r.i: r.response for r in ledger.complete_requests(df, "request", client, path, tasks=3).collect()}
    assert got == want and calls.value == 6  # only the one that had no answer
    more = df.union(spark.createDataFrame([(9, "new", "c"), (10, "a", "c")], df.schema))
    got = {r.i: r.response for r in ledger.complete_requests(more, "request", client, path).collect()}
    assert got == want | {9: "NEW", 10: "A"} and calls.value == 8
    assert ledger.complete_requests(df.limit(0), "request", client, str(tmp_path / "none")).count() == 0


def test_a_killed_task_repeats_only_its_own_part(spark, tmp_path):
    marks, path = tmp_path / "marks", str(tmp_path / "ledger")
    marks.mkdir()
    fuse = tmp_path / "fuse"
    fuse.write_text("")

    def client(requests):
        import time
        for r in requests:
            if r == "r7" and os.path.exists(fuse):
                time.sleep(3)  # the other tasks have ended
                os.remove(fuse)
                os._exit(1)
            with open(marks / r, "a") as f:
                f.write("x")
        return [r.upper() for r in requests]

    df = spark.createDataFrame([(f"r{i}",) for i in range(40)], "request string")
    with pytest.raises(Exception):
        ledger.complete_requests(df, "request", client, path, batch_size=1, tasks=8)
    kept = {r.response for r in ledger.answers(spark, path).collect()}
    out = {r.response for r in ledger.complete_requests(df, "request", client, path, batch_size=1, tasks=8).collect()}
    assert out == {f"R{i}" for i in range(40)} and kept
    times = {p.name: len(p.read_text()) for p in marks.iterdir()}
    assert all(times[r.lower()] == 1 for r in kept) and max(times.values()) <= 2


# ---------------------------------------------------------------- exact numbers, blank texts
def test_distinct_whole_numbers_are_not_merged(spark):
    df = spark.createDataFrame([(2 ** 53 + i, float(i % 3)) for i in range(20)] + [(None, float("nan"))], "big long, x double")
    got = {r.column_name: r.n_distinct for r in roles.detect_rating_table(df).collect()}
    assert got == {"big": 20, "x": 3}


def test_blank_is_what_strips_to_nothing(spark):
    texts = ["", " ", "\t\n", " \x1f", "a", " . ", "\xa0", "é", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.is_blank("t")).collect()]
    assert got == [None if t is None else not t.strip() for t in texts]
    assert profile.text_validity(df, "t").first().text_empty_count == sum(not (t if t is not None else "nan").strip() for t in texts)


def test_new_queries_run(spark):
    for key in ("complete_requests",):
        assert catalog.queries()[key](spark, SF001).count() > 0


# ---------------------------------------------------------------- token table, distinct rows
def test_token_table_gives_the_same_whatever_its_size(spark):
    texts = ["the cats ran", "  cats   and dogs ", "", " ", None, "no hits here", "dogs dogs"] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, _token string").repartition(3)
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("ran", "run"), ("dogs", "dog"), (None, "n"), ("here", None), ("unseen", "u")],
                                  "form string, replacement string")
    forms = {"cats": "cat", "dogs": "dog", "ran": "run"}
    want = {i: None if t is None else " ".join(forms.get(w, w) for w in t.split()) for i, t in enumerate(texts)}
    for kw in ({}, {"send_bytes": 0}, {"out": "o"}):
        out = X.lookup_tokens_table(df, "t", table, **kw)
        got = {r.i: r for r in out.collect()}
        name = kw.get("out", "t")
        assert {i: r[name] for i, r in got.items()} == want and got[0]["_token"] == "x"
        if "send_bytes" not in kw:
            assert "Exchange" not in out.drop("x")._jdf.queryExecution().optimizedPlan().toString()
    clash = table.union(spark.createDataFrame([("cats", "c")], table.schema))
    with pytest.raises(Exception, match="conflicting"):
        X.lookup_tokens_table(df, "t", clash).collect()
    assert X.lookup_tokens_table(df.limit(0), "t", table).count() == 0


def test_distinct_rows_of_files_and_of_other_inputs(spark, tmp_path):
    rows = [(i % 7, float("nan") if i % 2 else None, {"k": i % 3}, [0.0 if i % 4 else -0.0], "é" * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, m map<string,int>, l array<double>, t string").repartition(6)
    df.write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert profile._has_places(files) and profile._has_places(files.select("m", (F.col("a") + 1).alias("z")))
    for other in (df, files.union(files), files.where("a > 1"), files.withColumn("r", F.rand()), files.select(F.explode("l"))):
        assert not profile._has_places(other)
    key = lambda r: str((r.a, "nan" if r.b is not None and math.isnan(r.b) else r.b, sorted(r.m.items()), r.t))
    want = sorted({key(r) for r in df.collect()})
    for one in (files, df, files.union(files)):
        assert sorted(key(r) for r in profile.distinct_rows(one).collect()) == want
    gone = profile.repeated_places(files)
    assert gone.count() == 200 - len(want) and [t for _, t in gone.dtypes] == ["bigint", "bigint"]
    assert profile.distinct_rows(files.limit(0)).count() == 0


def test_distinct_rows_does_not_shuffle_rows(spark):
    plan = catalog.queries()["distinct_rows"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # the second scan meets a small staged table
