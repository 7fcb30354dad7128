"""Tests of the findings in FINDINGS_r03.md: the same results from less work, in bounded pieces."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from reviewlens.functions import text as X
from reviewlens.operators import scoring


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# ---------------------------------------------------------------- the scored reviews
PARTS = ["best", "xbest", "best.", "b3est", "idiot", "am", "pm", "10pm", "AM", "a.m.", "éam", "(am)", "http://x.y", "www.a", "a@b.c", "@", "-",
         "--", "  ", "\n", "\t", "\x85", " ", "9", "٣", "İ", "😀am", "$", "]", "\\", "word"]


def test_cleaning_in_one_pass_equals_the_plain_steps(spark):
    r = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "".join(r.choice(PARTS) + r.choice(["", " ", " " * (i % 9), "\n"]) for _ in range(r.randint(0, 12))))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, t string")
    clean = scoring.clean_pipeline(df, "t")
    assert "translate" not in plan(clean)  # digits and punctuation go in one pass
    assert clean.where(~F.col("clean_text_advanced").eqNullSafe(X.clean_advanced("clean_text"))).count() == 0
    raw = X.clean_advanced_df(df, "t", "a")
    assert raw.where(~F.col("a").eqNullSafe(X.clean_advanced("t"))).count() == 0


def test_hits_are_counted_without_making_tokens(spark):
    texts = ["best best", "xbest bests best", "", "a.b ab a.b", "b", None, "bab ab", "best"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (("best",), ("a.b", "b", "a"), ("ab", "bab"), ("best best", ""), ()):
        got = [r.n for r in df.select(X.count_in_clean("t", words).alias("n")).collect()]
        assert got == [None if t is None else sum(w in words for w in t.split(" ") if w) for t in texts]
    s = scoring.score_sentiment(scoring.clean_pipeline(df, "t"), "clean_text", scoring.LexiconScorer(("best",), ("idiot",)))
    assert "split(" not in plan(s)
    assert [r.sentiment for r in s.collect()][:4] == ["positive", "positive", "neutral", "neutral"]


def test_heavy_scans_get_a_task_for_each_piece_of_their_files(spark, tmp_path, monkeypatch):
    from reviewlens.sources import io

    path = str(tmp_path / "t.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    monkeypatch.setattr(io, "TASK_BYTES", 64)
    out = io.balanced(spark.read.parquet(path), "id", path=path)
    assert out.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    assert io.balanced(spark.range(0, 9, 1, 64), "id", 8).rdd.getNumPartitions() == 64


# ---------------------------------------------------------------- scorers, requests and lookup in pieces
def test_linear_scorer_works_on_pieces_and_sends_no_text(spark, monkeypatch):
    from reviewlens.operators import linear

    words = pa.array([[1] * 5, [2] * 3, [], [3] * 9, [4]], pa.list_(pa.int32()))
    assert list(linear.pieces(words, 8)) == [(0, 3), (3, 1), (4, 1)]
    assert list(linear.pieces(words.slice(1), 4)) == [(0, 2), (2, 1), (3, 1)]
    df = spark.createDataFrame([("a b c", 0), ("d e", 2), ("", 1), (None, 1)] * 3, "t string, y int").coalesce(1)
    m = linear.fit_linear_model(df, "t", "y", steps=3, buckets=32)
    out = linear.linear_score(df, m, "t")
    assert "MapInArrow" not in plan(out) and "ArrowEvalPython" in plan(out)
    monkeypatch.setattr(linear, "WORDS", 1)
    assert sorted(map(str, linear.linear_score(df, m, "t").collect())) == sorted(map(str, out.collect()))


def test_words_are_counted_where_rows_are_read(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b b  b x")], "i int, t string").coalesce(1)
    lists = F.coalesce(X.tokens("t"), F.array().cast("array<string>"))
    got = {r.i: dict(zip(r.w.word, r.w.n)) for r in df.select("i", scoring._word_counts(lists).alias("w")).collect()}
    assert got == {1: {"a": 2, "b": 1}, 2: {}, 3: {}, 4: {"b": 3, "x": 1}}
    m = scoring.fit_word_model(spark.createDataFrame([("a", 0), ("b", 2)], "t string, y int"), "t", "y")
    assert plan(scoring.trained_score(df, m, "t").select("i", "sentiment")).count("ArrowEvalPython") == 1


def test_requests_become_objects_a_batch_at_a_time(spark):
    from reviewlens.operators import prompts

    sizes = spark.sparkContext.accumulator(0)

    def client(requests):
        sizes.add(int(len(requests) > 3))
        return [None if r is None else r * 2 for r in requests]

    df = spark.createDataFrame([(i, None if i == 4 else f"r{i}", [i], {"k": i}) for i in range(10)],
                               "i int, request string, l array<int>, m map<string,int>").coalesce(1)
    out = prompts.map_completions(df, "request", client, batch_size=3)
    assert "MapInPandas" not in plan(out) and out.schema[:-1] == df.schema
    assert {r.i: (r.response, r.l, r.m) for r in out.collect()} == {i: (None if i == 4 else f"r{i}r{i}", [i], {"k": i}) for i in range(10)}
    assert sizes.value == 0


def test_lookup_works_on_pieces():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a"] * 3, [], ["b"] * 2], pa.list_(pa.string()))], ["i", "t"])
    assert [p.column(0).to_pylist() for p in X._token_pieces([b, b.slice(1)], 1, 3)] == [[1, 2], [3], [2, 3]]


# ---------------------------------------------------------------- collocations, files
def test_plurals_are_folded_by_one_aggregation(spark):
    from reviewlens.operators import collocations

    rows = [("g", "cat", 3), ("g", "cats", 2), ("g", "gas", 1), ("g", "class", 4), ("g", "s", 1), (None, "dogs", 5), (None, "dog", 1)]
    df = spark.createDataFrame(rows, "group string, word string, n long")
    out = collocations._folded(df, ["group"], "word", True)
    assert "Join" not in plan(out)
    assert {(r.group, r.form, r.n) for r in out.withColumn("form", collocations._form()).collect()} == {("g", "cat", 5), ("g", "gas", 1), ("g", "class", 4), ("g", "s", 1), (None, "dog", 6)}
    assert out.count() == 5 and collocations._folded(df, ["group"], "word", False).count() == 7


def test_files_are_put_together_once(spark, tmp_path):
    from reviewlens.sources import io

    (tmp_path / "a.json").write_text('{\n "x": {"0": 1, "1": 2},\n "t": {"0": "p", "1": "+q"}\n}')
    columns = io.read_table(spark, str(tmp_path / "a.json"))
    assert "Aggregate" not in plan(columns)
    assert sorted((r.x, r.t) for r in columns.collect()) == [(1, "p"), (2, "+q")]
    (tmp_path / "b.csv").write_text('x,"t"\r\n1,"p\n""q"\r\n 2 ,i\n')
    cells = io.scan_csv(spark, str(tmp_path / "b.csv"), multi_line=True)
    assert "MapInArrow" not in plan(cells)
    assert sorted((r.x, r.t) for r in cells.collect()) == [(1, 'p\n"q'), (2, "i")]
    (tmp_path / "c.csv").write_text('"x\ny",t\n1,2\n')  # a header of two lines
    assert io.scan_csv(spark, str(tmp_path / "c.csv"), multi_line=True).columns == ["x\ny", "t"]
