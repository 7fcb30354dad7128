"""The pipeline's stages against plain versions, and on odd and empty tables."""

import os
import random
import sys

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from test_llm_operators import DOCS, SF001, odd_documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402

from reviewlens.llm import quality_rules, queries  # noqa: E402


def test_stages_are_the_dealt_operators_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "source mixing", "best-fit packing"]
    assert len(queries.queries()) == 13 and set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline_against_plain_versions(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert tuple(docs.columns) == P.COLUMNS
        seen.append({r.doc_id: r for r in docs.collect()} if i < 3 else docs.collect())
    classified, ruled, single, mixed, packed = seen
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    assert all(i in classified for i, q in quality.items() if q == 1) and not any(i in classified for i, q in quality.items() if q == 0)
    # rules: what fails goes, clean documents stay
    for i, r in classified.items():
        words, *_, repeated = brute.rule_counts(r.text)
        assert (i in ruled) == (words >= 20 and 100 * repeated <= 30 * words)
    assert all(r.n_chars == len(r.text) for r in ruled.values())
    # one document of each group stays
    groups = brute.simhash_components([(i, r.text) for i, r in ruled.items()])
    assert set(single) == {comp for _, comp in groups.values()}
    # mixing: nothing more than three times, every text as it was
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == single[r.doc_id].text
    assert max(copies.values()) <= 3
    # packing: all words of all copies, no bin over its length
    assert sum(r.length for r in packed) == sum(len(brute.WORD.findall(r.text)) for r in mixed)
    held = {}
    for r in packed:
        held[r.bin, r.bin_length] = held.get((r.bin, r.bin_length), 0) + r.length
    assert all(n <= cap for (_, cap), n in held.items()) and len({b for b, _ in held}) == len(held)
    assert P.run(spark, SF001).count() == len(packed)


def test_stages_on_odd_documents(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    every = {n: stage(spark, docs.withColumn("predicted", F.lit("clash")), SF001) for n, stage in P.STAGES}
    for n, out in every.items():
        rows = out.collect()
        assert len(rows) <= 3 * docs.count(), n
    kept = sorted(str(r.doc_id) for r in every["simhash near-dedup"].collect())
    groups = brute.simhash_components([(i, t) for i, t, *_ in odd_documents() if i is not None])
    # the two repeated rows are one document; the one without id stays
    assert kept == sorted([str(c) for c in {c for _, c in groups.values()}] + ["None"])


def test_rules_leave_no_document_under_the_minimum(spark):
    words = lambda n, tag: " ".join(f"{tag}w{k}" for k in range(n))
    shared = words(41, "s")
    rows = [(i, shared + "\n" + words(19 + i % 2, f"d{i}"), "en", "h", 0) for i in range(30)]
    out = P.rules(spark, spark.createDataFrame(rows, DOCS), SF001).collect()
    assert {r.doc_id: r.text for r in out} == {i: t.split("\n")[1] for i, t, *_ in rows if i % 2}


@pytest.mark.parametrize("seed", range(2))
def test_of_a_cluster_of_near_copies_one_document_is_left(spark, seed):
    r = random.Random(seed)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    text = [line(12) for _ in range(40)]
    rows = [(i, "\n".join([*text[:i], text[i] + " more", *text[i + 1:]]), "en", "h", 0) for i in range(40)]
    rows += [(100 + i, line(60), "en", "h", 0) for i in range(5)]
    out = P.dedup(spark, P.rules(spark, spark.createDataFrame(rows, DOCS), SF001), SF001).collect()
    groups = brute.simhash_components([(i, t) for i, t, *_ in rows])
    assert sorted(x.doc_id for x in out) == sorted({c for _, c in groups.values()})
    assert all(x.text == dict((i, t) for i, t, *_ in rows)[x.doc_id] for x in out)


def test_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(1, text("a"), "en", "s", 0), (1, text("b"), "en", "t", 0), (1, text("b"), "en", "t", 0),  # an id with two texts
            (2, text("c"), "en", "s", 0), (5, text("d"), "en", "s", 0), (5, text("c"), "en", "t", 0), (4, text("d"), "en", "t", 0),
            *[(None, text("e"), "en", "s", i) for i in range(6)], (None, text("f"), "en", "s", 0), (9, text("f"), "en", "s", 0)]
    out = P.dedup(spark, spark.createDataFrame(rows, DOCS).repartition(5), SF001).collect()
    got = sorted((r.text[0], r.doc_id, r.source) for r in out)
    assert got == [("a", 1, "s"), ("b", 1, "t"), ("c", 2, "s"), ("d", 4, "t"), ("e", None, "s"), ("f", 9, "s")]


@pytest.mark.parametrize("i", range(5))
def test_stages_on_empty_tables(spark, i):
    assert P.STAGES[i][1](spark, spark.createDataFrame([], DOCS), SF001).count() == 0
