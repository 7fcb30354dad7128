"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import random
import zlib

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.llm import chat, classifier, components, embeddings, langid, mixing, packing, quality_rules, sharding, simhash
from reviewlens.llm import common as C
from reviewlens.llm import url_filters as U

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 60_000 + "ende"


def odd_documents():
    """Null ids, texts and sources, empty and very long texts, repeated rows."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["the", "of", "haed", "ston", "wher", "ting", "éau"]) + str(r.randrange(40)) for _ in range(n))
    rows = [(i, prose(30 + i), "en", "ab"[i % 2], 1) for i in range(12)]
    rows += [(None, prose(25), "en", "a", 1), (20, None, None, None, None), (21, "", "en", "a", 0), (22, " \n\t ", "en", None, 4),
             (23, LONG, "de", "b", len(LONG)), (3, rows[3][1], "en", "b", 1), (3, rows[3][1], "en", "b", 1), (24, rows[5][1], "en", "c", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- url filters
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block")]


def judged(spark, urls, **kw):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    hosts = spark.createDataFrame([("bad.org",), ("unseen.org",)], "host string")
    out = U.judge_urls(pages, rules, hosts, **kw).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


@pytest.mark.parametrize("kw", [{}, {"keys_per_shard": 2, "broadcast_bytes": 0}])
def test_url_verdicts(spark, kw):
    urls = [None, "", "no scheme", "http://x.net", "http://x.NET/", "https://a.example.net/en/xy?q#f", "http://example.net/en/",
            "http://bad.org/z", "http://sub.bad.org/z", "http://xnet/", "http://bad.org/z", "http://h?a://net/", "a://b.net/c://d"]
    got = judged(spark, urls, **kw)
    assert [got[i][2:] for i in range(len(urls))] == [
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), ("a.example.net/en/x", "block"),
        ("example.net/en/", "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("net/", "block")]
    assert got[4][:2] == ("x.net", "/") and got[5][:2] == ("a.example.net", "/en/xy") and got[11][:2] == ("h", "")


def test_url_empty_tables(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    no_rules = spark.createDataFrame([], "host string, path string, action string")
    no_hosts = spark.createDataFrame([], "host string")
    assert [r.verdict for r in U.judge_urls(pages, no_rules, no_hosts).collect()] == ["allow"]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 400), st.integers(0, 4000), st.integers(0, 2 ** 32))
def test_cascade_is_exact(n_listed, n_other, seed):
    rng = np.random.default_rng(seed)
    h1, h2 = rng.integers(0, 2 ** 63, (2, n_listed + n_other), dtype=np.uint64)
    listed = np.arange(len(h1)) < n_listed
    assert (U.is_listed(U.build_cascade(h1, h2, listed), h1, h2) == listed).all()


# ---------------------------------------------------------------- simhash
@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B\u00c9 c", "a b c d e f a b c", "\x1fa\x0bb\x85c\u2003d e", LONG])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.lists(st.integers(0, 63), max_size=2), st.sampled_from([1, 2, 3, 4, 8]), st.integers(3, 7))
def test_close_fingerprints_share_a_cell(fp, flips, width, blocks):
    def code(x):
        out = 0
        for at in range(0, 64, width):
            w = min(width, 64 - at)
            out |= (1 << ((x >> at) & ((1 << w) - 1)).bit_count()) - 1 << at
        return out
    other = fp
    for f in flips:
        other ^= 1 << f
    assert (code(fp) ^ code(other)).bit_count() <= (fp ^ other).bit_count()
    assert any(code(fp) & m == code(other) & m for m in (x % 2 ** 64 for x in simhash.cell_masks(2, blocks, width)))


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_near_links_of_crowded_cells(spark, chunk):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(4)] + [0, 2 ** 64 - 1]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64) if k % 3 else 0) for b in base for k in range(40)}
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.near_links(nodes, chunk=chunk).collect()
    got, want = brute.Union(), brute.Union()
    for x in links:
        got.join(x.a, x.b)
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) % 2 ** 64).bit_count() <= 2:
                want.join(a, b)
    assert [got.find(f) for f in signed] == [want.find(f) for f in signed]


def test_simhash_components(spark, docs, none):
    rows = [(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(
        docs.withColumn("component_id", F.lit("clash"))).collect()]
    assert len(rows) == docs.count()
    want = brute.simhash_components([(i, t) for i, t, *_ in odd_documents() if i is not None])
    for i, fp, comp in rows:
        if i is None:
            assert comp is None
        else:
            assert (fp % 2 ** 64, comp) == want[i]
    assert {r[2] for r in rows if r[1] == 0} == {20}
    assert simhash.simhash_components(none).count() == 0


def test_components_of_chains_stars_and_hubs(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 800)] + [(7, 7), (None, 3)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(90)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = brute.Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    assert got == {x: u.find(x) for x in list(u.up)}


# ---------------------------------------------------------------- quality rules
def test_rule_counts(spark, docs, none):
    extra = [(90, "a\na\n b \n\nb\na", None, "x", 0), (91, "x# $y\x85z | <<>> & * %", None, "x", 0),
             (92, "k " + "p q r s t u v w " * 3, None, "x", 0), (93, "p q r s t u v w x p q r s t u v w", None, None, 0)]
    both = docs.union(spark.createDataFrame(extra, DOCS))
    got = quality_rules.rule_counts(both.select("doc_id", "text", F.md5("text").alias("h"), F.lit(9).alias("n_words"))).collect()
    texts = {hashlib.md5(t.encode()).hexdigest() if t is not None else None: t for _, t, *_ in odd_documents() + extra}
    for r in got:
        assert tuple(r[c] for c in quality_rules.RULES) == brute.rule_counts(texts[r.h]), r
    assert quality_rules.quality_rules(none, with_text=True).count() == 0


def test_shared_lines_are_removed_and_depleted_documents_rejected(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler = "Subscribe to  OUR newsletter " + line(12)
    rows = []
    for i in range(60):  # 30 with the shared line and their own lines, 30 without
        own = [line(15), line(15)]
        rows.append((i, "\n".join(own + ([boiler.upper() if i % 4 else boiler] if i < 30 else [])), None, "h", 0))
    rows += [(100 + i, boiler + "\n" + line(6), None, "h", 0) for i in range(5)]  # little else
    rows += [(110 + i, boiler + "\n" + line(9), None, "h", 0) for i in range(5)]  # short, but over a third is its own
    copy = "\n".join(line(12) for _ in range(4))
    rows += [(200 + i, copy, None, "h", 0) for i in range(80)]  # exact copies of one document
    near = [line(20) for _ in range(4)]
    rows += [(300 + i, "\n".join(near[:3] + [near[3] + " " + word()]), None, "h", 0) for i in range(25)]
    rows += [(400, boiler + "\n" + line(3), None, None, 0), (401, None, None, None, 0)]  # other host: not over a limit there
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))
    got = {x.doc_id: x for x in quality_rules.quality_rules(docs, with_text=True, min_documents=20).collect()}
    want = brute.removed_words([(i, h, t) for i, t, _, h, _ in rows], 20)
    assert {i: x.removed_words for i, x in got.items()} == want
    assert not any(got[i].base_failed for i in [*range(100, 105), *range(110, 115)])
    assert all(got[i].kept for i in [*range(60), *range(110, 115), *range(200, 280)])
    assert not any(got[i].kept for i in range(300, 325))  # near copies are distinct texts, if not told otherwise
    assert got[1].text == "\n".join(rows[1][1].split("\n")[:2]) and got[40].text == rows[40][1] and got[200].text == copy
    assert not any(got[i].kept for i in [*range(100, 105), 400, 401])
    assert got[401].text is None and got[401].base_failed


def test_documents_that_share_several_lines_count_one_by_one(spark):
    r = random.Random(4)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu, passage = [line(8) for _ in range(5)], [line(9) for _ in range(6)]
    rows = [(i, "\n".join([*menu, line(14), line(14)]), None, "h", 0) for i in range(60)]
    rows += [(100 + i, "\n".join([*menu, line(3)]), None, "h", 0) for i in range(9)]  # little else
    # nothing but shared lines, each document another choice of them
    rows += [(200 + i, "\n".join(x for k, x in enumerate(passage) if i + 1 >> k & 1), None, "h", 0) for i in range(63)]
    rows += [(300 + i, line(30), None, "h", 0) for i in range(40)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute.removed_words([(i, h, t) for i, t, _, h, _ in rows], 20)
    assert {i: x.removed_words for i, x in got.items()} == want
    assert all(want[i] == 40 for i in range(60)) and all(want[200 + i] == got[200 + i].n_words for i in range(63))
    assert {i for i, x in got.items() if x.kept} == {*range(60), *range(300, 340)}


@pytest.mark.parametrize("others", [100, 2600])
def test_a_line_is_over_the_limit_on_hosts_of_any_size(spark, others):
    rows = [(i, f"own words {i} a b\nsubscribe to our letter", None, "h", 0) for i in range(25)]
    rows += [(100 + i, f"another text {i} of this host", None, "h", 0) for i in range(others)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.removed_words for r in quality_rules.quality_rules(docs).collect()}
    assert {i for i, n in got.items() if n} == set(range(25)) and {got[i] for i in range(25)} == {4}


@pytest.mark.parametrize("edit", ["any line", "same line", "line added"])
def test_counts_of_near_copies_equal_the_plain_ones(spark, edit):
    rows = []
    for seed in range(10):  # each on a host of its own
        r = random.Random(seed)
        line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))  # noqa: B023, E731
        text = [line(12) for _ in range(40)]
        for i in range(40):
            k = {"any line": i, "same line": 3, "line added": 40}[edit]
            new = line(8) if k == 40 else f"new{i}" + text[k][6:]
            rows.append((1000 * seed + i, "\n".join([*text[:k], new, *text[k + 1:]]), None, f"h{seed}", 0))
        rows += [(1000 * seed + 100 + i, line(30), None, f"h{seed}", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    plain = [(i, h, t) for i, t, _, h, _ in rows]
    got = {x.doc_id: x.removed_words for x in quality_rules.quality_rules(docs).collect()}
    assert got == brute.removed_words(plain, 20)
    # told that they are three documents: no line is in more than three
    group = {t: i % 3 if i % 1000 < 40 else i for i, _, t in plain}
    keys = docs.select(*[k.alias(n) for k, n in zip(quality_rules.text_key(F.col("text"), F.col("source")), ("_k1", "_k2"))],
                       F.when(F.col("doc_id") % 1000 < 40, F.col("doc_id") % 3).otherwise(F.col("doc_id")).alias("document"))
    got = {x.doc_id: x.removed_words for x in quality_rules.quality_rules(docs, copies=keys.filter("document < 3")).collect()}
    assert got == brute.removed_words(plain, 20, group) == {i: 0 for i, *_ in plain}
    got = {x.doc_id: x.removed_words for x in quality_rules.quality_rules(docs, copies=keys, min_documents=2).collect()}
    assert got == brute.removed_words(plain, 2, group)


# ---------------------------------------------------------------- mixing
def test_targets_stop_at_the_limit_and_share_the_rest(spark, docs, none):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), ("d", 880), (None, 0)], "source string, size long")
    t = {r._source: r for r in mixing.source_rates(sizes, "source", "size").collect()}
    # weights 1 2 3 1 2: b and c stop at 30, the rest goes to a and d by 1 : 1, of which a stops at 300
    assert [t[s].target for s in ("a", "b", "c", "d", None)] == [300, 30, 30, 640, 0]
    assert t[None].rate == 0
    got = mixing.mix_sources(docs.withColumn("rate", F.lit("clash")), C.n_words(F.col("text"))).collect()
    again = mixing.mix_sources(docs.orderBy(F.rand()), C.n_words(F.col("text"))).collect()
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.source), r.size, r.copies) for r in rows)
    assert key(got) == key(again) and len(got) == len(odd_documents())
    assert all(0 <= r.copies <= 3 for r in got)
    mixed = mixing.mix_sources(docs, C.n_words(F.col("text")))
    assert mixing.emit_copies(mixed).count() == sum(r.copies for r in got)
    assert mixing.mix_sources(none, C.n_words(F.col("text"))).count() == 0


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), None, f"s{i % 4}", 0) for i in range(8000)]
    m = mixing.mix_sources(spark.createDataFrame(rows, DOCS), C.n_words(F.col("text")))
    fraction = F.col("rate") - F.floor("rate")
    for r in m.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("k"), F.max("target").alias("t"),
                                     F.sum(F.col("size") ** 2 * fraction * (1 - fraction)).alias("var")).collect():
        assert abs(r.k - r.t) < 4 * r["var"] ** 0.5 and abs(r.k / r.t - 1) < 0.1


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_shards_are_balanced_and_slots_gapless(spark, docs, slack):
    rows = [(i, i % 3) for i in range(2000)] + [(7, 1)] * 900 + [(None, k % 400) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, shard int")
    df = df.withColumn("x", F.col("shard")).drop("shard")
    got = sharding.shard_rows(df.withColumn("slot", F.lit("clash")), "k", 8, slack=slack).collect()
    assert sorted((str(r.k), r.x) for r in got) == sorted((str(k), x) for k, x in rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 if slack == 0 else max(counts) <= -(-1.1 * len(rows) // 8)
    again = sharding.shard_rows(df.orderBy(F.rand()), "k", 8, slack=slack).collect()
    key = lambda rs: sorted((str(r.k), r.x, r.shard, r.slot) for r in rs)
    assert key(got) == key(again)
    assert sharding.shard_rows(docs.limit(0), "doc_id", 8).count() == 0
    assert sharding.shard_rows(docs, "doc_id", 8).count() == docs.count()


def plain_ring(counts, n_shards, cap, buckets, vnodes):
    """Bounded loads one unit at a time in the operator's order of rounds."""
    ring = sharding.ring_positions(n_shards, vnodes, buckets)
    order = {u: sorted(range(n_shards), key=lambda s: (min((p - u // 8) % buckets for p in ring[s]), s)) for u in counts}
    left, free, out = dict(counts), list(cap), {}
    for r in range(n_shards):
        room = list(free)
        for u in sorted(counts):
            s = order[u][r]
            got = min(left[u], room[s])
            room[s] -= got
            left[u] -= got
            out[s] = out.get(s, 0) + got
        free = room
    return out


def test_growth_moves_few_rows(spark):
    df = spark.range(6000).withColumnRenamed("id", "k")
    place = lambda n: {r.k: r.shard for r in sharding.shard_rows(df, "k", n, slack=0.1).collect()}
    a, b = place(8), place(9)
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.35 * len(a) and sum(b[k] == 8 for k in b) > 0.08 * len(b)


def test_ring_against_plain_version(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    got = {r.shard: r["count"] for r in sharding.shard_rows(df, "k", 5, slack=0.02).groupBy("shard").count().collect()}
    pos = df.select(F.pmod(F.xxhash64(F.lit("key"), "k"), F.lit(4096)).alias("b"), F.pmod(F.shiftright(
        C.null_first_row_hash(df, ["k"]), 17), F.lit(8)).alias("s")).groupBy("b", "s").count().collect()
    assert got == plain_ring({r.b * 8 + r.s: r["count"] for r in pos}, 5, sharding.capacities(3000, 5, 0.02), 4096, 64)


# ---------------------------------------------------------------- embeddings
def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = [centres[i % 12] + rng.normal(size=16) * (0.02 + 0.05 * (i % 4)) for i in range(240)] + list(rng.normal(size=(60, 16)))
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [float("nan")]), (904, [1.0] * 15 + [None]),
           (905, [float("inf")] * 16), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, [1e308] * 16), (909, [1e-300] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, kept string, label int")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    u = brute.Union()
    for a, b in zip(*np.nonzero(near)):
        u.join(int(a), int(b))
    for kw in ({}, {"chunk": 17}, {"chunk": 64, "max_pivots": 2}):
        got = {r.vec_id: r for r in embeddings.embedding_dedup(df, **kw).collect()}
        for i in range(300):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), u.find(i), u.find(i) == i)
        assert [got[i].n_links for i in range(900, 910)] == [0] * 6 + [1, 1, 1, 1]
        assert got[907].component_id == 906 and got[None].n_links == 0 and got[None].kept
    assert embeddings.embedding_dedup(df.limit(0)).count() == 0


def test_repeated_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_dedup(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 1)]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2 ** 32), st.floats(0.3, 0.99), st.integers(1, 12))
def test_partners_meet_in_a_cell(seed, cosine, n_pivots):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    home, visits = embeddings.cells_of(x, x[:n_pivots], float(np.sqrt(2 - 2 * cosine)))
    for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
        if home[a] > home[b]:
            assert visits[a, home[b]]


# ---------------------------------------------------------------- language
def test_language_of_held_out_documents_and_mixtures(spark):
    docs = C.table(spark, SF001, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    names, model = langid.fit(docs, remainder != 2)
    out = langid.predict(docs.withColumn("score", F.lit("clash")), names, model).filter(remainder == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    en, de = (next(r.text for r in out if r.lang == x and 400 < len(r.text) < 1500) for x in ("en", "de"))
    n = min(len(en), len(de))
    main, share = langid.identify(en[:n] + "\n" + de[: n // 3], model.astype(float), names)
    assert main == "en" and 0.6 < share < 0.9
    for text in (None, "", " \n", "1234 !?"):
        assert langid.identify(text, model.astype(float), names) == ("und", 0.0)
    assert langid.identify("日本語", model.astype(float), names)[0] in names
    names, model = langid.fit(docs.limit(0), remainder != 2)
    assert names == [] and {r.lang_pred for r in langid.predict(docs.limit(3), names, model).collect()} == {"und"}


def test_each_document_keeps_its_languages_and_their_shares(spark):
    docs = C.table(spark, SF001, "documents")
    names, model = langid.fit(docs, F.lit(True))
    pure = {r.lang: r.text for r in docs.filter("lang is not null and n_chars between 1000 and 4000").orderBy("doc_id").collect()}
    n = min(map(len, pure.values()))
    assert n >= 1000 and len(pure) > 2
    a, b, c = sorted(pure)[:3]
    texts = [pure[a][:n] + "\n" + pure[b][: n // 2], pure[a][: n // 3] + "\n" + pure[b][: n // 3] + "\n" + pure[c][:n], pure[b][:n], "12 !", None]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, text string, languages string")
    got = {r.i: r for r in langid.predict(rows, names, model).collect()}
    assert [x.lang for x in got[0].languages] == [a, b] and abs(got[0].languages[0].share - 2 / 3) < 0.1
    assert got[1].languages[0].lang == c and {x.lang for x in got[1].languages} == {a, b, c}
    assert [x.lang for x in got[2].languages] == [b] and got[3].languages == got[4].languages == []
    for i, r in got.items():
        assert (r.lang_pred, r.score) == langid.identify(texts[i], model.astype(float), names)
        assert not r.languages or abs(sum(x.share for x in r.languages) - 1) < 1e-6 and r.lang_pred == r.languages[0].lang


def test_mixture_finds_the_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(200) * 0.1, size=3).T + 1e-9
    count = rng.multinomial(5000, p @ [0.6, 0.3, 0.1])
    part, _ = langid.mixture(p, count.astype(float), rounds=200)
    assert np.abs(part - [0.6, 0.3, 0.1]).max() < 0.05


def test_the_chosen_set_is_the_best_of_all_sets():
    """A plain EM on every set of four languages, with the penalty for each further one, against the growing set."""
    from itertools import combinations

    rng = np.random.default_rng(5)
    letters, n = "abcdefghijklmnop", 0
    speak = [rng.dirichlet(np.ones(len(letters)) * 0.25) for _ in range(4)]
    prose = lambda k, words: " ".join("".join(rng.choice(list(letters), 4, p=speak[k])) for _ in range(words))
    counts = [langid.ngram_counts(prose(k, 4000)) + 0.1 for k in range(4)]
    model = np.stack([c / c.sum() for c in counts], axis=1)
    for mix in ((0,), (1,), (0, 1), (2, 3), (1, 2), (0, 2, 3)):
        text = " ".join(prose(k, 150) for k in mix)
        count = langid.ngram_counts(text)
        seen = np.flatnonzero(count)
        c, p = count[seen].astype(float), model[seen]
        best = {}
        for size in range(1, 5):
            for ks in combinations(range(4), size):
                part = np.full(size, 1 / size)
                for _ in range(500):
                    joint = p[:, ks] * part
                    part = (c / joint.sum(axis=1)) @ joint / c.sum()
                best[ks] = (c @ np.log(p[:, ks] @ part) - langid.PENALTY * np.log(c.sum() + 1) * (size - 1), part)
        want = max(best, key=lambda ks: best[ks][0])
        got, score = langid.proportions(text, model, list("wxyz"))
        assert sorted(x for x, _ in got) == ["wxyz"[k] for k in want] == ["wxyz"[k] for k in mix]
        shares = dict(zip(("wxyz"[k] for k in want), best[want][1]))
        assert all(abs(shares[x] - v) < 0.02 for x, v in got) and (len(mix) == 1 or score == got[0][1])
        n += 1
    assert n == 6


# ---------------------------------------------------------------- chat
PIECES = [*"a\\<>|/[]s\n", *chat.CONTROL, "INST", "start", "end", "é", "\u2028"]
ANY_TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ANY_TEXT, ANY_TEXT), max_size=5))
def test_template_is_reversible(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(p for p, _, _ in pieces)) == turns
    for (p, a, b), (_, t) in zip(pieces, turns):
        assert chat.unescape(p[a:b]) == t
        assert not any(c in p[a:b] for c in chat.CONTROL)


def chat_digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("segment", [chat.SEGMENT_CHARS, 40])
def test_conversations(spark, segment):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] \\ yes"), (1, 2, "user", None), (1, 3, "assistant", LONG),
            (2, 0, None, "no role"), (2, None, "assistant", "no turn"), (2, 1, "user", "twice"), (2, 1, "user", "twice"),
            (None, 0, "user", "no id"), (3, 0, "assistant", ""), (4, 0, "", "x"), (4, 0, "", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string")
    formatted = chat.format_conversations(chat.events_of(df), segment)
    if segment == 40:
        assert formatted.filter("conv_id = 1").count() > 1
    got = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
    want = {}
    key = lambda r: (r[0] or 0, -1 if r[1] is None else r[1], json.dumps({"role": r[2] or "", "text": hashlib.md5((r[3] or "").encode()).hexdigest()}))
    for c, _, role, text in sorted(rows, key=key):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert tuple(got[c])[1:5] == chat_digest(turns), c
    assert chat.digest_conversations(chat.format_conversations(chat.events_of(df.limit(0)))).count() == 0


def test_fold_of_events():
    e = [("open", "assistant", None), ("delta", None, "a"), ("regenerate", None, None), ("delta", None, "b"), ("delta", None, None),
         ("delta", None, "c"), ("seen", None, "x")]
    assert chat.fold(iter(e)) == ("assistant", "bc")
    assert chat.fold(iter([*e, ("edit", None, "new"), ("delta", None, "!")])) == ("assistant", "new!")
    assert chat.fold(iter([("delta", None, "t")])) == ("", "t")


# ---------------------------------------------------------------- packing
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins_hold_what_they_say(sizes):
    sizes = sorted(sizes, reverse=True)
    lengths = (8, 16, 32, 64)
    bins, offsets, caps = packing.pack(sizes, lengths, lambda n: 1 + n)
    held = [0] * len(caps)
    for s, b, o in zip(sizes, bins, offsets):
        assert held[b] == o
        held[b] += s
    assert all(min(c for c in lengths if c >= h) == cap for h, cap in zip(held, caps))
    assert len(caps) == 0 or sum(held) == sum(sizes)


def test_best_fit_takes_the_least_room_and_the_cheapest_bin():
    bins, offsets, caps = packing.pack([5, 4, 3, 1], (6, 8), lambda n: {6: 6, 8: 20}[n])
    assert (bins, offsets, caps) == ([0, 1, 2, 0], [0, 0, 0, 5], [6, 6, 6])
    _, _, caps = packing.pack([5, 1, 1, 1], (6, 8), lambda n: {6: 7, 8: 8}[n])
    assert caps == [8]  # one long bin costs less for each token than two short ones


def plain_pack(sizes, lengths, cost):
    """Best fit by looking at every open bin: -> bin of each size, contents and capacity of each bin."""
    room, since, held, out = [], [], [], []
    for t, size in enumerate(sizes):
        fits = [b for b, r in enumerate(room) if r >= size and r > 0]
        if fits:
            b = min(fits, key=lambda b: (room[b], -since[b]))  # of equally good ones the last to get its room
        else:
            spare = max(0, sum(sizes[t + 1:]) - sum(room))
            cap = min((c for c in sorted(lengths) if c >= size), key=lambda c: (cost(c) / min(c, size + spare), -c))
            b = len(room)
            room.append(cap)
            since.append(t)
            held.append(0)
        room[b] -= size
        since[b] = t
        held[b] += size
        out.append(b)
    return out, held, [min(c for c in lengths if c >= h) for h in held]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_plain_best_fit(seed):
    r = random.Random(seed)
    lengths = ((8, 16, 32, 64), (512, 1024, 2048), (50,))[seed % 3]
    sizes = sorted((r.randint(1, max(lengths)) if r.random() < 0.3 else r.randint(1, max(lengths) // 8) for _ in range(300)), reverse=True)
    bins, offsets, caps = packing.pack(sizes, lengths)
    want, held, shrunk = plain_pack(sizes, lengths, packing.sequence_cost)
    assert bins == want and caps == shrunk
    filled = {}
    for b, o, n in zip(bins, offsets, sizes):
        assert o == filled.get(b, 0)
        filled[b] = o + n
    assert [filled[b] for b in range(len(caps))] == held


def test_lots_are_packed_as_well_as_all_together():
    r = random.Random(1)
    sizes = [min(8192, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(60_000)]
    cost = lambda caps: sum(map(packing.sequence_cost, caps))
    whole = packing.pack(sorted(sizes, reverse=True))[2]
    lots = [c for i in range(0, len(sizes), packing.PIECES_PER_TASK)
            for c in packing.pack(sorted(sizes[i:i + packing.PIECES_PER_TASK], reverse=True))[2]]
    assert cost(lots) < 1.005 * cost(whole) and sum(lots) < 1.005 * sum(whole)


def test_pack_documents(spark, docs, none):
    sizes = docs.select("doc_id", C.n_words(F.col("text")).alias("n"), F.lit("clash").alias("bin"))
    got = packing.pack_documents(sizes, F.col("n"), lengths=(64, 128, 512), per_task=50).collect()
    total = {}
    for r in got:
        total.setdefault(r.doc_id, []).append((r.start, r.length))
    want = {}
    for i, t, *_ in odd_documents():
        want.setdefault(i, []).append(len(brute.WORD.findall(t or "")))
    assert {i: sum(n for _, n in v) for i, v in total.items()} == {i: sum(v) for i, v in want.items()}
    by = {}
    for r in got:
        if r.length:
            by.setdefault((r.bin, r.bin_length), []).append((r.offset, r.length))
    for (_, cap), parts in by.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert cap / 2 < at <= cap or cap == 64 or at > 128
    assert sum(1 for r in got if r.bin is None) == 3
    assert packing.pack_documents(none.select("doc_id"), F.lit(None)).count() == 0


# ---------------------------------------------------------------- classifier
def test_classifier_on_held_out_documents(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    d, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], labels.schema))
    model = classifier.fit(d, odd, in_training=F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) != 0)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = [r for r in classifier.classify(d.withColumn("score", F.lit("clash")), model).collect() if r.doc_id in truth]
    assert len(got) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
    out = classifier.classify(docs, model).collect()
    assert len(out) == len(odd_documents()) and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if not (r.text or "").strip()}
    assert len(empty) == 1
    assert classifier.classify(none, model).count() == 0
    unlearned = classifier.fit(none, labels.limit(0))
    assert {r.score for r in classifier.classify(docs, unlearned).collect()} == {0.5}


def plain_features(text):
    """Buckets of a text's features, one by one."""
    m64, words = (1 << 64) - 1, brute.WORD.findall(text or "")

    def mixed(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & m64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    def word_hash(w):
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode()))
        return mixed(h + len(w.encode()) * 0xD6E8FEB86659FD93 & m64)

    out = [word_hash(w) % classifier.BUCKETS for w in words] + [0 for a, b in zip(words, words[1:]) if a == b]
    data = bytes(0x20 if b in b" \t\n\x0b\f\r" else b for b in (text or "").encode())
    for size in classifier.N_GRAMS:
        for i in range(len(data) - size + 1):
            gram = data[i:i + size]
            if 0x20 not in gram[1:-1]:
                code = size
                for b in gram:
                    code = code * 0x01000193 & 0xFFFFFFFF ^ b
                code ^= code >> 15
                out.append((code * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - classifier.BUCKET_BITS)
    return out


def test_scores_equal_the_plain_ones():
    r = random.Random(3)
    texts = ["a a b", "", " \n", "x", "Ünïcode words words, 99!"] + [" ".join(r.choice(["ab", "cde", "fg!", "é"]) for _ in range(60)) for _ in range(5)]
    m = classifier.Model(np.random.default_rng(2).normal(size=classifier.BUCKETS).astype(np.float32), 0.3)
    for t, got in zip(texts, m.score(pa.array(texts))):
        f = plain_features(t)
        mean = sum(float(m.margin[b]) for b in f) / max(len(f), 1)
        assert got == pytest.approx(1 / (1 + np.exp(-(mean + 0.3))), abs=1e-9)


def test_training_equals_plain_gradient_descent():
    texts, labels = ["good fine words", "bad! bad! ###", "fine prose here", "", "spam spam 100%"], np.array([1, 0, 1, 0, 0])
    dim, epochs, rate, seed = 3, 4, 0.5, 5
    m = classifier.train(texts, labels, dim=dim, epochs=epochs, min_steps=1, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    vectors = (rng.uniform(-1, 1, (classifier.BUCKETS, dim)) / dim).astype(np.float32).astype(float)
    w, bias, steps, done = np.zeros((dim, 2)), np.zeros(2), epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            f = plain_features(texts[i])
            step = rate * (1 - done / steps)
            done += 1
            hidden = np.mean([vectors[b] for b in f], axis=0) if f else np.zeros(dim)
            p = np.exp(hidden @ w + bias)
            p /= p.sum()
            p[labels[i]] -= 1
            back = w @ p
            w = w - step * np.outer(hidden, p)
            bias = bias - 0.01 * step * p
            for b in f:
                vectors[b] = vectors[b] - step / len(f) * back
    assert np.allclose(m.margin, vectors @ (w[:, 1] - w[:, 0]), atol=1e-5) and m.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_the_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.range(100_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (1, 0)], "doc_id long, quality int")
    rows = classifier.training_rows(docs, labels, "doc_id", "text", "quality", F.lit(True), 2)
    got = sorted((r._id, r._label) for r in rows.collect())
    assert len(got) == 2 and set(got) <= {(0, 1), (1, 0), (2, 0)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan


def test_scores_do_not_depend_on_blocks():
    texts = [t for _, t, *_ in odd_documents()]
    m = classifier.Model(np.random.default_rng(1).normal(size=classifier.BUCKETS).astype(np.float32), 0.1)
    together = m.score(pa.array(texts))
    assert np.allclose(together, [m.score(pa.array([t], pa.string()))[0] for t in texts], atol=1e-9)


# ---------------------------------------------------------------- clashing names
def test_columns_named_like_internal_ones_pass_through(spark, docs):
    names = ("_k1", "_key1", "_key2", "_removed", "_copy", "_host", "_line", "_lines", "_x", "_h", "_p", "weight", "_source", "_src", "_key", "_fp",
             "low", "root", "node", "_unit", "_pos", "_rank", "_segments", "unit", "segments", "left", "order", "_total", "_cand", "h1", "h2", "page_id")
    wide = docs.withColumns({n: F.concat(F.lit(n), F.lit("!")) for n in names}).withColumn("url", F.lit("http://a.net/x"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    hosts = spark.createDataFrame([("a.org",)], "host string")
    n = docs.count()
    for out in (quality_rules.quality_rules(wide, with_text=True), mixing.mix_sources(wide, C.n_words(F.col("text"))),
                simhash.simhash_components(wide), sharding.shard_rows(wide.drop("text"), "doc_id", 4),
                U.judge_urls(wide, rules, hosts), U.judge_urls(wide, rules, hosts, broadcast_bytes=0),
                packing.pack_documents(wide.drop("text"), F.lit(3))):
        assert set(names) <= set(out.columns)
        rows = out.collect()
        assert len(rows) == n and all(r[x] == x + "!" for r in rows for x in names)


def test_columns_named_like_results_in_other_case_are_replaced(spark, docs):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    hosts = spark.createDataFrame([("a.org",)], "host string")
    model = classifier.Model(np.zeros(classifier.BUCKETS, np.float32), 0.0)
    table = np.full((langid.BUCKETS, 1), 1 / langid.BUCKETS, np.float32)
    n = docs.count()
    for clash, run in ((("FP", "Component_ID"), simhash.simhash_components), (("Score", "LANG_PRED"), lambda d: langid.predict(d, ["en"], table)),
                       (("SCORE", "Predicted"), lambda d: classifier.classify(d, model)), (("KEPT", "N_words"), quality_rules.quality_rules),
                       (("HOST", "Verdict"), lambda d: U.judge_urls(d.withColumn("url", F.lit("http://a.net/x")), rules, hosts)),
                       (("BIN", "Start"), lambda d: packing.pack_documents(d.drop("text"), F.lit(3))),
                       (("COPIES", "Rate"), lambda d: mixing.mix_sources(d, C.n_words(F.col("text")))),
                       (("SHARD", "Slot"), lambda d: sharding.shard_rows(d.drop("text"), "doc_id", 4))):
        out = run(docs.withColumns({c: F.lit("clash") for c in clash}))
        low = [c.lower() for c in out.columns]
        assert len(set(low)) == len(low) and {c.lower() for c in clash} <= set(low)
        rows = out.collect()
        assert len(rows) == n and not any(r[c.lower()] == "clash" for r in rows for c in clash)


# ---------------------------------------------------------------- very long texts
def test_long_texts_in_pieces_give_the_same(monkeypatch):
    from reviewlens.llm import textvec

    r = random.Random(9)
    words = ["alpha", "b", "Gamma!", "éàü", "x" * 300, "beta|", "the", "the"]
    text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", " \n\n"]) for _ in range(3000)) + "end\n" + "y" * 5000
    texts = [text, "short one", None, text[::-1], "z" * 4000, " " * 3000]
    m = classifier.Model(np.random.default_rng(1).normal(size=classifier.BUCKETS).astype(np.float32), 0.1)
    counts = lambda: {c: [int(v) for _, data, off in textvec.blocks(pa.array(texts)) for v in quality_rules.document_counts(data, off)[c]]
                      for c in quality_rules.RULES}
    whole = m.score(pa.array(texts)), counts(), [simhash.fingerprint(t) for t in texts], [langid.ngram_counts(t or "") for t in texts]
    monkeypatch.setattr(textvec, "BLOCK_BYTES", 256)
    monkeypatch.setattr(textvec.blocks, "__defaults__", (256,))
    monkeypatch.setattr(simhash, "_RUN_BYTES", 100)
    monkeypatch.setattr(langid, "_STEP", 64)
    assert np.allclose(m.score(pa.array(texts)), whole[0], atol=1e-9)
    assert counts() == whole[1]
    assert [tuple(whole[1][c][i] for c in quality_rules.RULES) for i in range(len(texts))] == [brute.rule_counts(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == whole[2] == [brute.fingerprint(t) for t in texts]
    for a, b in zip([langid.ngram_counts(t or "") for t in texts], whole[3]):
        assert (a is None and b is None) or (a == b).all()


def test_word_count_expression(spark):
    texts = [None, "", " ", "a", " a  b\tc\x0bd\x0ce\rf\ng ", "é\x85ü \u2003 x", LONG]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", C.n_words(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(brute.WORD.findall(t or "")) for t in texts]
