"""Merkle manifest, embedding whitening and suffix deduplication against plain versions, and on odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import merkle, suffixes, whitening
from reviewlens.llm import queries as Q

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifest
def tree(leaves):
    """All levels of a plain 16-ary tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, leaf, claimed) -> sorted result rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {s: tree([r[2] for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, (doc, _, leaf, claimed) in enumerate(groups[s]):
            way = siblings(trees[s], i) + siblings(top, n)
            folded = claimed or leaf
            for a, b in way:
                folded = sha("".join(a) + folded + "".join(b))
            root = top[-1][0]
            out.append((doc, s, leaf, trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in way)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claimed string, g string, total int, DOC long")
    return docs, merkle.build_manifest(docs, F.col("leaf"), claimed=F.col("claimed"))


def test_layout_is_a_permutation_with_contiguous_aligned_subtrees():
    for height in range(1, 5):
        at = np.concatenate([merkle.addresses(height, k) for k in range(height)])
        assert sorted(at) == list(range(merkle._size(height)))
    four = [merkle.addresses(4, k) for k in range(4)]
    assert list(four[3]) == [0] and list(four[2]) == list(range(1, 17))  # top half: two levels
    for b in (0, 1, 255):  # bottom subtrees of two levels, one after another
        assert four[1][b] == 17 + 17 * b
        assert list(four[0][16 * b:16 * b + 16]) == list(range(18 + 17 * b, 34 + 17 * b))


def test_manifest_matches_plain_trees(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "é", None, "Z"]), sha(str(i)), None, "x", 1, 2) for i in range(400)]
    rows += [(1000, "alone", sha("one"), sha("other"), "x", 1, 2), (1001, "", sha("empty"), sha("empty"), "x", 1, 2)]
    rows += [(None, "a", sha("n1"), None, "x", 1, 2), (None, "a", sha("n0"), sha("t"), "x", 1, 2), (5, "a", sha("5b"), None, "x", 1, 2)]
    rows += [(7, "b", sha("copy"), None, "x", 1, 2)] * 3
    rows += [(2000 + i, f"s{i:03}", sha(f"s{i}"), None, "x", 1, 2) for i in range(40)]
    _, m = manifest_rows(spark, rows)
    got = merkle.audit(m).select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest([x[:4] for x in rows])


def test_manifest_of_several_tiers(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", sha(str(i)), None, "x", 1, 2) for i in range(9000)]
    _, m = manifest_rows(spark, rows)
    assert len(m.tiers) == 2
    got = merkle.audit(m).select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest([x[:4] for x in rows])


def test_manifest_of_nothing_and_of_one_row(spark):
    _, m = manifest_rows(spark, [])
    assert m.root is None and merkle.audit(m).count() == 0
    _, m = manifest_rows(spark, [(1, None, sha("x"), None, "x", 1, 2)])
    row = merkle.audit(m).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("x") and row.proof_sha256 == sha("") and row.verified


def test_leaf_digest_tells_null_from_empty_and_counts_bytes(spark):
    df = spark.createDataFrame([(1, None, "é"), (2, "", "-")], "a long, b string, c string")
    got = [r[0] for r in df.orderBy("a").select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [sha("1:1-2:é"), sha("1:20:1:-")]


def test_manifest_query_equals_sql(spark, duck):
    a = duck.sql(Q.oracle_sql()["op11_merkle_manifest"]).df()
    b = Q.op11_merkle_manifest(spark, SF001).toPandas()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
    assert 0 < (~b.verified).sum() < len(b)


# ---------------------------------------------------------------- embedding whitening
def plain_whitening(vectors, k):
    """vectors: usable ones, equal lengths -> x, distinct count, sums, whitened columns, explained."""
    x = np.floor(256 * np.array(vectors, dtype=np.float64))
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return x, len(fit), fit.sum(axis=0), (x - mean) @ u / np.sqrt(e), e / np.trace(cov)


def check_whitening(out, ids, vectors, k=4):
    x, n, sums, white, explained = plain_whitening(vectors, k)
    assert {(r.vec_id, r.component) for r in out} == {(i, c + 1) for i in ids for c in range(k)}
    at = {i: j for j, i in enumerate(ids)}
    for c in range(k):
        rows = [r for r in out if r.component == c + 1]
        got, want = np.array([r.whitened for r in rows]), np.array([white[at[r.vec_id], c] for r in rows])
        sign = 1 if np.dot(got, want) >= 0 else -1
        assert np.abs(got - sign * want).max() < 1e-8
        for r in rows:
            row = x[at[r.vec_id]].astype(int).tolist()
            assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(row, sums))
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("dim, rank", [(64, 64), (40, 6), (5, 5)])
def test_whitening_matches_dense_eigenvectors(spark, dim, rank):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(300, rank)) * np.linspace(2, 0.5, rank) @ np.linalg.qr(rng.normal(size=(dim, rank)))[0].T
    v = np.vstack([v, v[:40], v[:1].repeat(60, axis=0)]).astype(np.float32)  # copies count once
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)]
    odd = [(900, None, ""), (901, [1.0, None] + [0.0] * (dim - 2), ""), (902, [float("nan")] * dim, ""), (903, [float("inf")] * dim, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, Component string").repartition(5)
    check_whitening(whitening.whiten(df).collect(), [r[0] for r in rows], v)


def test_whitening_of_little(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == [] and make([(1, [])]).collect() == []
    assert make([(1, [0.5, 1.0]), (2, [0.5, 1.0])]).collect() == []  # one distinct vector spans nothing
    two = make([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])]).collect()  # one direction; a short vector ends in zeros
    assert [(r.vec_id, r.component, r.n) for r in sorted(two)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1, 1]) and {r.explained for r in two} == {1.0}


def test_deviation_beyond_long_is_null(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0e7]), (3, [1.5e7])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, k=1).collect()}
    assert got == {1: None, 2: None, 3: 0}


# ---------------------------------------------------------------- suffix deduplication
def plain_removal(rows, length):
    """rows: (doc_id, text) -> sorted (doc_id, bytes, removed, spans, digest of the rest)."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in rows:
        b, seen = (t or "").encode(), set()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if first[w] < order(i) or w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removal(spark, rows, length, partitions=3):
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, SPANS string").repartition(partitions)
    out = suffixes.remove_repeats(df, length=length).collect()
    for r in out:  # spans are apart, in order, and complete
        ends = [(s.start, s.start + s.length) for s in r.spans]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    gone = [sum(s.length for s in r.spans) for r in out]
    return sorted([(r.doc_id, len(r.kept) + g, g, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r, g in zip(out, gone)], key=str)


def passages(seed, n=30):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(40)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared, rows = [text(30) for _ in range(5)], []
    for i in range(n):
        t = text(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            q, a = r.choice(shared), r.randint(0, 40)
            t += q[a:a + r.randint(20, 200)] + text(r.randint(0, 5))
        rows.append((i, t))
    rows += [(40, rows[3][1]), (41, rows[3][1] + "x"), (42, "a" * 500), (43, "ab" * 300), (44, None), (45, ""), (3, rows[5][1]),
             (3, rows[3][1]), (None, rows[7][1]), (None, rows[8][1] + shared[0]), (46, "a" * 300 + shared[1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, length", [(0, 100), (1, 100), (2, 20), (3, 7), (4, 3), (5, 1)])
def test_suffixes_match_plain_removal(spark, seed, length):
    rows = passages(seed)
    assert removal(spark, rows, length) == plain_removal(rows, length)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rows = passages(7)
    whole = removal(spark, rows, 50)
    cut = suffixes.pieces

    def small(column, more):  # pieces of 300 bytes, as for texts beyond the limit
        for first, data, offsets, _, _ in cut(column, more):
            for i in range(len(offsets) - 1):
                text = data[offsets[i]:offsets[i + 1]]
                for start in range(0, max(len(text), 1), 300):
                    part = text[start:start + 300 + more]
                    yield first + i, part, np.array([0, len(part)]), start, 300 if start + 300 < len(text) else len(part)

    batches = lambda fn, *cols: list(fn(iter([__import__("pyarrow").RecordBatch.from_arrays(list(cols), ["doc", "row", "text"])])))
    import pyarrow as pa
    text = [t for _, t in rows if t]
    ids = pa.array(range(len(text)), pa.int64())
    plain = batches(suffixes._anchor_units(50, 16), ids, ids, pa.array(text))
    monkeypatch.setattr(suffixes, "pieces", small)
    pieces = batches(suffixes._anchor_units(50, 16), ids, ids, pa.array(text))

    def windows(got):  # (doc, window start, anchor)
        out = set()
        for b in got:
            for doc, at in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                start, n, off = at >> 28, (at >> 14 & 16383) + 1, at & 16383
                out |= {(doc, start + i, start + off) for i in range(n)}
        return out

    assert windows(plain) == windows(pieces) and whole == plain_removal(rows, 50)


def test_one_large_group_over_many_buckets(spark):
    copy = passages(9)[0][1] or "x" * 300
    copy = (copy + "y" * 40) * 2
    rows = [(i, copy if i % 3 else copy[:150] + str(i)) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert removal(spark, rows, 100, 7) == plain_removal(rows, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_suffixes_of_nothing(spark):
    assert removal(spark, [], 100) == []
    assert removal(spark, [(1, None), (2, ""), (2, "short")], 100) == plain_removal([(1, None), (2, ""), (2, "short")], 100)


def test_multikey_order_sorts():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(-3, 3, 5000), rng.integers(-2 ** 62, 2 ** 62, 5000), rng.integers(0, 2, 5000)]
    tokens[1][:2500] = 7
    order = suffixes.multikey_order(tokens, small=16)
    rows = list(zip(*[t[order].tolist() for t in tokens]))
    assert sorted(order) == list(range(5000)) and rows == sorted(rows)


def test_suffix_query_on_documents(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF001}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = Q.op13_suffix_dedup(spark, SF001).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == plain_removal(rows, 100)
