"""Collocations, density, phrase replacement, quantile reads, split CSV, JSON numbers: against plain versions."""

import csv
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import phrases
from reviewlens.operators import collocations, density, quantiles
from reviewlens.sources import csv_records, io

# ---------------------------------------------------------------- collocations
STOP = ["the", "of"]


def g_squared(k, a, b, n):
    if n <= a or n <= b:
        return 0.0
    like = lambda k, n, p: k * math.log(max(p, 1e-10)) + (n - k) * math.log(max(1 - p, 1e-10))
    p, p1, p2 = b / n, k / a, (b - k) / (n - a)
    return -2 * (like(k, a, p) + like(b - k, n - a, p) - like(k, a, p1) - like(b - k, n - a, p2))


def plain_cloud(texts, threshold):
    """-> ({(word, next): (count, left, right, total, score)}, Counter of entries)."""
    words, pairs = Counter(), Counter()
    for t in texts:
        toks = (t or "").split()
        words.update(w for w in toks if w not in STOP)
        pairs.update((a, b) for a, b in zip(toks, toks[1:]) if a not in STOP and b not in STOP)
    one = lambda w, there: w[:-1] if w.endswith("s") and not w.endswith("ss") and there(w[:-1]) else w
    form = {w: one(w, words.__contains__) for w in words}
    folded = Counter()
    for w, n in words.items():
        folded[form[w]] += n
    two = Counter()
    for (a, b), n in pairs.items():
        two[a, one(b, lambda x, a=a: (a, x) in pairs)] += n
    total, found, entries = sum(words.values()), {}, Counter(folded)
    for (a, b), n in two.items():
        score = g_squared(n, folded[form[a]], folded[form[b]], total)
        if score > threshold:
            found[a, b] = (n, folded[form[a]], folded[form[b]], total, score)
            entries[form[a]] -= n
            entries[form[b]] -= n
            entries[f"{a} {b}"] += n
    return found, {w: n for w, n in entries.items() if n > 0}


def cloud_texts(seed):
    r = random.Random(seed)
    words = ["cat", "cats", "dog", "glass", "glas", "new", "york", "yorks", "red", "the", "of", "tree", "trees"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(80)]
    return [t.replace("new tree", "new york") for t in out] + ["new york"] * 30 + [None, "", "the of", "solo"]


def test_collocations_equal_the_plain_ones(spark):
    groups = {"a": cloud_texts(1), "b": cloud_texts(2), None: ["new york city"] * 3}
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g string, t string").repartition(5)
    got = collocations.collocations(df, "t", threshold=3.0, stopwords=STOP, by="g", cleaned=True).collect()
    top = collocations.cloud_words(df, "t", 1000, threshold=3.0, stopwords=STOP, by="g", cleaned=True).collect()
    for g, texts in groups.items():
        found, entries = plain_cloud(texts, 3.0)
        mine = {(r.word, r.next): r for r in got if r.g == g}
        assert set(mine) == set(found)
        for k, want in found.items():
            r = mine[k]
            assert (r["count"], r.left_count, r.right_count, r.total) == want[:4] and math.isclose(r.score, want[4], rel_tol=1e-9)
        assert {r.word: r["count"] for r in top if r.g == g} == entries
    assert any(r.word == "new" and r.next == "york" for r in got)
    one = collocations.cloud_words(df.where("g = 'a'"), "t", 3, threshold=3.0, stopwords=STOP, cleaned=True).collect()
    entries = plain_cloud(groups["a"], 3.0)[1]
    assert [(r.word, r["count"]) for r in one] == sorted(entries.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert collocations.collocations(df.limit(0), "t").count() == 0


def test_no_vocabulary_is_broadcast_by_hand():
    import inspect
    assert "broadcast(" not in inspect.getsource(collocations)


# ---------------------------------------------------------------- density
def test_density_is_within_the_stated_error(spark):
    r = random.Random(4)
    rows = [("a", r.gauss(0, 1)) for _ in range(900)] + [("a", r.gauss(6, 0.1)) for _ in range(300)] + [("b", 0.5)] * 40 + \
           [("c", 1.0), ("c", 2.0), ("d", None), ("d", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "label string, s double")
    got = {}
    for x in density.score_density(df, "label", "s", bins=512).collect():
        got.setdefault(x.label, []).append((x.x, x.density))
    assert set(got) == {"a", "b", "c"}
    for label, points in got.items():
        v = [s for g, s in rows if g == label]
        mean = sum(v) / len(v)
        std = math.sqrt(sum((x - mean) ** 2 for x in v) / max(len(v) - 1, 1))
        span = max(v) - min(v)
        h = max(1.059 * std * len(v) ** -0.2, span / 100) if span else 1.0
        points.sort()
        assert points[0][0] == pytest.approx(min(v) - 2 * h) and points[-1][0] == pytest.approx(max(v) + 2 * h)
        assert max(b[0] - a[0] for a, b in zip(points, points[1:])) <= h / 3 + 1e-12
        for x, d in points:
            direct = sum(math.exp(-((x - s) / h) ** 2 / 2) for s in v) / (len(v) * h * math.sqrt(2 * math.pi))
            assert abs(d - direct) <= density.error_bound(512) / h + 1e-12
            if label != "a":
                assert math.isclose(d, direct, rel_tol=1e-9)
    assert density.score_density(df.limit(0), "label", "s").count() == 0


# ---------------------------------------------------------------- phrases
def plain_replace(text, table):
    keyed, out, i = {phrases._key(k): v for k, v in table.items()}, [], 0
    longest, word = 2 * max(map(len, keyed)), lambda c: c.isalnum() or c == "_"
    while i < len(text):
        for j in range(min(len(text), i + longest), i, -1):
            part = text[i:j]
            if (phrases._key(part) in keyed and part == part.strip() and not (word(part[0]) and i and word(text[i - 1]))
                    and not (word(part[-1]) and j < len(text) and word(text[j]))):
                value = keyed[phrases._key(part)]
                out.append(value[:1].upper() + value[1:] if part[0] != part[0].lower() else value)
                i = j
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_contractions_in_raw_text(spark):
    texts = [None, "", "I can't've DON'T won’t, it's o'clock 'tis y'all's scan't cant's I'd've Can't\ncan't  .", "He'll he'll've \x1d he's\x1d"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(phrases.replace_phrases("t", phrases.contractions())).collect()]
    assert got == [t and plain_replace(t, phrases.contractions()) for t in texts]
    assert got[2].startswith("I cannot have Do not will not, it is of the clock it is")


def test_ten_thousand_phrases_that_begin_with_one_another(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 4))) for _ in range(150)]
    table = {}
    while len(table) < 10_000:
        table.setdefault(" ".join(r.choice(words) for _ in range(r.randint(1, 5))), f"<{len(table)}>")
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "  ", ", ", "-", "'"]) for _ in range(60)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [x[0] for x in df.orderBy("i").select(phrases.replace_phrases("t", table)).collect()]
    assert got == [plain_replace(t, table) for t in texts]
    assert df.select(phrases.replace_phrases("t", {})).count() == 25
    with pytest.raises(ValueError, match="conflicting"):
        phrases.replace_phrases("t", {"A b": "x", "a  B": "y"})


# ---------------------------------------------------------------- quantiles
def test_quantiles_read_their_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 40_000, 1, 4).selectExpr("id % 2 AS g", "double(id * 7919 % 40009) AS v").mapInArrow(count, "g long, v double")
    got = quantiles.group_summary(df, ["g"], "v", [0.1, 0.25, 0.5, 0.9]).collect()
    assert len(got) == 2 and seen.value == 80_000


def test_many_groups_with_a_hot_one(spark):
    df = spark.range(0, 300_000).selectExpr("IF(id < 200000, -1, id) AS g", "double(id * 7919 % 300007) / 3 AS v")
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 4.0)], "g long, v double"))
    out = quantiles.group_summary(df, ["g"], "v", [0.25, 0.5]).where("g IS NULL OR g = -1 OR g % 20000 = 0").collect()
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5]).alias("q")).where(
        "g IS NULL OR g = -1 OR g % 20000 = 0").collect()}
    assert {r.g for r in out} == set(want) and all(math.isclose(a, b, rel_tol=1e-12) for r in out for a, b in zip(r.q, want[r.g]))


# ---------------------------------------------------------------- sources
@pytest.mark.parametrize("newline, size", [("\n", 64), ("\r\n", 100), ("\n", 7), ("\n", 1000), ("\r\n", 9)])
def test_csv_in_splits_equals_the_whole_read(spark, tmp_path, newline, size):
    r = random.Random(size)

    def cell():
        if r.random() < 0.3:
            return r.choice(["a\nb", 'x "q" y\n\n",",z', "\n", ",", "é\n" * 3, "l1\nl2,l3\n" * 5, 'say "hi"'])
        return r.choice(["plain", "12", "a b", "NA"])

    path = tmp_path / "t.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["id", "na\nme", "x", "y"])
        rows = [[str(i), cell(), cell(), cell()] for i in range(300)]
        w.writerows(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = csv_records.read_csv_records(spark, str(path))
        assert df.columns == ["id", "na\nme", "x", "y"]
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_folder_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,id,\n1,"x\ny",3\n\n2,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('id,id,\n7,5" disk,"open\nto the end', encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    df = csv_records.read_csv_records(spark, str(tmp_path))
    assert df.columns == ["id0", "id1", "_c2"]
    assert sorted(map(tuple, df.collect())) == [("1", "x\ny", "3"), ("2", None, None), ("7", '5" disk', "open\nto the end")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert csv_records.read_csv_records(spark, str(tmp_path / "empty")).count() == 0


def test_whole_numbers_stay_whole_when_layouts_are_put_together(spark, tmp_path):
    big = 2 ** 53 + 1
    (tmp_path / "a.json").write_text('{"x": %d, "y": 1}\n{"x": 2, "y": 2}\n' % big)
    (tmp_path / "b.json").write_text('[{"x": 0.5, "y": 1.5}]')
    df = io.scan_json(spark, str(tmp_path), layout="auto")
    assert dict(df.dtypes) == {"x": "string", "y": "double"}
    assert sorted(r.x for r in df.collect()) == sorted([str(big), "2", "0.5"])
