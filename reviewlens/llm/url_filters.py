"""URL filters: rules and host lists in a Bloom filter cascade that is exact over the corpus's keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import fresh, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of one shard of the cascade; filters of at most so many bytes in all are broadcast.
KEYS_PER_SHARD, BROADCAST_BYTES = 1 << 20, 64 << 20
#: Levels after which two keys must have equal 128-bit hashes.
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def key_hash(*parts: Column) -> Column:
    """A key as two 64-bit hashes."""
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("2"), *parts).alias("h2"))


def _spread(h: np.ndarray, level: int) -> np.ndarray:
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class BloomFilter:
    """Bits and number of hashes; ``level`` makes the hashes of levels independent."""

    def __init__(self, level: int, hashes: int, bits: np.ndarray):
        self.level, self.hashes, self.bits = level, hashes, bits

    def _positions(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        a, b = _spread(h1, self.level), _spread(h2, self.level) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(len(self.bits) * 8)

    @classmethod
    def of(cls, level: int, h1: np.ndarray, h2: np.ndarray, rate: float) -> BloomFilter:
        """A filter of these keys that lets about ``rate`` of other keys pass."""
        per_key = max(1.0, -np.log2(rate))
        out = cls(level, round(per_key), np.zeros(int(np.ceil(len(h1) * per_key / np.log(2) / 8)) + 8, np.uint8))
        for p in out._positions(h1, h2):
            np.bitwise_or.at(out.bits, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        return out

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h1), dtype=bool)
        for p in self._positions(h1, h2):
            hit &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return hit


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[BloomFilter]:
    """Level 0 holds the listed keys, level 1 the other keys that pass it, level 2 the listed ones that pass level 1, and so on.

    ``h1, h2, listed`` are all keys that will ever be asked for; levels end when none passes wrongly.
    """
    levels: list[BloomFilter] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    rate = min(0.5, max(1e-6, len(inside) * 0.5 ** 0.5 / max(1, len(outside))))
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed key and another key of the corpus have the same hashes")
        levels.append(BloomFilter.of(len(levels), h1[inside], h2[inside], rate))
        outside = outside[levels[-1].holds(h1[outside], h2[outside])]
        inside, outside, rate = outside, inside, 0.5
    return levels


def is_listed(levels: list[BloomFilter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it is if the first level that rejects it has an odd number, or the last level's is even."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    at = np.arange(len(h1))
    for f in levels:
        hit = f.holds(h1[at], h2[at])
        out[at[~hit]] = f.level % 2 == 1
        at = at[hit]
    return out


def cascades(universe: DataFrame, listed: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """Filters ``(shard, level, hashes, bits)`` and the number of shards; keys are rows ``h1, h2``.

    Distinct keys are dealt to shards by their hash, about ``keys_per_shard`` each, and a
    task builds all levels of a shard from its listed and its other keys.
    """
    keys = universe.select("h1", "h2", F.lit(False).alias("listed")).union(listed.select("h1", "h2", F.lit(True)))
    keys = staged(keys.groupBy("h1", "h2").agg(F.max("listed").alias("listed")), "url-keys")
    shards = max(1, -(-keys.count() // keys_per_shard))

    def build(t: pa.Table) -> pa.Table:
        h1, h2 = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = build_cascade(h1, h2, t.column("listed").to_numpy())
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()] * len(levels), pa.int64()),
                         "level": pa.array([f.level for f in levels], pa.int32()),
                         "hashes": pa.array([f.hashes for f in levels], pa.int32()),
                         "bits": pa.array([f.bits.tobytes() for f in levels], pa.binary())})

    filters = keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(
        build, "shard long, level int, hashes int, bits binary")
    return staged(filters, "url-cascade"), shards


def _load(rows) -> dict[int, list[BloomFilter]]:
    out: dict[int, list[BloomFilter]] = {}
    for shard, level, hashes, bits in sorted(rows):
        out.setdefault(shard, []).append(BloomFilter(level, hashes, np.frombuffer(bits, np.uint8)))
    return out


def _ask(filters: dict[int, list[BloomFilter]], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), dtype=bool)
    shard = np.mod(h1, shards)  # as pmod
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        out[at] = is_listed(filters.get(int(s), []), h1[at].view(np.uint64), h2[at].view(np.uint64))
    return out


def listed_flags(rows: DataFrame, keys: str, filters: DataFrame, shards: int, flags: str) -> DataFrame:
    """``rows`` with ``flags``: whether each key of the array ``keys`` is listed. The filters are broadcast."""
    loaded = [(r["shard"], r["level"], r["hashes"], bytes(r["bits"])) for r in filters.collect()]  # size checked by the caller
    shared, at = rows.sparkSession.sparkContext.broadcast(loaded), rows.columns.index(keys)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _load(shared.value)
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten()
            hit = _ask(tables, shards, flat.field("h1").to_numpy(), flat.field("h2").to_numpy())
            off = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(b.columns) if i != at] + [pa.ListArray.from_arrays(pa.array(off), pa.array(hit))],
                [*(n for i, n in enumerate(b.schema.names) if i != at), flags])

    rest = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != keys])
    return rows.mapInArrow(in_task, T.StructType([*rest.schema, T.StructField(flags, T.ArrayType(T.BooleanType()))]))


def listed_keys(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct keys ``h1, h2`` that are listed, each shard's asked where its filters are (for filters too large to broadcast)."""
    def ask(k: pa.Table, f: pa.Table) -> pa.Table:
        if not k.num_rows or not f.num_rows:
            return k.slice(0, 0).select(["h1", "h2"])
        tables = _load(zip(*(f.column(c).to_pylist() for c in ("shard", "level", "hashes", "bits"))))
        hit = _ask(tables, shards, k.column("h1").to_numpy(), k.column("h2").to_numpy())
        return k.filter(pa.array(hit)).select(["h1", "h2"])

    sharded = keys.select("h1", "h2").distinct().withColumn("shard", F.pmod("h1", F.lit(shards)))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, "h1 long, h2 long")


def judge_urls(pages: DataFrame, rules: DataFrame, hosts: DataFrame, url: str = "url", default: str = "allow",
               keys_per_shard: int = KEYS_PER_SHARD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    ``rules`` (host, path, action): a rule fits its host and all subdomains if the path starts
    with the rule's; the longest rule (host and path together, then the longer host, then
    ``block``) decides. Without one, a host of ``hosts`` (column host) is blocked; any other
    gets ``default``.

    Rules and hosts are the listed keys. The universe is every key that a page can ask for:
    its host, and its host's suffixes with its path's prefixes in the numbers of labels and
    characters that rules have. The cascade over both answers exactly, so pages meet no join:
    the filters are broadcast if their size, which is measured, is at most
    ``broadcast_bytes``. Larger ones stay in shards: distinct keys are asked there, and the
    verdicts come back by (host, path).

    Null URLs and URLs without ``://`` have an empty host and path, which only ``default``
    fits. Repeated rows stay. Columns of ``pages`` named like a result column, in any case, are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    keep = [c for c in pages.columns if c.lower() not in new]
    cand, keys, flags, best, h, p = fresh(pages, "_cand", "_keys", "_flags", "_best", "_h", "_p")
    # labels and characters of the rules: as many numbers as there are lengths, not rules
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars")).distinct().collect()
    label = F.split("host", r"\.")
    options = []
    for s in shapes:
        suffix = F.array_join(F.slice(label, -s["labels"], s["labels"]), ".")
        prefix = F.substring("path", 1, s["chars"])
        fits = (F.size(label) >= s["labels"]) & (F.char_length("path") >= s["chars"]) & (F.col("host") != "")
        for order, action in enumerate(("block", "allow")):
            options.append(F.when(fits, F.struct(
                (-(F.char_length(suffix) + s["chars"])).alias("size"), (-F.char_length(suffix)).alias("host_size"),
                F.lit(order).alias("order"), F.concat(suffix, prefix).alias("rule"), F.lit(action).alias("verdict"),
                key_hash(F.lit(action), suffix, prefix).alias("key"))))
    far = F.lit(2 ** 30)
    options.append(F.when(F.col("host") != "", F.struct(
        far.alias("size"), F.lit(0).alias("host_size"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("verdict"), key_hash(F.lit("host"), F.col("host")).alias("key"))))
    sorted_options = F.array_sort(F.filter(F.array(*options), lambda x: x.isNotNull()))

    # keys are made where the pages are read: 16 bytes of each distinct one are shuffled, not the URLs
    key_rows = pages.select("host", "path").select(F.explode(F.transform(sorted_options, lambda x: x["key"])).alias("k"))
    universe = key_rows.select("k.h1", "k.h2").distinct()
    listed = (rules.select(key_hash(F.col("action"), F.col("host"), F.col("path")).alias("k"))
              .union(hosts.select(key_hash(F.lit("host"), F.col("host")).alias("k"))).select("k.h1", "k.h2"))
    filters, shards = cascades(universe, listed, keys_per_shard)
    size = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0

    def judged(df: DataFrame, cols: list[str]) -> DataFrame:
        """The first listed option decides."""
        first = F.get(F.filter(F.arrays_zip(F.col(cand).alias("c"), F.col(flags).alias("f")), lambda x: x["f"]), F.lit(0))["c"]
        return (df.withColumn(best, first).select(*[F.col(f"`{c}`") for c in cols], "host", "path", F.col(best)["rule"].alias("rule"),
                                                  F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict")))

    if size <= broadcast_bytes:
        asked = pages.withColumn(cand, sorted_options).withColumn(keys, F.transform(cand, lambda x: x["key"]))
        return judged(listed_flags(asked, keys, filters, shards, flags), keep)
    places = staged(pages.select("host", "path").distinct().withColumn(cand, sorted_options), "url-places")
    hits = staged(listed_keys(places.select(F.explode(F.transform(cand, lambda x: x["key"])).alias("k")).select("k.h1", "k.h2"),
                              filters, shards), "url-hits")
    one = places.select("host", "path", F.explode(cand).alias("c"))
    first = (one.join(hits, (F.col("c.key.h1") == F.col("h1")) & (F.col("c.key.h2") == F.col("h2")))
             .groupBy("host", "path").agg(F.min("c").alias(best)))
    first = staged(first.select(F.col("host").alias(h), F.col("path").alias(p), best), "url-verdicts")
    return (pages.join(first, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
            .select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col(best)["rule"].alias("rule"),
                    F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict")))
