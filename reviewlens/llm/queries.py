"""The registered queries of the operators (``opN_<name>``) and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import chat, classifier, embeddings, langid, merkle, mixing, packing, quality_rules, sharding, simhash, suffixes, url_filters, whitening


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and a host list of one host in sixteen of the table's own (in use, the list is a table of its own)."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    host, _ = url_filters.host_and_path(F.col("url"))
    hosts = pages.select(host.alias("host")).filter((F.col("host") != "") & F.md5("host").startswith("0")).distinct()
    return url_filters.judge_urls(pages, rules, hosts).drop("url")


OP1_SQL = r"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rule, h, q, action, rank) AS (VALUES ('example.net/en/', 'example.net', '/en/', 'allow', 1),
    ('example.com/de/', 'example.com', '/de/', 'block', 2), ('org/fr/', 'org', '/fr/', 'allow', 3), ('net/', 'net', '/', 'block', 4)),
b AS (SELECT page_id, host, path, (SELECT min(rank) FROM r WHERE (host = h OR ends_with(host, '.' || h))
                                   AND starts_with(path, q)) AS rank FROM p)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND md5(host) LIKE '0%' THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN r USING (rank)
"""
#: Production parameters, shared with the pipeline.
SIMHASH = {"shingle": 3, "max_bits": 2}
THRESHOLD = 0.3


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs, **SIMHASH).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.quality_rules(docs).drop("source")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mixing.mix_sources(docs, C.n_words(F.col("text")))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS i FROM c),
f AS (SELECT min(i) AS i FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, CASE WHEN l.i >= f.i
             THEN (SELECT level FROM l AS x WHERE x.i = f.i) * weight ELSE cap END AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * k AS BIGINT) AS taken, CAST(k AS INTEGER) AS copies
FROM (SELECT d.doc_id, d.size, q.source_size, q.target,
             floor(rate) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '') || ':0'), 1, 13) AS BIGINT)
                                     / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS k
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
"""


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    return sharding.shard_rows(docs, "doc_id", 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(C.table(spark, sf_dir, "embeddings"), min_cosine=0.95)


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    languages, model = langid.fit(docs, remainder != 2)
    return langid.predict(docs.select("doc_id", "text"), languages, model).select(
        "doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    return chat.digest_conversations(chat.format_conversations(chat.events_of(rows)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.n_words(F.col("text")).alias("n_tokens"))
    return packing.pack_documents(docs, F.col("n_tokens"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = classifier.fit(docs, C.table(spark, sf_dir, "labels"),
                           in_training=F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) != 0)
    return classifier.classify(docs, model, threshold=THRESHOLD).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                      merkle.leaf_digest(*first, F.translate("text", upper, upper.lower())))
    return merkle.audit(merkle.build_manifest(docs, merkle.leaf_digest(*first, F.col("text")), claimed=tampered)).drop("source")


def _op11_sql(levels: int = 6) -> str:
    """Levels of both trees spelled out (``16 ** levels`` leaves a source)."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    start = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
           "lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), "
           "lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")
    ctes = [f"""d AS (SELECT doc_id, source, sha256({start} || {value('text')}) AS leaf,
      CASE WHEN ({crc}) % 5 = 0 THEN sha256({start} || {value(lower)}) END AS tampered FROM documents)""",
            """s0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
      count(*) OVER (PARTITION BY source) AS cnt FROM d)"""]

    def tree(t: str, key: str) -> None:
        for k in range(levels):
            ctes.append(f"""{t}r{k} AS (SELECT {key}, idx // 16 AS run, string_agg(digest, '' ORDER BY idx) AS digests, any_value(cnt) AS cnt
      FROM {t}{k} WHERE cnt > 1 GROUP BY {key}, idx // 16)""")
            ctes.append(f"""{t}{k + 1} AS (SELECT {key}, run AS idx, sha256(digests) AS digest, (cnt + 15) // 16 AS cnt FROM {t}r{k})""")

    def fold(name: str, base: str, t: str, key: str, place: str) -> None:
        """``base`` with its proof and folded digest carried up the levels of tree ``t``."""
        for k in range(levels):
            at = f"({place} // {16 ** k}) % 16"
            left, right = f"substr(r.digests, 1, 64 * ({at}))", f"substr(r.digests, 64 * ({at}) + 65)"
            ctes.append(f"""{name}{k} AS (SELECT b.* EXCLUDE (proof, folded), b.proof || coalesce({left} || {right}, '') AS proof,
      CASE WHEN r.digests IS NULL THEN b.folded ELSE sha256({left} || b.folded || {right}) END AS folded
      FROM {base} b LEFT JOIN {t}r{k} r ON b.{key} IS NOT DISTINCT FROM r.{key} AND b.{place} // {16 ** (k + 1)} = r.run)""")
            base = f"{name}{k}"

    tree("s", "source")
    roots = " UNION ALL ".join(f"SELECT source, digest FROM s{k} WHERE cnt = 1" for k in range(levels + 1))
    ctes.append(f"roots AS ({roots})")
    ctes.append("t0 AS (SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS cnt FROM roots)")
    tree("t", "one")
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT digest FROM t{k} WHERE cnt = 1" for k in range(levels + 1)) + ")")
    ctes.append("""b AS (SELECT 0 AS one, s0.doc_id, s0.source, s0.leaf, s0.idx, t0.idx AS top, t0.digest AS subroot, '' AS proof,
      coalesce(s0.tampered, s0.leaf) AS folded FROM s0 JOIN t0 ON s0.source IS NOT DISTINCT FROM t0.source)""")
    fold("p", "b", "s", "source", "idx")
    fold("q", f"p{levels - 1}", "t", "one", "top")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified
FROM q{levels - 1}, root"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, k=4).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return suffixes.remove_repeats(docs, length=100).select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"),
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mixing": op4_source_mixing,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_language_mixture": op7_language_mixture,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}
_SQL = {"op1_url_filters": OP1_SQL, "op4_source_mixing": OP4_SQL, "op11_merkle_manifest": _op11_sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
