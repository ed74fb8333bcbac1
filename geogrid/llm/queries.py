"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, mixing, near_dedup, packing, periodic, pii, quality, shards, simhash, token_count, turn_trie, warc
from .common import documents, scratch


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates of all documents."""
    return near_dedup.near_classes(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = documents(spark, sf_dir)
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs, dictionaries)
    return found.select("doc_id", langid.held_out().alias("held_out"), "language.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many word pieces greedy longest match makes of every document."""
    return token_count.token_counts(documents(spark, sf_dir))


def op4_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, taken in as arrivals and read back from the compacted store."""
    store = shards.ShardStore(spark, scratch(spark, "shards"))
    found = shards.ingest(store, documents(spark, sf_dir))
    return found.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 4096 tokens."""
    pieces = packing.tokenised(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.packed(pieces)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether base rules and the log-likelihood ratio keep it."""
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' records, read back from archives that hold each payload once."""
    path = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = warc.read(spark, warc.resolved(spark, path), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    x = mixing.mixed(documents(spark, sf_dir))
    return x.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and the row of it that stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans of the patterns, and all spans."""
    found = pii.detected(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [F.size(kinds).cast("long") - F.size(F.array_remove(kinds, k)) for k in pii.KINDS[:4]]
    return found.select(
        "doc_id",
        *[x.cast("long").alias(f"n_{k}") for k, x in zip(pii.KINDS, n, strict=False)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most 3 bits."""
    return simhash.near_components(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document's words, a tenth of all documents made to repeat, and the run of the greatest exponent."""
    found = periodic.periodic_runs(documents(spark, sf_dir), rewrite=True)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs are in order of start and period, so of equal exponents the first stays.
    more = lambda top, r: top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"])
    top = F.reduce("runs", none, lambda top, r: F.when(more(top, r), r).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    found = found.withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that those of a hundred ids begin alike."""
    return turn_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_near_dedup,
        op2_language_id,
        op3_token_counts,
        op4_size_tiered_shards,
        op5_best_fit_packing,
        op6_quality_rules,
        op7_warc_revisits,
        op8_systematic_mix,
        op9_exact_dedup,
        op10_personal_data,
        op11_simhash_near_dedup,
        op12_periodic_runs,
        op13_turn_trie,
    )
}

SQL: dict[str, str] = {
    "op4_size_tiered_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op7_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), s AS (
  SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY payload) AS keep FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM s""",
    "op8_systematic_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS "limit", source_size * 2.0::DOUBLE / weight AS level,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w
), f AS (
  SELECT *,
    (total - coalesce(sum("limit") OVER o, 0)) / (all_weight - coalesce(sum(weight) OVER o, 0)) AS fill
  FROM l WINDOW o AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (SELECT *, max(fill) OVER () AS peak FROM f
), t AS (
  SELECT source, source_size, least("limit", peak * weight) AS target,
    floor(coalesce(least("limit", peak * weight) / nullif(source_size, 0)::DOUBLE, 0) * 1000000000)::BIGINT AS rate,
    floor(('0x' || substr(md5('7:' || coalesce(source, chr(0))), 1, 8))::BIGINT * 1000000000 / 4294967296)::BIGINT AS first
  FROM p
), r AS (
  SELECT d.*, t.source_size, t.target, t.rate, t.first,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS nth
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (((nth::HUGEINT * rate + first) // 1000000000 - ((nth - 1)::HUGEINT * rate + first) // 1000000000) * size)::BIGINT AS taken
FROM r""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op13_turn_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), b AS (SELECT c, base, h, (SELECT least(count(*), h) FROM t WHERE t.conv_id = base) AS heads FROM c
), r AS (
  SELECT c, pos AS d, role, text FROM b JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c, heads + pos - h, role, text FROM b JOIN t ON t.conv_id = c AND pos > h
), m AS (
  SELECT c, d, length(text) AS n, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM c
), l AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM m
), n AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ends
  FROM l GROUP BY d, key
), k AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key
), s AS (
  SELECT substr(key, 1, 32 * e) AS key, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM v) GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.d = v.d AND s.key = v.key LEFT JOIN v p ON p.d = v.d - 1 AND p.key = substr(v.key, 1, 32 * (v.d - 1)::INT)""",
}
