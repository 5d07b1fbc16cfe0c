"""The registered queries of the training-data operators: thin calls over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import compression_bands, decontaminate, hilbert_search, language_id, license_scan, mixing, prefix_trie, rule_ensemble, simhash, site_style, toxicity, turn_repair, warc


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.report(table(spark, sf_dir, "pages"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.report(table(spark, sf_dir, "documents"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op12_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.report(table(spark, sf_dir, "embeddings"))


def op13_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_HEX20 = "CAST('0x' || substr(h, {0}, 5) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_HEX20.format(5 * k + 1)} >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

#: CRC-32 of an ASCII string by its definition, bit by bit.
_BITS = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
_CRC32 = f"xor(list_reduce(list_transform(string_split({{0}}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {_BITS}, CAST(4294967295 AS BIGINT)), 4294967295)"

ORACLE = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, CAST({_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS INTEGER) AS h, list(struct_pack(id := id, n := n) ORDER BY turn NULLS FIRST, id, n) AS w FROM t GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(list_slice(coalesce(f.w, []), 1, o.h), list_slice(o.w, o.h + 1, len(o.w))) AS w FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 100),
paths AS (SELECT conv_id, d, array_to_string(list_transform(w[1:d], lambda x: x.id), '') AS p, coalesce(w[d].n, 0) AS n, len(w) = d AS ends FROM built, unnest(range(0, len(w) + 1)) AS u(d)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM paths GROUP BY d, p),
kids AS (SELECT d - 1 AS d, substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT x.*, coalesce(k.n_children, 0) AS n_children FROM nodes x LEFT JOIN kids k USING (d, p)),
below AS (SELECT a AS d, substr(p, 1, 32 * a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved_tokens FROM whole, unnest(range(0, d + 1)) AS u(a) GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, b.n_leaves, b.saved_tokens, x.ends_sha256
FROM whole x JOIN below b USING (d, p) LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = substr(x.p, 1, 32 * up.d)""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op7_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
hits AS (SELECT r, k, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS v(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN items USING (r)""",
}
