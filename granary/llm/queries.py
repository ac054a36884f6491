"""The registered queries of this package and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, packing, pii, quality, secrets, simhash, sstable, topk, toxicity
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, lanes=1, radius=4)
    return found.select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read_shards(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc, start, ids: (doc, start, len(ids) // 4, zlib.crc32(ids)))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_secret_scan, op4_benchmark_decontamination, op5_token_shards, op6_exact_top_k, op7_toxicity, op8_pii_scan, op9_quality_classifier, op10_html_extraction)}

# --- the queries that SQL can express, for DuckDB --------------------------------------------------------------------
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _spans(patterns: list[tuple[str, str]]) -> str:
    """CTEs d (doc_id, t) and spans (doc_id, kind, name, a, n, v): place, length, and length of the last group, of each match.

    A match and what stands before it are taken together, so places are sums of lengths."""
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, '{name}' AS name, " + ", ".join(f"regexp_extract_all(t, '(?s)(.*?)({p})', {g}) AS {c}" for g, c in ((1, "pre"), (2, "hit"), (3, "val"))) + " FROM d" for k, (name, p) in enumerate(patterns))
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}), each AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM found),
        spans AS (SELECT doc_id, kind, name, length(hit[i]) AS n, length(val[i]) AS v, list_sum(list_transform(pre[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS a FROM each)"""


_SECRETS = [("assign", "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""), ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)")]

_OP3 = f"""WITH {_spans(_SECRETS)}, kept AS (SELECT * FROM spans WHERE v >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
    per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, kind) AS s FROM kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWER.format(t='coalesce(text, ' + repr('') + ')')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    sized AS (SELECT item, w, CAST(least(10, len(w)) AS BIGINT) AS n FROM i WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
    hits AS (SELECT doc_id, k, p.n AS n, item FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM places) p JOIN windows ON p.n = windows.n AND p.s = windows.s),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5"""

SQL: dict[str, str] = {"op3_secret_scan": _OP3, "op4_benchmark_decontamination": _OP4, "op6_exact_top_k": _OP6}
