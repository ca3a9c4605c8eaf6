"""The corpus queries of the entry module: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import compact_windows, divergence, embedding_dedup, jaccard_join, packing, pii_crf, quality_gam, quality_rules, sentencepiece_match, suffix_dedup, token_shards, treap_search, warc
from rasterlake.llm.common import lean_workers, read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_match.round_trips(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(read_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    return compact_windows.near_passages(read_table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards_query(read_table(spark, sf_dir, "documents"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read_table(spark, sf_dir, "pages"))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_workers(spark)
    return treap_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sentencepiece, op2_suffix_dedup, op3_pii_crf, op4_embedding_dedup, op5_jaccard_join, op6_quality_rules, op7_best_fit_packing, op8_compact_windows, op9_token_shards, op10_quality_gam,
        op11_warc, op12_treap_search, op13_divergence_audit,
    )}


#: Smallest document or vector that links reach, from links p (x, y) in both directions and nodes v (id).
REACHED = "r(node, m) AS (SELECT id, id FROM v UNION SELECT p.y, r.m FROM r JOIN p ON p.x = r.node), c AS (SELECT node, min(m) AS m FROM r GROUP BY node)"
OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.93), {REACHED}
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) k ON k.x = e.vec_id
"""
OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
v AS (SELECT doc_id AS id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT q.x, q.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) q JOIN v s ON s.id = q.x JOIN v t ON t.id = q.y WHERE 100 * q.k >= 85 * (s.n + t.n - q.k)), {REACHED}
SELECT w.doc_id, coalesce(v.n, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id FROM w LEFT JOIN v ON v.id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what the method says; tests hold the others against brute force."""
    return {"op4_embedding_dedup": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op6_quality_rules": quality_rules.oracle(), "op11_warc": warc.SQL, "op12_treap_search": treap_search.SQL, "op13_divergence_audit": divergence.SQL}
