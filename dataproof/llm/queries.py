"""Registered queries of the corpus operators, with equivalent SQL where there is any.

Each query reads its whole table and gets its rows through its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dataproof.llm import (
    byte_bpe,
    centroids,
    chat_repair,
    decontaminate,
    divergence,
    filter_audit,
    jaccard_join,
    page_wrapper,
    piece_counts,
    quality_knn,
    sharding,
    suffix_tree,
    url_gbt,
)
from dataproof.queries.registry import Query, table

REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(run):
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return add


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(path, public_tokenizers.PATTERN))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS passage
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
spots AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM d, (SELECT DISTINCT size FROM wins) AS s, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, spots.size AS size, item FROM spots JOIN wins USING (passage) WHERE spots.size = wins.size),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(OP2_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.verdicts(table(spark, sf_dir, "documents"))


@query()
def op6_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query()
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge_urls(table(spark, sf_dir, "pages"))


@query()
def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.corpus_scores(table(spark, sf_dir, "documents"))


@query()
def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


@query()
def op11_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _cluster_sql(clusters: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The clustering with one common table expression per round."""
    steps = [
        f"""x AS MATERIALIZED (
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM embeddings, unnest(range(1, {size + 1})) AS t(i)
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: isfinite(e))) = {size})""",
        f"""first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster
  FROM (SELECT DISTINCT vec_id FROM x) QUALIFY cluster < {clusters})""",
        "c0 AS MATERIALIZED (SELECT CAST(cluster AS INTEGER) AS cluster, pos, x AS c FROM first JOIN x USING (vec_id))",
    ]
    for step in range(rounds + 1):
        steps.append(f"""a{step} AS MATERIALIZED (
  SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance FROM (
    SELECT vec_id, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{step} USING (pos) GROUP BY vec_id, cluster)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if step < rounds:
            # Remainders are made positive, so that the division is a floor whatever the sign.
            steps.append(f"""m{step} AS (
  SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM a{step} JOIN x USING (vec_id) GROUP BY cluster, pos),
c{step + 1} AS MATERIALIZED (
  SELECT c{step}.cluster, c{step}.pos, CAST(CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c
  FROM c{step} LEFT JOIN m{step} ON c{step}.cluster = m{step}.cluster AND c{step}.pos = m{step}.pos)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (
  SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
USING (cluster)"""


@query(_cluster_sql())
def op12_pca_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
rows_ AS (
  SELECT f.doc_id, part, [a, b, c, d, e] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM f LEFT JOIN l USING (doc_id)),
kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM rows_ GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS o
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT filter_order, o, CAST(step AS INTEGER) AS step, o[step] AS own FROM orders, unnest(range(1, 6)) AS u(step)),
parts AS (SELECT DISTINCT part FROM kinds),
judged AS (
  SELECT part, filter_order, step, n, good, toxic, own, fails[own] AS failed,
    len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS before, len(list_filter(fails, lambda y: y)) AS times
  FROM kinds, steps),
found AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN NOT failed AND NOT before THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed AND times = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT before THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""


@query(OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
