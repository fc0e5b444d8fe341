"""Canonical digests, the artifact table and reports."""

from __future__ import annotations

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.functions.canonical import canonical_json, sha256_hex, utf8_bytes
from dataproof.functions.types import field_of
from dataproof.operators.reports import build_reports, dataset_reference, verify_reports
from dataproof.queries.registry import query, table
from dataproof.queries.sources import DATASET_SQL, event_files
from dataproof.session import shared_dir
from dataproof.sources.manifest import dataset_manifest
from dataproof.sources.artifacts import artifact_rows, get_artifacts, put_artifacts, verify_artifacts

_CANONICAL = """'{"conv_id":' || conv_id || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}'"""
_CONTENT = f"SELECT conv_id, turn, {_CANONICAL} AS content FROM conversations"


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members out of order on purpose: canonical JSON sorts them."""
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.struct("turn", "role", "conv_id").alias("content"))


@query(f"SELECT conv_id, turn, content, sha256(content) AS digest, strlen(content) AS bytes FROM ({_CONTENT})")
def q_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _content(spark, sf_dir)
    text = canonical_json(F.col("content"), field_of(df, "content").dataType)
    content = F.col("content")
    return df.withColumn("content", text).withColumns({"digest": sha256_hex(content), "bytes": utf8_bytes(content)})


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE sha256('{"id":' || event_id || ',"v":' ||
       CAST(event_id % 7 AS VARCHAR) || '}') END AS hash, CASE WHEN event_id % 3 = 0 THEN 'non_finite_number' END AS error FROM events"""
)
def q_canonical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that JSON cannot hold flags its row and leaves the others alone."""
    df = table(spark, sf_dir, "events").select(
        "event_id", F.expr("named_struct('v', IF(event_id % 3 = 0, double('NaN'), event_id % 7), 'id', event_id)").alias("content")
    )
    found = artifact_rows(df, "query")
    return found.select("event_id", F.regexp_extract("artifact_id", "_([0-9a-f]{64})$", 1).alias("hash"), "error")


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def q_text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests over whole texts."""
    text = F.col("text")
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", sha256_hex(text).alias("digest"), utf8_bytes(text).alias("bytes"))


@query(
    f"""SELECT DISTINCT 'dataproof_profile_' || sha256(content) AS artifact_id, 'profile' AS kind,
        'sha256:' || sha256(content) AS digest, 'application/json' AS content_type, strlen(content) AS bytes, content
        FROM ({_CONTENT})"""
)
def q_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored twice, the second time with every row doubled: the table has each artifact once."""
    path = shared_dir(spark, "artifacts")
    content = _content(spark, sf_dir).select("content")
    put_artifacts(content, "profile", path)
    put_artifacts(content.unionAll(content), "profile", path)
    return spark.read.parquet(path).drop("write", "lead")


@query(
    f"""SELECT DISTINCT 'dataproof_query_' || sha256(content) AS artifact_id, strlen(content) AS bytes
        FROM ({_CONTENT}) WHERE conv_id = (SELECT min(conv_id) FROM conversations)"""
)
def q_get_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the artifacts of the first conversation by id."""
    path = shared_dir(spark, "artifacts")
    df = _content(spark, sf_dir)
    put_artifacts(df.select("content"), "query", path)
    put_artifacts(df.select("content"), "chart", path)
    first = df.agg(F.min("conv_id")).first()[0]
    ids = [row["artifact_id"] for row in artifact_rows(df.where(F.col("conv_id") == first), "query").collect()]
    return get_artifacts(spark, path, ids).select("artifact_id", "bytes")


@query(
    f"""SELECT conv_id, turn, n = 0 AS valid, CASE n WHEN 1 THEN 'kind: differs from the id'
        WHEN 2 THEN 'content: other hash than the id' WHEN 3 THEN 'bytes: other length than the content'
        WHEN 4 THEN 'content: not canonical' WHEN 5 THEN 'id: wrong form'
        WHEN 6 THEN 'digest: differs from the id' END AS error
        FROM (SELECT conv_id, turn, (conv_id + turn) % 7 AS n FROM conversations)"""
)
def q_verify_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way of tampering with a stored artifact, and untouched ones."""
    stored = artifact_rows(_content(spark, sf_dir), "profile")
    n = (F.col("conv_id") + F.col("turn")) % 7
    return verify_artifacts(
        stored.withColumns(
            {
                "artifact_id": F.when(n == 5, F.upper("artifact_id")).otherwise(F.col("artifact_id")),
                "digest": F.when(n == 6, F.lit("sha256:")).otherwise(F.col("digest")),
                "bytes": F.when(n == 3, F.col("bytes") + 1).otherwise(F.col("bytes")),
                "content": F.when(n == 2, F.replace("content", F.lit('"turn":'), F.lit('"turn":1')))
                .when(n == 4, F.concat(F.lit(" "), "content"))
                .otherwise(F.col("content")),
                "kind": F.when(n == 1, F.lit("chart")).otherwise(F.col("kind")),
            }
        )
    ).drop("artifact_id")


_DATASETS = [
    {"name": "conversations", "format": "parquet", "digest": "sha256:" + "a" * 64, "bytes": 10, "sourceKind": "path"}
]


def _body_sql(result: str) -> str:
    """``ds`` has the digest and the bytes of the dataset."""
    before = (
        '{"assumptions":[],"datasets":[{"bytes":\' || ds.bytes || \',"digest":"\' || ds.digest || \'","format":"ndjson",'
        '"name":"events","sourceKind":"path"}],"engine":{"name":"Spark","version":"' + pyspark.__version__ + '"},'
        '"methods":["profile"],"reproducibility":{"deterministic":true,"rowLimit":100,"sandboxProvider":"spark",'
        '"sourceDigests":["\' || ds.digest || \'"]},"request":{"a":[1,2.5,null],"operation":"profile"},"result":'
    )
    after = (
        ',"schemaVersion":"dataproof.report.v1","service":"dataproof","serviceVersion":"0.1.0",'
        '"tool":"profile_dataset","warnings":[]}'
    )
    return f"'{before}' || {result} || '{after}'"


def _reports(spark: SparkSession, sf_dir: str, datasets: list[dict] = _DATASETS) -> DataFrame:
    results = _content(spark, sf_dir).withColumnRenamed("content", "result")
    request = {"operation": "profile", "a": [1, 2.5, None]}
    reports = build_reports(results, "profile_dataset", request, datasets, methods=["profile"], row_limit=100)
    return reports.drop("result")


@query(
    f"""SELECT conv_id, turn, 'sha256:' || sha256(body) AS digest, 'dataproof_report_' || sha256(body) AS report_id
        FROM (SELECT conv_id, turn, {_body_sql('content')} AS body FROM ({_CONTENT}), ({DATASET_SQL}) AS ds)"""
)
def q_build_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on files: their manifest gives the dataset record."""
    manifest = dataset_manifest(spark, event_files(spark, sf_dir), "ndjson")
    return _reports(spark, sf_dir, [dataset_reference(manifest, "events", "ndjson")]).drop("report")


@query(
    """SELECT conv_id, turn, n <= 2 AS structure_valid, n IN (0, 2) AS digest_valid, n = 0 AS report_id_valid,
              n = 0 AS integrity_valid, CASE n WHEN 3 THEN '$.integrity.algorithm: other_value'
              WHEN 4 THEN '$.body: other_members' WHEN 5 THEN '$: not_json'
              WHEN 6 THEN '$.body.datasets: not_dataset_records' END AS error
       FROM (SELECT conv_id, turn, (conv_id + turn) % 7 AS n FROM conversations)"""
)
def q_verify_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("conv_id") + F.col("turn")) % 7
    report = F.col("report")
    tampered = (
        F.when(n == 1, F.replace(report, F.lit('"result":{"conv_id":'), F.lit('"result":{"conv_id":1')))
        .when(n == 2, F.regexp_replace(report, '"reportId":"dataproof_report_........', '"reportId":"dataproof_report_00000000'))
        .when(n == 3, F.replace(report, F.lit('"algorithm":"sha256"'), F.lit('"algorithm":"sha512"')))
        .when(n == 4, F.replace(report, F.lit('"assumptions":'), F.lit('"added":1,"assumptions":')))
        .when(n == 5, F.substr(report, F.lit(2)))
        .when(n == 6, F.replace(report, F.lit('"bytes":10'), F.lit('"bytes":-10')))
        .otherwise(report)
    )
    reports = _reports(spark, sf_dir).select("conv_id", "turn", tampered.alias("report"))
    return verify_reports(reports)
