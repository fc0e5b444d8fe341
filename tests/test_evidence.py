from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from dataproof import build_reports, get_artifacts, put_artifacts, verify_artifacts, verify_reports
from dataproof.functions.canonical import canonical_json, canonical_text, is_strict_json
from dataproof.functions.types import field_of
from dataproof.sources import artifacts

DATASETS = [{"name": "s.csv", "format": "csv", "digest": "sha256:" + "a" * 64, "bytes": 10, "sourceKind": "inline"}]


def canonical(df, name="v"):
    return df.select(canonical_json(F.col(name), field_of(df, name).dataType).alias("c")).first()["c"]


def test_canonical_order(spark):
    df = spark.sql("SELECT named_struct('z', 1, 'a', named_struct('d', 2, 'b', 1)) AS v")
    assert canonical(df) == '{"a":{"b":1,"d":2},"z":1}'


def test_canonical_values(spark):
    df = spark.sql(
        """SELECT named_struct('n', NULL, 'f', 1.0D, 'm', -0.0D, 't', TIMESTAMP '2024-01-02 03:04:05.000001',
           'w', TIMESTAMP_NTZ '2024-01-02 03:04:05', 'b', X'00FF', 'd', DATE '2024-01-02',
           'k', map('y', 1, 'x', 2)) AS v"""
    )
    assert canonical(df) == (
        '{"b":"AP8=","d":"2024-01-02","f":1,"k":{"x":2,"y":1},"m":0,"n":null,'
        '"t":"2024-01-02T03:04:05.000001Z","w":"2024-01-02T03:04:05.000000Z"}'
    )


@pytest.mark.parametrize("value", ["double('NaN')", "array(1D, double('Infinity'))", "map('a', named_struct('b', float('-inf')))"])
def test_non_finite_numbers_are_flagged(spark, value):
    df = spark.sql(f"SELECT named_struct('x', {value}) AS v")
    assert df.select(canonical_json(F.col("v"), df.schema["v"].dataType)).first()[0] is None
    both = df.select(F.col("v").alias("content"))
    assert artifacts.artifact_rows(both, "query").first()["error"] == "non_finite_number"


def test_canonical_text_is_stable(spark):
    texts = ['{"b":1.50,"a":[1e21,{"y":null,"x":"é\\u0001"}]}', "3", "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_text(F.col("t")).alias("c"))
    again = df.select("c", canonical_text(F.col("c")).alias("d")).collect()
    assert all(row["c"] == row["d"] for row in again)


def test_strict_json(spark):
    good = ["{}", "1", ' {"a":[1]} ', '"x"', "null", "[]"]
    bad = ["", " ", "{", "1 2", "1,2", '1,"b":2', "1] x", "1} x", '{"a":1} x', "NaN", "01", "{a:1}", "'x'"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    found = {row["t"]: row["s"] for row in df.select("t", is_strict_json(F.col("t")).alias("s")).collect()}
    assert found == {t: t in good for t in good + bad}


def test_artifacts(spark, folder):
    path = f"{folder}/artifacts"
    one = spark.sql("SELECT named_struct('b', 2, 'a', 1) AS content")
    two = spark.sql("SELECT named_struct('a', 1, 'b', 2) AS content")
    first = put_artifacts(one, "profile", path).first()
    second = put_artifacts(two, "profile", path).first()
    assert first == second
    put_artifacts(two.unionAll(two), "chart", path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    text = '{"a":1,"b":2}'
    row = get_artifacts(spark, path, [first["artifact_id"]]).first()
    assert row["content"] == text and row["bytes"] == len(text)
    assert row["artifact_id"] == "dataproof_profile_" + hashlib.sha256(text.encode()).hexdigest()
    assert get_artifacts(spark, path, ["dataproof_query_" + "0" * 64]).count() == 0
    with pytest.raises(ValueError, match="no artifact id"):
        get_artifacts(spark, path, ["../etc/passwd"])
    with pytest.raises(ValueError, match="Unknown artifact kind"):
        put_artifacts(one, "other", path)
    assert verify_artifacts(stored).where("NOT valid").count() == 0


def test_lookup_reads_one_partition(spark, folder):
    path = f"{folder}/artifacts"
    df = spark.range(50).select(F.struct("id").alias("content"))
    for kind in artifacts.KINDS:
        put_artifacts(df, kind, path)
    ids = [r["artifact_id"] for r in spark.read.parquet(path).where("kind = 'query'").limit(3).collect()]
    found = get_artifacts(spark, path, ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3
    assert "PartitionFilters: [isnotnull(kind" in plan and "GreaterThanOrEqual(artifact_id" in plan
    many = [r["artifact_id"] for r in spark.read.parquet(path).collect()] + ["dataproof_chart_" + "%064x" % i for i in range(1000)]
    assert get_artifacts(spark, path, many).count() == 300


def test_get_from_an_absent_table(spark, folder):
    assert get_artifacts(spark, f"{folder}/none", ["dataproof_query_" + "0" * 64]).count() == 0


def test_two_writers_at_once(spark, folder):
    """Each artifact is found once, whoever has added it, and readers see whole writes only."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"{folder}/artifacts"
    first = spark.sql("SELECT named_struct('n', id) AS content FROM range(60)")
    second = spark.sql("SELECT named_struct('n', id) AS content FROM range(30, 90)")
    with ThreadPoolExecutor(2) as pool:
        asked = [r["artifact_id"] for rows in pool.map(lambda df: put_artifacts(df, "query", path).collect(), (first, second)) for r in rows]
    assert len(set(asked)) == 90
    found = get_artifacts(spark, path, asked)
    assert artifacts.read_artifacts(spark, path).count() == 90
    assert found.count() == 90 and verify_artifacts(found).where("NOT valid").count() == 0
    before = spark.read.parquet(path).count()
    put_artifacts(first.unionAll(second), "query", path)
    assert spark.read.parquet(path).count() == before


def test_a_failed_write_is_not_read(spark, folder, monkeypatch):
    path = f"{folder}/artifacts"
    rows = spark.sql("SELECT named_struct('n', id) AS content FROM range(5)")
    ids = [r["artifact_id"] for r in put_artifacts(rows, "query", path).collect()]

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(artifacts, "_commit", broken)
        with pytest.raises(RuntimeError, match="lost"):
            put_artifacts(spark.sql("SELECT named_struct('n', id) AS content FROM range(9)"), "query", path)
    assert spark.read.parquet(path).count() == 5 and get_artifacts(spark, path, ids).count() == 5
    assert os.listdir(f"{path}/_staged") == []
    put_artifacts(spark.sql("SELECT named_struct('n', id) AS content FROM range(9)"), "query", path)
    assert spark.read.parquet(path).count() == 9


def test_oversized_artifact(spark, folder, monkeypatch):
    monkeypatch.setattr(artifacts, "MAX_ARTIFACT_BYTES", 20)
    df = spark.sql("SELECT named_struct('payload', repeat('x', 20)) AS content")
    df = df.unionAll(spark.sql("SELECT named_struct('payload', '') AS content"))
    asked = put_artifacts(df, "research", f"{folder}/big").collect()
    assert sorted(str(row["error"]) for row in asked) == ["None", "too_large"]
    assert spark.read.parquet(f"{folder}/big").count() == 1


def test_tampered_artifacts(spark, folder):
    path = f"{folder}/artifacts"
    put_artifacts(spark.sql("SELECT named_struct('rows', array(1, 2)) AS content"), "query", path)
    good = spark.read.parquet(path)
    cases = {
        "id: wrong form": good.withColumn("artifact_id", F.lit("x")),
        "kind: unknown": good.withColumn("kind", F.lit("other")),
        "kind: differs from the id": good.withColumn("kind", F.lit("chart")),
        "content_type: differs": good.withColumn("content_type", F.lit("text/plain")),
        "digest: differs from the id": good.withColumn("digest", F.lit("sha256:00")),
        "bytes: negative or missing": good.withColumn("bytes", F.lit(-1)),
        "content: not JSON": good.withColumn("content", F.lit("{")),
        "content: other hash than the id": good.withColumn("content", F.lit('{"rows":[1,3]}')),
        "bytes: other length than the content": good.withColumn("bytes", F.col("bytes") + 1),
        "content: not canonical": good.withColumn("content", F.lit('{"rows": [1, 2]}')),
    }
    for reason, df in cases.items():
        row = verify_artifacts(df).first()
        assert (row["valid"], row["error"]) == (False, reason)


@pytest.fixture(scope="module")
def report(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('rows', 2, 'columns', array('id')) AS result")
    return build_reports(df, "profile_dataset", {"operation": "profile"}, DATASETS, methods=["profile"], sql="SELECT 1", row_limit=5)


def verdict(spark, text):
    return verify_reports(spark.createDataFrame([(text,)], "report string")).first().asDict()


def test_report(spark, report):
    row = report.first()
    assert build_reports(
        report.select("k", "result").repartition(2), "profile_dataset", {"operation": "profile"}, DATASETS,
        methods=["profile"], sql="SELECT 1", row_limit=5,
    ).first() == row
    document = json.loads(row["report"])
    assert document["reportId"] == row["report_id"] == "dataproof_report_" + row["digest"].removeprefix("sha256:")
    assert document["body"]["result"] == {"columns": ["id"], "rows": 2}
    body = json.dumps(document["body"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert "sha256:" + hashlib.sha256(body.encode()).hexdigest() == row["digest"]
    assert verdict(spark, row["report"]) == {
        "structure_valid": True, "digest_valid": True, "report_id_valid": True, "integrity_valid": True, "error": None,
    }
    # The order of members does not matter.
    assert verdict(spark, json.dumps(dict(reversed(document.items())), indent=1))["integrity_valid"]


def edited(report, edit):
    document = json.loads(report.first()["report"])
    edit(document)
    return json.dumps(document)


def test_tampering_breaks_the_digest(spark, report):
    found = verdict(spark, edited(report, lambda d: d["body"].update(result={"rows": 999})))
    assert found["structure_valid"] and not found["digest_valid"] and not found["integrity_valid"]
    found = verdict(spark, edited(report, lambda d: d.update(reportId="dataproof_report_" + "00" * 32)))
    assert found["digest_valid"] and not found["report_id_valid"] and not found["integrity_valid"]


STRUCTURE = {
    "algorithm": lambda d: d["integrity"].update(algorithm="sha512"),
    "canonicalization": lambda d: d["integrity"].update(canonicalization="JCS"),
    "schema version": lambda d: d["body"].update(schemaVersion="dataproof.report.v2"),
    "service": lambda d: d["body"].update(service="x"),
    "tool": lambda d: d["body"].update(tool=1),
    "engine name": lambda d: d["body"]["engine"].update(name="x"),
    "engine extra": lambda d: d["body"]["engine"].update(extra=1),
    "missing result": lambda d: d["body"].pop("result"),
    "extra member": lambda d: d["body"].update(extra=1),
    "top level": lambda d: d.update(extra=1),
    "datasets object": lambda d: d["body"].update(datasets={}),
    "dataset bytes": lambda d: d["body"]["datasets"][0].update(bytes=-1),
    "dataset bytes fraction": lambda d: d["body"]["datasets"][0].update(bytes=1.5),
    "dataset kind": lambda d: d["body"]["datasets"][0].update(sourceKind="ftp"),
    "dataset extra": lambda d: d["body"]["datasets"][0].update(extra=1),
    "dataset url": lambda d: d["body"]["datasets"][0].update(sourceUrl=1),
    "dataset redacted": lambda d: d["body"]["datasets"][0].update(sourceQueryRedacted="yes"),
    "methods": lambda d: d["body"].update(methods=["a", 1]),
    "warnings": lambda d: d["body"].update(warnings="none"),
    "deterministic": lambda d: d["body"]["reproducibility"].update(deterministic="true"),
    "digests": lambda d: d["body"]["reproducibility"].update(sourceDigests=[None]),
    "provider": lambda d: d["body"]["reproducibility"].update(sandboxProvider="x"),
    "sql": lambda d: d["body"]["reproducibility"].update(sql=1),
    "row limit": lambda d: d["body"]["reproducibility"].update(rowLimit=-5),
    "digest form": lambda d: d["integrity"].update(digest="sha256:XYZ"),
    "signature": lambda d: d["integrity"].update(signature="0x12"),
    "signer": lambda d: d["integrity"].update(signer="nobody"),
}


@pytest.mark.parametrize("case", sorted(STRUCTURE))
def test_structure(spark, report, case):
    found = verdict(spark, edited(report, STRUCTURE[case]))
    assert not found["structure_valid"] and not found["integrity_valid"] and found["error"]


def test_optional_members(spark, report):
    def edit(d):
        d["integrity"]["signature"] = "0x" + "ab" * 65
        d["integrity"]["signer"] = "0x" + "ab" * 20

    assert verdict(spark, edited(report, edit))["integrity_valid"]
    plain = spark.sql("SELECT named_struct('a', 1) AS result")
    bare = build_reports(plain, "t", None, []).first()["report"]
    assert verdict(spark, bare)["integrity_valid"]
    assert "sql" not in json.loads(bare)["body"]["reproducibility"]


@pytest.mark.parametrize("text", ["", "x", "[]", "1", "null", "{}"])
def test_no_report_at_all(spark, text):
    assert not verdict(spark, text)["structure_valid"]
