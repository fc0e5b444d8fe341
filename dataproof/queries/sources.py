"""Readers, payload checks, manifests and URL screening on files and columns made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataproof.functions.canonical import is_strict_json
from dataproof.functions.dates import to_timestamp
from dataproof.functions.types import field_of
from dataproof.queries.registry import query, table
from dataproof.session import shared_dir
from dataproof.sources.manifest import dataset_digest, dataset_manifest, tree_digests
from dataproof.sources.readers import read_dataset
from dataproof.sources.urls import redact_url, screen_source_urls
from dataproof.sources.validation import validate_files

_SCANNED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders"


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(_SCANNED)
def q_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolon-separated files; separator, integer width and dates are found out."""
    path = shared_dir(spark, "csv")
    _dated_orders(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return read_dataset(spark, path, "csv")


@query(
    """SELECT conv_id, turn, role, replace(text, chr(13), ' ') || CASE WHEN conv_id % 2 = 0
       THEN ' "said"' || chr(10) || 'a; b, c' ELSE '' END AS text FROM conversations"""
)
def q_scan_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted values with separators, quotes and line breaks in them."""
    path = shared_dir(spark, "csv-quoted")
    extra = F.when(F.col("conv_id") % 2 == 0, F.lit(' "said"\na; b, c')).otherwise(F.lit(""))
    df = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.replace("text", F.lit("\r"), F.lit(" ")), extra))
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_dataset(spark, path, "csv")


@query(_SCANNED)
def q_scan_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "ndjson")
    _dated_orders(spark, sf_dir).write.json(path)
    return read_dataset(spark, path, "ndjson")


@query(_SCANNED)
def q_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold an array of objects, spread over lines."""
    path = shared_dir(spark, "json")
    record = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    # A file holds one array of at most 4096 orders, so no row of this write grows with the table.
    arrays = (
        _dated_orders(spark, sf_dir)
        .groupBy(F.expr("o_orderkey div 4096").alias("part"))
        .agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_dataset(spark, path, "json")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_totalprice > 300000")
def q_scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and columns reach the scan."""
    df = read_dataset(spark, f"{sf_dir.rstrip('/')}/orders.parquet", "parquet")
    return df.where("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_orderdate")


#: Events of one file: files grow in number with the table, not in size.
_PART = 2000
_EVENT_FILES = f"""SELECT event_id // {_PART} AS part, string_agg(props || chr(10), '' ORDER BY event_id) AS text
    FROM events GROUP BY 1"""


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one text file for every part of ``events``."""
    path = shared_dir(spark, "events")
    lines = table(spark, sf_dir, "events").select(F.expr(f"event_id div {_PART}").alias("part"), "event_id", F.col("props").alias("value"))
    _write_parts(lines, path)
    return path


def _write_parts(lines: DataFrame, path: str, **options: str) -> None:
    ordered = lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value")
    ordered.write.partitionBy("part").options(**options).text(path)


def _part_of(path_column: str) -> Column:
    return F.regexp_extract(path_column, r"/part=(\d+)/", 1).cast("bigint").alias("part")


@query(f"SELECT part, 'ndjson' AS format, 'sha256:' || sha256(text) AS digest, strlen(text) AS bytes FROM ({_EVENT_FILES})")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of files whose bytes are known from the rows."""
    manifest = dataset_manifest(spark, event_files(spark, sf_dir), "ndjson")
    return manifest.select(_part_of("source_url"), "format", "digest", "bytes")


#: The digest of all files together, which does not depend on their names.
DATASET_SQL = f"""SELECT sum(copies)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, CASE WHEN sum(copies) = 1 THEN max(any_digest)
    ELSE 'sha256:' || sha256(string_agg(hash, chr(10) ORDER BY hash)) END AS digest FROM (
    SELECT sum(copies) AS copies, sum(bytes) AS bytes, max(digest) AS any_digest,
           sha256(string_agg(digest || ' ' || copies, chr(10) ORDER BY digest || ' ' || copies)) AS hash FROM (
        SELECT digest, count(*) AS copies, sum(bytes) AS bytes FROM (
            SELECT 'sha256:' || sha256(text) AS digest, strlen(text) AS bytes FROM ({_EVENT_FILES})) GROUP BY digest)
    GROUP BY substr(digest, 8, 3))"""


@query(DATASET_SQL)
def q_dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_digest(dataset_manifest(spark, event_files(spark, sf_dir), "ndjson"))


_BLOCK, _FAN = 1000, 8


@query(
    f"""WITH f AS ({_EVENT_FILES}),
        l0 AS (SELECT part, i AS place, sha256(substr(text, i * {_BLOCK} + 1, {_BLOCK})) AS d
               FROM f, unnest(range(CAST(ceil(strlen(text) / {_BLOCK}) AS BIGINT))) AS t(i)),
        l1 AS (SELECT part, place // {_FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM l0 GROUP BY 1, 2),
        l2 AS (SELECT part, place // {_FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM l1 GROUP BY 1, 2),
        l3 AS (SELECT part, place // {_FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM l2 GROUP BY 1, 2)
        SELECT part, strlen(text) AS bytes, CAST(ceil(strlen(text) / {_BLOCK}) AS BIGINT) AS blocks,
               'tree-sha256-{_BLOCK}-{_FAN}:' || CASE WHEN strlen(text) <= {_BLOCK} THEN (SELECT any_value(d) FROM l0 WHERE l0.part = f.part)
               WHEN strlen(text) <= {_BLOCK * _FAN} THEN (SELECT any_value(d) FROM l1 WHERE l1.part = f.part)
               WHEN strlen(text) <= {_BLOCK * _FAN**2} THEN (SELECT any_value(d) FROM l2 WHERE l2.part = f.part)
               ELSE (SELECT any_value(d) FROM l3 WHERE l3.part = f.part) END AS digest FROM f"""
)
def q_tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are hashed in blocks side by side; parents hash their children's digests."""
    found = tree_digests(spark, event_files(spark, sf_dir), block_bytes=_BLOCK, fan=_FAN)
    return found.select(_part_of("path"), "bytes", "blocks", "digest")


_PARTS = f"SELECT DISTINCT event_id // {_PART} AS part FROM events"


@query(
    f"""SELECT part, part % 2 = 0 AS valid, CASE WHEN part % 2 = 1 THEN 'parquet: first or last bytes are not PAR1' END AS error
        FROM ({_PARTS})"""
)
def q_validate_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end as Parquet files do; every second one does not begin so."""
    path = shared_dir(spark, "parquet")
    lines = table(spark, sf_dir, "events").groupBy(F.expr(f"event_id div {_PART}").alias("part")).agg(
        F.min("event_id").alias("event_id"), F.min_by("props", "event_id").alias("value")
    )
    head = F.when(F.col("part") % 2 == 0, F.lit("PAR1")).otherwise(F.lit(""))
    _write_parts(lines.withColumn("value", F.concat(head, "value")), path, lineSep="PAR1")
    return validate_files(spark, path, "parquet").select(_part_of("path"), "valid", "error")


@query(f"SELECT part, part % 3 <> 1 AS valid, CASE WHEN part % 3 = 1 THEN 'text: zero byte' END AS error FROM ({_PARTS})")
def q_validate_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every third file has one with a zero byte."""
    path = shared_dir(spark, "csv-check")
    bad = (F.col("part") % 3 == 1) & (F.col("event_id") % 1000 == 7)
    lines = table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {_PART}").alias("part"), "event_id", F.concat_ws(",", "event_id", "event_type").alias("value")
    )
    _write_parts(lines.withColumn("value", F.when(bad, F.concat("value", F.lit("\0"))).otherwise(F.col("value"))), path)
    return validate_files(spark, path, "csv").select(_part_of("path"), "valid", "error")


@query(
    f"SELECT part, part % 4 IN (0, 3) AS valid, CASE WHEN part % 4 IN (1, 2) THEN 'json: not one JSON value' END AS error FROM ({_PARTS})"
)
def q_validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one array over many lines; some lack its end, some repeat a key."""
    path = shared_dir(spark, "json-check")
    lines = table(spark, sf_dir, "events").select(F.expr(f"event_id div {_PART}").alias("part"), "event_id", "props")
    place = F.row_number().over(Window.partitionBy("part").orderBy("event_id"))
    count = F.count("*").over(Window.partitionBy("part"))
    lines = lines.withColumns({"place": place, "count": count})
    before = F.when(F.col("place") == 1, F.lit("[")).otherwise(F.lit(","))
    item = F.when((F.col("part") % 4 == 2) & (F.col("place") == 1), F.lit('{"a": 1, "a": 2}')).otherwise(F.col("props"))
    after = F.when((F.col("place") == F.col("count")) & (F.col("part") % 4 != 1), F.lit("]")).otherwise(F.lit(""))
    _write_parts(lines.select("part", "event_id", F.concat(before, item, after).alias("value")), path)
    return validate_files(spark, path, "json").select(_part_of("path"), "valid", "error")


_LINE = """CASE event_id % 50 WHEN 0 THEN 'not-json' WHEN 1 THEN props || ' trailing' WHEN 2 THEN '[1, 2'
    WHEN 3 THEN '"text"' ELSE props END"""


@query(f"SELECT event_id, json_valid({_LINE}) AS valid FROM events")
def q_validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_LINE)
    return table(spark, sf_dir, "events").select("event_id", is_strict_json(line).alias("valid"))


_BAD = "event_id % 16 >= 8 AND event_id % 100 >= 60"


@query(
    f"""SELECT event_id % 16 AS part, bool_and(NOT ({_BAD})) AS valid,
        'ndjson: record ' || min(n) FILTER (WHERE {_BAD}) || ' is not one JSON value' AS error FROM (
        SELECT event_id, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS n FROM events)
        GROUP BY 1"""
)
def q_validate_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with broken records: the first bad record of each, blank lines not counted."""
    path = shared_dir(spark, "validate")
    lines = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 16).alias("part"),
        "event_id",
        F.when(F.expr(_BAD), F.lit("{broken"))
        .when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n"), "props"))
        .otherwise(F.col("props"))
        .alias("value"),
    )
    lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    found = validate_files(spark, path, "ndjson")
    return found.select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint").alias("part"), "valid", "error")


_WRITTEN = """CASE o_orderkey % 8 WHEN 0 THEN 'n/a' WHEN 1 THEN '2024' WHEN 2 THEN '2024-02' WHEN 3 THEN ''
    WHEN 4 THEN '2024-13-01' WHEN 5 THEN CAST(o_orderdate AS {0}) ELSE CAST(CAST(o_orderdate AS DATE) AS {0}) END"""


@query(f"SELECT o_orderkey, TRY_CAST({_WRITTEN.format('VARCHAR')} AS TIMESTAMP) AS parsed FROM orders")
def q_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("written", F.expr(_WRITTEN.format("STRING")))
    return df.select("o_orderkey", to_timestamp(F.col("written"), field_of(df, "written").dataType).alias("parsed"))


_REST = "regexp_replace(url, '^[a-z]+://[^/?#]*', '')"
_VARIANT = f"""CASE page_id % 8 WHEN 0 THEN 'ftp://example.org' || {_REST} WHEN 1 THEN 'https://user:p@example.org' || {_REST}
    WHEN 2 THEN 'https://example.org:8443' || {_REST} WHEN 3 THEN 'http://127.0.0.1' || {_REST}
    WHEN 4 THEN 'http://[::1]' || {_REST} WHEN 5 THEN 'http://localhost' || {_REST}
    WHEN 6 THEN 'http://10.1.2.3:80' || {_REST}
    ELSE CASE page_id % 5 WHEN 0 THEN 'http://①②⑦.⓪.⓪.①/x' WHEN 1 THEN 'http://ｌocalhost/' WHEN 2 THEN 'http://local­host/'
         ELSE url END END"""


@query(
    f"""WITH v AS (SELECT page_id, {_VARIANT} AS u FROM pages),
        s AS (SELECT page_id, u, CASE WHEN u LIKE 'ftp:%' THEN 'scheme_not_http' WHEN u LIKE 'https://user:p@%' THEN 'credentials'
              WHEN regexp_matches(u, '#.') THEN 'fragment' WHEN page_id % 8 = 7 AND page_id % 5 = 0 THEN 'prohibited_address'
              WHEN page_id % 8 = 7 AND page_id % 5 < 3 OR page_id % 8 = 5 THEN 'blocked_host'
              WHEN page_id % 8 = 2 THEN 'non_default_port' WHEN page_id % 8 IN (3, 4, 6) THEN 'prohibited_address' END AS reason
              FROM v)
        SELECT page_id, reason, reason IS NULL AS allowed, CASE WHEN reason IS NULL THEN
               regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN regexp_matches(u, '^[a-z]+://[^/?#]*([?#]|$)') THEN '/' ELSE '' END
               END AS normalized_url, regexp_matches(u, '^[^#?]*\\?[^#]') AS query_redacted FROM s"""
)
def q_url_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_VARIANT} AS u")
    return screen_source_urls(df, "u").drop("u")


#: Host names of other scripts, and what parsers make of them.
_NAMES = (
    ("münchen.example", "xn--mnchen-3ya.example"),
    ("BÜCHER.Example", "xn--bcher-kva.example"),
    ("例え.テスト", "xn--r8jz45g.xn--zckzah"),
    ("www.пример.example", "www.xn--e1afmkfd.example"),
    ("ñandú。example", "xn--and-6ma2c.example"),
    ("plain.example", "plain.example"),
    ("straße.example", None),
)
_NAME_CASES = " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_NAMES))
_ASCII_CASES = " ".join(f"WHEN {i} THEN {'NULL' if name is None else repr(name)}" for i, (_, name) in enumerate(_NAMES))


@query(
    f"""SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'non_ascii_host' END AS reason,
        'http://' || CASE page_id % 7 {_ASCII_CASES} END || '/p/' || page_id AS normalized_url FROM pages"""
)
def q_url_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of other scripts are written as parsers write them; one without a sure ASCII form is refused."""
    name = F.expr(f"CASE page_id % 7 {_NAME_CASES} END")
    df = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://"), name, F.lit("/p/"), "page_id").alias("u"))
    return screen_source_urls(df, "u").select("page_id", "reason", "normalized_url")


@query(
    r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS source_url, regexp_matches(url, '^[^?#]*\?[^#]') AS query_redacted
        FROM pages"""
)
def q_url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", redact_url(F.col("url")).alias("r")).select("page_id", "r.*")
