"""The read-only policy: what is rejected, what is accepted, and what is called ordered."""

from __future__ import annotations

import re
import time

import pytest

from dataproof import PolicyError, safe_select
from dataproof.plans import read_only, select

# Statements that the policy has to reject or accept.
REJECTED = [
    "DELETE FROM dataset",
    "UPDATE dataset SET value = 1",
    "INSERT INTO dataset VALUES (3, 30)",
    "DROP VIEW dataset",
    "CREATE TABLE t AS SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO dataset SELECT * FROM a",
    "SELECT * FROM dataset; SELECT * FROM dataset",
    "SELECT * FROM csv.`/etc/passwd`",
    "SELECT * FROM text.`/etc/passwd`",
    "SELECT * FROM binaryFile.`/etc`",
    "SELECT * FROM read_files('/etc/passwd')",
    "SELECT * FROM information_schema.tables",
    'SELECT * FROM "information_schema"."tables"',
    "SELECT * FROM system.main.dataset",
    "SELECT * FROM default.dataset",
    "SELECT * FROM global_temp.dataset",
    "SELECT * FROM spark_catalog.default.dataset",
    "SELECT * FROM other",
    "SELECT * FROM dataset WHERE EXISTS (SELECT 1 FROM other)",
    "SELECT (SELECT max(id) FROM other) FROM dataset",
    "SELECT * FROM range(2)",
    "SELECT * FROM (SELECT * FROM range(2))",
    "SELECT * FROM dataset JOIN range(2) AS generated ON true",
    "SELECT * FROM dataset, LATERAL explode(array(1, 2)) AS generated(i)",
    "SELECT * FROM dataset LATERAL VIEW explode(array(1, 2)) generated AS i",
    "SELECT * FROM TABLE(explode(array(1)))",
    "SELECT TRANSFORM(id) USING 'cat' FROM dataset",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT java_method('java.util.UUID', 'randomUUID')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT input_file_name() FROM dataset",
    "SELECT version()",
    "SELECT current_database()",
    "SELECT current_catalog()",
    "SELECT spark_partition_id() FROM dataset",
    "SHOW TABLES",
    "DESCRIBE dataset",
    "EXPLAIN SELECT 1",
    "SET spark.sql.ansi.enabled=false",
    "RESET",
    "USE default",
    "CACHE TABLE dataset",
    "ADD JAR '/tmp/x.jar'",
    "CALL something()",
    "TABLE dataset",
    "VALUES (1)",
    "FROM dataset SELECT id",
    "FROM dataset |> WHERE id > 1",
    "BEGIN SELECT 1; END",
    "SELECT * FROM IDENTIFIER('dataset')",
    "SELECT * FROM dataset VERSION AS OF 1",
    "SELECT 'unterminated",
    "SELECT * FROM dataset DISTRIBUTE BY id",
    "",
    "  -- nothing\n",
    "SELECT '\0'",
    "SELECT " + "1," * 10_000 + "1",
]

VOLATILE = [
    "SELECT rand()",
    'SELECT "rand"()',
    "SELECT random()",
    "SELECT randn()",
    "SELECT uniform(1, 5)",
    "SELECT randstr(5)",
    "SELECT uuid()",
    'SELECT "uuid"()',
    "SELECT shuffle(array(1, 2))",
    "SELECT monotonically_increasing_id() FROM dataset",
    "SELECT now()",
    'SELECT "now"()',
    "SELECT system.builtin.now()",
    "SELECT CURRENT_TIMESTAMP",
    "SELECT current_timestamp()",
    'SELECT "current_timestamp"()',
    "SELECT CURRENT_DATE",
    "SELECT current_date()",
    "SELECT curdate()",
    "SELECT CURRENT_TIME",
    "SELECT localtimestamp()",
    "SELECT unix_timestamp()",
    "SELECT CURRENT_USER",
    "SELECT session_user()",
    "SELECT user",
    "SELECT current_timezone()",
    "SELECT id FROM dataset ORDER BY rand()",
    "SELECT id FROM dataset WHERE id IN (SELECT rand())",
    "WITH a AS (SELECT rand() AS r) SELECT * FROM a ORDER BY r",
    "SELECT rank() OVER w FROM dataset WINDOW w AS (ORDER BY rand())",
    "SELECT CASE WHEN now() > TIMESTAMP '2024-01-01' THEN 1 END",
    "SELECT * FROM dataset TABLESAMPLE (1 ROWS)",
    "SELECT * FROM dataset TABLESAMPLE (10 PERCENT)",
    "SELECT * FROM dataset TABLESAMPLE (BUCKET 1 OUT OF 2)",
]

ACCEPTED = [
    "SELECT 1",
    "SELECT * FROM dataset",
    "select id from DATASET;",
    "/* SELECT now() */ SELECT 'now()' AS t -- rand()",
    "WITH totals AS (SELECT sum(value) AS value FROM dataset) SELECT * FROM totals",
    "WITH dataset2 AS (SELECT * FROM dataset) SELECT * FROM dataset2 JOIN dataset USING (id)",
    "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 3) SELECT * FROM n",
    "SELECT explode(array(1, 2)) AS i FROM dataset",
    "SELECT * FROM (VALUES (1), (2)) AS t(x)",
    "SELECT collect_list(id), first(id), max_by(id, value) FROM dataset",
    "SELECT * FROM dataset PIVOT (sum(value) FOR id IN (1, 2))",
    "SELECT * FROM dataset UNPIVOT (v FOR n IN (id, value))",
    "SELECT d.id, l.v FROM dataset d JOIN LATERAL (SELECT d.value + 1 AS v) l ON true",
    "SELECT id FROM dataset UNION SELECT value FROM dataset EXCEPT SELECT 1 INTERSECT SELECT 2",
    "SELECT id, count(*) FROM dataset GROUP BY CUBE (id) HAVING count(*) > 0 ORDER BY ALL LIMIT 5 OFFSET 1",
    "SELECT unix_timestamp(TIMESTAMP '2024-01-01') AS t",
]


@pytest.fixture(scope="module")
def tables(spark):
    return {"dataset": spark.createDataFrame([(2, 20), (1, 10), (3, 30)], "id bigint, value bigint")}


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(spark, tables, sql):
    with pytest.raises(PolicyError):
        safe_select(spark, tables, sql)


@pytest.mark.parametrize("sql", VOLATILE)
def test_volatile(spark, tables, sql):
    with pytest.raises(PolicyError, match="volatile or non-reproducible"):
        safe_select(spark, tables, sql)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, tables, sql):
    assert safe_select(spark, tables, sql).df.collect() is not None


def test_columns_named_like_functions(spark):
    df = spark.createDataFrame(
        [(1, "a", 2, 3, 4), (2, "b", 3, 4, 5)], "random int, uuid string, now int, current_timestamp int, query int"
    )
    sql = 'SELECT "random", "uuid", "now", "current_timestamp", "query" FROM dataset ORDER BY "random"'
    fetched = safe_select(spark, {"dataset": df}, sql).fetch()
    assert fetched.row_count == 2 and fetched.deterministic
    assert [tuple(row) for row in fetched.rows][0] == (1, "a", 2, 3, 4)


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT id, value FROM dataset", False),
        ("SELECT id, value FROM dataset ORDER BY id", True),
        ("WITH o AS (SELECT id FROM dataset ORDER BY id) SELECT * FROM o", False),
        ("SELECT id, row_number() OVER (ORDER BY id) AS position FROM dataset", False),
        ("WITH r AS (SELECT id FROM dataset) SELECT * FROM r ORDER BY id", True),
        ("SELECT id FROM dataset SORT BY id", False),
        ("SELECT id FROM dataset ORDER BY id LIMIT 2 OFFSET 1", True),
        ("SELECT id FROM (SELECT id FROM dataset ORDER BY id)", False),
    ],
)
def test_ordered_flag(spark, tables, sql, expected):
    assert safe_select(spark, tables, sql).deterministic is expected


def test_row_limit(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id bigint")
    result = safe_select(spark, {"dataset": df}, "SELECT * FROM dataset ORDER BY id", 2)
    fetched = result.fetch()
    assert [row["id"] for row in fetched.rows] == [1, 2] and fetched.truncated and result.truncated()
    assert not safe_select(spark, {"dataset": df}, "SELECT * FROM dataset", 4).fetch().truncated
    assert safe_select(spark, {"dataset": df}, "SELECT * FROM dataset", 10**9).row_limit == 10**9
    with pytest.raises(ValueError, match="more than 10 bytes"):
        safe_select(spark, {"dataset": df}, "SELECT * FROM dataset", 4, max_bytes=10).fetch()
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError, match="positive integer"):
            safe_select(spark, {"dataset": df}, "SELECT 1", bad)


def test_ordered_limit_is_a_distributed_top_n(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = safe_select(spark, {"orders": orders}, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice", 10).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(o_totalprice), GreaterThan" in plan


def test_table_names(spark, tables):
    for name in ("Bad", "1a", "a-b", "a" * 64, ""):
        with pytest.raises(ValueError, match="cannot be a table name"):
            safe_select(spark, {name: tables["dataset"]}, "SELECT 1")
    with pytest.raises(ValueError, match="one table"):
        safe_select(spark, {}, "SELECT 1")


def test_nothing_is_left_behind(spark, tables):
    before = spark.sql("SHOW VIEWS IN global_temp").count()
    ansi = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    safe_select(spark, tables, "SELECT * FROM dataset").fetch()
    assert spark.sql("SHOW VIEWS IN global_temp").count() == before
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == ansi
    assert not spark.catalog.tableExists("dataset")


def test_a_registered_table_may_have_any_origin(spark):
    from pyspark.sql import functions as F

    df = spark.range(3).withColumn("r", F.rand(1))
    assert safe_select(spark, {"dataset": df}, "SELECT count(r) AS n FROM dataset").fetch().rows[0]["n"] == 3


def test_result_size(spark, monkeypatch, tables):
    monkeypatch.setattr(select, "MAX_RESULT_BYTES", 20)
    with pytest.raises(ValueError, match="more than"):
        safe_select(spark, tables, "SELECT * FROM dataset").fetch()


def test_timeout(spark):
    df = spark.range(0, 20_000_000_000, 1, 4000)  # many short tasks: no more are started once interrupted
    started = time.time()
    with pytest.raises(TimeoutError):
        safe_select(spark, {"dataset": df}, "SELECT sum(hash(id)) AS h FROM dataset").fetch(timeout_seconds=1)
    assert time.time() - started < 30
    assert safe_select(spark, {"dataset": spark.range(2)}, "SELECT * FROM dataset").fetch(timeout_seconds=60).row_count == 2


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret)",
        "WITH a AS (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) SELECT * FROM secret",
        "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS x) SELECT * FROM a",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT (SELECT max(a) FROM secret) AS m, id FROM dataset",
    ],
)
def test_names_of_other_scopes_are_not_tables(spark, sql):
    df = spark.createDataFrame([(1,)], "id bigint")
    with pytest.raises(PolicyError):
        safe_select(spark, {"dataset": df}, sql)


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("WITH a AS (SELECT id FROM dataset), b AS (SELECT id + 1 AS id FROM a) SELECT * FROM b", 1),
        ("WITH dataset AS (SELECT 5 AS id) SELECT * FROM dataset", 1),
        ("WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (WITH b AS (SELECT x FROM a) SELECT x FROM b)", 1),
    ],
)
def test_names_in_scope_are_tables(spark, sql, rows):
    df = spark.createDataFrame([(1,)], "id bigint")
    assert safe_select(spark, {"dataset": df}, sql).df.count() == rows


@pytest.mark.parametrize("word", ["now", "today", "tomorrow", "yesterday"])
@pytest.mark.parametrize("form", ["DATE '{}'", "TIMESTAMP ' {} '", "CAST('{}' AS TIMESTAMP)", "CAST(concat('', '{}') AS DATE)", "to_date('{}')"])
def test_words_for_the_clock(spark, form, word):
    df = spark.createDataFrame([(1,)], "id bigint")
    if word == "now" and form.startswith("DATE"):
        word = "NOW"
    with pytest.raises(PolicyError):
        safe_select(spark, {"dataset": df}, f"SELECT {form.format(word)} AS t, id FROM dataset")


def test_ordinary_dates_are_allowed(spark):
    df = spark.createDataFrame([(1, "now")], "id bigint, word string")
    sql = "SELECT DATE '2024-01-01' AS d, TIMESTAMP '2024-01-01 00:00:00' AS t, CAST('2024-01-01' AS DATE) AS c, 'today' AS w FROM dataset"
    assert safe_select(spark, {"dataset": df}, sql).df.count() == 1


def built_in_functions(spark):
    """Names, groups and examples of all functions that Spark has."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    names = registry.listFunction().iterator()
    while names.hasNext():
        name = names.next()
        info = registry.lookupFunction(name).get()
        yield name.funcName(), info.getGroup(), re.findall(r"> (SELECT.*?);\n", info.getExamples() + "\n", re.DOTALL)


def test_every_built_in_function_is_refused_or_repeatable(spark, tables):
    """Examples of allowed functions give the same rows in two runs, dealt over other numbers of tasks."""
    refused, tried = set(), set()
    for name, group, examples in built_in_functions(spark):
        allowed = True
        try:
            read_only._check_function(spark, name)
        except PolicyError:
            allowed = False
            refused.add(name)
        for sql in examples[:2]:
            try:
                runs = []
                for parts in (1, 8):
                    spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
                    runs.append(safe_select(spark, tables, sql).df.toJSON().collect())
            except Exception:
                continue  # Examples that are refused, need other tables, or show an error.
            finally:
                spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            if allowed:
                tried.add(name)
                assert sorted(runs[0]) == sorted(runs[1]), (name, sql)
    assert len(tried) > 350
    # Of the groups that are allowed, exactly these are left out.
    kept_out = {n for n, g, _ in built_in_functions(spark) if g in read_only.REPEATABLE_GROUPS} & refused
    assert {n for n in kept_out if not read_only.UNSTABLE_AGGREGATES.fullmatch(n)} == {
        "curdate", "current_date", "current_time", "current_timestamp", "current_timezone", "localtimestamp", "now", "rand", "randn",
        "random", "randstr", "shuffle", "uniform",
    }


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT hex(aes_encrypt('Spark','0000111122223333')) FROM t",
        "SELECT kll_sketch_agg_bigint(id) FROM t",
        "SELECT kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(id), 0.5) FROM t",
        "SELECT percentile_approx(id, 0.5) FROM t",
        "SELECT hll_sketch_estimate(hll_sketch_agg(id)) FROM t",
        "SELECT system.builtin.aes_encrypt('Spark','0000111122223333') FROM t",
        "SELECT my_own(id) FROM t",
        "SELECT my_own_python(id) FROM t",
        "SELECT upper('a'), no_such_function(id) FROM t",
    ],
)
def test_functions_outside_of_the_allow_list(spark, sql):
    spark.udf.register("my_own_python", lambda x: x)
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS my_own")
    spark.sql("CREATE TEMPORARY FUNCTION my_own(x BIGINT) RETURNS BIGINT RETURN x + 1")
    with pytest.raises(PolicyError, match="volatile or non-reproducible"):
        safe_select(spark, {"t": spark.range(3)}, sql)
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS my_own")
