"""Named tables in a session of their own."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLE_NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")

# Settings of the isolated session. Double quotes name columns, files cannot
# be queried as tables.
_ISOLATED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
}
_COPIED_CONF = (
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.caseSensitive",
)


def check_names(tables: Mapping[str, DataFrame]) -> None:
    if not tables:
        raise ValueError("give one table at least")
    for name in tables:
        if not TABLE_NAME.fullmatch(name):
            raise ValueError(f"{name} cannot be a table name")


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A new session that sees exactly the given tables, under the given names.

    Temporary views do not cross sessions, so each table passes through a global view with a
    random name, which is dropped as soon as the new session has resolved it.
    """
    check_names(tables)
    session = spark.newSession()
    for key in _COPIED_CONF:
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    for key, value in _ISOLATED_CONF.items():
        session.conf.set(key, value)
    for name, df in tables.items():
        bridge = f"dataproof_{uuid.uuid4().hex}"
        df.createGlobalTempView(bridge)
        try:
            session.table(f"global_temp.{bridge}").createOrReplaceTempView(name)
        finally:
            df.sparkSession.catalog.dropGlobalTempView(bridge)
    return session
