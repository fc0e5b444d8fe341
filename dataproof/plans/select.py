"""Bounded read-only SQL over registered tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dataproof.plans.read_only import check_analyzed, check_parsed
from dataproof.plans.tables import register

DEFAULT_ROWS = 1000
MAX_RESULT_BYTES = 5 * 1024 * 1024


@dataclass(frozen=True)
class FetchedRows:
    columns: tuple[str, ...]
    rows: tuple[Row, ...]
    row_count: int
    truncated: bool
    deterministic: bool


@dataclass(frozen=True)
class SelectResult:
    """``df`` has at most ``row_limit`` rows. ``deterministic`` means the outermost rows are ordered."""

    df: DataFrame
    deterministic: bool
    row_limit: int
    _query: DataFrame
    max_bytes: int

    def truncated(self) -> bool:
        """Whether the query has more rows than the limit; reads one row beyond it at most."""
        return self._query.limit(self.row_limit + 1).count() > self.row_limit

    def fetch(self, timeout_seconds: float | None = None) -> FetchedRows:
        """Bring the bounded result to the driver, after the executors have measured it."""
        bounded = self._query.limit(self.row_limit + 1)
        names = [f"c{i}" for i in range(len(bounded.columns))]
        size = F.octet_length(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).cast("bigint")
        measured = _collect(bounded.toDF(*names).agg(F.coalesce(F.sum(size), F.lit(0)).alias("size")), timeout_seconds)
        if measured[0]["size"] > self.max_bytes:
            raise ValueError(f"The result takes more than {self.max_bytes} bytes; ask for fewer rows or columns")
        found = _collect(bounded, timeout_seconds)
        rows = found[: self.row_limit]
        return FetchedRows(
            tuple(bounded.columns), tuple(rows), len(rows), len(found) > self.row_limit, self.deterministic
        )


def _collect(df: DataFrame, timeout_seconds: float | None) -> list[Row]:
    if timeout_seconds is None:
        return df.collect()
    context = df.sparkSession.sparkContext
    tag = f"dataproof-{uuid.uuid4().hex}"
    expired = threading.Event()

    def interrupt() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_seconds, interrupt)
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as error:
        if expired.is_set():
            raise TimeoutError(f"Query exceeded {timeout_seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def safe_select(
    spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, row_limit: int = DEFAULT_ROWS, *, max_bytes: int | None = None
) -> SelectResult:
    """Check a query against the read-only policy and plan it with a row limit.

    The query itself is ordinary Spark SQL over whole tables; only its result is bounded. An
    ordered query with its limit becomes a distributed top-n.
    """
    if isinstance(row_limit, bool) or not isinstance(row_limit, int) or row_limit < 1:
        raise ValueError("row limit must be a positive integer")
    session = register(spark, tables)
    text, deterministic = check_parsed(session, sql, set(tables))
    query = session.sql(text)
    check_analyzed(query, set(tables))
    return SelectResult(query.limit(row_limit), deterministic, row_limit, query, MAX_RESULT_BYTES if max_bytes is None else max_bytes)
