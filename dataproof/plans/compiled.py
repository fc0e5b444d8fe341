"""Plans over many computed columns whose generated code the JVM still compiles."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: HotSpot leaves methods of more bytes uncompiled, and runs them some ten times slower.
HUGE_METHOD = 8000


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within it, stages whose code would be one huge method run operator by operator instead, each cut into small ones."""
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(min(HUGE_METHOD, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)
