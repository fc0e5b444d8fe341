"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "dataproof", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Shuffle partitions are left to the cluster: adaptive execution coalesces them, so the
    configured number is an upper bound rather than the number of tasks.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared folder, for tables written between steps.

    The folder the cluster names in ``spark.checkpoint.dir`` is used, or else the warehouse,
    which all executors share as well. All folders of an application lie in one, which its owner
    can drop when the application has ended.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"
