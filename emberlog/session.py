"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    # Offset-less timestamps are UTC and a day partition is a UTC day.
    "spark.sql.session.timeZone": "UTC",
    # Int64 timestamps carry min/max statistics and accept pushed filters; the
    # default INT96 does neither.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # A repeated JSON key keeps its last value instead of failing the whole body.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    A machine-local folder is only chosen for a local master, where driver and
    executors are one process; elsewhere the setting has to name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="emberlog-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
