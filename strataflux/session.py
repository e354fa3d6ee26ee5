"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# What the jobs rely on: AQE splits skewed join partitions and merges small
# ones, so the shuffle count can be set high on a cluster. Arrow carries the
# few pandas functions. The JVM leaves methods over 8,000 bytes uncompiled, so
# wide projections are better off split than fused into one such method.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "strataflux", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_wide_code(spark: SparkSession) -> None:
    """Wide projections of this session run as small methods, which the JVM compiles, whoever built the session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", SETTINGS["spark.sql.codegen.hugeMethodLimit"])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: `spark.checkpoint.dir` when the cluster names one.

    Only where the setting is absent and the master is local (tests, a laptop) a
    local folder is made; on a cluster executors would not share it, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    fallback = os.environ.get("STRATAFLUX_LOCAL_SCRATCH")
    if not fallback:
        fallback = tempfile.mkdtemp(prefix="strataflux-")
        os.environ["STRATAFLUX_LOCAL_SCRATCH"] = fallback
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or removed here."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise through `checkpoint()` in the shared folder, never on an executor's own disk."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
