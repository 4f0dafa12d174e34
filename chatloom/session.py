"""Session settings, checkpoints and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count shows at most so many rows.
BROADCAST_ROWS = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is made only where none is set (tests)."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc.getCheckpointDir()
    if now:
        return now
    own = own or os.path.join(tempfile.gettempdir(), "chatloom-checkpoints")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df is proven to have at most ``rows`` rows; else leave the join to AQE.

    The probe reads at most rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def apart(df: DataFrame) -> DataFrame:
    """df behind an operator that takes no part in code generation, so that what comes before and after
    it becomes methods of its own. The JVM compiles no method of more than 8,000 bytes, and long
    projections that are fused into one run interpreted. Partitions stay as they are."""
    return df.coalesce(1 << 30)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(app: str = "chatloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
