"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def session(app: str = "procscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan in this package assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder: on a cluster that would not outlive the machine that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="procscope-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``materialize`` that also returns the row count, observed while writing."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get["rows"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch area and read it back.

    Used where a result has several consumers or where a loop would otherwise double its plan.
    Unlike a cached block the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``tables``, once nothing reads them any more: every plan
    over them has been written or collected."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            p.getFileSystem(conf).delete(p, True)
