"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution merges small shuffle partitions and splits skewed ones at run time,
# so the shuffle partition count is left to the cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # Recording the calling line of every column expression costs more than building wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_written: list[str] = []


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder in ``spark.checkpoint.dir``, which all executors share.

    A session without that setting must run in one process, where a temporary folder will do; it goes when the
    process ends. On a cluster the setting is required, since executors can't see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.local.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("plumbline.local.scratch", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table that this process stored in the scratch folder. Results that read them must be stored before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared scratch folder once and read it back.

    Meant for tables that several passes read: the passes then start from Parquet, also after an
    executor is lost, instead of computing joins and aggregations again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
