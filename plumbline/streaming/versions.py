"""Fitted steps that are refreshed while a stream runs: each micro-batch takes the newest version, and its rows say which.

A version is a list of fitted steps (``clean.save_model``) in a folder of its own and a row in an index that is written
last, so a half-written version is never seen. A batch notes its version before it writes a row; when it is run again after a
failure it takes the noted one, so a result never depends on how often a batch ran. Parameters are a few numbers or
dictionary tables, so loading costs the same at any size of the stream.

Defined results: a stream that starts before any version was published raises; an empty batch writes no row and still
notes its version; rows with missing values go through the steps as in batch; ``model_version`` is reserved. If two writers take the
same number at once, each batch still notes which of the two folders it used.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.clean import load_model, save_model

VERSION = "model_version"
INDEX = "version int, folder string, n_steps int"


@dataclass
class StepVersions:
    """Versions of a chain of fitted steps below ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str
    _loaded: dict[str, list] = field(default_factory=dict)

    def _index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).json(f"{self.root}/index/*.json")

    def latest(self) -> tuple[int, str, int] | None:
        """Number, folder and count of steps of the newest version."""
        try:
            row = self._index().orderBy(F.desc("version"), "folder").first()
        except AnalysisException:  # nothing published yet
            return None
        return tuple(row) if row else None

    def publish(self, steps: Sequence) -> int:
        """Store ``steps`` as the next version. Batches that start later use it."""
        newest, folder = StepVersions.latest(self), uuid.uuid4().hex
        version = (newest[0] if newest else 0) + 1
        for i, step in enumerate(steps):
            save_model(step, self.spark, f"{self.root}/steps/{folder}/{i}")
        row = self.spark.createDataFrame([(version, folder, len(steps))], INDEX)
        row.coalesce(1).write.mode("append").json(f"{self.root}/index")
        return version

    def steps(self, folder: str, n_steps: int) -> list:
        """The steps of a version; the last one read is kept in the driver."""
        if folder not in self._loaded:
            self._loaded = {folder: [load_model(self.spark, f"{self.root}/steps/{folder}/{i}") for i in range(n_steps)]}
        return self._loaded[folder]


@dataclass
class VersionedRun:
    """A stream through the newest steps into ``out``: rows in ``out/rows``, the version of each batch in ``out/versions``."""

    versions: StepVersions
    out: str

    def noted(self, spark: SparkSession, batch_id: int) -> tuple[int, str, int] | None:
        try:
            row = spark.read.schema(INDEX).parquet(f"{self.out}/versions/batch_id={batch_id}").first()
        except AnalysisException:
            return None
        return tuple(row) if row else None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Running it again replaces its own rows by the same ones."""
        spark = batch.sparkSession
        use = self.noted(spark, batch_id)
        if use is None:
            use = self.versions.latest()
            if use is None:
                raise ValueError(f"no version of the steps in {self.versions.root}")
            spark.createDataFrame([use], INDEX).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/versions/batch_id={batch_id}")
        version, folder, n_steps = use
        for step in self.versions.steps(folder, n_steps):
            batch = step.transform(batch)
        batch.withColumn(VERSION, F.lit(version)).write.mode("overwrite").parquet(f"{self.out}/rows/batch_id={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Run over all that is available now or, with ``every``, on and on at that interval."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with ``model_version`` and ``batch_id``."""
        return spark.read.parquet(f"{self.out}/rows").withColumn("batch_id", F.col("batch_id").cast(T.LongType()))

    def used(self, spark: SparkSession) -> DataFrame:
        """``batch_id`` and ``version``, also of batches without rows."""
        return spark.read.parquet(f"{self.out}/versions").select(F.col("batch_id").cast("long").alias("batch_id"), "version")
