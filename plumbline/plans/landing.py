"""A landing folder: every file goes through the full run of every blueprint, with a ledger of the outcomes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.blueprints import get_blueprint
from plumbline.plans.run import run_blueprint
from plumbline.sources.files import read_csv

LEDGER = "file string, blueprint string, status string, n_rows bigint, error string"
FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def _pair(path: str, blueprint: str) -> str:
    return hashlib.sha1(f"{blueprint}\n{path}".encode()).hexdigest()


def _run(spark: SparkSession, file: str, path: str, name: str, as_of: Column, out: str, options: dict) -> tuple:
    try:
        df = read_csv(spark, path, schema=get_blueprint(name).struct_type())
        result = run_blueprint(df, name, as_of, **options)
        result.table.write.mode("overwrite").parquet(f"{out}/{name}/{_pair(path, name)}")
        return file, name, "completed", df.count(), None
    except Exception as error:  # a file that fails is an outcome and does not stop the others
        return file, name, "failed", None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


def process_landing(
    spark: SparkSession, folder: str, blueprints: Sequence[str], as_of: Column, out: str, ledger: str, *, files_per_trigger: int = 20, **options
) -> DataFrame:
    """Run the CSV files in and below ``folder`` that have come since the last call; the ledger of all files so far is returned.

    One row per (file, blueprint): ``completed`` with the rows read, or ``failed`` with the error. A file's table goes to a folder
    of its own below ``out/<blueprint>``, its outcome to one below ``ledger``, both named by (path, blueprint), so a
    batch that is run again after it was killed replaces what it had written. Which files were taken is kept by the file stream's
    checkpoint in ``ledger``; a trigger takes ``files_per_trigger`` files, so the driver never holds more paths. ``options`` go to
    ``run_blueprint``.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("maxFilesPerTrigger", files_per_trigger)
    files = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder)

    root = folder.rstrip("/").rsplit("/", 1)[-1]

    def run(batch: DataFrame, number: int) -> None:
        for path in sorted(r["path"] for r in batch.select("path").collect()):
            for name in blueprints:
                row = _run(spark, path.split(f"{root}/", 1)[-1], path, name, as_of, out, options)
                spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").json(f"{ledger}/outcomes/pair={_pair(path, name)}")

    writer = files.select("path").writeStream.option("checkpointLocation", f"{ledger}/state").trigger(availableNow=True)
    writer.foreachBatch(run).start().awaitTermination()
    return read_ledger(spark, ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/outcomes")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{ledger}/outcomes").select("file", "blueprint", "status", "n_rows", "error")
