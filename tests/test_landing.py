"""The landing folder: outcomes by file, files that come later, and batches that are run again."""

import glob
import json
import shutil

from pyspark.sql import functions as F

from plumbline.operators.quality import Completeness
from plumbline.plans.landing import process_landing, read_ledger
from plumbline.sources.tables import as_of_column, churn_base

SF = "/root/testdata/sf0.001"


def test_files_are_taken_once_and_bad_ones_stop_no_other(spark, tmp_path):
    folder, out, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")
    folder.mkdir()
    assert read_ledger(spark, ledger).count() == 0
    rows = churn_base(spark, SF).where("last_activity_date is not null").orderBy("customer_id").toPandas()
    rows.to_csv(folder / "b good.csv", index=False)
    (folder / "a bad.csv").write_text("nothing,of,use\n1,2,3\n")

    def run():
        return {r.file: (r.status, r.n_rows) for r in process_landing(spark, str(folder), ["customer_churn"], as_of_column(), out, ledger, rules=[Completeness()]).collect()}

    first = run()
    assert first == {"a bad.csv": ("failed", None), "b good.csv": ("completed", len(rows))}
    tables = glob.glob(f"{out}/customer_churn/*")
    assert len(tables) == 1
    before = spark.read.parquet(tables[0]).agg(F.count("*"), F.sum(F.xxhash64("*") % 1000)).first()
    # A killed batch: the checkpoint forgets it, and all its files are run again.
    shutil.rmtree(f"{ledger}/state")
    (folder / "c bad.csv").write_text("x\n")
    assert run() == {**first, "c bad.csv": ("failed", None)}
    assert glob.glob(f"{out}/customer_churn/*") == tables
    assert spark.read.parquet(tables[0]).agg(F.count("*"), F.sum(F.xxhash64("*") % 1000)).first() == before
    assert all(r.error for r in read_ledger(spark, ledger).where("status = 'failed'").collect())
    # Nothing new: nothing is run.
    stamps = {f: json.dumps(sorted(glob.glob(f"{f}/*"))) for f in glob.glob(f"{ledger}/outcomes/*")}
    run()
    assert stamps == {f: json.dumps(sorted(glob.glob(f"{f}/*"))) for f in glob.glob(f"{ledger}/outcomes/*")}
