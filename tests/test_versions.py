"""Steps refreshed inside a running stream against the same steps applied in batch."""

import pytest

from plumbline.operators import clean as C
from plumbline.session import scratch_path
from plumbline.streaming import jobs as S
from plumbline.streaming.versions import StepVersions, VersionedRun

SCHEMA = "id long, value double, kind string"


def rows(low, high):
    return [(i, float(i % 37) if i % 11 else None, f"k{i % 5}") for i in range(low, high)]


def steps(spark, low, high):
    df = spark.createDataFrame(rows(low, high), SCHEMA)
    scale = C.fit_scale(df, "standard", columns=["value"])
    return [scale, C.fit_encode(scale.transform(df), "label", columns=["kind"])]


def applied(df, chain):
    for step in chain:
        df = step.transform(df)
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture()
def run(spark):
    root = scratch_path(spark, "versions")
    return VersionedRun(StepVersions(spark, f"{root}/steps"), f"{root}/out")


def test_a_version_published_while_the_stream_runs(spark, run, tmp_path):
    """Three files, one a trigger. The second version appears after the first batch has begun."""
    for low in (0, 100, 200):
        spark.createDataFrame(rows(low, low + 100), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first, second = steps(spark, 0, 100), steps(spark, 0, 300)

    class Later(StepVersions):
        asked = 0

        def latest(self):
            found = super().latest()
            self.asked += 1
            if self.asked == 1:
                self.publish(second)
            return found

    run.versions = Later(spark, run.versions.root)
    assert run.versions.publish(first) == 1
    run.start(S.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1), str(tmp_path / "state")).awaitTermination()
    assert {r.batch_id: r.version for r in run.used(spark).collect()} == {0: 1, 1: 2, 2: 2}
    got = run.rows(spark)
    assert got.count() == 300
    for version, chain in ((1, first), (2, second)):
        part = got.where(f"model_version = {version}")
        ids = {r.id for r in part.select("id").collect()}
        want = applied(spark.createDataFrame([r for r in rows(0, 300) if r[0] in ids], SCHEMA), chain)
        assert applied(part.drop("model_version", "batch_id"), []) == want and len(ids) == 100 * version


def test_a_batch_that_runs_again_keeps_its_version(spark, run):
    batch = spark.createDataFrame(rows(0, 50), SCHEMA)
    run.versions.publish(steps(spark, 0, 50))
    run.process(batch, 0)
    before = applied(run.rows(spark), [])
    run.versions.publish(steps(spark, 0, 500))
    run.process(batch, 0)
    assert applied(run.rows(spark), []) == before
    run.process(batch.limit(0), 1)
    assert {r.batch_id: r.version for r in run.used(spark).collect()} == {0: 1, 1: 2} and run.rows(spark).count() == 50


def test_no_version_raises_and_leaves_nothing(spark, run):
    with pytest.raises(ValueError, match="no version"):
        run.process(spark.createDataFrame(rows(0, 5), SCHEMA), 0)
    assert run.noted(spark, 0) is None
