"""Sources and sinks that need no external system."""

import pytest

from spanflow.session import checkpoint_dir, file_system, shared_root
from spanflow.sources.jdbc import Partitioning, jdbc_options
from spanflow.sources.tables import drop_stages, fingerprint, resumable, stage


def test_stage_writes_under_checkpoint_dir_and_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    out = stage(df)
    assert sorted(r["twice"] for r in out.collect()) == [2 * i for i in range(100)]
    files = out.inputFiles()
    assert files and all(checkpoint_dir(spark).rstrip("/").split(":")[-1] in f for f in files)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_restarted_job_reads_its_stage(spark, tmp_path):
    src = f"file://{tmp_path}/numbers"
    spark.range(50).write.parquet(src)

    def job(factor=2):
        return spark.read.parquet(src).selectExpr("id", f"id * {factor} AS x")

    first = resumable(job(), "test-owner")
    again = resumable(job(), "test-owner")
    assert first.inputFiles() == again.inputFiles() and again.count() == 50
    assert "id * 2" not in again._jdf.queryExecution().optimizedPlan().toString()
    other = resumable(job(3), "test-owner")  # another plan
    assert set(other.inputFiles()).isdisjoint(first.inputFiles())
    spark.range(60).write.mode("overwrite").parquet(src)  # another input
    assert resumable(job(), "test-owner").count() == 60
    drop_stages(spark, "test-owner")
    fs, path = file_system(spark, f"{shared_root(spark)}/stages/test-owner")
    assert not fs.exists(path)


def test_half_written_stages_are_ignored(spark):
    df = spark.range(30).selectExpr("id % 3 AS k").groupBy("k").count()
    root = f"{shared_root(spark)}/stages/half/{fingerprint(df)}"
    spark.range(7).write.parquet(f"{root}/attempt-died")  # a run that ended before its marker
    assert resumable(df, "half").count() == 3
    drop_stages(spark, "half")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": "file:/w"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_root(Session())


def test_jdbc_options_partitioned_and_pushed_predicate():
    o = jdbc_options("jdbc:postgresql://db/x", "keys", driver="org.postgresql.Driver", user="u", password="p",
                     partition=Partitioning("user_id", 0, 1000, 8), fetch_size=5000, predicate="time > '2017-11-27'")
    assert o["partitionColumn"] == "user_id" and o["lowerBound"] == "0" and o["upperBound"] == "1000"
    assert o["numPartitions"] == "8" and o["fetchsize"] == "5000"
    assert o["dbtable"] == "(SELECT * FROM keys WHERE time > '2017-11-27') AS src"
    plain = jdbc_options("jdbc:x", "keycodes")
    assert plain == {"url": "jdbc:x", "dbtable": "keycodes"}


def test_jdbc_options_reject_bad_partitioning():
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition=Partitioning("id", 10, 1, 4))
