"""Session construction and shared-storage helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  The time zone is pinned because calendar
# features and timestamp casts depend on it; AQE re-plans joins from runtime
# sizes (broadcast only what was measured small) and splits skewed join
# partitions.  The run stage expands every shuffled run row into events,
# matches and markers and sorts them three times, so its cost per shuffled
# byte is high: coalescing must not merge small shuffles into a single task
# (the minimum partition size only matters for tiny inputs).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "spanflow",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the defaults above.

    ``master`` is only used when building (tests and local benchmarks); on a
    cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # Session-level settings also apply when the session already existed.
    spark.conf.set("spark.sql.session.timeZone", settings["spark.sql.session.timeZone"])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (master ``local``) uses a folder
    of its SQL warehouse; on a cluster there is no folder that every executor is
    known to see, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set; it must name storage that driver and executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return d.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder for lineage cuts, under :func:`shared_root`."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(spark))  # creates a sub-folder
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system of a path, the path as its object)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str | None = None) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{name or uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table this application has staged.

    Call it when no frame that reads a staged table is needed any more.
    """
    fs, path = file_system(spark, scratch_root(spark))
    fs.delete(path, True)
