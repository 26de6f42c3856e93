"""Catalog tables, lineage stages, and stages that a restarted job finds again."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from spanflow.session import file_system, scratch_path, shared_root

_MARKER = "_committed"


def save_table(df: DataFrame, name: str, mode: str = "overwrite", fmt: str = "parquet",
               partition_by: list[str] | None = None) -> None:
    """Write ``df`` as a managed table (explicit mode: re-runs replace it)."""
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def stage(df: DataFrame, name: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Persist an intermediate result and continue from the written copy.

    With a ``name`` it becomes a catalog table (warehouse storage); without,
    Parquet under the shared ``spark.checkpoint.dir``.  Either way the
    returned frame is a plain scan: lineage is cut, and a lost executor costs a
    re-read, not a recomputation of everything before the stage.
    """
    spark = df.sparkSession
    if name:
        save_table(df, name, mode)
        return spark.table(name)
    path = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
    df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a schema that is known need not be read from the files, which is a job


def fingerprint(df: DataFrame) -> str:
    """A hash of what a frame computes: its plan without expression ids, its schema, and the paths, sizes and times of its input files.

    A plan names a Python function only by its name, so a frame that runs one
    needs the function's version in the stage's owner.
    """
    spark = df.sparkSession
    key = "spark.sql.debug.maxToStringFields"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 30))  # every column counts
    try:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
    parts = [plan, df.schema.json()]
    folders: dict[str, set[str]] = {}
    for f in df.inputFiles():
        folders.setdefault(f.rsplit("/", 1)[0], set()).add(f.rsplit("/", 1)[1])
    for folder, names in sorted(folders.items()):
        fs, path = file_system(spark, folder)
        for status in fs.listStatus(path):
            name = status.getPath().toUri().getRawPath().rsplit("/", 1)[1]
            if name in names:
                parts.append(f"{folder}/{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _stage_root(spark: SparkSession, owner: str) -> str:
    return f"{shared_root(spark)}/stages/{owner}"


def resumable(df: DataFrame, owner: str) -> DataFrame:
    """Stage ``df`` so that a later run of the same job reads it instead of computing it again.

    The stage is named by the frame's fingerprint: another plan, schema or input
    file is another stage.  Every attempt writes a folder of its own, and a marker
    names the attempt that ended; without the marker a half-written stage does not
    count.  Where two runs end at once, the first marker holds.
    """
    spark = df.sparkSession
    root = f"{_stage_root(spark, owner)}/{fingerprint(df)}"
    fs, marker = file_system(spark, f"{root}/{_MARKER}")

    def committed() -> str:
        stream = fs.open(marker)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    if not fs.exists(marker):
        attempt = f"attempt-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{attempt}")
        if not fs.exists(marker):
            out = fs.create(marker, False)
            out.write(attempt.encode())
            out.close()
    return spark.read.parquet(f"{root}/{committed()}")


def drop_stages(spark: SparkSession, owner: str) -> None:
    """Remove all stages of an owner, ended or not."""
    fs, path = file_system(spark, _stage_root(spark, owner))
    fs.delete(path, True)
