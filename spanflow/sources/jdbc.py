"""JDBC sources.

A partitioned read splits the table on a numeric column into ``num_partitions``
ranges between ``lower`` and ``upper`` (rows outside still land in the first
and last range), each read by its own task with ``fetch_size`` rows per round
trip.  Filters given as ``predicate`` become the WHERE clause of the pushed
query, so the database returns only what the job keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Partitioning:
    column: str
    lower: int
    upper: int
    num_partitions: int


def jdbc_options(url: str, table: str, *, driver: str | None = None, user: str | None = None,
                 password: str | None = None, partition: Partitioning | None = None,
                 fetch_size: int | None = None, predicate: str | None = None) -> dict[str, str]:
    """Reader options; ``predicate`` wraps the table in a filtering subquery."""
    src = f"(SELECT * FROM {table} WHERE {predicate}) AS src" if predicate else table
    opts = {"url": url, "dbtable": src}
    if driver:
        opts["driver"] = driver
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition is not None:
        if partition.num_partitions < 1 or partition.upper < partition.lower:
            raise ValueError("invalid JDBC partitioning")
        opts.update({"partitionColumn": partition.column, "lowerBound": str(partition.lower),
                     "upperBound": str(partition.upper), "numPartitions": str(partition.num_partitions)})
    if fetch_size:
        opts["fetchsize"] = str(fetch_size)
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    """``spark.read.format("jdbc")`` with :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kw)).load()
