"""Partitions by the size of the input, so that a task's share does not grow with the data.

An exchange of Spark's own has a fixed number of partitions, and adaptive
execution joins small ones up to a size in shuffled bytes.  Where every shuffled
row becomes many rows of a sort, as in the run stage, that size is too large;
there the number of partitions follows from the bytes of the input files.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

from spanflow.session import file_system

#: Bytes of input files (compressed) for one partition of a run-keyed exchange.
INPUT_BYTES = 1 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, each once; 0 for a frame without files and for a stream."""
    if df.isStreaming:
        return 0
    folders: dict[str, set[str]] = {}
    for f in df.inputFiles():
        folders.setdefault(f.rsplit("/", 1)[0], set()).add(f.rsplit("/", 1)[1])
    total = 0
    for folder, names in folders.items():
        fs, path = file_system(df.sparkSession, folder)
        for status in fs.listStatus(path):
            if status.getPath().toUri().getRawPath().rsplit("/", 1)[1] in names:
                total += status.getLen()
    return total


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over so many partitions that none has more than its share of the input; a small input is left as it is."""
    n = ceil(input_bytes(df) / INPUT_BYTES)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over more partitions than there are cores, also where it is small: for rows that cost far more than their bytes tell."""
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, ceil(input_bytes(df) / INPUT_BYTES))
    return df.repartition(n, *keys)
