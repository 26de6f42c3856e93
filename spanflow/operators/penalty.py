"""Per-run penalties and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.functions.metrics import percentage, seconds
from spanflow.operators.islands import FAMILIES
from spanflow.operators.sequences import RUN_KEYS


def per_run(islands: DataFrame, families: Sequence[str] = tuple(FAMILIES),
            keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Sum island penalties per run, one column ``penalty_<family>_us`` per
    family, in one conditional aggregation; a family without islands in a run
    is null there."""
    aggs = [F.sum(F.when(F.col("family") == f, F.col("penalty_us"))).alias(f"penalty_{f}_us")
            for f in families]
    return islands.groupBy(*keys).agg(*aggs)


def run_metrics(runs: DataFrame, penalties: DataFrame, families: Sequence[str] = tuple(FAMILIES),
                keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Runs of positive duration with ``task_time`` and, per family,
    ``penalty_<f>`` (seconds) and ``percentage_<f>`` (100 * penalty / task time).

    The duration filter is applied before dividing, so no division by zero is
    ever evaluated; runs without islands keep null penalties (left join).
    """
    keys = list(keys)
    r = runs.withColumn("task_us", F.col("last_us") - F.col("first_us")).filter(F.col("task_us") > 0)
    j = r.join(penalties, on=keys, how="left")
    cols = {"task_time": seconds("task_us")}
    for f in families:
        cols[f"penalty_{f}"] = seconds(f"penalty_{f}_us")
        cols[f"percentage_{f}"] = percentage(f"penalty_{f}_us", "task_us")
    return j.withColumns(cols)
