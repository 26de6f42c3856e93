"""Evaluation of regression models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, pred: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """RMSE, R-squared as the squared correlation of prediction and label, MAE
    and row count, in one aggregation (per group if given)."""
    e = F.col(pred) - F.col(label)
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.pow(F.corr(pred, label), 2).alias("rsquared"),
            F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
