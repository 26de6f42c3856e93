"""Run strings: per-event character offsets and the ordered concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanflow.operators.partitions import spread

RUN_KEYS = ("user_id", "editor", "task_runs")


def end_offset(df: DataFrame, keys: Sequence[str] = RUN_KEYS, order: Sequence[str] = ("t_us", "seq"),
               token: str = "key_event", out: str = "last_index") -> DataFrame:
    """0-based offset of the event's last character in its run string:
    running sum of token lengths in run order, minus one."""
    w = (Window.partitionBy(*keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spread(df, *keys).withColumn(out, (F.sum(F.length(token)).over(w) - 1).cast("int"))


def ordered_concat(df: DataFrame, keys: Sequence[str] = RUN_KEYS, order: Sequence[str] = ("t_us", "seq"),
                   token: str = "key_event", sep: str = "", t: str = "t_us") -> DataFrame:
    """One row per group: tokens joined in ``order`` (``key_string``), the number
    of non-null tokens (``n_events``) and the first/last time (``first_us``,
    ``last_us``).

    The list is sorted explicitly inside the aggregate; ``collect_list`` alone
    keeps no order after a shuffle.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(token).alias("_tok"))))
    return spread(df, *keys).groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["_tok"]), sep).alias("key_string"),
        F.count(token).alias("n_events"),
        F.min(t).alias("first_us"),
        F.max(t).alias("last_us"),
    )


def attach_runs(events: DataFrame, runs: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Left join of run attributes to every event of the run (1:N).  Both
    sides are keyed by the run, so an events frame already partitioned by run
    is not shuffled again."""
    return events.join(runs, on=list(keys), how="left")
