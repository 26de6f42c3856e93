"""The cleaning job: key events -> task runs -> episodes -> penalties.

Exchanges of the flagship plan: the bucket summary (partial aggregates, then
one row per active 40 s slot), the join of events to their bucket (broadcast
when AQE measures the summary small, else a shuffle join), and one exchange of
events by run key.  Everything after that stays in the run's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.operators.episodes import (episode_stream, island_table, run_penalty_table, run_rows,
                                         stream_islands)
from spanflow.operators.sessionize import assign_runs

EVENT_COLS = ["user_id", "editor", "task_runs", "t_us", "seq", "key_event"]


def sessionized(k: DataFrame) -> DataFrame:
    """Key events with ``gap_us``, ``is_new_task_run``, ``task_runs``, ``row_id``."""
    return assign_runs(k, keys=("user_id", "editor"), t="t_us", tie="seq")


def run_events(k: DataFrame) -> DataFrame:
    """Key events with their run number only (no event-level window)."""
    return assign_runs(k, keys=("user_id", "editor"), t="t_us", tie="seq",
                       gap_col=None, new_col=None, row_col=None).select(*EVENT_COLS)


def run_table(k: DataFrame) -> DataFrame:
    """One row per run: events array, key_string, n_events, first_us, last_us."""
    return run_rows(run_events(k))


def episodes(k: DataFrame, mode: str = "all") -> DataFrame:
    return episode_stream(run_table(k), first_only=(mode == "first"))


def islands(k: DataFrame, mode: str = "all") -> DataFrame:
    return island_table(stream_islands(episodes(k, mode)))


def run_penalties(k: DataFrame, mode: str = "all", min_us: int = 1, max_us: int | None = None) -> DataFrame:
    """Run table with task time, per-family penalties and percentages, of runs
    that last ``min_us <= task time < max_us``.  Other runs leave before the
    regex, explode and sort steps."""
    runs = run_table(k)
    task_us = F.col("last_us") - F.col("first_us")
    runs = runs.filter(task_us >= min_us)
    if max_us is not None:
        runs = runs.filter(task_us < max_us)
    return run_penalty_table(stream_islands(episode_stream(runs, first_only=(mode == "first"))))
