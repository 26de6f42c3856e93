"""Gaps and islands over matched events of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanflow.functions.metrics import FREE_US, excess_us
from spanflow.operators.sequences import RUN_KEYS

# Episode families: an event counts for a family when it lies in a match of
# any of the family's patterns.
FAMILIES: dict[str, list[str]] = {
    "del": ["del_key", "del_mouse"],
    "del_mouse": ["del_mouse"],
    "nav": ["mov_key", "mov_mouse"],
    "nav_mouse": ["mov_mouse"],
}


def family_flags(families: Mapping[str, Sequence[str]] = FAMILIES) -> dict[str, Column]:
    out = {}
    for fam, pats in families.items():
        c = None
        for p in pats:
            c = F.col(f"in_{p}") if c is None else (c | F.col(f"in_{p}"))
        out[f"is_{fam}"] = c
    return out


def island_ids(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = RUN_KEYS,
               order: Sequence[str] = ("t_us", "seq")) -> DataFrame:
    """For every boolean flag column ``f`` add ``f_island``: the number of the
    maximal block of consecutive flagged events it belongs to (1, 2, ... in
    run order; null when not flagged).  Runs are the partition, so islands
    never cross runs and no single task sees more than one run's events."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = {f"_st_{f}": (F.col(f) & ~F.coalesce(F.lag(f).over(w), F.lit(False))).cast("int")
              for f in flags}
    df = df.withColumns(starts)
    df = df.withColumns({f"{f}_island": F.when(F.col(f), F.sum(f"_st_{f}").over(running))
                         for f in flags})
    return df.drop(*starts)


def change_groups(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = RUN_KEYS,
                  order: Sequence[str] = ("t_us", "seq")) -> DataFrame:
    """``group_<f>`` = 1 + number of times flag ``f`` changed value so far in
    the run (previous value of the first event taken as 0)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ints = {f: F.col(f).cast("int") for f in flags}
    diffs = {f"_chg_{f}": ((c - F.lag(c, 1, 0).over(w)) != 0).cast("int") for f, c in ints.items()}
    df = df.withColumns(diffs)
    df = df.withColumns({f"group_{f}": (F.sum(f"_chg_{f}").over(running) + 1).cast("long")
                         for f in flags})
    return df.drop(*diffs)


def consecutive_groups(df: DataFrame, keys: Sequence[str] = RUN_KEYS, row_id: str = "row_id",
                       order: Sequence[str] = ("t_us", "seq"), out: str = "consecutive_groups") -> DataFrame:
    """Islands by row-id adjacency: among the rows of ``df`` (already filtered
    to matched events), a new group starts wherever the row id is not the
    previous row id + 1 (the run's first row always starts one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    brk = F.coalesce((F.col(row_id) - F.lag(row_id).over(w)) != 1, F.lit(True)).cast("int")
    return df.withColumn("_brk", brk).withColumn(out, F.sum("_brk").over(running).cast("long")).drop("_brk")


def island_durations(flagged: DataFrame, families: Sequence[str] = tuple(FAMILIES),
                     keys: Sequence[str] = RUN_KEYS, t: str = "t_us",
                     free_us: int = FREE_US) -> DataFrame:
    """One row per (run, family, island): events, first/last time, duration and
    penalty (duration above ``free_us``, else 0), all in microseconds."""
    keys = list(keys)
    per = [F.struct(F.lit(f).alias("family"), F.col(f"is_{f}_island").alias("island"))
           for f in families]
    x = flagged.select(*keys, t, F.explode(F.array(*per)).alias("_f"))
    x = x.filter(F.col("_f.island").isNotNull())
    out = x.groupBy(*keys, F.col("_f.family").alias("family"), F.col("_f.island").alias("island")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(t).alias("first_us"), F.max(t).alias("last_us"))
    out = out.withColumn("duration_us", F.col("last_us") - F.col("first_us"))
    return out.withColumn("penalty_us", excess_us("duration_us", free_us))
