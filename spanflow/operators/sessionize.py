"""Gap sessionization: cut each key's ordered event stream into task runs.

A new run starts wherever the time since the previous event of the same key
is strictly greater than the gap ``G``.  A plain ``Window.partitionBy(user,
editor)`` sends a whole user to one task; one very active user would then be
one task for a third of the data.  Instead a key's time is cut into segments
of fixed width (an hour by default), and everything is decided in two parts:

1. Events are dealt by (key, segment) once.  Inside a segment a window gives
   each event its predecessor, its position and the breaks so far.
2. A segment is summed up in one row: first and last time, breaks inside, and
   number of events.  Such rows combine associatively: between two segments
   there is a break if the later one's first time is more than ``G`` after the
   earlier one's last.  A running sum over a key's segments (one row per active
   hour, not per event) gives the run number and position at which each starts.

The summary comes from the same exchange as the events (Spark reuses it), so
the source is scanned and shuffled once.  It is joined back to the events;
AQE broadcasts it only when its measured size is under the threshold,
otherwise the events already lie by (key, segment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanflow.functions.metrics import RUN_GAP_US
from spanflow.operators.partitions import spread

SEGMENT = "_sf_segment"
HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def segment_of(t: str, width_us: int) -> F.Column:
    """Integer floor division ``t // width_us`` (exact for any bigint time)."""
    return F.expr(f"({t} - pmod({t}, {int(width_us)})) div {int(width_us)}")


def segment_starts(segments: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """Per (key, segment): ``_sf_pl`` the last time before it, ``_sf_runs`` the number of the run it starts in, and ``_sf_rows``
    the key's events before it.  ``segments`` has one row per (key, segment): _sf_first, _sf_last, _sf_breaks, _sf_n."""
    w = Window.partitionBy(*keys).orderBy(SEGMENT)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = segments.withColumn("_sf_pl", F.lag("_sf_last").over(w))
    x = x.withColumn("_sf_edge", F.coalesce((F.col("_sf_first") - F.col("_sf_pl") > gap_us).cast("int"), F.lit(0)))
    return x.select(*keys, SEGMENT, "_sf_pl",
                    (1 + F.sum("_sf_edge").over(running) + F.coalesce(F.sum("_sf_breaks").over(before), F.lit(0))).cast("long").alias("_sf_runs"),
                    F.coalesce(F.sum("_sf_n").over(before), F.lit(0)).cast("long").alias("_sf_rows"))


def assign_runs(df: DataFrame, keys: Sequence[str] = ("user_id", "editor"),
                t: str = "t_us", tie: str | None = "seq", gap_us: int = RUN_GAP_US,
                run_col: str = "task_runs", gap_col: str | None = "gap_us",
                new_col: str | None = "is_new_task_run", row_col: str | None = "row_id",
                segment_us: int = HOUR_US) -> DataFrame:
    """Add ``task_runs`` (1 + breaks so far) and, on request, ``gap_us`` (time
    since the key's previous event, 0 for its first), ``is_new_task_run``
    (``gap > gap_us``) and ``row_id`` (1-based position in the key's stream,
    order ``(t, tie)``).  ``t`` is integer microseconds; rows with a null key or
    time are left out.  Pass only columns that
    are needed: those dropped later keep Spark from reusing the exchange."""
    keys = list(keys)
    order = [t] + ([tie] if tie else [])
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn(SEGMENT, segment_of(t, segment_us))
    for c in [*keys, SEGMENT]:  # what the join below asks of both sides, said before the exchange they share
        x = x.where(F.col(c).isNotNull())
    x = spread(x.repartition(*keys, SEGMENT), *keys, SEGMENT)
    x = x.withColumn("_sf_prev", F.lag(t).over(w))
    x = x.withColumn("_sf_brk", F.coalesce((F.col(t) - F.col("_sf_prev") > gap_us).cast("int"), F.lit(0)))
    # the last event as a struct of every column: both uses of the exchange then read the same columns
    last = F.max(F.struct(*order, *[c for c in df.columns if c not in order]))[t]
    segments = x.groupBy(*keys, SEGMENT).agg(F.min(t).alias("_sf_first"), last.alias("_sf_last"),
                                             F.sum("_sf_brk").alias("_sf_breaks"), F.count(F.lit(1)).alias("_sf_n"))
    starts = segment_starts(segments, keys, gap_us)
    x = x.withColumn(run_col, F.sum("_sf_brk").over(upto))
    if row_col:
        x = x.withColumn(row_col, F.row_number().over(w))
    out = x.join(starts, on=keys + [SEGMENT], how="inner")
    gap = F.coalesce(F.col(t) - F.coalesce("_sf_prev", "_sf_pl"), F.lit(0)).cast("long")
    cols = {run_col: (F.col(run_col) + F.col("_sf_runs")).cast("long")}
    if gap_col:
        cols[gap_col] = gap
    if new_col:
        cols[new_col] = (gap > gap_us).cast("int")
    if row_col:
        cols[row_col] = (F.col("_sf_rows") + F.col(row_col)).cast("long")
    return out.select(*df.columns, *[c.alias(n) for n, c in cols.items()])


def time_gap(df: DataFrame, keys: Sequence[str], t: str = "t_us", tie: str | None = None,
             gap_col: str = "gap_us", segment_us: int = DAY_US) -> DataFrame:
    """Microseconds since the previous event of the same key (0 for the first); a window holds ``segment_us`` of one key."""
    out = assign_runs(df, keys, t=t, tie=tie, gap_us=segment_us, run_col="_sf_run",
                      gap_col=gap_col, new_col=None, row_col=None, segment_us=segment_us)
    return out.drop("_sf_run")
