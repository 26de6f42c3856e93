"""Run-level feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spanflow.functions.metrics import MAX_TASK_S, MIN_TASK_S, log_shift, task_flag, used
from spanflow.functions.timefn import half_day, local_time, micros_to_ntz, weekday

RUN_KEYS = ["user_id", "editor", "task_runs"]
# Fixed value: the zone the calendar features are read in.
LOCAL_ZONE = "America/Bogota"


def fill_numeric(df: DataFrame, value=0, subset: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by ``value`` in the named numeric columns (all numeric
    columns when ``subset`` is None); string columns keep their nulls."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cols = [c for c in (subset or numeric) if c in numeric]
    return df.na.fill(value, subset=cols) if cols else df


def duration_range(df: DataFrame, col: str = "task_time", lo: float = MIN_TASK_S, hi: float = MAX_TASK_S) -> DataFrame:
    """Half-open range filter ``lo <= col < hi``."""
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def positive_duration(df: DataFrame, col: str = "task_time") -> DataFrame:
    return df.filter(F.col(col) > 0)


# Decimal places kept for derived doubles: microsecond quantities are exact at
# 6; logs and averages are reported at 9 (engines differ in the last bits of
# log and of sums taken in a different order).
MICRO_DIGITS = 6
REPORT_DIGITS = 9


def add_log_penalties(df: DataFrame) -> DataFrame:
    return df.withColumns({"logpenaltydel": F.round(log_shift("penalty_del"), REPORT_DIGITS),
                           "logpenaltynav": F.round(log_shift("penalty_nav"), REPORT_DIGITS)})


def add_task_flags(df: DataFrame) -> DataFrame:
    """``is_in_task_del/nav``: penalty or commands non-zero, null-aware."""
    return df.withColumns({
        "is_in_task_del": task_flag("penalty_del", "del_commands"),
        "is_in_task_nav": task_flag("penalty_nav", "nav_commands"),
    })


def add_usage_flags(df: DataFrame) -> DataFrame:
    """``used_command_del/nav``: commands > 0."""
    return df.withColumns({"used_command_del": used("del_commands"), "used_command_nav": used("nav_commands")})


def add_calendar(df: DataFrame, first_us: str = "first_us", zone: str = LOCAL_ZONE) -> DataFrame:
    """Local calendar of the run start: day, month, year, weekday name and
    Morning/Afternoon, in ``zone``."""
    local = local_time(micros_to_ntz(first_us), zone)
    return (df.withColumn("task_ocurrence", local)
              .withColumns({
                  "task_day": F.dayofmonth("task_ocurrence"),
                  "task_month": F.month("task_ocurrence"),
                  "task_year": F.year("task_ocurrence"),
                  "task_dayweek": weekday("task_ocurrence"),
                  "morning_after": half_day("task_ocurrence"),
              }))


def join_people(runs: DataFrame, people: DataFrame, on: str = "user_id") -> DataFrame:
    """Inner join with the people table; runs of unknown people drop out.
    No hint: AQE broadcasts the people side only when its measured size is
    under the threshold, else it is a shuffle join."""
    return runs.join(people, on=on, how="inner")


def both_tasks(del_runs: DataFrame, nav_runs: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Runs present in both sets (inner join on the run key)."""
    return del_runs.select(*keys).join(nav_runs, on=list(keys), how="inner")


DAILY_KEYS = ["user_id", "editor", "task_year", "task_month", "task_day", "task_dayweek"]
DAILY_MEASURES = ["del_commands", "nav_commands", "penalty_del", "penalty_nav", "task_time"]


def daily_totals(df: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                 measures: Sequence[str] = DAILY_MEASURES) -> DataFrame:
    """Sums per day; nulls are skipped and an all-null group sums to 0.  The
    measures are whole commands or microsecond-precision seconds, so sums are
    rounded to the microsecond."""
    return df.groupBy(*keys).agg(*[F.round(F.coalesce(F.sum(m), F.lit(0)).cast("double"), MICRO_DIGITS).alias(m)
                                   for m in measures])


def penalty_by_usage(df: DataFrame, commands: str, penalty: str) -> DataFrame:
    """Penalty distribution per number of commands used."""
    return df.groupBy(F.col(commands).alias("commands")).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count(penalty).alias("n_with_penalty"),
        F.round(F.avg(penalty), REPORT_DIGITS).alias("avg_penalty"),
        F.min(penalty).alias("min_penalty"),
        F.max(penalty).alias("max_penalty"),
        F.sum((F.col(penalty) > 0).cast("int")).alias("n_positive"),
    )
