"""Penalty and feature arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time allowed per matched island before it counts as penalty,
# silence that separates task runs, and the task-duration window used for models.
FREE_US = 1_100_000
RUN_GAP_US = 40_000_000
MIN_TASK_S = 10
MAX_TASK_S = 900
LOG_SHIFT = 0.01


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def excess_us(total_us, free_us: int = FREE_US) -> Column:
    """``max(total - free, 0)`` in integer microseconds (null total -> 0)."""
    return F.coalesce(F.greatest(_col(total_us) - F.lit(free_us), F.lit(0)), F.lit(0))


def seconds(us) -> Column:
    """Integer microseconds -> double seconds (a single, correctly rounded division)."""
    return _col(us).cast("double") / F.lit(1e6)


def percentage(part_us, whole_us) -> Column:
    """``100 * part / whole`` from integer microseconds; null when whole is 0."""
    return F.try_divide((_col(part_us) * F.lit(100)).cast("double"), _col(whole_us).cast("double"))


def log_shift(x, shift: float = LOG_SHIFT) -> Column:
    return F.log(_col(x) + F.lit(shift))


def task_flag(penalty, commands) -> Column:
    """1 when ``penalty != 0 or commands != 0`` under three-valued logic
    (null OR true = 1, null OR false = null), else 0."""
    cond = (_col(penalty) != 0) | (_col(commands) != 0)
    return F.when(cond, F.lit(1)).when(~cond, F.lit(0))


def used(commands) -> Column:
    return F.when(_col(commands) > 0, F.lit(1)).otherwise(F.lit(0))


def round_half_even(x, scale: int = 0) -> Column:
    return F.bround(_col(x), scale)
