"""Time arithmetic. Event time is carried as integer epoch microseconds
(``t_us``) wherever differences are taken, so gap tests and sums are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType, DataType

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(col, dtype: DataType | None = None) -> Column:
    """Timestamp -> epoch microseconds (bigint).

    ``timestamp_ntz`` values are taken as UTC wall-clock time, independently of
    the session zone; ``timestamp`` values are instants already.
    """
    c = _col(col)
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    if not isinstance(dtype, TimestampNTZType):
        c = c.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)


def micros_to_ntz(col) -> Column:
    """Epoch microseconds -> ``timestamp_ntz`` (UTC wall clock), zone independent."""
    return F.timestamp_add("MICROSECOND", _col(col), F.expr(_EPOCH_NTZ))


def calendar_columns(ts, prefix: str = "") -> dict[str, Column]:
    """Calendar parts of a timestamp: year, month, day, hours, minutes, seconds."""
    c = _col(ts)
    return {
        f"{prefix}year": F.year(c), f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c), f"{prefix}hours": F.hour(c),
        f"{prefix}minutes": F.minute(c), f"{prefix}seconds": F.second(c),
    }


def parse_utc(text) -> Column:
    """ISO text (``YYYY-MM-DDTHH:MM:SS[.ffffff]``) read as UTC wall-clock time."""
    return F.to_timestamp_ntz(_col(text))


def local_time(ts_ntz_utc, zone: str) -> Column:
    """UTC wall-clock ``timestamp_ntz`` -> wall-clock time in ``zone`` (NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts_ntz_utc))


def weekday(ts) -> Column:
    """English weekday name (``Monday`` ...)."""
    return F.date_format(_col(ts), "EEEE")


def half_day(ts) -> Column:
    return F.when(F.hour(_col(ts)) < 12, F.lit("Morning")).otherwise(F.lit("Afternoon"))
