"""Column-valued functions. All are built-in Spark expressions (codegen, no Python worker)."""

from spanflow.functions.text import (EDITOR_RULES, classify_contains, classify_editor,
                                     composite_key, event_token)
from spanflow.functions.timefn import (calendar_columns, epoch_us, half_day, local_time,
                                       micros_to_ntz, parse_utc, weekday)
from spanflow.functions.spans import (PATTERNS, EXEC_PATTERNS, find_spans, in_spans,
                                      match_count)
from spanflow.functions.metrics import (excess_us, log_shift, percentage, round_half_even,
                                        seconds, task_flag, used)

__all__ = [
    "EDITOR_RULES", "classify_contains", "classify_editor", "composite_key", "event_token",
    "calendar_columns", "epoch_us", "half_day", "local_time", "micros_to_ntz", "parse_utc",
    "weekday", "PATTERNS", "EXEC_PATTERNS", "find_spans", "in_spans", "match_count",
    "excess_us", "log_shift", "percentage", "round_half_even", "seconds", "task_flag", "used",
]
