"""The key-event stream ``K`` derived from the ``events`` table.

Each event expands into two or three key codes 0.4 s apart; event time is
compressed 1000-fold towards 2024-01-01 so that the 40 s silence rule cuts the
synthetic stream into realistic task runs.  ``(user_id, editor, t_us)`` is
unique and ``(t_us, seq)`` is the total order used everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions.timefn import epoch_us

# Codes per event type (in order), time origin, compression and
# spacing of the codes of one event.
EVENT_CODES: dict[str, list[str]] = {
    "click": ["MLD", "MM", "MLU"],
    "purchase": ["BSD", "BSU"],
    "error": ["RED", "REU"],
    "view": ["AND", "ANU"],
    "signup": ["aD", "aU"],
}
ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
COMPRESSION = 1000
CODE_STEP_US = 400_000
SEQ_STRIDE = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def codes_sql(event_type: str = "event_type") -> str:
    whens = " ".join(f"WHEN '{et}' THEN array({', '.join(repr(c) for c in codes)})"
                     for et, codes in EVENT_CODES.items())
    return f"CASE {event_type} {whens} END"


def key_events(events: DataFrame) -> DataFrame:
    """``K(user_id, editor, seq, t_us, key_event)``; a narrow transformation
    (no shuffle): every event row becomes its code rows in place."""
    ts_type = events.schema["ts"].dataType
    x = events.select("event_id", "user_id", epoch_us("ts", ts_type).alias("_us"),
                      F.expr(f"posexplode({codes_sql()})").alias("_i", "key_event"))
    return x.selectExpr(
        "user_id",
        "CASE WHEN event_id % 2 = 0 THEN 'eclipse' ELSE 'vscode' END AS editor",
        f"event_id * {SEQ_STRIDE} + _i AS seq",
        f"{ORIGIN_US} + (_us - {ORIGIN_US}) div {COMPRESSION} + _i * {CODE_STEP_US} AS t_us",
        "key_event",
    )


def load_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_events(read_table(spark, sf_dir, "events"))


# SQL form of K for the DuckDB oracle (same rule, written as a join to the code list).
def key_events_sql() -> str:
    rows = ", ".join(f"('{et}', {i}, '{c}')" for et, cs in EVENT_CODES.items() for i, c in enumerate(cs))
    return f"""
    codes(event_type, i, key_event) AS (VALUES {rows}),
    k AS (
      SELECT e.user_id,
             CASE WHEN e.event_id % 2 = 0 THEN 'eclipse' ELSE 'vscode' END AS editor,
             e.event_id * {SEQ_STRIDE} + c.i AS seq,
             {ORIGIN_US} + (epoch_us(e.ts) - {ORIGIN_US}) // {COMPRESSION} + c.i * {CODE_STEP_US} AS t_us,
             c.key_event
      FROM events e JOIN codes c ON e.event_type = c.event_type
    )"""
