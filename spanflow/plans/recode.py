"""Recoding raw key rows: editor from the window title, lookup key, code
table join, calendar parts and the press/release suffix.

The test data has no keystroke table, so ``raw_keys`` derives one in the
reference's shape from ``events``: every event becomes its key actions
(mouse press/move/release for clicks, press/release of one key otherwise)
with a window title picked from the event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions.text import EDITOR_DEFAULT, EDITOR_RULES, classify_editor, composite_key, event_token
from spanflow.functions.timefn import calendar_columns, epoch_us, micros_to_ntz, parse_utc
from spanflow.plans.keystream import CODE_STEP_US, COMPRESSION, ORIGIN_US, SEQ_STRIDE

# Fixed values for the derived key table: window titles (chosen by event_id
# modulo their count), key actions per event type, the keyboard device name,
# the code table (one code maps to DELETE, the Return key has no code) and the
# date before which rows are ignored.
TITLES = [
    "Main.java - Eclipse",
    "pom.xml - Spring Tool Suite 4",
    "index.ts - Visual Studio Code",
    "App.java - NetBeans IDE 8.2",
    "notes.md - Sublime Text",
    "data.csv - Notepad++",
    "Inbox - Google Chrome",
    "Eclipse Installer",
]
ACTIONS: dict[str, list[tuple[str | None, str]]] = {
    "click": [(None, "down"), (None, "move"), (None, "up")],
    "purchase": [("BackSpace", "down"), ("BackSpace", "up")],
    "error": [("Return", "down"), ("Return", "up")],
    "view": [("Down", "down"), ("Down", "up")],
    "signup": [("a", "down"), ("a", "up")],
}
DEVICE = "kbd"
KEYCODES = [
    ("mouse", "ML"),
    ("kbd - BackSpace", "BS"),
    ("kbd - Down", "AN"),
    ("kbd - a", "DELETE"),
]
SINCE = "2024-01-03"
# The compressed log starts on this day; its first microsecond is not after it.
ORIGIN_DAY = "2023-12-01"
# Columns of a raw key log that are carried through unchanged.
CARRIED = ["email", "company", "date_joined", "x_coord", "y_coord", "keyboard_language"]
COMPANIES = ["north", "south", "east"]


def raw_keys(events: DataFrame) -> DataFrame:
    """Reference-shaped key rows: user_id_id, event_id, key_no, time, device,
    app, keyval (null for mouse), event_type and the ``CARRIED`` columns."""
    acts = None
    for et, lst in ACTIONS.items():
        arr = F.array(*[F.struct(F.lit(k).cast("string").alias("keyval"), F.lit(kind).alias("kind"))
                        for k, kind in lst])
        acts = F.when(F.col("event_type") == et, arr) if acts is None else acts.when(F.col("event_type") == et, arr)
    titles = F.array(*[F.lit(t) for t in TITLES])
    x = events.select(F.col("user_id").alias("user_id_id"), "event_id", F.col("ts").alias("time"),
                      F.element_at(titles, (F.col("event_id") % len(TITLES) + 1).cast("int")).alias("app"),
                      F.posexplode(acts).alias("key_no", "_a"))
    user, mouse = F.col("user_id_id"), F.col("_a.keyval").isNull()
    companies = F.array(*[F.lit(c) for c in COMPANIES])
    return x.select("user_id_id", "event_id", "key_no", "time", F.lit(DEVICE).alias("device"), "app",
                    F.col("_a.keyval").alias("keyval"), F.col("_a.kind").alias("event_type"),
                    F.concat(F.lit("u"), user.cast("string"), F.lit("@example.org")).alias("email"),
                    F.element_at(companies, (user % len(COMPANIES) + 1).cast("int")).alias("company"),
                    F.date_add(F.lit("2023-01-01").cast("date"), (user % 365).cast("int")).alias("date_joined"),
                    F.when(mouse, F.col("event_id") % 1920).alias("x_coord"),
                    F.when(mouse, F.col("event_id") % 1080).alias("y_coord"),
                    F.when(user % 2 == 0, "es").otherwise("en").alias("keyboard_language"))


def keycodes_frame(spark: SparkSession) -> DataFrame:
    """The code table; a join broadcasts it only when its size is under the threshold."""
    return spark.createDataFrame(KEYCODES, "keyval string, new string")


def recode_events(keys: DataFrame, codes: DataFrame, since: str = SINCE,
                  id_cols: tuple[str, ...] = ("event_id", "key_no")) -> DataFrame:
    """Classify the editor, build the lookup key, keep rows after ``since`` in
    a known editor, attach the code (rows whose code is DELETE or missing
    drop out) and add calendar parts and the event token.  ``id_cols`` are
    carried through (a stable row id serves as the tie-breaker ``seq``), and so
    are the ``CARRIED`` columns that ``keys`` has."""
    k = keys.withColumns({"editor": classify_editor("app"),
                          "keyval": composite_key("device", "keyval", null_col="keyval")})
    k = k.filter((F.col("time") > F.lit(since)) & (F.col("editor") != EDITOR_DEFAULT))
    j = k.join(codes, on="keyval", how="left")
    out = j.select(F.col("user_id_id").alias("user_id"), *id_cols, "time", "device",
                   *[c.alias(n) for n, c in calendar_columns("time").items()],
                   "editor", "event_type", F.col("new").alias("event"),
                   *[c for c in CARRIED if c in keys.columns])
    # Null codes fail the comparison too, so the left join acts as an inner one.
    out = out.filter(F.col("event") != "DELETE")
    return out.withColumn("key_event", event_token("event", "event_type"))


def raw_keys_as_text(events: DataFrame) -> DataFrame:
    """Raw key rows of a log whose times are ISO text; event time is compressed and keys are spaced as in ``keystream``."""
    us = epoch_us("ts", events.schema["ts"].dataType)
    since = us - ORIGIN_US
    close = events.withColumn("ts", micros_to_ntz(((since - F.pmod(since, F.lit(COMPRESSION))) / COMPRESSION).cast("long") + ORIGIN_US))
    keys = raw_keys(close)
    at = F.timestamp_add("MICROSECOND", F.col("key_no").cast("long") * CODE_STEP_US, F.col("time"))
    return keys.withColumn("time", F.replace(at.cast("string"), F.lit(" "), F.lit("T")))


def key_events_of(keys: DataFrame, codes: DataFrame, since: str = ORIGIN_DAY) -> DataFrame:
    """Raw key rows with text times as key events (user_id, editor, seq, t_us, key_event)."""
    timed = keys.withColumn("time", parse_utc("time"))
    ev = recode_events(timed, codes, since)
    return ev.select("user_id", "editor", (F.col("event_id") * SEQ_STRIDE + F.col("key_no")).alias("seq"),
                     epoch_us("time", timed.schema["time"].dataType).alias("t_us"), "key_event")


def raw_key_events_sql() -> str:
    """The same key events as a CTE ``k`` for the DuckDB oracle."""
    at = (f"make_timestamp({ORIGIN_US} + CAST(floor((epoch_us(e.ts) - {ORIGIN_US}) / {COMPRESSION}) AS BIGINT)"
          f" + CAST(a.key_no AS BIGINT) * {CODE_STEP_US})")
    return f"""recoded AS ({recode_sql(at, ORIGIN_DAY)}),
    k AS (SELECT user_id, editor, event_id * {SEQ_STRIDE} + key_no AS seq, epoch_us(time) AS t_us, key_event FROM recoded)"""


def recode_sql(time: str = "e.ts", since: str = SINCE) -> str:
    acts = " UNION ALL ".join(
        f"SELECT '{et}' AS event_type, {i} AS key_no, {('NULL' if k is None else repr(k))} AS keyval, '{kind}' AS kind"
        for et, lst in ACTIONS.items() for i, (k, kind) in enumerate(lst))
    titles = "[" + ", ".join(repr(t) for t in TITLES) + "]"
    codes = ", ".join(f"({k!r}, {v!r})" for k, v in KEYCODES)
    rules = " ".join(
        "WHEN " + " OR ".join(f"contains(app, {f!r})" for f in frags) + f" THEN {label!r}"
        for frags, label in EDITOR_RULES)
    return f"""
    WITH acts AS ({acts}),
    codes(keyval, new) AS (VALUES {codes}),
    raw AS (
      SELECT e.user_id AS user_id_id, e.event_id, CAST(a.key_no AS INTEGER) AS key_no, {time} AS time,
             '{DEVICE}' AS device, list_extract({titles}, CAST(e.event_id % {len(TITLES)} + 1 AS INTEGER)) AS app,
             CAST(a.keyval AS VARCHAR) AS keyval, a.kind AS event_type,
             'u' || CAST(e.user_id AS VARCHAR) || '@example.org' AS email,
             list_extract({COMPANIES!r}, CAST(e.user_id % {len(COMPANIES)} + 1 AS INTEGER)) AS company,
             DATE '2023-01-01' + CAST(e.user_id % 365 AS INTEGER) AS date_joined,
             CASE WHEN a.keyval IS NULL THEN e.event_id % 1920 END AS x_coord,
             CASE WHEN a.keyval IS NULL THEN e.event_id % 1080 END AS y_coord,
             CASE WHEN e.user_id % 2 = 0 THEN 'es' ELSE 'en' END AS keyboard_language
      FROM events e JOIN acts a ON e.event_type = a.event_type),
    k AS (
      SELECT *, CASE {rules} ELSE '{EDITOR_DEFAULT}' END AS editor,
             CASE WHEN keyval IS NULL THEN 'mouse' ELSE concat_ws(' - ', device, keyval) END AS lk
      FROM raw),
    j AS (
      SELECT k.*, c.new AS event FROM k LEFT JOIN codes c ON k.lk = c.keyval
      WHERE k.time > TIMESTAMP '{since}' AND k.editor <> '{EDITOR_DEFAULT}')
    SELECT user_id_id AS user_id, event_id, key_no, time, device,
           CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
           CAST(day(time) AS INTEGER) AS day, CAST(hour(time) AS INTEGER) AS hours,
           CAST(minute(time) AS INTEGER) AS minutes, CAST(second(time) AS INTEGER) AS seconds,
           editor, event_type, event, {", ".join(CARRIED)},
           CASE WHEN event_type = 'up' THEN event || 'U' WHEN event_type = 'down' THEN event || 'D'
                ELSE event END AS key_event
    FROM j WHERE event <> 'DELETE'"""
