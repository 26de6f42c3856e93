"""Run metrics -> model features: command counts, people, flags, calendar.

``COMMANDS`` is the command catalogue used on the test data: two editors and
patterns that reduce deletes, navigation, or both.  ``people`` derives the
people table from ``customer`` (one row per customer key = user id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions.metrics import MAX_TASK_S, MIN_TASK_S
from spanflow.operators.commands import catalogue_frame, category_counts, count_commands
from spanflow.operators.features import (LOCAL_ZONE, add_calendar, add_log_penalties, add_task_flags,
                                         add_usage_flags,
                                         fill_numeric, join_people)
from spanflow.plans import cleaning, oracle
from spanflow.plans.keystream import load_key_events, read_table

# Command catalogue (editor, command id, pattern, categories).
COMMANDS = [
    ("eclipse", "delete_word", "BSDBSUBSDBSU", "Delete"),
    ("eclipse", "page_down", "ANDANUANDANU", "Navigation"),
    ("eclipse", "select_delete", "MLUBSD", "Delete,Navigation"),
    ("vscode", "delete_back", "REDREU", "Delete"),
    ("vscode", "cursor_down", "ANDANU", "Navigation"),
]

RUN_KEYS = ["user_id", "editor", "task_runs"]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("company"),
                    F.concat(F.lit("degree_"), (F.col("c_nationkey") % 5).cast("string")).alias("degree"),
                    (F.col("c_nationkey") % 7 + 1).cast("int").alias("years_study"),
                    F.col("c_acctbal").alias("work_experience"))


PEOPLE_SQL = """people AS (
      SELECT c_custkey AS user_id, c_mktsegment AS company, 'degree_' || CAST(c_nationkey % 5 AS VARCHAR) AS degree,
             CAST(c_nationkey % 7 + 1 AS INTEGER) AS years_study, c_acctbal AS work_experience
      FROM customer)"""


def command_counts(spark: SparkSession, runs: DataFrame, zeros: bool = False) -> DataFrame:
    return count_commands(runs, catalogue_frame(spark, COMMANDS), zeros=zeros)


def command_sql_ctes() -> str:
    rows = ", ".join(f"({a!r}, {b!r}, {c!r}, {d!r})" for a, b, c, d in COMMANDS)
    return f""",
    catalogue(editor, command_id, pattern, reduces) AS (VALUES {rows}),
    cc AS (
      SELECT r.user_id, r.editor, r.task_runs, c.command_id, c.reduces,
             CAST(len(regexp_extract_all(r.key_string, c.pattern)) AS INTEGER) AS n
      FROM runs r JOIN catalogue c ON r.editor = c.editor),
    cat AS (
      SELECT user_id, editor, task_runs,
             CAST(coalesce(sum(n) FILTER (WHERE contains(reduces, 'Delete')), 0) AS BIGINT) AS del_commands,
             CAST(coalesce(sum(n) FILTER (WHERE contains(reduces, 'Navigation')), 0) AS BIGINT) AS nav_commands
      FROM cc GROUP BY user_id, editor, task_runs)"""


def run_metrics(spark: SparkSession, sf_dir: str, mode: str = "all", **duration) -> DataFrame:
    """Run penalties with the canonical names used downstream and command totals."""
    k = load_key_events(spark, sf_dir)
    rp = cleaning.run_penalties(k, mode, **duration)
    return rp.withColumns(category_counts(COMMANDS))


def run_metrics_ctes(mode: str = "all") -> str:
    return oracle.run_penalties_ctes(mode) + command_sql_ctes() + """,
    rm AS (SELECT rp.*, coalesce(cat.del_commands, 0) AS del_commands, coalesce(cat.nav_commands, 0) AS nav_commands
           FROM rp LEFT JOIN cat ON rp.user_id = cat.user_id AND rp.editor = cat.editor
                                 AND rp.task_runs = cat.task_runs)"""


RUN_FEATURES = ["user_id", "editor", "task_runs", "first_us", "penalty_del", "penalty_nav", "task_time",
                "del_commands", "nav_commands", "is_in_task_del", "is_in_task_nav", "logpenaltydel",
                "logpenaltynav"]
# The people columns after the key, as laid out by ``people`` (the SQL oracle
# lists the same names).
FEATURE_COLS = RUN_FEATURES + ["company", "degree", "years_study", "work_experience"]
CALENDAR_COLS = ["task_day", "task_month", "task_year", "task_dayweek", "used_command_del",
                 "used_command_nav", "morning_after"]


def model_features(spark: SparkSession, sf_dir: str, mode: str = "all") -> DataFrame:
    """Runs of 10-900 s with log penalties, people, command totals, task
    flags, nulls filled with 0 and local calendar features."""
    rm = run_metrics(spark, sf_dir, mode, min_us=MIN_TASK_S * 1_000_000, max_us=MAX_TASK_S * 1_000_000)
    rm = add_log_penalties(rm)
    ppl = people(spark, sf_dir)
    rm = add_task_flags(join_people(rm, ppl))
    # Run features plus every people column but the key, named at run time.
    cols = RUN_FEATURES + ppl.columns[1:]
    rm = fill_numeric(rm.select(*cols), 0)
    rm = add_usage_flags(add_calendar(rm, "first_us", LOCAL_ZONE))
    return rm.select(*cols, *CALENDAR_COLS)


def model_features_ctes(mode: str = "all") -> str:
    fill = ", ".join(
        f"coalesce({c}, 0) AS {c}" if c not in ("user_id", "editor", "company", "degree") else c
        for c in FEATURE_COLS)
    return run_metrics_ctes(mode) + ",\n    " + PEOPLE_SQL + f""",
    f0 AS (
      SELECT rm.*, round(ln(penalty_del + 0.01), 9) AS logpenaltydel, round(ln(penalty_nav + 0.01), 9) AS logpenaltynav,
             people.company, people.degree, people.years_study, people.work_experience
      FROM rm JOIN people ON rm.user_id = people.user_id
      WHERE task_time >= {MIN_TASK_S} AND task_time < {MAX_TASK_S}),
    f1 AS (
      SELECT *, CASE WHEN (penalty_del <> 0 OR del_commands <> 0) THEN 1
                     WHEN NOT (penalty_del <> 0 OR del_commands <> 0) THEN 0 END AS is_in_task_del,
                CASE WHEN (penalty_nav <> 0 OR nav_commands <> 0) THEN 1
                     WHEN NOT (penalty_nav <> 0 OR nav_commands <> 0) THEN 0 END AS is_in_task_nav
      FROM f0),
    f2 AS (SELECT {fill} FROM f1),
    mf AS (
      SELECT f2.* EXCLUDE (lt), CAST(day(lt) AS INTEGER) AS task_day, CAST(month(lt) AS INTEGER) AS task_month,
             CAST(year(lt) AS INTEGER) AS task_year, dayname(lt) AS task_dayweek,
             CASE WHEN del_commands > 0 THEN 1 ELSE 0 END AS used_command_del,
             CASE WHEN nav_commands > 0 THEN 1 ELSE 0 END AS used_command_nav,
             CASE WHEN hour(lt) < 12 THEN 'Morning' ELSE 'Afternoon' END AS morning_after
      FROM (SELECT *, timezone('{LOCAL_ZONE}', make_timestamp(first_us) AT TIME ZONE 'UTC') AS lt FROM f2) f2)"""
