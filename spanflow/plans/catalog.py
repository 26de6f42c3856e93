"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the given tables (or data
Spark derives from them), so its work grows with the data.  Column names and
types are aligned with the SQL so results compare directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions.metrics import RUN_GAP_US, round_half_even, seconds
from spanflow.functions.spans import PATTERNS
from spanflow.functions.text import EDITOR_DEFAULT, EDITOR_RULES, classify_editor, composite_key
from spanflow.functions.timefn import epoch_us, half_day, local_time, weekday
from spanflow.operators import features as feat
from spanflow.operators import islands as isl_ops
from spanflow.operators.episodes import episode_stream
from spanflow.operators.quantiles import exact_quantiles
from spanflow.operators.sampling import stratified, with_sample
from spanflow.operators.sequences import end_offset, ordered_concat
from spanflow.operators.sessionize import time_gap
from spanflow.operators.spans import span_flags, span_rows
from spanflow.plans import cleaning, oracle, recode, runfeatures
from spanflow.plans.keystream import load_key_events, read_table
from spanflow.session import scratch_path
from spanflow.sources import files, tables

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

RUN_KEYS = ["user_id", "editor", "task_runs"]
FAMILIES = list(isl_ops.FAMILIES)
PENALTY_COLS = [c for f in FAMILIES for c in (f"penalty_{f}", f"percentage_{f}")]


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def K(spark, sf_dir):
    return load_key_events(spark, sf_dir)


# --- flagship: per-run penalties -------------------------------------------------

def _run_penalties(mode):
    def q(spark, sf_dir):
        rp = cleaning.run_penalties(K(spark, sf_dir), mode)
        return rp.select(*RUN_KEYS, "key_string", "n_events", "first_us", "last_us", "task_time", *PENALTY_COLS)
    return q


for _m in ("all", "first"):
    register(f"run_penalties_{_m}", oracle.run_penalties_sql(_m))(_run_penalties(_m))


# --- spans, flags, islands -------------------------------------------------------

def _spans(pattern, mode):
    def q(spark, sf_dir):
        runs = cleaning.run_table(K(spark, sf_dir))
        s = span_rows(runs, patterns={pattern: PATTERNS[pattern]}, first_only=(mode == "first"))
        return s.select(*RUN_KEYS, "match_no", "span_start", "span_end")
    return q


for _p in PATTERNS:
    for _m in ("all", "first"):
        register(f"spans_{_p}_{_m}", oracle.spans_sql(_p, _m))(_spans(_p, _m))

FLAG_COLS = [f"in_{p}" for p in PATTERNS]


def _span_flags(mode):
    def q(spark, sf_dir):
        st = cleaning.episodes(K(spark, sf_dir), mode).filter(F.col("typ") == "E")
        return st.select(*RUN_KEYS, "seq", F.col("t").alias("t_us"), "key_event", "last_index", *FLAG_COLS)
    return q


for _m in ("all", "first"):
    register(f"span_flags_{_m}", oracle.span_flags_sql(_m))(_span_flags(_m))


@register("run_penalties_modular", oracle.run_penalties_sql("all"))
def run_penalties_modular(spark, sf_dir):
    """The flagship from the stand-alone operators: offsets window, span rows,
    marker merge, island numbering, island durations, per-run sums and the
    metric join (the fused plan in ``cleaning`` computes the same in one pass
    per run)."""
    from spanflow.operators.penalty import per_run, run_metrics
    ev = cleaning.run_events(K(spark, sf_dir))
    runs = ordered_concat(ev)
    fl = span_flags(end_offset(ev), span_rows(runs)).withColumns(isl_ops.family_flags())
    fl = isl_ops.island_ids(fl, [f"is_{f}" for f in FAMILIES])
    rp = run_metrics(runs, per_run(isl_ops.island_durations(fl)))
    return rp.select(*RUN_KEYS, "key_string", "n_events", "first_us", "last_us", "task_time", *PENALTY_COLS)


@register("span_flags_modular", oracle.span_flags_sql("all"))
def span_flags_modular(spark, sf_dir):
    """The same flags from the stand-alone operators (offset window, span rows,
    marker merge) instead of the fused per-run stream."""
    ev = cleaning.run_events(K(spark, sf_dir))
    runs = ordered_concat(ev)
    fl = span_flags(end_offset(ev), span_rows(runs))
    return fl.select(*RUN_KEYS, "seq", "t_us", "key_event", "last_index", *FLAG_COLS)


def _islands(mode):
    def q(spark, sf_dir):
        return cleaning.islands(K(spark, sf_dir), mode)
    return q


for _m in ("all", "first"):
    register(f"island_durations_{_m}", oracle.islands_sql(_m))(_islands(_m))


@register("islands", "WITH " + oracle.flags_ctes("all") + """,
    m AS (SELECT * FROM fl WHERE in_del_key OR in_del_mouse),
    c AS (SELECT *, CASE WHEN row_id - lag(row_id) OVER (PARTITION BY user_id, editor, task_runs ORDER BY t_us, seq) = 1
                         THEN 0 ELSE 1 END AS brk FROM m)
    SELECT user_id, editor, task_runs, row_id, t_us, key_event,
           CAST(sum(brk) OVER (PARTITION BY user_id, editor, task_runs ORDER BY t_us, seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS consecutive_groups
    FROM c""")
def islands_by_row_id(spark, sf_dir):
    """Matched delete events numbered into islands by row-id adjacency."""
    ev = cleaning.sessionized(K(spark, sf_dir))
    runs = ordered_concat(ev)
    fl = span_flags(end_offset(ev), span_rows(runs))
    m = fl.filter(F.col("in_del_key") | F.col("in_del_mouse"))
    out = isl_ops.consecutive_groups(m, RUN_KEYS, "row_id")
    return out.select(*RUN_KEYS, "row_id", "t_us", "key_event", "consecutive_groups")


@register("change_groups", "WITH " + oracle.flags_ctes("all") + """,
    f AS (SELECT *, CAST(in_del_key OR in_del_mouse AS INTEGER) AS d, CAST(in_del_mouse AS INTEGER) AS dm,
                    CAST(in_mov_key OR in_mov_mouse AS INTEGER) AS n, CAST(in_mov_mouse AS INTEGER) AS nm FROM fl),
    g AS (SELECT *, CASE WHEN d - lag(d, 1, 0) OVER w <> 0 THEN 1 ELSE 0 END AS cd,
                    CASE WHEN dm - lag(dm, 1, 0) OVER w <> 0 THEN 1 ELSE 0 END AS cdm,
                    CASE WHEN n - lag(n, 1, 0) OVER w <> 0 THEN 1 ELSE 0 END AS cn,
                    CASE WHEN nm - lag(nm, 1, 0) OVER w <> 0 THEN 1 ELSE 0 END AS cnm
          FROM f WINDOW w AS (PARTITION BY user_id, editor, task_runs ORDER BY t_us, seq))
    SELECT user_id, editor, task_runs, seq,
           CAST(1 + sum(cd) OVER r AS BIGINT) AS group_is_del, CAST(1 + sum(cdm) OVER r AS BIGINT) AS group_is_del_mouse,
           CAST(1 + sum(cn) OVER r AS BIGINT) AS group_is_nav, CAST(1 + sum(cnm) OVER r AS BIGINT) AS group_is_nav_mouse
    FROM g WINDOW r AS (PARTITION BY user_id, editor, task_runs ORDER BY t_us, seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def change_groups_q(spark, sf_dir):
    st = cleaning.episodes(K(spark, sf_dir), "all").filter(F.col("typ") == "E")
    st = st.withColumns(isl_ops.family_flags())
    flags = [f"is_{f}" for f in FAMILIES]
    out = isl_ops.change_groups(st, flags, RUN_KEYS, ("t", "seq"))
    return out.select(*RUN_KEYS, "seq", *[f"group_{f}" for f in flags])


# --- sessionization and run strings ---------------------------------------------

@register("task_runs", "WITH " + oracle.runs_ctes() + """
    SELECT user_id, editor, seq, t_us, key_event, gap_us, CAST(gap_us > 40000000 AS INTEGER) AS is_new_task_run,
           CAST(task_runs AS BIGINT) AS task_runs, row_id FROM ev""")
def task_runs_q(spark, sf_dir):
    ev = cleaning.sessionized(K(spark, sf_dir))
    return ev.select("user_id", "editor", "seq", "t_us", "key_event", "gap_us", "is_new_task_run",
                     "task_runs", "row_id")


@register("time_gap", f"""
    SELECT event_id, user_id, epoch_us(ts) AS t_us,
           coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS gap_us,
           CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS DOUBLE) / 1e6 AS time_diff
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def time_gap_q(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    ev = ev.select("event_id", "user_id", epoch_us("ts", ev.schema["ts"].dataType).alias("t_us"))
    out = time_gap(ev, ["user_id"], t="t_us", tie="event_id")
    return out.select("event_id", "user_id", "t_us", "gap_us", seconds("gap_us").alias("time_diff"))


@register("running_offset", "WITH " + oracle.runs_ctes() + """
    SELECT user_id, editor, task_runs, seq, key_event, CAST(last_index AS INTEGER) AS last_index FROM ev2""")
def running_offset_q(spark, sf_dir):
    ev = end_offset(cleaning.run_events(K(spark, sf_dir)))
    return ev.select(*RUN_KEYS, "seq", "key_event", "last_index")


@register("ordered_concat", "WITH " + oracle.runs_ctes() + "\n    SELECT * FROM runs")
def ordered_concat_q(spark, sf_dir):
    return ordered_concat(cleaning.run_events(K(spark, sf_dir)))


@register("ordered_concat_events", """
    SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, ',' ORDER BY ts, event_id) AS key_string,
           count(event_type) AS n_events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
    FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def ordered_concat_events_q(spark, sf_dir):
    """Event types of each user and day joined in time order (a day bounds
    the group; a user's whole history would be one unbounded row)."""
    ev = read_table(spark, sf_dir, "events")
    ev = ev.withColumns({"t_us": epoch_us("ts", ev.schema["ts"].dataType), "day": F.to_date("ts")})
    return ordered_concat(ev, ["user_id", "day"], ("t_us", "event_id"), "event_type", sep=",")


@register("company_strata", "WITH " + oracle.runs_ctes() + ",\n    " + runfeatures.PEOPLE_SQL + """
    SELECT DISTINCT company, user_id, editor FROM k JOIN people USING (user_id)""")
def company_strata_q(spark, sf_dir):
    """Distinct (company, user, editor): the strata of the split.  Distinct before the join, so one row per user and editor is joined."""
    strata = K(spark, sf_dir).select("user_id", "editor").distinct()
    return strata.join(runfeatures.people(spark, sf_dir).select("user_id", "company"), "user_id").select("company", "user_id", "editor").distinct()


@register("distinct_strata", "WITH " + oracle.runs_ctes() + "\n    SELECT DISTINCT user_id, editor FROM k")
def distinct_strata_q(spark, sf_dir):
    return K(spark, sf_dir).select("user_id", "editor").distinct()


def _run_times(events):
    """First and last time of every run, without its string."""
    return events.groupBy(*RUN_KEYS).agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@register("duration_range", "WITH " + oracle.run_penalties_ctes("all") + """
    SELECT user_id, editor, task_runs, task_time FROM rp WHERE task_time >= 10 AND task_time < 900""")
def duration_range_q(spark, sf_dir):
    r = _run_times(cleaning.run_events(K(spark, sf_dir)))
    r = r.withColumn("task_time", seconds(F.col("last_us") - F.col("first_us")))
    return feat.duration_range(r).select(*RUN_KEYS, "task_time")


@register("positive_duration", "WITH " + oracle.runs_ctes() + """
    SELECT user_id, editor, task_runs, CAST(last_us - first_us AS DOUBLE) / 1e6 AS task_time
    FROM runs WHERE last_us - first_us > 0""")
def positive_duration_q(spark, sf_dir):
    r = _run_times(cleaning.run_events(K(spark, sf_dir)))
    r = r.withColumn("task_time", seconds(F.col("last_us") - F.col("first_us")))
    return feat.positive_duration(r).select(*RUN_KEYS, "task_time")


# --- recode front end -------------------------------------------------------------

@register("recode_events", recode.recode_sql())
def recode_events_q(spark, sf_dir):
    keys = recode.raw_keys(read_table(spark, sf_dir, "events"))
    return recode.recode_events(keys, recode.keycodes_frame(spark))


@register("raw_keys_to_penalties", "WITH " + oracle.run_penalties_ctes("all", k=recode.raw_key_events_sql()) + "\n    SELECT * FROM rp")
def raw_keys_to_penalties_q(spark, sf_dir):
    """From raw key rows with ISO text times to per-run penalties: editor, code table, time parsing, task runs, episodes, islands."""
    keys = recode.raw_keys_as_text(read_table(spark, sf_dir, "events"))
    rp = cleaning.run_penalties(recode.key_events_of(keys, recode.keycodes_frame(spark)))
    return rp.select(*RUN_KEYS, "key_string", "n_events", "first_us", "last_us", "task_time", *PENALTY_COLS)


_APP_SUFFIX = ["Eclipse", "Spring Tool Suite 4", "Visual Studio Code", "NetBeans IDE 8.2",
               "Sublime Text", "Notepad++", "Google Chrome", "Terminal"]
_RULES_SQL = " ".join("WHEN " + " OR ".join(f"contains(app, {f!r})" for f in frags) + f" THEN {label!r}"
                      for frags, label in EDITOR_RULES)


@register("classify_contains", f"""
    SELECT p_partkey, app, CASE {_RULES_SQL} ELSE '{EDITOR_DEFAULT}' END AS editor
    FROM (SELECT p_partkey, p_name || ' - ' || list_extract({_APP_SUFFIX!r}, CAST(p_partkey % 8 + 1 AS INTEGER)) AS app
          FROM part)""")
def classify_contains_q(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    sfx = F.array(*[F.lit(s) for s in _APP_SUFFIX])
    p = p.select("p_partkey", F.concat(F.col("p_name"), F.lit(" - "),
                                       F.element_at(sfx, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("app"))
    return p.withColumn("editor", classify_editor("app"))


@register("composite_lookup_key", """
    SELECT conv_id, turn, CASE WHEN nullif(role, 'system') IS NULL THEN 'mouse'
                               ELSE concat_ws(' - ', 'kbd', nullif(role, 'system')) END AS keyval
    FROM conversations""")
def composite_lookup_key_q(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    c = c.withColumn("_k", F.nullif(F.col("role"), F.lit("system")))
    return c.select("conv_id", "turn", composite_key(F.lit("kbd"), F.col("_k"), null_col="_k").alias("keyval"))


@register("fill_nulls", """
    SELECT c.c_custkey, c.c_mktsegment, coalesce(o.o_orderkey, 0) AS o_orderkey,
           coalesce(o.o_totalprice, 0) AS o_totalprice, o.o_orderstatus
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def fill_nulls_q(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    j = j.select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice", "o_orderstatus")
    return feat.fill_numeric(j, 0, ["o_orderkey", "o_totalprice"])


@register("local_calendar", """
    SELECT event_id, task_ocurrence, CAST(day(task_ocurrence) AS INTEGER) AS task_day,
           CAST(month(task_ocurrence) AS INTEGER) AS task_month, CAST(year(task_ocurrence) AS INTEGER) AS task_year,
           dayname(task_ocurrence) AS task_dayweek,
           CASE WHEN hour(task_ocurrence) < 12 THEN 'Morning' ELSE 'Afternoon' END AS morning_after
    FROM (SELECT event_id, timezone('America/Bogota', ts AT TIME ZONE 'UTC') AS task_ocurrence FROM events)""")
def local_calendar_q(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    x = ev.select("event_id", local_time(F.col("ts").cast("timestamp_ntz"), feat.LOCAL_ZONE).alias("task_ocurrence"))
    return x.select("event_id", "task_ocurrence", F.dayofmonth("task_ocurrence").alias("task_day"),
                    F.month("task_ocurrence").alias("task_month"), F.year("task_ocurrence").alias("task_year"),
                    weekday("task_ocurrence").alias("task_dayweek"), half_day("task_ocurrence").alias("morning_after"))


@register("round_half_even", """
    SELECT l_orderkey, l_linenumber, l_quantity / 2 AS half_qty, round_even(l_quantity / 2, 0) AS half_qty_even
    FROM lineitem""")
def round_half_even_q(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).alias("half_qty"),
                     round_half_even(F.col("l_quantity") / 2, 0).alias("half_qty_even"))


# --- commands and run features ----------------------------------------------------

@register("command_counts", "WITH " + oracle.runs_ctes() + runfeatures.command_sql_ctes() + """
    SELECT user_id, editor, task_runs, command_id, reduces, n FROM cc""")
def command_counts_q(spark, sf_dir):
    """Every run with every command of its editor, also those that do not occur (n = 0)."""
    runs = ordered_concat(cleaning.run_events(K(spark, sf_dir)))
    return runfeatures.command_counts(spark, runs, zeros=True)


@register("commands_by_category", "WITH " + oracle.runs_ctes() + runfeatures.command_sql_ctes() + """
    SELECT * FROM cat""")
def commands_by_category_q(spark, sf_dir):
    from spanflow.operators.commands import by_category
    runs = ordered_concat(cleaning.run_events(K(spark, sf_dir)))
    return by_category(runs, runfeatures.command_counts(spark, runs))


@register("task_flags", "WITH " + runfeatures.run_metrics_ctes("all") + """
    SELECT user_id, editor, task_runs,
           CASE WHEN (penalty_del <> 0 OR del_commands <> 0) THEN 1
                WHEN NOT (penalty_del <> 0 OR del_commands <> 0) THEN 0 END AS is_in_task_del,
           CASE WHEN (penalty_nav <> 0 OR nav_commands <> 0) THEN 1
                WHEN NOT (penalty_nav <> 0 OR nav_commands <> 0) THEN 0 END AS is_in_task_nav,
           CASE WHEN del_commands > 0 THEN 1 ELSE 0 END AS used_command_del,
           CASE WHEN nav_commands > 0 THEN 1 ELSE 0 END AS used_command_nav,
           round(ln(penalty_del + 0.01), 9) AS logpenaltydel, round(ln(penalty_nav + 0.01), 9) AS logpenaltynav
    FROM rm""")
def task_flags_q(spark, sf_dir):
    rm = runfeatures.run_metrics(spark, sf_dir)
    rm = feat.add_log_penalties(feat.add_usage_flags(feat.add_task_flags(rm)))
    return rm.select(*RUN_KEYS, "is_in_task_del", "is_in_task_nav", "used_command_del", "used_command_nav",
                     "logpenaltydel", "logpenaltynav")


@register("join_people", "WITH " + runfeatures.run_metrics_ctes("all") + ",\n    " + runfeatures.PEOPLE_SQL + """
    SELECT rm.user_id, rm.editor, rm.task_runs, rm.penalty_del, rm.penalty_nav, people.company, people.degree,
           people.years_study, people.work_experience
    FROM rm JOIN people ON rm.user_id = people.user_id""")
def join_people_q(spark, sf_dir):
    rm = runfeatures.run_metrics(spark, sf_dir)
    j = feat.join_people(rm, runfeatures.people(spark, sf_dir))
    return j.select(*RUN_KEYS, "penalty_del", "penalty_nav", "company", "degree", "years_study", "work_experience")


@register("model_features", "WITH " + runfeatures.model_features_ctes("all") + "\n    SELECT * FROM mf")
def model_features_q(spark, sf_dir):
    return runfeatures.model_features(spark, sf_dir)


@register("both_tasks", "WITH " + runfeatures.model_features_ctes("all") + """
    SELECT d.user_id, d.editor, d.task_runs, n.penalty_del, n.penalty_nav
    FROM (SELECT * FROM mf WHERE is_in_task_del = 1) d
    JOIN (SELECT * FROM mf WHERE is_in_task_nav = 1) n
      ON d.user_id = n.user_id AND d.editor = n.editor AND d.task_runs = n.task_runs""")
def both_tasks_q(spark, sf_dir):
    mf = tables.stage(runfeatures.model_features(spark, sf_dir))
    d = mf.filter(F.col("is_in_task_del") == 1)
    n = mf.filter(F.col("is_in_task_nav") == 1).select(*RUN_KEYS, "penalty_del", "penalty_nav")
    return feat.both_tasks(d, n)


@register("daily_totals", "WITH " + runfeatures.model_features_ctes("all") + """
    SELECT user_id, editor, task_year, task_month, task_day, task_dayweek,
           round(CAST(coalesce(sum(del_commands), 0) AS DOUBLE), 6) AS del_commands,
           round(CAST(coalesce(sum(nav_commands), 0) AS DOUBLE), 6) AS nav_commands,
           round(CAST(coalesce(sum(penalty_del), 0) AS DOUBLE), 6) AS penalty_del,
           round(CAST(coalesce(sum(penalty_nav), 0) AS DOUBLE), 6) AS penalty_nav,
           round(CAST(coalesce(sum(task_time), 0) AS DOUBLE), 6) AS task_time
    FROM mf GROUP BY user_id, editor, task_year, task_month, task_day, task_dayweek""")
def daily_totals_q(spark, sf_dir):
    return feat.daily_totals(runfeatures.model_features(spark, sf_dir))


def _usage_sql(filter_col, commands, penalty):
    return "WITH " + runfeatures.model_features_ctes("all") + f"""
    SELECT {commands} AS commands, count(*) AS n_runs, count({penalty}) AS n_with_penalty,
           round(avg({penalty}), 9) AS avg_penalty, min({penalty}) AS min_penalty, max({penalty}) AS max_penalty,
           CAST(sum(CASE WHEN {penalty} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
    FROM mf WHERE {filter_col} = 1 GROUP BY {commands}"""


@register("penalty_by_usage_del", _usage_sql("is_in_task_del", "del_commands", "penalty_del"))
def penalty_by_usage_del_q(spark, sf_dir):
    mf = runfeatures.model_features(spark, sf_dir).filter(F.col("is_in_task_del") == 1)
    return feat.penalty_by_usage(mf, "del_commands", "penalty_del")


@register("penalty_by_usage_nav", _usage_sql("is_in_task_nav", "nav_commands", "penalty_nav"))
def penalty_by_usage_nav_q(spark, sf_dir):
    mf = runfeatures.model_features(spark, sf_dir).filter(F.col("is_in_task_nav") == 1)
    return feat.penalty_by_usage(mf, "nav_commands", "penalty_nav")


PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _percentiles(target):
    flag, commands, penalty = f"is_in_task_{target}", f"{target}_commands", f"penalty_{target}"
    columns = ", ".join(f"quantile_disc({penalty}, {q}) AS {n}" for n, q in PERCENTILES.items())

    @register(f"penalty_percentiles_{target}", "WITH " + runfeatures.model_features_ctes("all") + f"""
    SELECT {commands} AS commands, count({penalty}) AS n_values, {columns} FROM mf WHERE {flag} = 1 GROUP BY {commands}""")
    def q(spark, sf_dir):
        """Exact percentiles of the penalty by number of commands used."""
        mf = tables.stage(runfeatures.model_features(spark, sf_dir).where(F.col(flag) == 1).select(F.col(commands).alias("commands"), penalty))
        return exact_quantiles(mf, ["commands"], penalty, PERCENTILES)
    return q


for _t in ("del", "nav"):
    _percentiles(_t)


# --- sampling ---------------------------------------------------------------------

_SAMPLE_SQL = """
    s0 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment
                                        ORDER BY md5(concat_ws('|', '2018', CAST(c_custkey AS VARCHAR))), c_custkey) AS rn,
                     count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n
           FROM customer),
    sample AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM s0
               WHERE rn <= round_even(0.5 * n, 0))"""


@register("stratified_sample", "WITH " + _SAMPLE_SQL + "\n    SELECT * FROM sample")
def stratified_sample_q(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return stratified(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"], 0.5, 2018)


@register("holdout", "WITH " + _SAMPLE_SQL + """
    SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM sample)""")
def holdout_q(spark, sf_dir):
    """The rows outside the sample: the same column, negated, without deriving the sample again."""
    c = read_table(spark, sf_dir, "customer")
    return with_sample(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"], 0.5, 2018, "in_sample").where("NOT in_sample").drop("in_sample")


@register("stratified_runs", "WITH " + runfeatures.model_features_ctes("all") + """,
    s0 AS (SELECT *, row_number() OVER (PARTITION BY company, user_id, editor
                    ORDER BY md5(concat_ws('|', '2018', CAST(user_id AS VARCHAR), editor, CAST(task_runs AS VARCHAR))),
                             user_id, editor, task_runs) AS rn,
                     count(*) OVER (PARTITION BY company, user_id, editor) AS n
           FROM mf WHERE is_in_task_del = 1)
    SELECT company, user_id, editor, task_runs, penalty_del FROM s0 WHERE rn <= round_even(0.5 * n, 0)""")
def stratified_runs_q(spark, sf_dir):
    mf = tables.stage(runfeatures.model_features(spark, sf_dir).filter(F.col("is_in_task_del") == 1))
    s = stratified(mf, ["company", "user_id", "editor"], ["user_id", "editor", "task_runs"], 0.5, 2018)
    return s.select("company", "user_id", "editor", "task_runs", "penalty_del")


# --- metrics ----------------------------------------------------------------------

@register("regression_metrics", """
    SELECT l_returnflag, round(sqrt(avg((p - y) * (p - y))), 9) AS rmse, round(power(corr(p, y), 2), 12) AS rsquared,
           round(avg(abs(p - y)), 9) AS mae, count(*) AS n
    FROM (SELECT l_returnflag, l_extendedprice / 1000 AS p, l_quantity AS y FROM lineitem)
    GROUP BY l_returnflag""")
def regression_metrics_q(spark, sf_dir):
    from spanflow.operators.modeling import regression_metrics
    li = read_table(spark, sf_dir, "lineitem")
    x = li.select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("y"))
    m = regression_metrics(x, "p", "y", ["l_returnflag"])
    return m.select("l_returnflag", F.round("rmse", 9).alias("rmse"), F.round("rsquared", 12).alias("rsquared"),
                    F.round("mae", 9).alias("mae"), "n")


# --- sources and sinks -----------------------------------------------------------

@register("save_and_read_table", "SELECT * FROM nation")
def save_and_read_table_q(spark, sf_dir):
    name = f"spanflow_nation_{uuid.uuid4().hex[:12]}"
    tables.save_table(read_table(spark, sf_dir, "nation"), name, mode="overwrite")
    return tables.read_table(spark, name)


@register("stage_roundtrip", "SELECT n_nationkey, n_name, n_regionkey, upper(n_name) AS n_upper FROM nation")
def stage_roundtrip_q(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").withColumn("n_upper", F.upper("n_name"))
    return tables.stage(n)


@register("resumable_stage", "SELECT n_nationkey, n_name, n_regionkey, lower(n_name) AS n_lower FROM nation")
def resumable_stage_q(spark, sf_dir):
    """A stage that a restarted job reads instead of computing it again; two calls, the second finds the first's."""
    n = read_table(spark, sf_dir, "nation").withColumn("n_lower", F.lower("n_name"))
    tables.resumable(n, "nation_names")
    return tables.resumable(n, "nation_names")


@register("csv_roundtrip", "SELECT r_regionkey, r_name FROM region")
def csv_roundtrip_q(spark, sf_dir):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    files.write_csv(read_table(spark, sf_dir, "region"), path, header=True)
    return files.read_csv(spark, path, schema="r_regionkey int, r_name string")




@register("attach_runs", "WITH " + oracle.runs_ctes() + """
    SELECT e.user_id, e.editor, e.task_runs, e.seq, e.key_event, r.n_events, CAST(length(r.key_string) AS INTEGER) AS run_length
    FROM ev e LEFT JOIN runs r ON e.user_id = r.user_id AND e.editor = r.editor AND e.task_runs = r.task_runs""")
def attach_runs_q(spark, sf_dir):
    """Run attributes attached to every event of the run (1:N left join)."""
    from spanflow.operators.sequences import attach_runs
    ev = cleaning.run_events(K(spark, sf_dir))
    runs = ordered_concat(ev).withColumn("run_length", F.length("key_string"))
    out = attach_runs(ev, runs.select(*RUN_KEYS, "n_events", "run_length"))
    return out.select(*RUN_KEYS, "seq", "key_event", "n_events", "run_length")


@register("export_feature_sets", "WITH " + runfeatures.model_features_ctes("all") + """
    SELECT 'all' AS feature_set, user_id, editor, task_runs, penalty_del, penalty_nav FROM mf
    UNION ALL SELECT 'del', user_id, editor, task_runs, penalty_del, penalty_nav FROM mf WHERE is_in_task_del = 1
    UNION ALL SELECT 'nav', user_id, editor, task_runs, penalty_del, penalty_nav FROM mf WHERE is_in_task_nav = 1""")
def export_feature_sets_q(spark, sf_dir):
    """Write the feature sets (all runs; delete runs; navigation runs) as CSV
    with a header under the shared checkpoint folder and read them back."""
    mf = tables.stage(runfeatures.model_features(spark, sf_dir))
    cols = ["user_id", "editor", "task_runs", "penalty_del", "penalty_nav"]
    schema = "user_id long, editor string, task_runs long, penalty_del double, penalty_nav double"
    out = None
    for name, cond in (("all", F.lit(True)), ("del", F.col("is_in_task_del") == 1), ("nav", F.col("is_in_task_nav") == 1)):
        path = scratch_path(spark, f"features-{name}-{uuid.uuid4().hex}")
        files.write_csv(mf.filter(cond).select(*cols), path, header=True)
        back = files.read_csv(spark, path, schema=schema).select(F.lit(name).alias("feature_set"), *cols)
        out = back if out is None else out.unionByName(back)
    return out


# --- streaming ----------------------------------------------------------------------

@register("stream_task_runs", "WITH " + oracle.runs_ctes() + """
    SELECT user_id, editor, first_us, last_us, n_events, key_string FROM runs""")
def stream_task_runs_q(spark, sf_dir):
    """The task-run rule as a Structured Streaming query over the events folder."""
    from spanflow.streaming import stream_runs_to_table
    return stream_runs_to_table(spark, sf_dir)


def queries() -> dict[str, Builder]:
    from spanflow.plans import models  # noqa: F401  (registers the model queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
