"""DuckDB SQL for the registered queries (the correctness oracle).

Each statement is written the plain way - one window per user stream, joins of
events to spans by offset range - over the same parquet views, so it checks
the distributed plans against an independent formulation.
"""

from __future__ import annotations

from spanflow.functions.metrics import FREE_US, RUN_GAP_US
from spanflow.functions.spans import PATTERNS
from spanflow.plans.keystream import key_events_sql

FAMILY_SQL = {
    "del": "in_del_key OR in_del_mouse",
    "del_mouse": "in_del_mouse",
    "nav": "in_mov_key OR in_mov_mouse",
    "nav_mouse": "in_mov_mouse",
}


def _runs_ctes(k: str | None = None) -> str:
    """CTEs of runs of the key events ``k`` (a CTE list that ends in k; by default those of the test data)."""
    return (k or key_events_sql()) + f""",
    kb AS (
      SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id, editor ORDER BY t_us, seq) > {RUN_GAP_US}
                     THEN 1 ELSE 0 END AS brk,
             coalesce(t_us - lag(t_us) OVER (PARTITION BY user_id, editor ORDER BY t_us, seq), 0) AS gap_us,
             row_number() OVER (PARTITION BY user_id, editor ORDER BY t_us, seq) AS row_id
      FROM k),
    ev AS (
      SELECT *, CAST(1 + sum(brk) OVER (PARTITION BY user_id, editor ORDER BY t_us, seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS task_runs
      FROM kb),
    ev2 AS (
      SELECT *, sum(length(key_event)) OVER (PARTITION BY user_id, editor, task_runs ORDER BY t_us, seq
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS last_index
      FROM ev),
    runs AS (
      SELECT user_id, editor, task_runs, string_agg(key_event, '' ORDER BY t_us, seq) AS key_string,
             count(key_event) AS n_events, min(t_us) AS first_us, max(t_us) AS last_us
      FROM ev GROUP BY user_id, editor, task_runs)"""


def _spans_ctes(mode: str) -> str:
    parts = []
    for name, rx in PATTERNS.items():
        parts.append(f"""
      SELECT user_id, editor, task_runs, '{name}' AS pattern,
             regexp_extract_all(key_string, '{rx}') AS m,
             regexp_split_to_array(key_string, '{rx}') AS g
      FROM runs""")
    first = "WHERE k = 0" if mode == "first" else ""
    return f""",
    sp0 AS ({" UNION ALL ".join(parts)}),
    sp1 AS (SELECT user_id, editor, task_runs, pattern, m, g, unnest(range(len(m))) AS k FROM sp0),
    sp2 AS (SELECT user_id, editor, task_runs, pattern, k, length(g[k + 1]) AS gl, length(m[k + 1]) AS ml
            FROM sp1 {first}),
    sp3 AS (SELECT *, sum(gl + ml) OVER (PARTITION BY user_id, editor, task_runs, pattern ORDER BY k
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span_end
            FROM sp2),
    spans AS (SELECT user_id, editor, task_runs, pattern, CAST(k AS INTEGER) AS match_no,
                     CAST(span_end - ml AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end
              FROM sp3)"""


def _flags_ctes() -> str:
    cols = ",\n             ".join(
        f"coalesce(bool_or(s.pattern = '{p}'), false) AS in_{p}" for p in PATTERNS)
    return f""",
    fl AS (
      SELECT e.user_id, e.editor, e.task_runs, e.t_us, e.seq, e.row_id, e.key_event, e.last_index,
             {cols}
      FROM ev2 e LEFT JOIN spans s
        ON e.user_id = s.user_id AND e.editor = s.editor AND e.task_runs = s.task_runs
       AND s.span_start < e.last_index AND e.last_index < s.span_end
      GROUP BY e.user_id, e.editor, e.task_runs, e.t_us, e.seq, e.row_id, e.key_event, e.last_index)"""


def _islands_ctes() -> str:
    fams = " UNION ALL ".join(
        f"SELECT user_id, editor, task_runs, t_us, seq, '{f}' AS family, ({c}) AS f FROM fl"
        for f, c in FAMILY_SQL.items())
    return f""",
    fam AS ({fams}),
    fg AS (
      SELECT *, row_number() OVER (PARTITION BY user_id, editor, task_runs, family ORDER BY t_us, seq)
              - row_number() OVER (PARTITION BY user_id, editor, task_runs, family, f ORDER BY t_us, seq) AS g
      FROM fam),
    isl AS (
      SELECT user_id, editor, task_runs, family, g, count(*) AS n_events, min(t_us) AS first_us,
             max(t_us) AS last_us, max(t_us) - min(t_us) AS duration_us,
             greatest(max(t_us) - min(t_us) - {FREE_US}, 0) AS penalty_us
      FROM fg WHERE f GROUP BY user_id, editor, task_runs, family, g),
    isln AS (
      SELECT *, row_number() OVER (PARTITION BY user_id, editor, task_runs, family ORDER BY first_us) AS island
      FROM isl)"""


def islands_sql(mode: str) -> str:
    return "WITH " + _runs_ctes() + _spans_ctes(mode) + _flags_ctes() + _islands_ctes() + """
    SELECT user_id, editor, task_runs, family, CAST(island AS BIGINT) AS island, CAST(n_events AS BIGINT) AS n_events,
           first_us, last_us, duration_us, CAST(penalty_us AS BIGINT) AS penalty_us
    FROM isln"""


def run_penalties_ctes(mode: str, name: str = "rp", k: str | None = None) -> str:
    """All CTEs up to ``name``: the run penalty table (without WITH)."""
    pen = ",\n           ".join(
        f"CAST(sum(penalty_us) FILTER (WHERE family = '{f}') AS BIGINT) AS p_{f}" for f in FAMILY_SQL)
    out = []
    for f in FAMILY_SQL:
        out.append(f"CAST(p.p_{f} AS DOUBLE) / 1e6 AS penalty_{f}")
        out.append(f"CAST(p.p_{f} * 100 AS DOUBLE) / CAST(r.last_us - r.first_us AS DOUBLE) AS percentage_{f}")
    outs = ",\n           ".join(out)
    return _runs_ctes(k) + _spans_ctes(mode) + _flags_ctes() + _islands_ctes() + f""",
    pr AS (
      SELECT user_id, editor, task_runs,
           {pen}
      FROM isl GROUP BY user_id, editor, task_runs),
    {name} AS (
    SELECT r.user_id, r.editor, r.task_runs, r.key_string, r.n_events, r.first_us, r.last_us,
           CAST(r.last_us - r.first_us AS DOUBLE) / 1e6 AS task_time,
           {outs}
    FROM runs r LEFT JOIN pr p
      ON r.user_id = p.user_id AND r.editor = p.editor AND r.task_runs = p.task_runs
    WHERE r.last_us - r.first_us > 0)"""


def run_penalties_sql(mode: str) -> str:
    return "WITH " + run_penalties_ctes(mode) + "\n    SELECT * FROM rp"


def spans_sql(pattern: str, mode: str) -> str:
    return "WITH " + _runs_ctes() + _spans_ctes(mode) + f"""
    SELECT user_id, editor, task_runs, match_no, span_start, span_end
    FROM spans WHERE pattern = '{pattern}'"""


def span_flags_sql(mode: str) -> str:
    cols = ", ".join(f"in_{p}" for p in PATTERNS)
    return "WITH " + _runs_ctes() + _spans_ctes(mode) + _flags_ctes() + f"""
    SELECT user_id, editor, task_runs, seq, t_us, key_event, CAST(last_index AS INTEGER) AS last_index, {cols}
    FROM fl"""


def runs_ctes() -> str:
    return _runs_ctes()


def flags_ctes(mode: str) -> str:
    return _runs_ctes() + _spans_ctes(mode) + _flags_ctes()
