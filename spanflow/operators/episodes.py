"""Episodes, islands and penalties of task runs in one pass per run.

After the run-keyed exchange every step below stays inside the run's
partition; the run table is not joined back to its own events.

1. ``run_rows`` - one row per run: its events sorted by ``(t, seq)`` as an
   array, the run string, event count and first/last time.
2. ``episode_stream`` - one generator turns a run row into: a run-info row,
   one row per event and one row per regex match (per pattern).  A running
   sum of lengths in event order gives each event's last-character offset; in
   match order it gives each match's ``[start, end)``.
3. Matches become an open and a close marker; ordered by character offset
   (close < event < open at equal offsets) the running count of open matches
   of a pattern is positive exactly at the events strictly inside one.
4. On that same order, windows mark each family's islands of consecutive
   flagged events (lag/lead), carry each island's first time forward, put the
   island's penalty on its last event and sum penalties over the run onto the
   run-info row.  No aggregate follows the marker sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanflow.functions.metrics import FREE_US, excess_us, percentage, seconds
from spanflow.functions.spans import PATTERNS, gap_strings, match_strings
from spanflow.operators.islands import FAMILIES
from spanflow.operators.partitions import spread
from spanflow.operators.sequences import RUN_KEYS

# Integer group codes inside the stream (cheaper to sort and compare than
# names): events, then one code per pattern, then the run-info row.
EVENT_CODE = 0
RUN_CODE = 99


def run_rows(ev: DataFrame, keys: Sequence[str] = RUN_KEYS, t: str = "t_us", tie: str = "seq",
             token: str = "key_event") -> DataFrame:
    """One row per run with ``evs`` (events sorted by ``(t, tie)``),
    ``key_string``, ``n_events``, ``first_us`` and ``last_us``."""
    evs = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(tie).alias("seq"),
                                                F.col(token).alias("tok"))))
    r = spread(ev, *keys).groupBy(*keys).agg(evs.alias("evs"), F.count(token).alias("n_events"))
    return r.select(*keys, "evs",
                    F.expr("array_join(transform(evs, x -> x.tok), '')").alias("key_string"),
                    "n_events",
                    F.expr("evs[0].t").alias("first_us"),
                    F.expr("element_at(evs, -1).t").alias("last_us"))


# Items of the per-run stream, written as SQL lambdas (one expression each).
_NULLS = "'t', CAST(NULL AS BIGINT), 'seq', CAST(NULL AS BIGINT)"
# Run columns travel inside the run item, so the generator copies no run string per event.
_NO_RUN = ("'key_string', CAST(NULL AS STRING), 'n_events', CAST(NULL AS BIGINT), "
           "'first_us', CAST(NULL AS BIGINT), 'last_us', CAST(NULL AS BIGINT)")
_EVENT_ITEMS = (f"transform(evs, (x, i) -> named_struct('typ', 'E', 'grp', {EVENT_CODE}, 'idx', i, 't', x.t, "
                "'seq', x.seq, 'len', length(x.tok), 'ml', CAST(NULL AS INT), 'key_event', x.tok, " + _NO_RUN + "))")
_RUN_ITEM = (f"array(named_struct('typ', 'R', 'grp', {RUN_CODE}, 'idx', -1, {_NULLS}, 'len', 0, "
             "'ml', CAST(NULL AS INT), 'key_event', CAST(NULL AS STRING), 'key_string', key_string, 'n_events', n_events, "
             "'first_us', first_us, 'last_us', last_us))")


def _span_items(code: int, g: str, m: str) -> str:
    return (f"transform(arrays_zip({g}, {m}), (z, i) -> named_struct('typ', 'S', 'grp', {code}, 'idx', i, "
            f"{_NULLS}, 'len', length(z.{g}) + length(z.{m}), 'ml', length(z.{m}), "
            f"'key_event', CAST(NULL AS STRING), {_NO_RUN}))")


_MARKERS = """CASE typ
  WHEN 'S' THEN array(named_struct('pos', _cum - ml, 'kind', 2, 'v', 1), named_struct('pos', _cum, 'kind', 0, 'v', -1))
  WHEN 'E' THEN array(named_struct('pos', _cum - 1, 'kind', 1, 'v', 0))
  ELSE array(named_struct('pos', -1, 'kind', -1, 'v', 0)) END"""


def episode_stream(runs: DataFrame, keys: Sequence[str] = RUN_KEYS,
                   patterns: Mapping[str, str] = PATTERNS, first_only: bool = False) -> DataFrame:
    """Events with ``last_index`` and ``in_<pattern>`` flags, plus one run-info
    row per run (``typ = 'R'``, carrying key_string, n_events, first/last)."""
    keys = list(keys)
    run_cols = ["key_string", "n_events", "first_us", "last_us"]
    codes = {name: n + 1 for n, name in enumerate(patterns)}
    regex_cols = []
    for name, p in patterns.items():
        m = match_strings("key_string", p)
        if first_only:
            m = F.slice(m, 1, 1)
        c = codes[name]
        regex_cols += [m.alias(f"_m{c}"), F.slice(gap_strings("key_string", p), 1, F.size(m)).alias(f"_g{c}")]
    x = runs.select(*keys, *run_cols, "evs", *regex_cols)
    items = ", ".join([_EVENT_ITEMS] + [_span_items(codes[n], f"_g{codes[n]}", f"_m{codes[n]}") for n in patterns]
                      + [_RUN_ITEM])
    x = x.select(*keys, F.expr(f"explode(concat({items}))").alias("_it")).select(*keys, "_it.*")

    # Offsets: running length sum per (run, group) in item order.
    w1 = (Window.partitionBy(*keys, "grp").orderBy("idx")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_cum", F.sum("len").over(w1).cast("int"))

    # Markers: a match opens after its start and closes at its end.
    carried = ["typ", "grp", "idx", "t", "seq", "key_event", *run_cols]
    x = x.select(*keys, *carried, F.expr(f"explode({_MARKERS})").alias("_m"))
    x = x.select(*keys, *carried, F.col("_m.pos").alias("last_index"), F.col("_m.kind").alias("_kind"),
                 F.col("_m.v").alias("_v"))
    w2 = (Window.partitionBy(*keys).orderBy("last_index", "_kind", "idx")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumns({f"in_{p}": F.sum(F.expr(f"CASE WHEN grp = {codes[p]} THEN _v ELSE 0 END")).over(w2) > 0
                       for p in patterns})
    return x.filter(F.col("typ") != "S").drop("grp", "_v")


def stream_islands(stream: DataFrame, keys: Sequence[str] = RUN_KEYS,
                   families: Mapping[str, Sequence[str]] = FAMILIES,
                   free_us: int = FREE_US) -> DataFrame:
    """Island bookkeeping on the run-ordered stream, with windows only.

    The stream arrives sorted by run and offset from the marker window, so
    every window below reuses that order (no further sort, no aggregate).  Per
    family ``f``: ``is_f`` (event in a match of the family), ``_st_f`` /
    ``_en_f`` (first / last event of an island, from lag / lead), ``_isl_f``
    (island number), ``_t0_f`` / ``_i0_f`` (time and index of the island's
    first event) and ``_pen_f`` (the island's penalty, on its last event).
    """
    keys = list(keys)
    fams = list(families)
    w = Window.partitionBy(*keys).orderBy("last_index", "_kind", "idx")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = {f"is_{fam}": F.expr("(" + " OR ".join(f"in_{p}" for p in pats) + ") AND typ = 'E'")
             for fam, pats in families.items()}
    x = stream.withColumns(flags)
    x = x.withColumns({
        **{f"_st_{f}": F.col(f"is_{f}") & ~F.lag(f"is_{f}", 1, False).over(w) for f in fams},
        **{f"_en_{f}": F.col(f"is_{f}") & ~F.lead(f"is_{f}", 1, False).over(w) for f in fams},
    })
    x = x.withColumns({
        **{f"_isl_{f}": F.sum(F.col(f"_st_{f}").cast("long")).over(running) for f in fams},
        **{f"_t0_{f}": F.last(F.when(F.col(f"_st_{f}"), F.col("t")), ignorenulls=True).over(running) for f in fams},
        **{f"_i0_{f}": F.last(F.when(F.col(f"_st_{f}"), F.col("idx")), ignorenulls=True).over(running)
           for f in fams},
    })
    return x.withColumns({f"_pen_{f}": F.when(F.col(f"_en_{f}"), excess_us(F.col("t") - F.col(f"_t0_{f}"), free_us))
                          for f in fams})


def island_table(isl: DataFrame, families: Sequence[str] = tuple(FAMILIES),
                 keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per island: keys, family, island, n_events, first_us, last_us,
    duration_us, penalty_us (taken from each island's last event)."""
    keys = list(keys)
    fams = list(families)
    ends = " OR ".join(f"_en_{f}" for f in fams)
    items = ", ".join(
        f"CASE WHEN _en_{f} THEN named_struct('family', '{f}', 'island', _isl_{f}, "
        f"'n_events', CAST(idx - _i0_{f} + 1 AS BIGINT), 'first_us', _t0_{f}, 'penalty_us', _pen_{f}) END"
        for f in fams)
    x = isl.filter(F.expr(ends)).select(
        *keys, "t", F.expr(f"explode(filter(array({items}), s -> s IS NOT NULL))").alias("_i"))
    return x.select(*keys, F.col("_i.family").alias("family"), F.col("_i.island").alias("island"),
                    F.col("_i.n_events").alias("n_events"), F.col("_i.first_us").alias("first_us"),
                    F.col("t").alias("last_us"), (F.col("t") - F.col("_i.first_us")).alias("duration_us"),
                    F.col("_i.penalty_us").alias("penalty_us"))


def run_penalty_table(isl: DataFrame, keys: Sequence[str] = RUN_KEYS,
                      families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """Per run: run columns, task time and per-family penalty and percentage.

    Island penalties are summed over the run's partition and read off the run
    row - one more window on the same order, no aggregate and no join back.
    Runs of zero duration are dropped before any division; a family without
    islands in a run stays null."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    sums = {f"penalty_{f}_us": F.sum(f"_pen_{f}").over(w) for f in families}
    r = isl.withColumns(sums).filter(F.col("typ") == "R")
    r = r.withColumn("task_us", F.col("last_us") - F.col("first_us")).filter(F.col("task_us") > 0)
    cols = {"task_time": seconds("task_us")}
    for f in families:
        cols[f"penalty_{f}"] = seconds(f"penalty_{f}_us")
        cols[f"percentage_{f}"] = percentage(f"penalty_{f}_us", "task_us")
    return r.select(*keys, "key_string", "n_events", "first_us", "last_us", "task_us", *sums,
                    *[c.alias(n) for n, c in cols.items()])
