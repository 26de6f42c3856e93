"""Episode spans as rows, and event membership in them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanflow.functions.spans import PATTERNS, gap_strings, match_strings
from spanflow.operators.partitions import spread
from spanflow.operators.sequences import RUN_KEYS


def span_rows(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, text: str = "key_string",
              patterns: Mapping[str, str] = PATTERNS, first_only: bool = False) -> DataFrame:
    """One row per regex match: ``keys, pattern, match_no, span_start, span_end``.

    Matches and the text between them are exploded together; a match starts
    after all earlier gaps and matches plus its own leading gap, which a
    running sum over ``match_no`` gives (the window is partitioned by the run,
    so it reuses the run partitioning).  ``first_only`` keeps match 0.
    """
    keys = list(keys)
    per = []
    for name, p in patterns.items():
        m = match_strings(text, p)
        g = F.slice(gap_strings(text, p), 1, F.size(m))
        per.append(F.struct(F.lit(name).alias("pattern"),
                            F.arrays_zip(g.alias("g"), m.alias("m")).alias("z")))
    x = runs.select(*keys, F.explode(F.array(*per)).alias("_p"))
    x = x.select(*keys, F.col("_p.pattern").alias("pattern"),
                 F.posexplode("_p.z").alias("match_no", "_gm"))
    if first_only:
        x = x.filter(F.col("match_no") == 0)
    w = (Window.partitionBy(*keys, "pattern").orderBy("match_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.length("_gm.g") + F.length("_gm.m")).over(w)
    x = x.withColumn("span_end", end.cast("int"))
    return x.select(*keys, "pattern", F.col("match_no").cast("int").alias("match_no"),
                    (F.col("span_end") - F.length("_gm.m")).cast("int").alias("span_start"),
                    "span_end")


def span_flags(events: DataFrame, spans: DataFrame, keys: Sequence[str] = RUN_KEYS,
               pos: str = "last_index", patterns: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    """Add ``in_<pattern>`` (boolean): ``start < pos < end`` for some span of the
    event's run.

    Span boundaries become marker rows merged into the run's events by
    position: a close marker sorts before an event at the same offset and an
    open marker after it, so the running count of open spans at an event is
    positive exactly when the offset is strictly inside one.  Linear in events
    plus spans per run, unlike testing every event against every span.
    """
    keys = list(keys)
    deltas = {p: f"_d_{p}" for p in patterns}
    ev = events.withColumns({"_pos": F.col(pos), "_kind": F.lit(1),
                             **{d: F.lit(0) for d in deltas.values()}})
    marks = spans.select(*keys, F.col("pattern"), F.explode(F.array(
        F.struct(F.col("span_start").alias("_pos"), F.lit(2).alias("_kind"), F.lit(1).alias("_v")),
        F.struct(F.col("span_end").alias("_pos"), F.lit(0).alias("_kind"), F.lit(-1).alias("_v")),
    )).alias("_m"))
    marks = marks.select(*keys, F.col("_m._pos").alias("_pos"), F.col("_m._kind").alias("_kind"),
                         *[F.when(F.col("pattern") == p, F.col("_m._v")).otherwise(F.lit(0)).alias(d)
                           for p, d in deltas.items()])
    u = spread(ev.unionByName(marks, allowMissingColumns=True), *keys)
    w = (Window.partitionBy(*keys).orderBy("_pos", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumns({f"in_{p}": F.sum(d).over(w) > 0 for p, d in deltas.items()})
    return u.filter(F.col("_kind") == 1).drop("_pos", "_kind", *deltas.values())
