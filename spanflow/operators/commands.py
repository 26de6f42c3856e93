"""Command usage counts per run from a command catalogue.

The catalogue is a long table ``(editor, command_id, pattern, reduces)``: the
regex of a shortcut in the run string and the task categories it reduces
(``Delete``, ``Navigation`` or both).  It travels as one constant map from editor
to its patterns, in pieces of a checked size, so runs are counted where they are:
no join and no shuffle on ``editor``, which has few values and would skew.
Commands that do not occur make a row on request only.  Category totals are a
conditional aggregation, so no column is ever named after a data value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KEYS = ["user_id", "editor", "task_runs"]
CATALOGUE_SCHEMA = "editor string, command_id string, pattern string, reduces string"


def catalogue_frame(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), CATALOGUE_SCHEMA)


_ENTRY = "struct<command_id:string,pattern:string,reduces:string>"


def _pieces(catalogue: DataFrame, piece_bytes: int) -> list[dict[str, list[dict]]]:
    """The catalogue as maps from editor to commands, each of at most about ``piece_bytes``."""
    size = F.octet_length(F.concat_ws("", "editor", "command_id", "pattern", "reduces")) + 64
    total = catalogue.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // piece_bytes))
    numbered = catalogue.withColumn("_piece", F.pmod(F.xxhash64("editor", "command_id", "pattern"), F.lit(n)))
    out = []
    for i in range(n):  # one piece at a time is on the driver
        piece: dict[str, list[dict]] = {}
        for r in numbered.where(F.col("_piece") == i).orderBy("editor", "command_id", "pattern").collect():
            piece.setdefault(r["editor"], []).append({"command_id": r["command_id"], "pattern": r["pattern"], "reduces": r["reduces"]})
        out.append(piece)
    return out


def count_commands(runs: DataFrame, catalogue: DataFrame, keys: Sequence[str] = RUN_KEYS,
                   text: str = "key_string", piece_bytes: int = 4 << 20, zeros: bool = False) -> DataFrame:
    """One row per (run, command of the run's editor) that occurs, or with ``zeros`` per any:
    ``n`` = non-overlapping matches of the command pattern in the run string.

    A catalogue of more than ``piece_bytes`` is counted in several passes over the runs.
    """
    out = None
    for piece in _pieces(catalogue, piece_bytes):
        commands = F.from_json(F.lit(json.dumps(piece)), f"map<string, array<{_ENTRY}>>")
        x = runs.select(*keys, F.col(text).alias("_text"), commands[F.col("editor")].alias("_commands"))
        found = "transform(_commands, c -> struct(c.command_id, c.reduces, regexp_count(_text, c.pattern) AS n))"
        part = x.select(*keys, F.explode(F.expr(found if zeros else f"filter({found}, c -> c.n > 0)")).alias("_c")).select(*keys, "_c.command_id", "_c.reduces", "_c.n")
        out = part if out is None else out.unionByName(part)
    return out


def by_category(runs: DataFrame, counts: DataFrame, categories: dict[str, str] | None = None,
                keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per row of ``runs``: sum of ``counts`` of the commands whose ``reduces``
    contains each category word; 0 for a run without any command."""
    categories = categories or {"del_commands": "Delete", "nav_commands": "Navigation"}
    aggs = [F.sum(F.when(F.col("reduces").contains(word), F.col("n"))).alias(name) for name, word in categories.items()]
    sums = counts.groupBy(*keys).agg(*aggs)
    return runs.select(*keys).join(sums, list(keys), "left").select(
        *keys, *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in categories])


def category_counts(rows: Sequence[tuple[str, str, str, str]], categories: dict[str, str] | None = None,
                    editor: str = "editor", text: str = "key_string") -> dict[str, F.Column]:
    """Per-run category totals as column expressions, for an in-memory
    catalogue: the sum of ``regexp_count`` over the commands of the run's
    editor whose ``reduces`` contains the category word (0 when none).

    Same numbers as :func:`count_commands` + :func:`by_category`, without a
    join (use those for a catalogue too long for an expression), so a run table can be extended in place instead of being joined
    back to its own aggregate.
    """
    categories = categories or {"del_commands": "Delete", "nav_commands": "Navigation"}
    out = {}
    for name, word in categories.items():
        per_editor: dict[str, list[str]] = {}
        for ed, _cid, pattern, reduces in rows:
            if word in reduces:
                per_editor.setdefault(ed, []).append(pattern)
        expr = F.lit(0).cast("long")
        for ed, pats in per_editor.items():
            total = None
            for p in pats:
                c = F.regexp_count(F.col(text), F.lit(p)).cast("long")
                total = c if total is None else total + c
            expr = F.when(F.col(editor) == ed, total).otherwise(expr)
        out[name] = expr
    return out
