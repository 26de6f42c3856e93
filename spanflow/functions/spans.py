"""Regex episode finding over run strings.

A task run is spelled as one string of event codes (``MLDMMMLUBSDBSU``...).
Episodes are found with four regular expressions; a match is a half-open
character span ``[start, end)`` of that string, and an event belongs to an
episode when the offset of its last character lies strictly inside a span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four episode patterns, exactly as specified.
PATTERNS: dict[str, str] = {
    "del_mouse": "MLD(?:(MM|MCU|MCD))+MLU(?:((BSDBSU|REDREU)+|(SDSU|EDEU)|[^A-Z]D))",
    "mov_mouse": "(?:(MM|MCU|MCD))+",
    "del_key": "(BSDBSU|REDREU)+",
    "mov_key": "(ANDANU|LDLU|ASDASU|AEDAEU)+",
}

# The same patterns in the form the JVM runs them.  Java's backtracking engine
# recurses once per repetition of a group that contains an alternation, so a
# run with a few thousand consecutive ``MM`` codes overflows the thread stack.
# Possessive repetition (``++``) is matched iteratively.  It selects the same
# spans here because no repeated alternative is a prefix of another, and what
# follows a repetition (``MLU``, or the end of the pattern) can never start
# with characters a repetition gave back: giving one back only exposes ``MM``
# or ``MC``, where ``MLU`` cannot match.  Capture groups are dropped; only whole
# matches are used.  tests/test_spans.py checks both forms agree with Python's
# ``re`` on random code strings.
EXEC_PATTERNS: dict[str, str] = {
    "del_mouse": "MLD(?:MM|MCU|MCD)++MLU(?:(?:BSDBSU|REDREU)++|SDSU|EDEU|[^A-Z]D)",
    "mov_mouse": "(?:MM|MCU|MCD)++",
    "del_key": "(?:BSDBSU|REDREU)++",
    "mov_key": "(?:ANDANU|LDLU|ASDASU|AEDAEU)++",
}

SPAN_TYPE = "array<struct<start:int,end:int>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exec_pattern(pattern: str) -> str:
    """Map a specified pattern to its JVM execution form (identity for others)."""
    for name, p in PATTERNS.items():
        if p == pattern:
            return EXEC_PATTERNS[name]
    return pattern


def match_strings(text, pattern: str) -> Column:
    """All non-overlapping, leftmost-first matches, in order."""
    return F.regexp_extract_all(_col(text), F.lit(exec_pattern(pattern)), 0)


def gap_strings(text, pattern: str) -> Column:
    """Text between matches (``len = matches + 1``)."""
    return F.split(_col(text), exec_pattern(pattern), -1)


def find_spans(text, pattern: str, first_only: bool = False) -> Column:
    """Offsets ``[start, end)`` of the matches of ``pattern`` in ``text`` as
    ``array<struct<start:int,end:int>>``.

    Matches and the text between them are both produced by the regex engine,
    so start offsets are prefix sums of their lengths.  The pattern must not
    match the empty string (none of :data:`PATTERNS` does).  ``first_only``
    keeps the first match only; no match gives an empty array.

    This is the per-row form; the run pipeline explodes matches and takes the
    prefix sums with a window instead (linear in the number of matches).
    """
    m = match_strings(text, pattern)
    if first_only:
        m = F.slice(m, 1, 1)
    g = F.slice(gap_strings(text, pattern), 1, F.size(m))
    z = F.arrays_zip(g.alias("g"), m.alias("m"))

    def step(acc, x):
        s = acc["pos"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"),
                        F.array_append(acc["spans"], F.struct(s.alias("start"), e.alias("end"))).alias("spans"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("spans"))
    return F.aggregate(z, init, step, lambda acc: acc["spans"])


def in_spans(value, spans) -> Column:
    """1 when ``start < value < end`` for some span, else 0 (null/empty -> 0)."""
    v = _col(value)
    hit = F.exists(_col(spans), lambda s: (v > s["start"]) & (v < s["end"]))
    return F.coalesce(hit.cast("int"), F.lit(0))


def match_count(text, pattern) -> Column:
    """Number of non-overlapping matches; ``pattern`` may be a column."""
    p = F.lit(exec_pattern(pattern)) if isinstance(pattern, str) else pattern
    return F.regexp_count(_col(text), p)
