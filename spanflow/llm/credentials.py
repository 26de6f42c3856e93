"""Secrets in texts: fixed patterns, and values in a credential context that are costly to guess.

A value that follows a word such as ``password`` counts as a secret if no cheap
way to guess it is known.  Its guess cost is the least, over all segmentations
into words, dates, repeats, keyboard walks and brute-force spans, of the sum of
the parts' log10 numbers of guesses: a shortest path over the value's positions.

The words and their costs come from the corpus itself, with every credential
value taken out, so a secret that is copied often does not become a word.  Only
the pieces of values are looked up, by a join; no dictionary travels to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.words import text_key

#: The patterns of the base kinds, the group that is measured, and its least length.
BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # maximal runs: the longer ones are those of [0-9a-f]+
]
GUESS = "guess"
KINDS = [k for k, *_ in BASE] + [GUESS]

#: Words that announce a credential, in the languages of web text at hand; then a separator and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|bearer|credentials?|auth(?:orization)?"""
    r"""|(?:api|access|private|secret|client|auth)[_\- ]?(?:key|token|secret)|contrase(?:ñ|n)a|clave"""
    r"""|mot\ de\ passe|passwort|kennwort)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|es|est|ist)\x20+(?=["'])|(?<=[Bb]earer)\x20+)"""
    r"""(?:(?:bearer|basic)\x20+)?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>]+))""", re.IGNORECASE | re.ASCII)
#: Punctuation that ends a sentence rather than a value.
_TRAIL = ".,;:!?)]}"

#: log10 guesses from which a value is a secret (ten digits: beyond a patient online attack).
LEAST_COST = 10.0
#: Letters of a dictionary piece, at least and at most.
WORD_SIZES = (3, 24)
#: Longest repeated unit and keyboard walk looked for; a longer random unit is a secret by itself.
LONGEST_UNIT, LONGEST_WALK = 32, 64
#: Usual substitutes of letters.
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
#: Rows of keys; a walk goes on to a neighbouring key of a row or of the row below or above.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_SALTS = 32
_SEGMENT = math.log10(5)  # which of the five kinds a segment is


def _boards() -> list[tuple[dict[str, dict[str, tuple[int, int]]], int, float]]:
    """The keyboard and the alphabet: per key its neighbours and the direction to them, number of keys, mean neighbours."""
    at = {k: (r, c) for r, row in enumerate(KEY_ROWS) for c, k in enumerate(row)}
    keys = {a: {b: (r - ra, c - ca) for b, (r, c) in at.items()
                if (r == ra and abs(c - ca) == 1) or (abs(r - ra) == 1 and c - ca in (0, ra - r))} for a, (ra, ca) in at.items()}
    line = {a: {b: (0, i - j) for i, b in enumerate(ALPHABET) if abs(i - j) == 1} for j, a in enumerate(ALPHABET)}
    return [(near, len(near), sum(map(len, near.values())) / len(near)) for near in (keys, line)]


_BOARDS = _boards()
_DATE = re.compile(r"(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s1)(?:0?[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])(?P<s2>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s2)(?P<y2>(?:19|20)?\d\d)|(?P<y3>(?:19|20)\d\d))")


def char_cost(c: str) -> float:
    """log10 of the size of the character's class."""
    if c.isascii():
        return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def pieces(value: str) -> set[str]:
    """Lower-cased runs of letters of dictionary size within a value, as written and with substitutes undone."""
    low, out = value.lower(), set()
    for text in {low, low.translate(LEET)}:
        for run in re.finditer(r"[^\W\d_]+", text):
            s = run.group()
            out.update(s[i:j] for i in range(len(s)) for j in range(i + WORD_SIZES[0], min(i + WORD_SIZES[1], len(s)) + 1))
    return out


def _variants(piece: str, plain: str) -> float:
    """log10 of the ways to write a word with capitals and substitutes as this piece is written."""
    upper = sum(c.isupper() for c in piece)
    swapped = sum(a != b for a, b in zip(piece.lower(), plain))
    ways = 1
    if upper:
        ways *= 2 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else sum(
            math.comb(len(piece), i) for i in range(1, min(upper, len(piece) - upper) + 1)) or 2
    return math.log10(ways) + swapped * math.log10(2)


def _segments(value: str, costs: dict[str, float], depth: int) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words, dates, walks and repeats in a value."""
    low = value.lower()
    plains = [low] if low == low.translate(LEET) else [low, low.translate(LEET)]
    n = len(value)
    if len(low) != n:  # lower-casing changed the length: words of such a value are not looked up
        plains = []
    for plain in plains:
        for i in range(n):
            for j in range(i + WORD_SIZES[0], min(i + WORD_SIZES[1], n) + 1):
                if plain[i:j] in costs:
                    yield i, j, costs[plain[i:j]] + _variants(value[i:j], plain[i:j])
    for i in range(n):
        m = _DATE.match(value, i)
        if m:
            year = next(y for y in (m["y1"], m["y2"], m["y3"]) if y)
            years = max(abs(int(year) - 2000), 20) if len(year) == 4 else 100
            days = 1 if m["y3"] else 365
            yield i, m.end(), math.log10(days * years) + (math.log10(4) if m["s1"] or m["s2"] else 0)
        for near, keys, degree in _BOARDS if len(low) == n else ():
            j, turns, step = i + 1, 0, None
            while j < n and j - i < LONGEST_WALK and low[j] in near.get(low[j - 1], ()):
                here = near[low[j - 1]][low[j]]
                turns, step = turns + (here != step), here
                j += 1
                if j - i >= 3:
                    yield i, j, math.log10(sum(math.comb(k - 1, t - 1) * keys * degree ** t
                                               for k in range(2, j - i + 1) for t in range(1, min(turns, k - 1) + 1)))
        if depth:
            for p in range(1, min(LONGEST_UNIT, (n - i) // 2) + 1):
                if value[i:i + p] != value[i + p:i + 2 * p] or (i >= p and value[i - p:i] == value[i:i + p]):
                    continue
                unit, k = value[i:i + p], 2
                while value[i + k * p:i + (k + 1) * p] == unit:
                    k += 1
                cost = guess_cost(unit, costs, depth - 1)
                yield i, i + k * p, cost + math.log10(k)


def guess_cost(value: str, costs: dict[str, float], depth: int = 1) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    ``costs`` has the log10 rank cost of lower-cased words.  Positions are
    nodes; a brute-force span grows by one character at a time and pays for
    its kind once.
    """
    n = len(value)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _segments(value, costs, depth):
        into[j].append((i, cost))
    known, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        brute[j] = char_cost(value[j - 1]) + min(brute[j - 1], known[j - 1] + _SEGMENT)
        known[j] = min((min(known[i], brute[i]) + _SEGMENT + cost for i, cost in into[j]), default=math.inf)
    return min(known[n], brute[n])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: whole matches, in code points."""
    return [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE
            for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values that stand in a credential context."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = next(m.span(g) for g in (1, 2, 3) if m.group(g) is not None)
        if m.group(3) is not None:
            b = a + len(m.group(3).rstrip(_TRAIL))
        if b > a:
            out.append((a, b))
    return out


_FOUND = "array<struct<kind:string,start:long,end:long,cost:double>>"


def scan(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], text: str = "text", keep: list[str] | None = None,
         least_cost: float = LEAST_COST) -> DataFrame:
    """One row per row of ``docs``: row (a struct of the columns ``keep``, by default all), n_values, and secrets.

    secrets lists (kind, start, end, cost), sorted by start, then kind in the
    order of ``KINDS``; offsets are code points, the end exclusive.  Base kinds
    have no cost; ``guess`` marks a credential value whose guess cost, as log10,
    is ``least_cost`` or more, also where a base kind has found it.  n_values
    counts the values judged.  A null or empty text has no secrets; texts and
    values of any length are judged whole; repeated rows are judged each; the
    struct keeps clashing column names apart; an empty table gives no rows.
    """
    columns = docs.columns if keep is None else keep
    source = docs.select(F.struct(*columns).alias("row"), F.col(text).alias("text"))
    row_type = source.schema["row"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, values = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base.append([{"kind": k, "start": a, "end": b, "cost": None} for k, a, b in base_spans(t)])
                values.append([{"start": a, "end": b, "value": t[a:b]} for a, b in context_values(t)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array(base, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))),
                 pa.array(values, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))],
                names=["row", "base", "values"])

    found = stage(source.mapInArrow(find, f"row {row_type}, base {_FOUND}, values array<struct<start:long,end:long,value:string>>")
                  .withColumn("at", F.monotonically_increasing_id()))
    each = found.where(F.size("values") > 0).select("at", F.explode("values").alias("v")).select("at", "v.*")
    each = each.select("at", "start", "end", *text_key(F.col("value")), "value")
    costs = stage(value_costs(source.select("text"), each, stage))
    # a hot value is dealt over several partitions: its cost is a copy in each
    salted = costs.select("k1", "k2", "cost", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    judged = each.withColumn("salt", F.pmod(F.hash("at", "start"), F.lit(_SALTS))).join(salted, ["k1", "k2", "salt"])
    guessed = judged.groupBy("at").agg(F.collect_list(F.when(F.col("cost") >= least_cost, F.struct(
        F.lit(GUESS).alias("kind"), "start", "end", "cost"))).alias("guessed"))
    with_values = found.where(F.size("values") > 0).join(guessed, "at")
    kinds = f"array({', '.join(repr(k) for k in KINDS)})"
    ranked = (f"transform(array_sort(transform(x, s -> struct(s.start, array_position({kinds}, s.kind) AS i, s.end, s.kind, s.cost))),"
              " s -> struct(s.kind, s.start, s.end, s.cost))")
    both = with_values.select("row", F.size("values").alias("n_values"), F.concat("base", "guessed").alias("x")).unionByName(
        found.where(F.size("values") == 0).select("row", F.lit(0).alias("n_values"), F.col("base").alias("x")))
    return both.select("row", "n_values", F.expr(ranked).alias("secrets"))


def value_costs(texts: DataFrame, values: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k1, k2, cost): the guess cost of every distinct value; ``values`` has one row per occurrence."""
    distinct = stage(values.groupBy("k1", "k2").agg(F.min("value").alias("value"), F.count("*").alias("n")))

    def split(column):
        return F.explode(F.split(F.lower(column), r"[^\p{L}]+")).alias("word")

    # words of all texts, less those of the values
    counted = texts.select(split(F.coalesce("text", F.lit("")))).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    inside = distinct.select(split(F.col("value")), "n").where("word != ''").groupBy("word").agg((-F.sum("n")).alias("n"))
    words = stage(counted.unionByName(inside).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    total = words.agg(F.sum("n")).first()[0] or 1

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = sorted(pieces(value))
                yield pa.RecordBatch.from_arrays([pa.array([k1] * len(found), pa.int64()), pa.array([k2] * len(found), pa.int32()),
                                                  pa.array(found, pa.string())], names=["k1", "k2", "word"])

    known = (distinct.select("k1", "k2", "value").mapInArrow(explode, "k1 long, k2 int, word string").join(words, "word")
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "n")).alias("known")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = [guess_cost(v, {w["word"]: math.log10(total / w["n"]) for w in k or ()})
                    for v, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cost, pa.float64())], names=["k1", "k2", "cost"])

    return distinct.select("k1", "k2", "value").join(known, ["k1", "k2"], "left").select("k1", "k2", "value", "known").mapInArrow(
        judge, "k1 long, k2 int, cost double")


def digest(scanned: DataFrame) -> DataFrame:
    """The rows of :func:`scan` with their counts and joined spans; ``row`` stays as it is."""
    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    base = f"filter(secrets, s -> s.kind != '{GUESS}')"
    counts = [F.expr(f"size(filter(secrets, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("row", *counts[:-1], F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
                          F.expr(joined("secrets")).alias("spans"), counts[-1],
                          F.col("n_values").cast("long").alias("n_values"))
