"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a number per document, larger meaning worse.  Its cutoffs come from
a fixed grid.  For each stratum, the labelled good documents that a cutoff would
reject are counted; a cutoff is certified when an exact binomial test says, at a
level corrected for all rules and strata, that it rejects at most its share of
good documents.  Cutoffs of one rule are tested from the loosest to the
strictest until one fails (fixed-sequence testing, which needs no correction for
the number of cutoffs).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.llm.words import SPACE, words_column

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RULES = ("symbol_ratio", "shout_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "word_length")


@dataclass(frozen=True)
class Risk:
    """``limit``: share of good documents that all rules of a stratum together may reject;
    ``level``: probability that any of the guarantees fails."""

    limit: float = 0.05
    level: float = 0.05
    grid: dict[str, tuple[float, ...]] = field(default_factory=lambda: {
        **{r: tuple(round(0.02 * 1.15 ** i, 6) for i in range(40)) for r in RULES[:-1]},
        "word_length": tuple(round(4 * 1.06 ** i, 6) for i in range(40)),
    })


def base_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules use.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines
    with a word that equal an earlier line); n_repeat_words (words in a window
    of three words found more than once); n_lines, n_upper and n_shouts.  A null
    text counts as empty, and all counts of an empty text are 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__words", words_column(F.col(text)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    # (hash, position) of every window of three words, sorted; equal windows are neighbours then
    out = out.withColumn("__runs", F.expr(
        "CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), "
        "i -> struct(xxhash64(__words[i], __words[i + 1], __words[i + 2]) AS h, i AS p))) "
        "ELSE CAST(array() AS array<struct<h:bigint,p:int>>) END"))
    out = out.withColumn("__again", F.expr(
        "transform(filter(__runs, (x, i) -> (i > 0 AND __runs[i - 1].h = x.h) "
        "OR (i + 1 < size(__runs) AND __runs[i + 1].h = x.h)), x -> x.p)"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = out.withColumn("__lines", lines)
    return out.withColumns({
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr("CAST(size(array_distinct(concat(__again, transform(__again, p -> p + 1), "
                                 "transform(__again, p -> p + 2)))) AS bigint)"),
        "n_upper": (F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_shouts": (F.char_length(t) - F.char_length(F.translate(t, "!?", ""))).cast("long"),
    }).drop("__words", "__runs", "__again", "__lines")


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts")


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The rules on counts of ``base_metrics``; 0 where a document has no words."""
    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")

    return {"symbol_ratio": ratio("n_symbols", "n_words"), "shout_ratio": ratio("n_shouts", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words")}


def _log_gamma(x: str) -> str:
    """SQL for ln(gamma(x)), x >= 1, to about 1e-13: Stirling's series after a shift by eight."""
    y = f"({x} + 8)"
    shift = " * ".join(f"({x} + {i})" for i in range(8))
    return (f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) "
            f"+ 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7)) - ln({shift}))")


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly; 1 from k >= n * p on, where it is above one half.

    The sum runs downwards from k.  Its terms shrink; those more than 60 standard
    deviations below the mean are less than the smallest double and left out.
    """
    k, n = f"CAST({k} AS double)", f"CAST({n} AS double)"
    top = (f"exp({_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')} "
           f"+ {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))")
    terms = f"CAST(least({k}, ceil(60 * sqrt({n} * {p}D)) + 60) AS int)"
    rest = (f"aggregate(sequence(1, greatest(1, {terms})), named_struct('s', 1D, 't', 1D), (a, j) -> named_struct("
            f"'s', a.s + IF(j > {terms}, 0D, a.t * ({k} - j + 1) * (1 - {p}D) / (({n} - {k} + j) * {p}D)), "
            f"'t', a.t * ({k} - j + 1) * (1 - {p}D) / (({n} - {k} + j) * {p}D)), a -> a.s)")
    return F.expr(f"CASE WHEN {k} >= {n} * {p}D THEN 1D ELSE {top} * {rest} END")


def cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Certified cutoffs: one row per stratum, one column per rule (null: no cutoff is certified).

    ``labelled`` has a row per labelled document: stratum, good (boolean) and the
    rules' values.  Among a rule's certified cutoffs the one with the largest
    (share of bad documents rejected - share of good ones rejected) is taken,
    the loosest of equals, and none where that is not positive.  Only counts per
    stratum, rule and grid step are shuffled.
    """
    share = risk.limit / len(RULES)
    step = [F.struct(F.lit(r).alias("rule"), F.expr(
        f"size(filter(array({', '.join(f'{g}D' for g in risk.grid[r])}), g -> g < {r}))").alias("step")) for r in RULES]
    counts = (labelled.select("stratum", "good", F.explode(F.array(*step)).alias("x"))
              .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.step").alias("step"))
              .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")))
    # a document at step s exceeds the first s cutoffs of the grid: cutoff i rejects those with s > i
    spark = labelled.sparkSession
    steps = spark.createDataFrame([(r, i, g) for r in RULES for i, g in enumerate(risk.grid[r])],
                                  "rule string, i int, cutoff double")
    totals = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    above = (totals.join(steps, "rule").join(counts, ["stratum", "rule"])
             .groupBy("stratum", "rule", "i", "cutoff", "n_good", "n_bad")
             .agg(F.sum(F.when(F.col("step") > F.col("i"), F.col("good")).otherwise(0)).alias("k_good"),
                  F.sum(F.when(F.col("step") > F.col("i"), F.col("bad")).otherwise(0)).alias("k_bad")))
    n_strata = totals.groupBy("rule").agg(F.count("*").alias("strata")).groupBy().agg(F.max("strata").alias("strata"))
    level = F.lit(risk.level) / (len(RULES) * F.col("strata"))
    # one row of one number; the only unkeyed join
    tested = above.join(F.broadcast(n_strata)).withColumn("passes", binomial_tail("k_good", "n_good", share) <= level)
    loosest_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("i"))
    certified = (tested.withColumn("all_pass", F.min("passes").over(loosest_first)).where("all_pass")
                 .withColumn("gain", F.coalesce(F.try_divide("k_bad", "n_bad"), F.lit(0.0))
                             - F.try_divide("k_good", "n_good"))
                 .where("gain > 0"))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "i", "cutoff")).alias("b"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cutoff"))).alias(f"cut_{r}")
                                         for r in RULES])


def labelled_rows(metrics: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``metrics`` (with ``stratum``) that have a label, with ``good`` and the rules' values.

    Of several labels for one key the worst counts; a null label or key is none.
    """
    one = (labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull())
           .groupBy(key).agg((F.min("quality") == 1).alias("good")))
    return metrics.where(~base_failed()).select(key, "stratum", *[v.alias(r) for r, v in rule_values().items()]) \
        .join(one, key)


def judge(metrics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``: not failed, and no rule above its stratum's certified cutoff."""
    rejected = F.lit(False)
    for r, v in rule_values().items():
        rejected = rejected | F.coalesce(v > F.col(f"cut_{r}"), F.lit(False))
    out = metrics.join(cuts, "stratum", "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected) \
        .drop(*[f"cut_{r}" for r in RULES])


def stratum_of(column: Column) -> Column:
    """The stratum of a document; a null is a stratum of its own."""
    return F.coalesce(column.cast("string"), F.lit(""))
