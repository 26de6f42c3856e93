"""URL filter: allow and block rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models of URL characters are counted, one on
URLs that a rule accepts and one on URLs that a rule rejects.  A URL without a
rule is scored by the difference of its log-likelihoods per character, and
blocked when that is below a cutoff calibrated on held-out ruled URLs.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
#: One ruled URL in so many calibrates the cutoff and trains no model.
CALIBRATION_FOLD = 5
#: Share of accepted calibration URLs that the cutoff may block.
FALSE_BLOCK = 0.01

START = "\u0002"
END = "\u0003"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


@dataclass(frozen=True)
class Scorer:
    order: int = ORDER
    fold: int = CALIBRATION_FOLD
    false_block: float = FALSE_BLOCK


def grams(urls: DataFrame, order: int) -> DataFrame:
    """(url, gram): for each character and the end mark, it and the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), F.col("url"), F.lit(END))
    return urls.withColumn("__p", padded).select(
        "*", F.explode(F.sequence(F.lit(1), F.length("url") + 1)).alias("__i")).withColumn(
        "gram", F.expr(f"substring(__p, __i, {order + 1})")).drop("__p", "__i")


def gram_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log probability of a gram's last character under the accepted model minus the rejected one.

    ``counts`` has gram, ok and bad (training counts; 0 for a gram only seen in
    scoring).  Order k backs off to order k - 1 by Witten-Bell interpolation: a
    context seen n times before t different characters trusts its own counts by
    n / (n + t).  Below order 0 stands the uniform distribution over the
    characters of the corpus and one unknown.
    """
    def last(k: int) -> Column:
        return F.substring("gram", order + 1 - k, k + 1)

    out = counts.select("gram")
    alphabet = counts.select(last(0).alias("c")).distinct().agg((F.count("*") + 1).alias("__a"))
    out = out.join(F.broadcast(alphabet))  # one row
    ok = bad = F.lit(1.0) / F.col("__a")
    for k in range(order + 1):
        seen = counts.groupBy(last(k).alias(f"__g{k}")).agg(F.sum("ok").alias(f"__ok{k}"), F.sum("bad").alias(f"__bad{k}"))
        ctx = (seen.groupBy(F.substring(f"__g{k}", 1, k).alias(f"__h{k}"))
               .agg(*[F.sum(f"__{m}{k}").alias(f"__n_{m}{k}") for m in ("ok", "bad")],
                    *[F.sum((F.col(f"__{m}{k}") > 0).cast("long")).alias(f"__t_{m}{k}") for m in ("ok", "bad")]))
        out = (out.withColumns({f"__g{k}": last(k), f"__h{k}": F.substring("gram", order + 1 - k, k)})
               .join(seen, f"__g{k}").join(ctx, f"__h{k}"))
        ok, bad = (F.when(F.col(f"__n_{m}{k}") > 0, (F.col(f"__{m}{k}") + F.col(f"__t_{m}{k}") * lower)
                          / (F.col(f"__n_{m}{k}") + F.col(f"__t_{m}{k}"))).otherwise(lower)
                   for m, lower in (("ok", ok), ("bad", bad)))
        out = out.withColumns({f"p_ok{k}": ok, f"p_bad{k}": bad}).drop(
            f"__g{k}", f"__h{k}", *[f"__{x}{m}{k}" for x in ("", "n_", "t_") for m in ("ok", "bad")])
        ok, bad = F.col(f"p_ok{k}"), F.col(f"p_bad{k}")
    return out.select("gram", (F.ln(ok) - F.ln(bad)).alias("ratio"))


def score_urls(urls: DataFrame, scorer: Scorer = Scorer()) -> DataFrame:
    """(url, score) for distinct URLs with their ``rule_verdict``: mean log ratio per character, end mark included.

    URLs with a verdict train the models, but for one in ``fold`` (by hash).
    Without accepted or rejected training URLs a model is uniform.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(scorer.fold)) == 0
    all_grams = grams(urls.select("url", "rule_verdict", fold.alias("held")), scorer.order)
    train = ~F.col("held")
    counts = all_grams.groupBy("gram").agg(
        F.sum((train & (F.col("rule_verdict") == "allow")).cast("long")).alias("ok"),
        F.sum((train & (F.col("rule_verdict") == "block")).cast("long")).alias("bad"),
    ).fillna(0, ["ok", "bad"])
    ratios = gram_ratios(counts, scorer.order)
    return (all_grams.select("url", "rule_verdict", "held", "gram").join(ratios, "gram")
            .groupBy("url", "rule_verdict", "held").agg(F.round(F.avg("ratio"), 6).alias("score")))


def cutoff(scores: DataFrame, false_block: float = FALSE_BLOCK) -> DataFrame:
    """One row, ``cutoff``: the ``false_block`` quantile of accepted held-out scores, exact to three decimals.

    Null without such URLs: then nothing is blocked by score.
    """
    held = scores.where("held AND rule_verdict = 'allow'").groupBy(F.floor(F.col("score") * 1000).alias("b")).agg(
        F.count("*").alias("n"))
    return held.agg(F.expr(f"percentile(b, {false_block}D, n)").alias("q")).select((F.floor("q") / 1000).alias("cutoff"))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, scorer: Scorer = Scorer(), stage=lambda df: df) -> DataFrame:
    """Add host, path, rule, score (null where a rule decides) and verdict to every row of ``pages``.

    A null URL is judged as an empty one.  Every distinct URL is scored once and
    joined back.  Ties at the cutoff are allowed.  ``stage`` may write the
    scores and return what it wrote.  Columns of ``pages`` with one of the five
    names are replaced; any other name is kept, whatever it is.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = host_path(F.col("url"))
    # the caller's columns by number, so that no name of theirs meets one used here
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(url), F.lit("")).alias("url"))
    judged = apply_rules(rows.withColumns({"host": host, "path": path}), rules)
    urls = judged.select("url", "rule_verdict").distinct()
    scores = stage(score_urls(urls, scorer))
    open_urls = scores.where("rule_verdict IS NULL").select(F.col("url").alias("scored"), "score")
    least = cutoff(scores, scorer.false_block)
    by_score = F.when(F.col("score") < F.col("cutoff"), F.lit("block")).otherwise(F.lit("allow"))
    return (judged.join(open_urls, judged["url"] == open_urls["scored"], "left").join(F.broadcast(least))  # least is one row
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", "score",
                    F.coalesce("rule_verdict", by_score).alias("verdict")))
