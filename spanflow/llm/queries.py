"""The registered queries of this package, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.llm import (collocations, credentials, decontamination, formatting, lm, packing, pii, quality, resampling,
                          sharding, similarity, substrings, urls)
from spanflow.sources.tables import stage

#: Key of the surrogates in the registered query; a real run passes its own secret.
PII_KEY = b"spanflow surrogate key"
SHARDS = 8
#: Fixed value: the text of both turns of the conversation added to ``conversations``.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = similarity.join_sets(table(spark, sf_dir, "documents"), stage)
    return joined.select("doc_id", "class_id", "n_links", "n_set")


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY, stage).select("doc_id", "text", "n_replaced")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, stage=stage).select("page_id", "host", "path", "rule", "verdict", "score")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, stage).select("doc_id", "n_words", "n_removed", "kept_sha256")


def ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return sharding.shard(docs, key, F.col("size"), key, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), stage)


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs), docs.count())


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return formatting.digest(formatting.format_conversations(formatting.events_of_rows(rows.unionByName(extra))))


def quality_metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of whole texts, the languages as strata."""
    return quality.base_metrics(docs.select(*keep, "text", quality.stratum_of(F.col("lang")).alias("stratum")))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = stage(quality_metrics(table(spark, sf_dir, "documents"), "doc_id").drop("text"))
    cuts = quality.cutoffs(quality.labelled_rows(metrics, table(spark, sf_dir, "labels")))
    return quality.judge(metrics, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                               "n_repeat_words", "base_failed", "kept")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), stage)
    return found.withColumnRenamed("language", "lang")


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"), stage, keep=["doc_id"])
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), stage, keep=["doc_id"])
    return credentials.digest(scanned).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess",
                                              "n_values")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join,
    "op2_pii_surrogates": pii_surrogates,
    "op3_url_filter": url_filter,
    "op4_substring_dedup": substring_dedup,
    "op5_ring_sharding": ring_sharding,
    "op6_lm_scoring": lm_scoring,
    "op7_sequence_packing": sequence_packing,
    "op8_decontamination": decontaminate,
    "op9_chat_formatting": chat_formatting,
    "op10_quality_rules": quality_rules,
    "op11_phrase_collocations": phrase_collocations,
    "op12_importance_resampling": importance_resampling,
    "op13_secret_scans": secret_scans,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(0, len(w) - 4),
          lambda i: md5(array_to_string(w[i + 1:i + 5], ' '))))
          WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE n >= 0.8 * (na + nb - n) - 1e-9
      UNION ALL SELECT a.doc_id, b.doc_id FROM s a, s b WHERE len(a.s) = 0 AND len(b.s) = 0 AND a.doc_id <> b.doc_id),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, c.class_id, coalesce(k.n, 0) AS n_links, len(s.s) AS n_set
FROM s JOIN (SELECT a, min(b) AS class_id FROM r GROUP BY a) c ON c.a = s.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = s.doc_id
"""


def _formatting_sql() -> str:
    t = formatting.Template()
    # one backslash more between the first character of a control string and the rest
    escaped = "coalesce(text, '')"
    for head in dict.fromkeys(h for h, _ in t.controls):
        tails = "|".join("\\|" if x == "|" else x.replace("]", "\\]") for h, x in t.controls if h == head)
        escaped = f"regexp_replace({escaped}, '(\\{head}\\\\*)({tails})', '\\1\\\\\\2', 'g')"
    marks = len(t.open) + len(t.body) + len(t.close)
    return rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {escaped} AS escaped FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum({marks} + length(role) + length(escaped)) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def _quality_sql() -> str:
    risk = quality.Risk()
    rules = len(quality.RULES)
    steps = ", ".join(f"('{r}', {i}, CAST({g} AS DOUBLE))" for r in quality.RULES for i, g in enumerate(risk.grid[r]))
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS v FROM u" for r in quality.RULES)
    share = risk.limit / rules
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM i),
m AS (SELECT doc_id, g FROM n GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM n JOIN m USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
b AS (SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts
      FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
u AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
             coalesce(n_shouts / nullif(n_words, 0), 0) AS shout_ratio,
             coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
             coalesce(word_chars / nullif(n_words, 0), 0) AS word_length FROM b),
v AS ({long}),
q AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT v.stratum, v.rule, v.v, q.good FROM v JOIN q USING (doc_id) JOIN u USING (doc_id) WHERE NOT u.base_failed),
s(rule, i, cutoff) AS (VALUES {steps}),
k AS (SELECT stratum, rule, i, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
             count(*) FILTER (good AND v > cutoff) AS k_good, count(*) FILTER (NOT good AND v > cutoff) AS k_bad
      FROM h JOIN s USING (rule) GROUP BY ALL),
x AS (SELECT *, CASE WHEN k_good >= n_good * {share} THEN 1 ELSE list_sum(list_transform(range(0, k_good + 1), lambda j:
             exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share}) + (n_good - j) * ln(1 - {share}))))
             END <= {risk.level} / ({rules} * (SELECT count(DISTINCT stratum) FROM h)) AS passes FROM k),
y AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY i DESC) AS ok,
             coalesce(k_bad / nullif(n_bad, 0), 0) - k_good / n_good AS gain FROM x),
z AS (SELECT stratum, rule, cutoff FROM y WHERE ok AND gain > 0
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, i DESC) = 1),
r AS (SELECT DISTINCT v.doc_id FROM v JOIN z USING (stratum, rule) WHERE v.v > z.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM r) AS kept FROM u
"""


SQL: dict[str, str] = {
    "op1_jaccard_join": JACCARD_SQL,
    "op4_substring_dedup": substrings.SQL,
    "op8_decontamination": decontamination.SQL,
    "op9_chat_formatting": _formatting_sql(),
    "op10_quality_rules": _quality_sql(),
    "op11_phrase_collocations": collocations.sql(),
    "op12_importance_resampling": resampling.sql(),
}
