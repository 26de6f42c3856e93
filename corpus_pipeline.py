"""A cleaning pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Quality rules, n-gram Jaccard join, benchmark decontamination, surrogates for
personal data, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.llm import decontamination, packing, pii, quality, queries, similarity
from spanflow.llm.words import text_key
from spanflow.sources.tables import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a base rule nor exceed a certified cutoff; cutoffs come from the labelled ones."""
    keyed = docs.select("doc_id", "lang", *text_key(F.col("text")), "text")
    metrics = stage(queries.quality_metrics(keyed, "doc_id", "k1", "k2").drop("text"))
    cuts = quality.cutoffs(quality.labelled_rows(metrics, queries.table(spark, sf_dir, "labels")))
    kept = stage(quality.judge(metrics, cuts).where("kept").select(
        F.col("doc_id").alias("__d"), "k1", "k2", F.col("stratum").alias("__s")))
    rows = docs.select("*", quality.stratum_of(F.col("lang")).alias("__t"),
                       *[k.alias(f"__{n}") for n, k in zip(("t1", "t2"), text_key(F.col("text")))])
    on = (rows["doc_id"].eqNullSafe(kept["__d"]) & (rows["__t1"] == kept["k1"]) & (rows["__t2"] == kept["k2"])
          & (rows["__t"] == kept["__s"]))
    return rows.join(kept, on, "left_semi").select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least doc_id."""
    return similarity.first_of_class(docs, similarity.join_sets(docs, stage))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain a benchmark item."""
    keyed = docs.select(F.struct("doc_id", *text_key(F.col("text"))).alias("__id"), "text")
    hits = decontamination.contaminated(keyed, queries.table(spark, sf_dir, "benchmark"), doc_id="__id")
    bad = stage(hits.select(F.col("doc_id.doc_id").alias("__d"), F.col("doc_id.k1").alias("__k1"),
                            F.col("doc_id.k2").alias("__k2")).distinct())
    rows = docs.select("*", *[k.alias(f"__{n}") for n, k in zip(("t1", "t2"), text_key(F.col("text")))])
    on = rows["doc_id"].eqNullSafe(bad["__d"]) & (rows["__t1"] == bad["__k1"]) & (rows["__t2"] == bad["__k2"])
    return rows.join(bad.hint("merge"), on, "left_anti").select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs, queries.PII_KEY, stage)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each with its sequence and offset."""
    return packing.pack(packing.pieces(docs), docs.count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_similar),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
