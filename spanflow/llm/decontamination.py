"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size.  An item's sketch is its bottom-m MinHash: the m
shingles of smallest hash, where m is one more than it may miss at the wanted
containment, so every document that contains enough of the item holds at least
one of them (recall is 1, not a probability).  The largest hash in the sketches
of a partition bounds what a document's own sketch has to keep for it, and
documents with fewer shingles than the partition's items need are not searched.
A hit is verified by the exact containment of the item's shingles.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.words import words_column

SHINGLE = 5
CONTAINMENT = 0.8
#: Broadcast at once, in units of 16 bytes of sketches and shingles; a larger benchmark is searched in blocks of items.
SKETCH_ROWS = 1 << 20


def sketches(items: DataFrame, item_id: str = "item_id", text: str = "text", shingle: int = SHINGLE,
             containment: float = CONTAINMENT) -> DataFrame:
    """One row per item with at least one shingle: item (a hash of id and words), item_id, distinct shingles, n_item, part, sketch.

    ``part`` is the item's size class (powers of two).  Items of fewer words
    than a shingle, and null texts, have none and are left out: nothing tells
    a document that copies one word of an item from one that merely uses it.  Of
    repeated rows one is kept; a null id is an id like any other.
    """
    words = items.select(F.col(item_id).alias("item_id"), words_column(F.col(text)).alias("__w")).distinct()
    out = words.where(F.size("__w") >= shingle).select(F.xxhash64(F.col("item_id").isNull(), "item_id", "__w").alias("item"), "item_id", F.expr(
        f"array_distinct(transform(sequence(0, greatest(size(__w) - {shingle}, 0)), "
        f"i -> array_join(slice(__w, i + 1, {shingle}), ' ')))"
    ).alias("shingles"))
    out = out.withColumn("n_item", F.size("shingles"))
    out = out.withColumn("need", F.ceil(F.lit(containment) * F.col("n_item") - 1e-9).cast("int"))
    return out.withColumns({
        "part": F.floor(F.log2("n_item")).cast("int"),
        "sketch": F.expr("slice(array_sort(array_distinct(transform(shingles, x -> xxhash64(x)))), 1, "
                         "n_item - need + 1)"),
    })


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, containment: float = CONTAINMENT,
                 sketch_rows: int = SKETCH_ROWS) -> DataFrame:
    """Pairs (doc_id, item_id) where a document holds at least ``containment`` of an item's shingles.

    Returns doc_id, item_id, n_item, n_shared and containment, one row per pair
    and distinct text.  Null texts and texts of fewer words than a shingle hold
    nothing; empty tables give an empty result; documents with equal ids and
    equal texts are reported once, further columns are left out.
    """
    found = sketches(items, shingle=shingle, containment=containment)
    # what a block broadcasts: sketch hashes, and the shingles that verify a hit
    size = F.size("sketch") + F.aggregate("shingles", F.lit(0), lambda n, x: n + F.octet_length(x)) / 16
    rows = int(found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    blocks = max(1, -(-rows // sketch_rows))
    return _union([_search(docs, found.where(F.pmod("item", F.lit(blocks)) == b), doc_id, text,
                           shingle, containment) for b in range(blocks)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _search(docs: DataFrame, found: DataFrame, doc_id: str, text: str, shingle: int, containment: float) -> DataFrame:
    parts = (found.groupBy("part").agg(F.min("need").alias("need"), F.max(F.element_at("sketch", -1)).alias("top"))
             .orderBy("part").collect())  # at most one row per power of two
    d = docs.select(F.col(doc_id).alias("doc_id"), words_column(F.col(text)).alias("__w"))
    d = d.withColumn("__n", F.size("__w") - (shingle - 1))
    run = ", ".join(f"__w[i + {j}]" for j in range(shingle))
    d = d.withColumn("__h", F.expr(
        f"IF(__n > 0, transform(sequence(0, greatest(__n, 1) - 1), i -> xxhash64(concat_ws(' ', {run}))), "
        "CAST(array() AS array<bigint>))"))
    # the document's sketch: hashes up to the largest bound of the partitions it is long enough for
    bound = F.lit(None).cast("long")
    for p in parts:
        bound = F.when(F.col("__n") >= p["need"], F.greatest(bound, F.lit(p["top"]))).otherwise(bound)
    # explode_outer, and all conditions after it: a condition before would be moved to the scan
    # and compute words and hashes there once more
    hits = d.select("doc_id", "__w", "__n", F.explode_outer("__h").alias("h")).where(F.col("h") <= bound)
    probe = found.select("item", F.explode("sketch").alias("h"))
    exact = found.select("item", "item_id", "shingles", "n_item")
    text_run = f"transform(sequence(0, greatest(__n, 1) - 1), i -> array_join(slice(__w, i + 1, {shingle}), ' '))"
    return (hits.join(F.broadcast(probe), "h")
            .join(F.broadcast(exact), "item")
            .withColumn("n_shared", F.expr(f"size(array_intersect(shingles, {text_run}))"))
            .where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)
            .select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"),
                    F.col("n_shared").cast("long").alias("n_shared")).distinct()
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
d AS (SELECT doc_id, list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
      FROM w WHERE len(w) >= 5),
v AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM benchmark),
b AS (SELECT DISTINCT item_id, list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
      FROM v WHERE len(w) >= 5),
e AS (SELECT doc_id, unnest(s) AS x FROM d),
f AS (SELECT item_id, len(s) AS n_item, unnest(s) AS x FROM b),
g AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM e JOIN f USING (x) GROUP BY ALL)
SELECT DISTINCT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM g
WHERE n_shared >= 0.8 * n_item - 1e-9
"""
