"""Importance resampling towards a target distribution, by hashed n-gram features.

Features of a text are its runs of 1 to 3 words; each falls into a bucket by
its CRC-32.  A bucket's gain is the log ratio of its smoothed share in the
target texts to that in all documents; a document weighs the sum of the gains
of its features, and Gumbel noise drawn from a hash of its id turns the highest
scores into a sample without replacement.

A task handles its texts in blocks.  Words, and then n-grams as tuples of word
slots, are interned in an open-addressed numpy table: xxhash64 keys, content
compared byte for byte.  A slot holds the n-gram's bucket and its count.  The
first pass adds up counts by bucket; in the second the slot of every occurrence
gathers the bucket's gain.  What leaves a task is one row a bucket or one a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanflow.llm.ngrams import (byte_blocks, byte_set, crc_join, crc_spans, find_words, intern, same_spans, xxh64_longs,
                                 xxh64_spans)

BUCKETS = 10000
ORDERS = 3
#: Per cent of the documents that are long enough.
SHARE = 5
MIN_WORDS = 20
SEED = 42
#: Words whose n-grams are interned at once; longer texts are handled in several such runs.
RUN_WORDS = 1 << 17
_SLOT_BITS = 21
_SLOT = (1 << _SLOT_BITS) - 1

_GAP = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Interned:
    """n-grams of a run of words: per slot bucket and count, per occurrence its slot, and the word at which it starts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, first: int, last: int,
                 buckets: int):
        """n-grams that start at the words ``first``..``last``; they may reach on into later words of the same row."""
        stop = min(last + ORDERS - 1, len(starts))
        starts, ends, row = starts[first:stop], ends[first:stop], row[first:stop]
        word, owner = intern(xxh64_spans(data, starts, ends), same_spans(data, starts, ends))
        used = np.flatnonzero(owner >= 0)
        plain = np.zeros(len(owner), dtype=np.uint32)
        plain[used] = crc_spans(data, starts[owner[used]], ends[owner[used]])
        size = np.zeros(len(owner), dtype=np.int64)
        size[used] = (ends - starts)[owner[used]]
        space = np.full(len(owner), zlib.crc32(b" "), dtype=np.uint32)
        spaced = crc_join(space, plain, size)

        n = last - first
        # an n-gram is one 64-bit value of up to three word slots of 21 bits, 0 for no word: equal values, equal bytes
        packed, grams, at = np.zeros(n, dtype=np.uint64), [], []
        for order in range(ORDERS):
            reach = min(n, len(row) - order)
            fits = np.flatnonzero(row[:reach] == row[order:order + reach])
            packed[fits] |= (word[fits + order] + 1).astype(np.uint64) << np.uint64(_SLOT_BITS * order)
            grams.append(packed[fits])
            at.append(first + fits)
        gram = np.concatenate(grams)
        self.start = np.concatenate(at)
        self.slot, owner = intern(xxh64_longs(gram), lambda a, b: gram[a] == gram[b])
        self.count = np.bincount(self.slot, minlength=len(owner))
        used = np.flatnonzero(owner >= 0)
        gram = gram[owner[used]]
        crc = plain[(gram & np.uint64(_SLOT)).astype(np.int64) - 1]
        for i in range(1, ORDERS):
            w = (gram >> np.uint64(_SLOT_BITS * i)).astype(np.int64) & _SLOT
            on = np.flatnonzero(w)
            w = w[on] - 1
            crc[on] = crc_join(crc[on], spaced[w], size[w] + 1)
        self.bucket = np.zeros(len(owner), dtype=np.int64)
        self.bucket[used] = crc % np.uint32(buckets)


def _runs(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Interned | None]]:
    """(first row, end row, words of each row, row of each word, n-grams), several times for the rows of a long text."""
    for lo, hi, data, off in byte_blocks(texts):
        starts, ends, rows = find_words(data, off, _GAP)
        words = np.diff(rows)
        row = np.repeat(np.arange(hi - lo), words)
        if not len(starts):
            yield lo, hi, words, row, None
        for first in range(0, len(starts), RUN_WORDS):
            yield (lo, hi, words if first == 0 else np.zeros_like(words), row,
                   Interned(data, starts, ends, row, first, min(first + RUN_WORDS, len(starts)), buckets))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (the only column) by bucket; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, grams in _runs(batch.column(0), buckets):
                if grams is not None:
                    total += np.bincount(grams.bucket, weights=grams.count, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n))))
                     for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` (key, text) as (key, n_words, n_features, weight)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for lo, hi, count, row, grams in _runs(batch.column(1), buckets):
                words[lo:hi] += count
                if grams is not None:
                    at = lo + row[grams.start]
                    features += np.bincount(at, minlength=n)
                    np.add.at(weight, at, gain[grams.bucket][grams.slot])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                             names=["key", "n_words", "n_features", "weight"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {key}, n_words long, n_features long, weight long")


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, floored, from a hash of seed and id (a null id counts as an empty one)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, stage: Callable[[DataFrame], DataFrame], eligible: Column, share: int = SHARE) -> DataFrame:
    """``scored`` (id, score, ...) and rank: 1, 2, ... for the ``share`` per cent highest scores among the eligible rows.

    Ties go to the smaller id, then to either row.  Rows are dealt by ranges of
    (score, id), each range is numbered for itself, and the counts of earlier
    ranges are added; the driver sees one count a range.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number parts repeated rows, so that no range holds all copies of one
    rows = stage(scored.withColumn("__in", eligible).withColumn("__row", F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("__row")]
    dealt = stage(rows.where("__in").repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offsets = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "__part int, __before long")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    ranked = dealt.join(F.broadcast(offsets), "__part").withColumn("rank", number.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= share * total // 100, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(
        rows.where("NOT __in").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, stage: Callable[[DataFrame], DataFrame], id_column: str = "doc_id",
             text: str = "text", keep: list[str] | None = None, share: int = SHARE, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Documents with their importance weights; those drawn have a rank.

    ``target`` is a frame whose only column is the target texts.  Returns row (a
    struct of the columns ``keep`` of ``docs``, by default all, so that no name
    can clash), n_words, n_features, weight, score and rank (null: not drawn).
    Null and empty texts have no features, weight 0 and cannot be drawn; texts of
    any length are counted whole; repeated rows are rows of their own, with equal
    scores; a null id draws the noise of an empty one and comes first among ties.
    Empty tables give an empty result; an empty target gives all buckets T = 0.
    """
    columns = docs.columns if keep is None else keep
    gain = gains(bucket_counts(docs.select(text), buckets), bucket_counts(target, buckets))
    key = F.struct(F.col(id_column).alias("id"), F.struct(*columns).alias("row")).alias("key")
    weighed = weigh(docs.select(key, F.col(text).alias("text")), gain)
    scored = weighed.select(F.col("key.id").alias("id"), F.col("key.row").alias("row"), "n_words", "n_features", "weight",
                            (F.col("weight") + noise(F.col("key.id"), seed)).alias("score"))
    return draw(scored, stage, F.col("n_words") >= min_words, share).drop("id")


def sql(share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> str:
    """DuckDB SQL of the same draw over ``documents`` towards ``benchmark``; the CRC-32 is folded over the bytes of a feature."""
    split = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
            r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

    def step(c: str) -> str:
        return f"CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"

    steps = [f"b{i} AS (SELECT v, {step('c')} AS c FROM b{i - 1})" for i in range(1, 9)]
    return rf"""
WITH b0 AS (SELECT v, v AS c FROM range(0, 256) r(v)),
{", ".join(steps)},
k AS (SELECT list(c ORDER BY v) AS t FROM b8),
w AS (SELECT row_number() OVER () AS r, doc_id, 0 AS side, {split} AS w FROM documents
      UNION ALL SELECT row_number() OVER (), NULL, 1, {split} FROM benchmark),
g AS (SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
             list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
f AS (SELECT g, list_transform(range(0, octet_length(encode(g))), lambda i:
             ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT g FROM g)),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % {buckets} AS b FROM f, k),
o AS (SELECT r, side, b, count(*) AS n FROM g JOIN h USING (g) GROUP BY ALL),
c AS (SELECT range AS b, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(0, {buckets}) LEFT JOIN
        (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM o GROUP BY b) x ON x.b = range),
q AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})::DOUBLE
                                / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets})::DOUBLE)))::BIGINT AS gain FROM c),
d AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM o JOIN q USING (b) WHERE side = 0 GROUP BY r),
z AS (SELECT r, doc_id, len(w) >= {min_words} AS eligible, coalesce(n_features, 0)::BIGINT AS n_features,
             coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM w LEFT JOIN d USING (r) WHERE side = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
x AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM y WHERE eligible)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= {share} * (SELECT count(*) FROM x) // 100 THEN rank END AS rank FROM y LEFT JOIN x USING (r)
"""
