"""Frequent phrases and their collocation scores, by Misra-Gries summaries of hash partitions.

First pass: the n-grams (1 to 4 words of one piece) of every text are hashed
with their language; the leading bits of the hash name one of P hash
partitions.  Tasks send, per partition, sorted hashes with counts.  A Misra-Gries
summary of each partition is merged from these chunks.  Its capacity exceeds
the partition's mass divided by the threshold, so that an n-gram counted
``threshold`` times anywhere cannot fall out; what is left of a summary marks
bits of a filter of fixed size.  Two n-grams with one hash are counted
together there, which can only keep more.

Second pass: n-grams that the filter lets through are counted exactly, by their
words.  All later steps are joins of the table of frequent phrases.

Memory is bounded by the mass of a hash partition, which is set by the number of
partitions; a very common n-gram is one entry of a chunk, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanflow.llm.ngrams import byte_blocks, byte_set, find_words
from spanflow.llm.words import Words, mix, run_hashes

THRESHOLD = 30
MAX_WORDS = 4
#: A candidate goes if a longer one that holds its words occurs so many per cent as often.
COVER = 80
TOP = 2000
SCALE = 2_000_000
#: Capacity of a summary, in multiples of mass / threshold; a larger one lets fewer infrequent n-grams stay.
SLACK = 4
#: Mean mass of a hash partition aimed at, and bounds of the number of leading bits that name one.
PART_MASS = 1 << 21
PART_BITS = (6, 20)
FILTER_BITS = 27
#: Bytes of text, hashes sorted at once, and hashes of a chunk.
_BLOCK, _SORTED, _CHUNK = 1 << 19, 1 << 21, 1 << 10

_BREAK = byte_set(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
_GAP = _BREAK | byte_set((0x20, 0x20), (0x09, 0x09))
_U = np.uint64


def _language(column: Column) -> Column:
    return F.coalesce(column, F.lit("und"))


class Grams:
    """The n-grams of a block of texts: hash, first word and number of words of every occurrence."""

    def __init__(self, data: np.ndarray, off: np.ndarray, salt: np.ndarray, max_words: int):
        """``salt`` holds a hash of each row's language."""
        starts, ends, rows = find_words(data, off, _GAP)
        self.data, self.starts, self.ends = data, starts, ends
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
        breaks = np.cumsum(_BREAK[data])
        piece = (breaks[starts] if len(starts) else starts) + self.row  # both rise: it changes where either does
        at, size = [], []
        for order in range(1, max_words + 1):
            reach = max(0, len(starts) - order + 1)
            fits = np.flatnonzero(piece[:reach] == piece[order - 1:])
            at.append(fits)
            size.append(np.full(len(fits), order))
        self.first, self.size = np.concatenate(at), np.concatenate(size)
        if len(starts):
            h = run_hashes(Words(data, starts, ends, rows).hashes(), self.first, self.first + self.size)
            self.hash = mix(h ^ salt[self.row[self.first]])
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def phrases(self, which: np.ndarray) -> list[bytes]:
        """The words of the numbered n-grams, joined by one space."""
        length = self.ends - self.starts
        begin = np.cumsum(length + 1) - length - 1
        source = np.repeat(self.starts - begin, length + 1) + np.arange(int((length + 1).sum()))
        joined = self.data[np.minimum(source, len(self.data) - 1)]
        joined[begin + length] = 32
        last = self.first[which] + self.size[which] - 1
        whole = joined.tobytes()
        return [whole[a:b] for a, b in zip(begin[self.first[which]].tolist(), (begin + length)[last].tolist())]


def _salts(languages: pa.Array) -> tuple[np.ndarray, list]:
    """(hash of each row's language, the languages themselves)."""
    coded = languages.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.array([hash_text(n) for n in names], dtype=np.uint64)
    return hashed[coded.indices.to_numpy()], languages.to_pylist()


def hash_text(name: str) -> int:
    """A 64-bit hash of a short string."""
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def pack_chunk(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, equal bytes of all of them side by side, which compresses well."""
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_chunk(packed: bytes) -> np.ndarray:
    by_byte = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(by_byte.T).view("<u4")[:, 0], dtype=np.uint32)


class MisraGries:
    """Mergeable summary of 32-bit keys: counts too low by at most ``error``, which is at most mass / (capacity + 1)."""

    #: Counts above this are kept as this: decrements add up to less than the threshold, so it survives them.
    TOP = 1 << 20

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._held.append((keys.astype(np.uint64), counts.astype(np.int64)))
        self._n += len(keys)
        if self._n > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Merge what was added; if more than ``capacity`` keys are left, all counts fall by the largest that must go."""
        parts = [(self.keys, self.counts), *self._held]
        self._held, self._n = [], 0
        both = np.concatenate([(k << _U(32)) | np.minimum(c, self.TOP).astype(np.uint64) for k, c in parts])
        both.sort()
        keys = both >> _U(32)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        counts = np.add.reduceat((both & _U(0xFFFFFFFF)).astype(np.int64), first) if len(first) else self.counts[:0]
        keys = keys[first]
        if len(keys) > self.capacity:
            fall = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.error += fall
            keys, counts = keys[counts > fall], counts[counts > fall] - fall
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """The keys whose true count may be ``threshold`` or more; none that is can be missing."""
        self.settle()
        return self.keys[self.counts + self.error >= threshold].astype(np.uint32)


def part_bits(mass: float) -> int:
    """Number of leading hash bits that name a partition, for this many n-grams."""
    return int(min(max(np.ceil(np.log2(max(mass, 1) / PART_MASS)), PART_BITS[0]), PART_BITS[1]))


def chunks(texts: DataFrame, bits: int, max_words: int) -> DataFrame:
    """``texts`` (language, text) as rows (part, mass, keys, counts) of sorted n-gram hashes."""

    def emit(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(hashes) >> _U(32 - bits)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[first, len(keys)])
        keys = keys[first]
        again = (counts - 1) // 255  # a count fits a byte, so a large one is several
        if again.any():
            rest = counts - 255 * again
            keys = np.repeat(keys, again + 1)
            counts = np.full(len(keys), 255, dtype=np.int64)
            counts[np.cumsum(again + 1) - 1] = rest
        part = (keys >> _U(32)).astype(np.int32)
        low, counts = keys.astype(np.uint32), counts.astype(np.uint8)
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        spans = [(i, min(i + _CHUNK, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for i in range(a, b, _CHUNK)]
        for i in range(0, len(spans), 2048):
            some = spans[i:i + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[[a for a, _ in some]]), pa.array([int(counts[a:b].sum(dtype=np.int64)) for a, b in some]),
                 pa.array([pack_chunk(low[a:b]) for a, b in some], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())],
                names=["part", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            salt, _ = _salts(batch.column(0))
            for lo, hi, data, off in byte_blocks(batch.column(1), _BLOCK):
                grams = Grams(data, off, salt[lo:hi], max_words)
                if len(grams.hash):
                    held.append(grams.hash)
                    n += len(grams.hash)
                if n >= _SORTED:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return texts.mapInArrow(run, "part int, mass long, keys binary, counts binary")


def frequent_filter(chunked: DataFrame, bits: int, threshold: int, slack: int = SLACK) -> np.ndarray:
    """Bits, by the leading ``FILTER_BITS`` of the hash, of all n-grams that may occur ``threshold`` times."""
    shift = np.uint32(32 - (FILTER_BITS - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def done() -> pa.RecordBatch:
            marked = np.zeros(1 << (FILTER_BITS - bits), dtype=bool)
            marked[summary.at_least(threshold) >> shift] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(marked).tobytes()])],
                                              names=["part", "marks"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for p, total, keys, counts in zip(*columns):
                if p != part:
                    if summary:
                        yield done()
                    part, summary = p, MisraGries(slack * total // threshold + 1)
                summary.add(unpack_chunk(keys), np.frombuffer(counts, np.uint8))
        if summary:
            yield done()

    whole = Window.partitionBy("part")
    marks = (chunked.select("part", F.sum("mass").over(whole).alias("total"), "keys", "counts")
             .mapInArrow(run, "part int, marks binary").toArrow())
    out = np.zeros((1 << bits, 1 << (FILTER_BITS - bits - 3)), dtype=np.uint8)
    for p, m in zip(marks.column(0).to_pylist(), marks.column(1).to_pylist()):
        out[p] = np.frombuffer(m, np.uint8)
    return out.ravel()


def exact_counts(texts: DataFrame, marks: np.ndarray, max_words: int) -> DataFrame:
    """(language, phrase, n) of the n-grams that the filter lets through, and of all words together (phrase null)."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)  # 2 ** FILTER_BITS bits at every size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            salt, names = _salts(batch.column(0))
            for lo, hi, data, off in byte_blocks(batch.column(1), _BLOCK):
                grams = Grams(data, off, salt[lo:hi], max_words)
                at = grams.hash >> _U(64 - FILTER_BITS)
                hit = np.flatnonzero((bitmap[(at >> _U(3)).astype(np.int64)] >> (7 - (at & _U(7)).astype(np.uint8))) & 1)
                _, first, counts = np.unique(grams.hash[hit], return_index=True, return_counts=True)
                first = hit[first]
                words = np.bincount(grams.row, minlength=hi - lo)
                rows = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[lo + r] for r in grams.row[grams.first[first]].tolist()]
                              + [names[lo + r] for r in rows.tolist()], pa.string()),
                     pa.array(grams.phrases(first) + [None] * len(rows) if len(first) else [None] * len(rows),
                              pa.binary()).cast(pa.string()),
                     pa.array(np.r_[counts, words[rows]])], names=["language", "phrase", "n"])

    return texts.mapInArrow(run, "language string, phrase string, n long").groupBy("language", "phrase").agg(
        F.sum("n").alias("n"))


def scored(counts: DataFrame, threshold: int) -> DataFrame:
    """Candidates (language, phrase, a, l, r, score) at their lowest-scoring cut."""
    words = F.split("phrase", " ")
    found = counts.select("language", "phrase", F.col("n").alias("a"), words.alias("w")).where(
        (F.size("w") > 1) & (F.col("a") >= threshold))
    cuts = found.select("language", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "language", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"),
        F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("tail"))
    part = counts.where("phrase IS NOT NULL")
    left = part.select("language", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = part.select("language", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    # decimals: the product may pass 64 bits
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    each = cuts.join(left, ["language", "head"]).join(right, ["language", "tail"]).withColumn("score", score)
    best = each.groupBy("language", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    return best.select("language", "phrase", "x.a", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates without a longer one that holds their words and occurs ``cover`` per cent as often."""
    inner = candidates.select("language", F.col("a").alias("outer"), F.split("phrase", " ").alias("w")).where("size(w) > 2").select(
        "language", "outer", F.explode(F.expr(
            "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
        )).alias("phrase"))
    most = inner.groupBy("language", "phrase").agg(F.max("outer").alias("outer"))
    gone = F.col("outer").isNotNull() & (F.col("outer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * cover)
    return candidates.join(most, ["language", "phrase"], "left").where(~gone).drop("outer")


def collocations(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], text: str = "text", language: str = "lang",
                 threshold: int = THRESHOLD, max_words: int = MAX_WORDS, cover: int = COVER, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: language, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of a phrase and of the two parts of its
    lowest-scoring cut, n those of all words of the language.  A null text is
    empty, a null language ``und``; repeated rows count repeatedly; texts of any
    length are read whole; ties go by a, then by the phrase's bytes.  Other
    columns of ``docs`` are not read.  An empty table gives no rows, as does one
    without a phrase of ``threshold`` occurrences.
    """
    texts = docs.select(_language(F.col(language)).alias("language"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = part_bits(size / 6 * max_words)  # about six bytes a word; the partitions' true masses set the capacities
    marks = frequent_filter(chunks(texts, bits, max_words), bits, threshold)
    counts = stage(exact_counts(texts, marks, max_words).where((F.col("n") >= threshold) | F.col("phrase").isNull()))
    left = uncovered(stage(scored(counts, threshold)), cover)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of every hash class hold the first of all: no task sorts a whole language
    salted = left.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("language", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(*order)).cast("long"))
    total = counts.where("phrase IS NULL").select("language", "n")
    return ranked.where(F.col("rank") <= top).join(total, "language").select("language", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(threshold: int = THRESHOLD, cover: int = COVER, top: int = TOP) -> str:
    """DuckDB SQL of the collocations of ``documents``."""
    grams = "w, " + ", ".join(f"list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))"
                              for m in range(2, MAX_WORDS + 1))
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(flatten([{grams}])) AS g FROM w),
f AS (SELECT lang, g, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {threshold}),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, g AS phrase, n AS a, string_split(g, ' ') AS w FROM f WHERE contains(g, ' ')),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, phrase, a, k, x.n AS l, y.n AS r, ({SCALE}::HUGEINT * a // (x.n + y.n))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = array_to_string(w[1:k], ' ')
             JOIN f y ON y.lang = k.lang AND y.g = array_to_string(w[k + 1:len(w)], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, a, w, unnest(range(2, len(w))) AS m FROM c WHERE len(w) > 2),
i AS (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM m),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM i GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR 100::HUGEINT * o.a < {cover} * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= {top}
"""
