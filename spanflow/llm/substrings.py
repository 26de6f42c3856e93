"""Removal of repeated passages: seed and extend on winnowed anchors.

Seed.  Every window of ``length`` words picks one of its word grams, the one of
least hash (winnowing), so equal windows pick equal anchors at equal offsets.
Occurrences of anchors are joined on their hash.

Extend.  An occurrence stands for the run of windows that picked it; the run's
words are its surroundings.  Occurrences of an anchor with equal surroundings
match to both ends, and are one class from then on.  Where classes of an anchor
differ, each class is extended word by word within its run: its windows are
compared by 128-bit hashes with those of the other classes.  Classes, not pairs
of occurrences, are compared, so the work grows with the text even where a
passage occurs in a third of all documents.

Texts are named by their content, so copies of a text share all results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.words import blocks, mix, run_hashes, text_key

LENGTH = 35
GRAM = 8

_U = np.uint64
#: Anchors compare by the upper 36 bits of a gram's hash; the lower bits hold its place, later ones first.
_PLACE = _U((1 << 28) - 1)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of x[i:i + size] for every i that has so many values."""
    have, out = 1, x
    while 2 * have <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors_of(h: np.ndarray, rows: np.ndarray, length: int, gram: int):
    """Anchor occurrences of a block of rows, from its words' hashes.

    Returns row, first and last window start (in the row), anchor hash, and hash of the surroundings.
    """
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    at = np.arange(len(h) - gram + 1)
    grams = run_hashes(h, at, at + gram)
    key = (grams & ~_PLACE) | (_PLACE - at.astype(_U))
    least = _sliding_min(key, length - gram + 1)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    starts = np.arange(len(least))
    ok = rows[row[starts] + 1] - starts >= length
    starts = starts[ok]
    if not len(starts):
        return none, none, none, none.astype(_U), none.astype(_U)
    anchor = (_PLACE - (least[starts] & _PLACE)).astype(np.int64)
    row = row[starts]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    a, b, p, row = starts[first], starts[last], anchor[first], row[first]
    around = mix(run_hashes(h, a, b + length) + mix((p - a).astype(_U)))
    return row, a - rows[row], b - rows[row], grams[p], around


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, around, k1, k2, run) of every anchor occurrence of ``texts`` (k1, k2, text); run = 32 * first + extent."""
    assert length - gram + 1 <= 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for lo, _, words in blocks(batch.column(2)):
                row, a, b, h, around = anchors_of(words.hashes(), words.rows, length, gram)
                if len(row):
                    at = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h), _signed(around), k1.take(at), k2.take(at), pa.array(a * 32 + (b - a))],
                        names=["h", "around", "k1", "k2", "run"])

    return texts.mapInArrow(run, "h long, around long, k1 long, k2 int, run long")


def window_rows(texts: DataFrame, length: int) -> DataFrame:
    """Windows of the listed runs of each text: (w1, w2, k1, k2, start, single).

    ``texts`` has k1, k2, text and runs, an array of (run, single).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for lo, hi, words in blocks(batch.column(2)):
                listed = batch.column(3).slice(lo, hi - lo)
                runs = listed.flatten()
                code, single = (runs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                row = np.repeat(np.arange(hi - lo), listed.value_lengths().to_numpy())
                size = code % 32 + 1
                row, single = np.repeat(row, size), np.repeat(single, size)
                start = np.repeat(code // 32, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                a = words.rows[row] + start
                h = words.hashes()
                w1 = run_hashes(h, a, a + length)
                w2 = run_hashes(mix(h ^ _U(0x5851F42D4C957F2D)), a, a + length)
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [_signed(w1), _signed(w2), k1.take(at), k2.take(at), pa.array(start), pa.array(single)],
                    names=["w1", "w2", "k1", "k2", "start", "single"])

    return texts.mapInArrow(run, "w1 long, w2 long, k1 long, k2 int, start long, single boolean")


def repeated_runs(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], text: str = "text",
                  length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, runs): for each text with a repeated window, the codes of all runs of repeated window starts."""
    texts = docs.select(*text_key(F.col(text)), F.col(text).alias("text"))
    found = stage(anchor_rows(texts, length, gram))
    # written first: a join whose sides are both plain scans can split the rows of a very common anchor
    again = stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = stage(found.join(again, "h"))
    classes = stage(found.groupBy("h", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "run")).alias("one")))
    whole = found.join(classes.where("n > 1").select("h", "around"), ["h", "around"]).select("k1", "k2", "run")

    # classes of anchors that have a class of one occurrence: extend them within their runs
    differ = classes.groupBy("h").agg(F.count("*").alias("c"), F.min("n").alias("least")).where(
        "c > 1 AND least = 1").select("h")
    extend = (classes.join(differ, "h").select("one.k1", "one.k2", F.struct("one.run", (F.col("n") == 1).alias("single")).alias("r"))
              .groupBy("k1", "k2").agg(F.collect_list("r").alias("runs")))
    part = stage(window_rows(texts.join(extend, ["k1", "k2"]), length))
    place = F.struct("k1", "k2", "start")
    twice = stage(part.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"),
                                          F.min("single").alias("single"))
             .where("lo != hi OR NOT single").select("w1", "w2"))
    edges = part.where("single").join(twice, ["w1", "w2"]).select("k1", "k2", (F.col("start") * 32).alias("run"))
    # copies of a text share all their codes: one of each is kept, so a list is no longer than its text
    once = whole.unionByName(edges).distinct()
    return once.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))


def remove_repeats(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], text: str = "text",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts anywhere else.

    Windows are judged on the input.  Returns the columns of ``docs`` with
    ``text`` replaced by the kept words joined by one space, and n_words,
    n_removed, kept_sha256 (columns of these names in ``docs`` are replaced).
    A null text has no words; repeated rows are repeats of each other; an empty
    table gives an empty one.  ``stage`` writes a frame to shared storage and
    returns what it wrote.
    """
    out = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256")]
    carried = docs.select(*out, F.col(text).alias("__text"))
    # written first, so that the join can split the copies of a very common text
    runs = stage(repeated_runs(docs, stage, text, length, gram))
    keyed = carried.select("*", *[k.alias(f"__{n}") for n, k in zip(("k1", "k2"), text_key(F.col("__text")))])
    joined = keyed.join(runs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs")),
                        ["__k1", "__k2"], "left").select(*out, "__text", "__runs")
    names = [*out, "text", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = ([], [], [], [])
                texts = part.column(len(out)).cast(pa.binary()).to_pylist()
                for t, runs in zip(texts, part.column(len(out) + 1)):
                    words = (t or b"").split()
                    n, removed = len(words), 0
                    if runs.is_valid:
                        code = runs.values.to_numpy()
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, code // 32, 1)
                        np.add.at(edge, code // 32 + code % 32 + length, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        removed = int(cover.sum())
                        words = [w for w, c in zip(words, cover.tolist()) if not c]
                    kept = b" ".join(words)
                    for r, v in zip(rows, (kept.decode(), n, removed, hashlib.sha256(kept).hexdigest())):
                        r.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(out))]
                    + [pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                    names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    result = joined.mapInArrow(run, schema + ("," if out else "") + " text string, n_words long, n_removed long, kept_sha256 string")
    return result.withColumnRenamed("text", text)


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM s JOIN r USING (x)),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed,
             list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS k
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM k
"""
