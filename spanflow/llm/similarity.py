"""N-gram Jaccard self join by chosen paths.

Every text is the set of its five-word shingles.  Texts with equal sets are one
set from the start.  A run is a random tree: at each level one coordinate of the
sets' MinHash signature, that is one sampled shared token, splits the nodes'
sets by their token there.  A node of at most ``leaf`` sets is not split
further; neither is one at ``max_depth``.  Leaves are compared by brute force.

No two levels or runs share a coordinate, so runs are independent: a pair of
similarity J agrees on the first d tokens of a run with probability J ** d, and
then meets there unless its path goes deeper than d.  A set whose deepest path
so far has depth d is done after so many runs that a pair at the threshold has
agreed d times with the target probability.  (The depth of a single path tells
less: paths by tokens that a set has for itself end early and meet nothing.)

No pair is ever written out.  A pair belongs to the first run in which it
shares a leaf; there it is verified on whole texts and counted.  A leaf yields,
per set, a number of links and one edge to a linked set.  Leaves that stay
large (a group of thousands of different near copies) are cut into blocks, and
pairs of blocks are tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.components import components
from spanflow.llm.words import blocks, mix, run_hashes, text_key, windows

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 32
#: Chance that a pair at the threshold is found.
RECALL = 0.9999
LEAF = 64
MAX_DEPTH = 6
RUNS = 8
BLOCK = 256
#: A pair is verified if at least so many of the first 32 sampled tokens agree; at the threshold, fewer do in 1 of 10**7 pairs.
AGREE = 12
#: Bytes of text whose shingles are hashed at once.
_BLOCK_BYTES = 1 << 19

_U = np.uint64
_U32 = np.uint32


def shingle_hashes(h: np.ndarray, rows: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row; a row of fewer words is one shingle of all of them."""
    at, run = windows(h, rows, shingle)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[at] if len(at) else at
    short = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < shingle))
    if len(short):
        row = np.r_[row, short]
        run = np.r_[run, run_hashes(h, rows[short], rows[short + 1])]
    order = np.lexsort([run, row])
    row, run = row[order], run[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
    return row[new], run[new]


def signatures(texts: DataFrame, shingle: int = SHINGLE, tokens: int = TOKENS) -> DataFrame:
    """Columns of ``texts`` (k1, k2, ..., text last) without text, and set_id, n_set and tokens (MinHash).

    set_id is a 128-bit hash of the set; the empty set has null tokens.
    """
    names = texts.columns[:-1]
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 32, tokens, dtype=np.uint64).astype(_U32) | _U32(1)
    flip = rng.integers(0, 1 << 32, tokens, dtype=np.uint64).astype(_U32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in blocks(batch.column(len(names)), limit=_BLOCK_BYTES):
                n = hi - lo
                row, h = shingle_hashes(words.hashes(), words.rows, shingle)
                size = np.bincount(row, minlength=n)
                first = np.cumsum(size) - size
                some = np.flatnonzero(size)
                ids = np.zeros((n, 2), dtype=np.uint64)
                sig = np.zeros((n, tokens), dtype=np.uint32)
                if len(some):
                    ids[some, 0] = np.add.reduceat(mix(h), first[some])
                    ids[some, 1] = np.add.reduceat(mix(h ^ _U(0x9E3779B97F4A7C15)), first[some])
                    low = (h ^ (h >> _U(32))).astype(_U32)
                    for t in range(tokens):
                        x = (low ^ flip[t]) * mult[t]
                        x ^= x >> _U32(15)
                        x *= _U32(0x85EBCA6B)
                        x ^= x >> _U32(13)
                        sig[some, t] = np.minimum.reduceat(x, first[some])
                flat = pa.array(sig[some].view(np.int32).ravel())
                offs = pa.array(np.r_[0, np.cumsum(size > 0) * tokens].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, n) for i in range(len(names))]
                    + [pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                       pa.array(size), pa.ListArray.from_arrays(offs, flat, mask=pa.array(size == 0))],
                    names=[*names, "set_id", "n_set", "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, schema + ", set_id binary, n_set long, tokens array<int>")


def runs_needed(threshold: float, recall: float, max_depth: int) -> list[int]:
    """Number of runs after which a set whose deepest path has depth 1, 2, ... ``max_depth`` is done.

    Each depth may miss its share of 1 - recall, so that all together miss no more.
    """
    return [RUNS * math.ceil(math.log((1 - recall) / max_depth) / math.log(1 - threshold ** d) / RUNS)
            for d in range(1, max_depth + 1)]


def leaves(sets: DataFrame, stage: Callable[[DataFrame], DataFrame], first_run: int, runs: int,
           leaf: int, max_depth: int) -> DataFrame:
    """One row per set and run: (set_id, run, path, depth, n): the node where its path ended, and its number of sets.

    ``tokens`` of ``sets`` has ``max_depth`` tokens for each of these runs, one run after the other.  A set's nodes
    depend on nothing but its tokens, so all of a run's are computed at once; a level only counts them.
    """
    at = f"((r - {first_run}) * {max_depth})"
    nodes = (f"transform(sequence({first_run}, {first_run + runs - 1}), r -> struct(r AS run, slice(aggregate("
             f"slice(tokens, {at} + 1, {max_depth}), array(cast(r as bigint)),"
             " (path, t) -> concat(path, array(xxhash64(element_at(path, -1), t)))), 2, "
             f"{max_depth}) AS path))")
    live = sets.select("set_id", F.explode(F.expr(nodes)).alias("x")).select("set_id", "x.run", "x.path")
    live = stage(live.select("set_id", "run", F.col("path")[0].alias("node"), F.slice("path", 2, max_depth).alias("rest")))
    done = []
    for depth in range(1, max_depth + 1):
        many = live.groupBy("node").agg(F.count("*").alias("n"))
        held = live.join(many, "node").withColumn("depth", F.lit(depth))
        if depth == max_depth:
            done.append(held)
            break
        big = stage(held.where(F.col("n") > leaf))
        done.append(held.where(F.col("n") <= leaf))
        if big.isEmpty():
            break
        live = stage(big.select("set_id", "run", F.col("rest")[0].alias("node"), F.slice("rest", 2, max_depth).alias("rest")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("set_id", "run", F.col("node").alias("path"), "depth", "n")


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal values in column ``key`` of a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, and their values one after the other."""
    lists = column.combine_chunks()
    off = lists.offsets.to_numpy()
    return np.diff(off), lists.values.slice(off[0], off[-1] - off[0])


def _new_pairs(table: pa.Table, agree: int):
    """For each job in ``table`` its (first row, rows, x, y): pairs that meet here first and may be similar."""
    job = table.column("job").to_numpy()
    n_runs = int(max(1, np.max(table.column("run").to_numpy()) + 1)) if len(job) else 1
    before = np.zeros((len(job), n_runs), dtype=np.int64)
    lengths, nodes = _values(table.column("nodes"))
    row = np.repeat(np.arange(len(job)), lengths)
    r, p = (x.to_numpy() for x in nodes.flatten())
    ok = r < n_runs
    before[row[ok], r[ok]] = p[ok]
    sig = _values(table.column("tokens"))[1].to_numpy().reshape(len(job), -1)
    run, side = table.column("run").to_numpy(), table.column("side").to_numpy()
    cuts = np.flatnonzero(np.r_[True, job[1:] != job[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        m = b - a
        if m < 2:
            continue
        if side[a] < 0:
            x, y = np.triu_indices(m, 1)
        else:
            left, right = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        for lo in range(0, len(x), 1 << 16):
            px, py = x[lo:lo + (1 << 16)], y[lo:lo + (1 << 16)]
            new = np.ones(len(px), dtype=bool)
            for q in range(run[a]):
                node = before[a:b, q]
                new &= (node[px] != node[py]) | (node[px] == 0)
            px, py = px[new], py[new]
            if len(px):
                alike = (sig[a + px] == sig[a + py]).sum(axis=1) >= agree
                px, py = px[alike], py[alike]
            if len(px):
                yield a, b, px, py


def _merge_roots(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component under the links x-y."""
    root = np.arange(m)
    while True:
        old = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == old).all():
            return root


_JOB = "job long, run int, side int, set_id binary, copies long, k1 long, k2 int, nodes array<struct<run:int,path:long>>, tokens array<int>"


def join_sets(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], id_column: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, leaf: int = LEAF,
              max_depth: int = MAX_DEPTH, block: int = BLOCK) -> DataFrame:
    """Jaccard self join on word shingles: one row per row of ``docs``.

    Returns ``id_column``, k1, k2 (the text's key), class_id (the least id of
    its connected component of links), n_links (other rows linked to it, copies
    included) and n_set (distinct shingles).  A text of fewer than ``shingle``
    words is one shingle of all its words; empty and null texts are copies of
    each other and of nothing else.  Null ids come first, as the least.
    """
    texts = docs.select(F.col(id_column).alias("id"), *text_key(F.col(text)), F.col(text).alias("text"))
    enough = runs_needed(threshold, recall, max_depth)
    first_tokens = max(TOKENS, RUNS * max_depth)
    rows = stage(signatures(texts, shingle, first_tokens))
    sets = stage(rows.groupBy("set_id").agg(
        F.count("*").alias("copies"), F.min("id").alias("least_id"), F.max(F.col("id").isNull()).alias("no_id"),
        F.min(F.struct("k1", "k2", "id")).alias("k"), F.first("tokens").alias("tokens")))

    def one_text(which: DataFrame) -> DataFrame:
        """(k1, k2, set_id, text) of the sets in ``which``: the text of the row that stands for the set.

        The row is found by key and id, so copies of a text, which differ in id, lie in different tasks."""
        rep = stage(which.select("set_id").join(sets.select("set_id", "k"), "set_id").select(
            "set_id", *[F.col(f"k.{c}").alias(f"{c}_r") for c in ("k1", "k2", "id")]))
        on = ((texts["k1"] == rep["k1_r"]) & (texts["k2"] == rep["k2_r"]) & texts["id"].eqNullSafe(rep["id_r"]))
        # a merge join at every size: the list of texts grows with the input
        return texts.join(rep.hint("merge"), on).select("k1", "k2", "set_id", "text").dropDuplicates(["set_id"])

    def sized(first):
        """The sets that have tokens, with those of the runs from ``first`` on."""
        held, at = (sets.where("tokens IS NOT NULL"), first) if not first else (more, first)
        return held.select("set_id", F.slice("tokens", at * max_depth + 1, RUNS * max_depth).alias("tokens"))

    found, todo, first, depths, more = [], sized(0), 0, None, None
    while True:
        ended = stage(leaves(todo, stage, first, RUNS, leaf, max_depth))
        found.append(ended.where("n > 1"))
        deepest = ended.groupBy("set_id").agg(F.max("depth").alias("depth"))
        depths = deepest if depths is None else depths.unionByName(deepest)
        first += RUNS
        if first >= enough[-1]:
            break
        short = stage(depths.groupBy("set_id").agg(F.max("depth").alias("depth")).where(
            F.col("depth") > sum(n <= first for n in enough)).select("set_id"))
        if short.isEmpty():
            break
        if more is None:  # later runs concern ever fewer of these sets; only they get the tokens of all runs
            again = signatures(one_text(short).select("k1", "k2", F.col("set_id").alias("of"), "text"), shingle, enough[-1] * max_depth)
            more = stage(again.select(F.col("of").alias("set_id"), "tokens"))
        todo = stage(sized(first).join(short, "set_id"))
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)

    blocks_of = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("set_id"), F.col("b").cast("long")).cast("int")
    members = (met.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("run", "path", "n"))).alias("all"))
               .join(sets.select("set_id", "copies", "k.k1", "k.k2", F.slice("tokens", 1, TOKENS).alias("tokens")), "set_id"))
    jobs = (members.select("*", F.explode("all").alias("at"), F.expr("transform(all, x -> struct(x.run, x.path))").alias("nodes"))
            .select("set_id", "copies", "k1", "k2", "tokens", "nodes", "at.run", "at.path", "at.n")
            .withColumn("b", F.when(F.col("n") <= leaf, 1).otherwise(blocks_of)).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            .select(F.when(F.col("b") == 1, F.col("path")).otherwise(
                        F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other"))).alias("job"),
                    "run", F.when(F.col("mine") == F.col("other"), -1)
                    .otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
                    "set_id", "copies", "k1", "k2", "nodes", "tokens"))

    names = ["job", "run", "side", "set_id", "copies", "k1", "k2", "nodes", "tokens"]

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            keep = np.zeros(table.num_rows, dtype=bool)
            for a, _, x, y in _new_pairs(table, AGREE):
                keep[a + x] = keep[a + y] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    work = stage(jobs.repartition("job").sortWithinPartitions("job").mapInArrow(needed, _JOB))
    held = stage(one_text(work.select("set_id").distinct()).select("set_id", "text"))
    loaded = work.join(held.hint("merge"), "set_id").select(*names, "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            cuts = None
            ids, copies = table.column("set_id").to_pylist(), table.column("copies").to_numpy()
            shingled: dict[int, np.ndarray] = {}
            text_column = table.column("text").combine_chunks()

            def shingles(a: int, b: int) -> None:
                for lo, hi, words in blocks(text_column.slice(a, b - a), limit=_BLOCK_BYTES):
                    row, h = shingle_hashes(words.hashes(), words.rows, shingle)
                    for i, part in enumerate(np.split(h, np.cumsum(np.bincount(row, minlength=hi - lo))[:-1])):
                        shingled[a + lo + i] = part

            links = np.zeros(table.num_rows, dtype=np.int64)
            linked: dict[int, list] = {}
            for a, b, x, y in _new_pairs(table, AGREE):
                if cuts != (a, b):
                    shingled.clear()
                    shingles(a, b)
                    cuts = (a, b)
                same = _overlaps([shingled[i] for i in range(a, b)], x, y)
                size = np.array([len(shingled[i]) for i in range(a, b)])
                close = same >= threshold * (size[x] + size[y] - same) - 1e-9
                x, y = x[close], y[close]
                np.add.at(links, a + x, copies[a + y])
                np.add.at(links, a + y, copies[a + x])
                linked.setdefault(a, []).append((b, x, y))
            out = ([], [], [])
            for a, parts in linked.items():
                b = parts[0][0]
                x, y = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                root = _merge_roots(b - a, x, y)
                for i in np.unique(np.r_[x, y]).tolist():
                    out[0].append(ids[a + i])
                    out[1].append(ids[a + root[i]])
                    out[2].append(int(links[a + i]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
                                                  pa.array(out[2], pa.int64())], names=["a", "b", "links"])

    links = stage(loaded.repartition("job").sortWithinPartitions("job").mapInArrow(
        compare, "a binary, b binary, links long"))
    roots = components(links, stage)
    # staged, so that a join can split a class or a set that holds many rows
    joined = stage(sets.select("set_id", "copies", "least_id", "no_id")
              .join(links.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links")), "set_id", "left")
              .join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
              .withColumn("root", F.coalesce("root", "set_id")))
    least = stage(joined.groupBy("root").agg(F.when(F.max("no_id"), None).otherwise(F.min("least_id")).alias("class_id")))
    per_set = stage(joined.join(least, "root").select(
        "set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root"))
    return rows.select("id", "k1", "k2", "set_id", "n_set").join(per_set, "set_id").select(
        F.col("id").alias(id_column), "k1", "k2", "class_id", "n_links", "n_set", F.col("root").alias("class_key"))


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[i] and y[i], all sorted without repeats."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())],
                        dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(values), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), min(4096, len(values) - lo)), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    return both[x, y].astype(np.int64)


def first_of_class(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does: the one of least id, then least text key."""
    best = classes.groupBy("class_key").agg(F.min(F.struct(F.col(id_column).alias("__id"), F.col("k1").alias("__k1"),
                                                           F.col("k2").alias("__k2"))).alias("x")).select("x.*")
    keyed = docs.select("*", *[k.alias(f"__{n}") for n, k in zip(("t1", "t2"), text_key(F.col(text)))])
    on = keyed[id_column].eqNullSafe(best["__id"]) & (keyed["__t1"] == best["__k1"]) & (keyed["__t2"] == best["__k2"])
    return keyed.join(best, on).dropDuplicates(["__id", "__k1", "__k2"]).select(*[keyed[c] for c in docs.columns])
