"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words with A-Z lower-cased, and one end token per document.  The most
frequent words are classes of their own; every other word, known or not, belongs
to a class named by its last two bytes.  A word's probability is that of its
class given the words before it, times its share of the class:

    log P(word | context) = log softmax(r . Q + b)[class] + log((c + 1) / (n + v + 1))

where c is the word's count, n and v the tokens and distinct words of its class
in the training documents, and one word more stands for all unknown ones.  A
word that is its own class has share 1.  ``r`` is the sum over the context
positions of C[i] * R[word], a diagonal log-bilinear predictor; Q, b, C and R are
trained by noise-contrastive estimation on every training document, one local
model for each shard of the documents, averaged by their numbers of tokens.
Shards, and the order within them, follow from hashes of ids and texts, and their
number from the number of training tokens: how the input is split, or a task run
again, does not change a score.

All counts are exact.  Counts of the frequent words travel with the tasks, which
is bounded by ``HEAD``; the others are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.words import Words, blocks, mix, text_key

#: Words whose counts travel with the tasks (16 bytes each).
HEAD = 1 << 17
#: Frequent words that are classes and contexts of their own, and classes of all others.
OWN = 96
TAIL = 31
CONTEXT_WORDS = 2048
ORDER = 3
DIM = 24
#: Noise samples per batch, shared by its positions; positions per batch.
NOISE = 64
BATCH = 4096
#: Tokens scored at once; their classes' scores stay in a core's cache.
SCORED = 512
#: Training tokens a shard has on average, and documents handled at once.
SHARD_TOKENS = 1 << 21
ROWS = 256
RATE = 0.15

END_HASH = np.uint64(0x2545F4914F6CDD1D)
_U = np.uint64
_SLOT = _U((1 << 20) - 1)


def token_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of the tokens of a block (end tokens included), and each row's token range."""
    n = len(words.rows) - 1
    rows = words.rows + np.arange(n + 1)
    h = np.full(rows[-1], END_HASH, dtype=np.uint64)
    last = np.zeros(rows[-1], dtype=np.int64)
    at = np.arange(len(words.starts)) + words.row_of()
    h[at] = words.hashes()
    if len(at):
        a = words.data[words.ends - 1].astype(np.uint64)
        b = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
        last[at] = (mix(a * _U(256) + b) % _U(TAIL)).astype(np.int64)
    return h, last, rows


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, tail, c): exact counts of all training tokens; ``docs`` has text and held (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in blocks(batch.column(0), lower=True, limit=4 << 20):
                h, last, _ = token_hashes(words)
                if len(h):
                    values, first, n = np.unique(h, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values.view(np.int64)), pa.array(last[first].astype(np.int32)), pa.array(n)],
                        names=["h", "tail", "n"])

    return (docs.where("NOT held").select("text").mapInArrow(run, "h long, tail int, n long")
            .groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("c")))


def frequent(counts: DataFrame, limit: int = HEAD) -> list[tuple[int, int]]:
    """(h, c) of the most frequent words, at most ``limit``, by falling count.

    Counts are put in some thousand logarithmic classes, and whole classes are
    taken from the top, so no more than the result reaches the driver.
    """
    level = F.floor(F.log2("c") * 64)
    least, room = None, limit
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return []
    found = [(r["h"], r["c"]) for r in counts.where(level >= least).select("h", "c").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The frequent words, and the classes' sizes.

    ``head`` rows are (hash, count) by falling count.  The first OWN of them are
    classes 0..OWN-1; class OWN + t has the other words of tail class t.
    """

    def __init__(self, head: list[tuple[int, int]], tails: dict[int, tuple[int, int]]):
        hashes = np.array([h for h, _ in head], dtype=np.int64).view(np.uint64)
        self.own = min(OWN, len(hashes))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.array([c for _, c in head], dtype=np.int64)[order]
        self.rank = order.astype(np.int32)  # place by count
        # a slot by the low bits of a hash holds the place of one word; words that share a slot are searched for
        self.slots = np.full(1 << 20, -1, dtype=np.int32)
        slot = (self.hashes & _SLOT).astype(np.int64)
        self.slots[slot] = np.arange(len(slot), dtype=np.int32)
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1 << 20) > 1)] = -2
        self.classes = OWN + TAIL
        self.share = np.zeros(self.classes)  # log10 of a class's denominator
        own_tokens = np.zeros(self.classes)
        own_tokens[:self.own] = [c for _, c in head[:self.own]]
        for t in range(TAIL):
            n, v = tails.get(t, (0, 0))
            own_tokens[OWN + t] = n
            self.share[OWN + t] = np.log10(n + v + 1)
        self.share[:self.own] = np.log10(own_tokens[:self.own] + 1)
        self.bias = np.log((own_tokens + 0.5) / (own_tokens + 0.5).sum()).astype(np.float32)
        self.contexts = CONTEXT_WORDS + TAIL + 1  # the last stands before the start of a text

    def look_up(self, h: np.ndarray, tail: np.ndarray):
        """(in head, count, class, context id) of tokens."""
        if not len(self.hashes):
            none = np.zeros(len(h), dtype=np.int64)
            return none.astype(bool), none, OWN + tail, CONTEXT_WORDS + tail
        at = self.slots[(h & _SLOT).astype(np.int64)]
        shared = np.flatnonzero(at == -2)
        at[shared] = np.minimum(np.searchsorted(self.hashes, h[shared]), len(self.hashes) - 1)
        known = self.hashes[at] == h
        rank = np.where(known, self.rank[at], np.int32(1 << 30))
        return (known, np.where(known, self.counts[at], 0), np.where(rank < self.own, rank, OWN + tail),
                np.where(rank < CONTEXT_WORDS, rank, CONTEXT_WORDS + tail))


def contexts_of(context: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """(tokens, ORDER): the context ids before each token; ``start`` before a text's first."""
    n = len(context)
    place = np.arange(n) - np.repeat(rows[:-1], np.diff(rows))
    out = np.full((n, ORDER), start, dtype=np.int32)
    for i in range(ORDER):
        ok = np.flatnonzero(place > i)
        out[ok, i] = context[ok - i - 1]
    return out


def new_model(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = 0.1
    return {"R": rng.normal(0, scale, (vocabulary.contexts, DIM)).astype(np.float32),
            "C": np.ones((ORDER, DIM), np.float32) * np.float32(0.7) ** np.arange(ORDER, dtype=np.float32)[:, None],
            "Q": rng.normal(0, scale, (vocabulary.classes, DIM)).astype(np.float32),
            "b": vocabulary.bias.copy()}


def train(model: dict, context: np.ndarray, target: np.ndarray, noise_log_p: np.ndarray, state: dict, seed: int) -> None:
    """One pass of noise-contrastive estimation over the positions, in place (AdaGrad)."""
    rng = np.random.default_rng(seed)
    p = np.exp(noise_log_p)
    cumulative = np.cumsum(p) / p.sum()
    order = rng.permutation(len(target))
    hits = np.zeros((min(BATCH, len(order)), len(p)), np.float32)
    small = np.uint16 if len(model["R"]) <= 1 << 16 else np.int64  # numbers of 16 bits are sorted by their digits
    for lo in range(0, len(order), BATCH):
        take = order[lo:lo + BATCH]
        ctx, y = context[take], target[take]
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(p) - 1)
        words = [np.take(model["R"], ctx[:, i], axis=0) for i in range(ORDER)]
        r = words[0] * model["C"][0]
        for i in range(1, ORDER):
            r += words[i] * model["C"][i]
        ln_k = np.float32(np.log(NOISE))
        q_true, q_false = np.take(model["Q"], y, axis=0), model["Q"][noise]
        true = np.einsum("bd,bd->b", r, q_true) + (model["b"] - noise_log_p - ln_k)[y]
        false = r @ q_false.T
        false += (model["b"] - noise_log_p - ln_k)[noise]
        g_true = 1 / (1 + np.exp(true))  # ascent; 1 - sigmoid
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        g_false = np.divide(-1, false, out=false)  # - sigmoid
        n = np.float32(len(take))
        g_r = g_true[:, None] * q_true + g_false @ q_false
        hit, at = hits[:len(take)], (np.arange(len(take)), y)
        hit[at] = g_true
        noise_sum = np.zeros((len(p), NOISE), np.float32)
        noise_sum[noise, np.arange(NOISE)] = 1
        grads = {"Q": (hit.T @ r + noise_sum @ (g_false.T @ r)) / n,
                 "b": (hit.sum(0) + noise_sum @ g_false.sum(0)) / n,
                 "C": np.stack([np.einsum("bd,bd->d", w, g_r) for w in words]) / n}
        hit[at] = 0
        by = (g_r[:, None, :] * model["C"]).reshape(-1, DIM)
        sort = np.argsort(ctx.ravel().astype(small), kind="stable")
        flat = ctx.ravel()[sort]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        at = flat[first]
        sums = np.add.reduceat(np.take(by, sort, axis=0), first, axis=0) / n
        for name, g in grads.items():
            state[name] += g * g
            model[name] += RATE * g / np.sqrt(state[name] + 1e-8)
        state["R"][at] += sums * sums
        model["R"][at] += RATE * sums / np.sqrt(state["R"][at] + 1e-8)


def shard_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[int, pa.Array]]:
    """(shard, texts) of at most ``rows`` rows of one shard, from a stream sorted by shard; Arrow's batches leave no trace."""
    shard, held, n = None, [], 0
    for batch in batches:
        at = batch.column(0).to_numpy()
        edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a == b:
                continue
            if at[a] != shard:
                if n:
                    yield shard, pa.concat_arrays(held)
                shard, held, n = int(at[a]), [], 0
            while a < b:
                take = min(b - a, rows - n)
                held.append(batch.column(2).slice(a, take))
                a, n = a + take, n + take
                if n == rows:
                    yield shard, pa.concat_arrays(held)
                    held, n = [], 0
    if n:
        yield shard, pa.concat_arrays(held)


def train_model(docs: DataFrame, vocabulary: Vocabulary, tokens: int, shard_tokens: int = SHARD_TOKENS) -> dict[str, np.ndarray]:
    """The average, weighted by tokens, of models trained by NCE on each shard of the ``tokens`` training tokens.

    All start from one model and pass over their shard once.  Parameters are
    averaged by Spark in rows of one parameter vector each; only the average, of
    a fixed size, reaches the driver.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary)

    def parameters(model: dict, tokens: int) -> pa.RecordBatch:
        names, rows, values = [], [], []
        for name, v in model.items():
            v = v.reshape(len(v), -1)
            names += [name] * len(v)
            rows += range(len(v))
            values += list(v.astype(np.float64) * tokens)
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(rows, pa.int32()), pa.array(values, pa.list_(pa.float64())),
             pa.array([tokens] * len(rows), pa.int64())], names=["name", "row", "v", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, at, model, state, tokens = vocab.value, None, None, None, 0
        for shard, texts in shard_rows(batches):
            if shard != at:
                if tokens:
                    yield parameters(model, tokens)
                at, model, tokens = shard, new_model(voc), 0
                state = {k: np.full(v.shape, 1e-6, np.float32) for k, v in model.items()}
            for _, _, words in blocks(texts, lower=True):
                h, tail, rows = token_hashes(words)
                if len(h):
                    _, _, cls, ctx = voc.look_up(h, tail)
                    train(model, contexts_of(ctx, rows, voc.contexts - 1), cls, voc.bias, state, seed=tokens)
                    tokens += len(h)
        if tokens:
            yield parameters(model, tokens)

    key = F.xxhash64("doc_id", *text_key(F.col("text")))
    dealt = docs.where("NOT held").select(F.pmod(key, F.lit(max(1, -(-tokens // shard_tokens)))).cast("int").alias("shard"),
                                          key.alias("key"), "text").repartition("shard").sortWithinPartitions("shard", "key")
    parts = dealt.mapInArrow(run, "name string, row int, v array<double>, tokens long")
    mean = (parts.groupBy("name", "row").agg(
        *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)], F.sum("tokens").alias("tokens"))).collect()
    model = new_model(vocabulary)
    for r in mean:
        flat = model[r["name"]].reshape(len(model[r["name"]]), -1)
        flat[r["row"]] = np.array([r[f"v{i}"] for i in range(flat.shape[1])]) / r["tokens"]
    vocab.unpersist()
    return model


def class_log10(model: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 P(class | context) of each token, by batched matrix products."""
    out = np.empty(len(target), dtype=np.float64)
    tables = [model["R"] * c for c in model["C"]]
    for lo in range(0, len(target), SCORED):
        ctx, y = context[lo:lo + SCORED], target[lo:lo + SCORED]
        r = np.take(tables[0], ctx[:, 0], axis=0)
        for i in range(1, ORDER):
            r += np.take(tables[i], ctx[:, i], axis=0)
        s = r @ model["Q"].T
        s += model["b"]
        s -= s.max(axis=1, keepdims=True)
        own = s[np.arange(len(y)), y]
        np.exp(s, out=s)
        out[lo:lo + len(y)] = (own - np.log(s.sum(axis=1))) / np.log(10)
    return out


def score_documents(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Score every whole text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score (the model's log10 probability of the text).  A null text
    is empty: its one token is the end.  A null id is never held out.  Repeated
    rows are scored, and counted in training, each.  Without training documents
    every token is unknown and classes are equally likely.  ``stage`` writes a
    frame to shared storage and returns what it wrote.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held"))
    counts = stage(count_tokens(source))
    head = frequent(counts)
    own = spark.createDataFrame([(h,) for h, _ in head[:OWN]], "h long")
    tails = {r["tail"]: (r["n"], r["v"]) for r in counts.join(F.broadcast(own), "h", "left_anti")
             .groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary = Vocabulary(head, tails)
    model = train_model(source, vocabulary, int(total["n"]))
    shared = spark.sparkContext.broadcast((vocabulary, model))
    keyed = source.select("doc_id", "held", *text_key(F.col("text")), "text")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value[0]
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for lo, _, words in blocks(batch.column(2), lower=True):
                h, tail, rows = token_hashes(words)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                known = voc.look_up(h, tail)[0]
                h, row = h[~known], row[~known]
                order = np.lexsort([h, row])
                h, row = h[order], row[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)])
                n = np.diff(np.r_[new, len(h)])
                at = pa.array(row[new] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), k1.take(at), k2.take(at), pa.array(n.astype(np.int32))],
                    names=["h", "k1", "k2", "n"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = shared.value
        for batch in batches:
            for lo, hi, words in blocks(batch.column(4), lower=True):
                h, tail, rows = token_hashes(words)
                known, c, cls, ctx = voc.look_up(h, tail)
                class_part = class_log10(model, contexts_of(ctx, rows, voc.contexts - 1), cls) - voc.share[cls]
                sums = [np.add.reduceat(x, rows[:-1]) for x in
                        (np.where(known, np.log10(c + 1.0), 0.0), class_part, known.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(4)]
                    + [pa.array(np.diff(rows))] + [pa.array(x) for x in sums],
                    names=["doc_id", "held_out", "k1", "k2", "n_tokens", "log_c", "log_class", "n_head"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    tail_rows = keyed.select("k1", "k2", "text").mapInArrow(rare, "h long, k1 long, k2 int, n int")
    tail_sums = (tail_rows.groupBy("h", "k1", "k2").agg(F.max("n").alias("n"))  # copies of a text count once here
                 .join(counts.select("h", "c"), "h").groupBy("k1", "k2")
                 .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log_c"),
                      F.sum("n").cast("long").alias("n_rare")))
    out = keyed.mapInArrow(common, f"doc_id {id_type}, held_out boolean, k1 long, k2 int, n_tokens long, log_c double, "
                                   "log_class double, n_head long").join(tail_sums, ["k1", "k2"], "left")
    log_c = F.col("log_c") + F.coalesce("rare_log_c", F.lit(0.0))
    n, v = int(total["n"]), int(total["v"])
    return out.select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (log_c + F.col("log_class")).alias("score"))
