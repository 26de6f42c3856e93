"""Packing of tokenised documents into fixed-length sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently
in randomised groups of documents.  Every document is tokenised where it is
read; only piece descriptions (no ids) are shuffled, to their group.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 2
#: Documents meant for one group, on average; a group is packed in one task.
GROUP_ROWS = 16_384
#: Words whose ids a Python worker remembers; only a matter of speed.
MEMO_WORDS = 1_600_000
#: A word of one id, and the words that are encoded as one line with it between them.
SEPARATOR = b"|"
LINE_WORDS = 64

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space before it merges, so no id spans two words
    and the ids of a text are its words' ids one after the other.  Its added
    tokens (such as an end of text) are matched in the text as it stands, before
    case is folded: they cut the text, and what lies between them is words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.encode(): struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + b")") if added else None
        self.added_ids = added
        # the words between them: a word that becomes an added token by folding is none
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[bytes, bytes] = {}
        self.separator = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids[0]

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text.  The tokenizer folds case, so A-Z may be folded first."""
        cut = [self.added.split(t) if self.added and self.added.search(t) else [t] for t in texts]
        split = [[p.lower().split() for p in parts[::2]] for parts in cut]
        self.learn(set().union(*[words for parts in split for words in parts]))
        get = self.memo.__getitem__
        for parts, words in zip(cut, split):
            out = b"".join(map(get, words[0]))
            for token, more in zip(parts[1::2], words[1:]):
                out += self.added_ids[token] + b"".join(map(get, more))
            yield out

    def learn(self, words: set[bytes]) -> None:
        """Have the ids of all ``words`` in the memo.

        Letters and the marks after them are different tokens, so a word of
        letters with marks at its end is put together from the two.  Words are
        encoded in lines with a separator between them, whose id no other word
        without that character has; the others are encoded one by one.
        """
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        cut: dict[bytes, tuple[bytes, bytes]] = {}
        wanted = set()
        for word in words.difference(self.memo):
            core = word.rstrip(b".,!?") if word[-1] in b".,!?" else b""
            if core and core.decode().isalpha():
                cut[word] = (core, word[len(core):])
                wanted.update(cut[word])
            else:
                wanted.add(word)
        wanted = wanted.difference(self.memo)
        new = [w for w in wanted if SEPARATOR not in w]
        lines = [new[i:i + LINE_WORDS] for i in range(0, len(new), LINE_WORDS)]
        found = self._encoded([b" | ".join(line) for line in lines])
        memo = self.memo
        for line, ids in zip(lines, found):
            ends = np.flatnonzero(ids == self.separator).tolist()
            buffer, start = ids.tobytes(), 0
            for w, end in zip(line, [*ends, len(ids)], strict=True):
                memo[w] = buffer[4 * start:4 * end]
                start = end + 1
        odd = [w for w in wanted if SEPARATOR in w]
        memo.update(zip(odd, (ids.tobytes() for ids in self._encoded(odd))))
        for w, (core, marks) in cut.items():
            memo[w] = memo[core] + memo[marks]

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in encoded]


#: Coders of this Python worker by tokenizer file; Spark gives a worker one task after another.
_coders: dict[str, WordIds] = {}


def coder_of(path: str) -> WordIds:
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def pieces(df: DataFrame, text: str = "text", tokenizer: str | None = None, length: int = SEQUENCE,
           end_id: int = END_ID, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and cut at each ``length`` ids.

    Returns one row per piece: the ``keep`` columns, then start, length,
    ids_crc32 and doc_tokens, and the ids themselves with ``with_ids``.  A null
    text counts as empty: its one piece is the end id.  A very long text is
    encoded whole, in one task, and gives as many pieces as it needs.
    """
    path = tokenizer or default_tokenizer()
    names = list(keep)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = coder_of(path)
        for batch in batches:
            col = batch.column(len(names)).cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                texts = [t or b"" for t in col.slice(lo, 256).to_pylist()]
                at, start, size, crc, total, ids = [], [], [], [], [], []
                for row, found in enumerate(coder.ids(texts), lo):
                    found += end
                    n = len(found) // 4
                    for s in range(0, n, length):
                        part = found[4 * s:4 * (s + length)]
                        at.append(row)
                        start.append(s)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                cols = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(names))]
                cols += [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                if at:
                    yield pa.RecordBatch.from_arrays(cols, names=out_names)

    source = df.select(*names, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema += ", " + PIECES + (", ids array<int>" if with_ids else "")
    out_names = [*names, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return source.mapInArrow(run, schema)


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every size when each, in the given order, goes to the first bin it fits.

    A tournament tree over the bins holds at each node the largest free capacity
    below it; a walk from the root finds the leftmost bin with enough room.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack(cut: DataFrame, documents: int, length: int = SEQUENCE, group_rows: int = GROUP_ROWS,
         seed: int = 0) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    ``cut`` has a row per piece with ``start``, ``length`` (1 to ``length``) and
    ``ids_crc32``; ``documents`` is how many documents were cut, and sets the
    number of groups.  Pieces are dealt to random groups by a hash of their row,
    so the groups are alike and any one of them can be packed, or packed again
    after a lost executor, by itself.

    Returns ``cut`` with sequence_id (unique over all groups) and offset
    (gapless from 0 within its sequence).  An empty input gives an empty result;
    a null in any carried column is kept; repeated rows are packed each.
    """
    groups = max(1, -(-documents // group_rows))
    names = cut.columns
    key = [F.lit(seed)] + [F.col(f"`{c}`") for c, kind in cut.dtypes if "map<" not in kind]
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(*key), F.lit(groups)).cast("long"))

    def one(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        order = np.lexsort([table.column("start").to_numpy(), table.column("ids_crc32").to_numpy(), -sizes])
        table, sizes = table.take(pa.array(order)), sizes[order]
        bins = first_fit(sizes, length)
        place = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[place])
        begins = ends - sizes[place]
        first = np.r_[True, bins[place][1:] != bins[place][:-1]]
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[place] = begins - np.maximum.accumulate(np.where(first, begins, 0))
        sequence = table.column("__group").to_numpy() * (1 << 32) + bins
        return table.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())) \
            .append_column("offset", pa.array(offset, pa.int64()))

    fields = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInArrow(one, fields)
