"""Words of whole texts, as Spark columns and as numpy arrays inside tasks.

A word is a run of characters other than the six ASCII white-space characters.
Inside tasks, texts arrive as Arrow string arrays and words are found and hashed
on their bytes, a bounded block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text handled at once in a task; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def words_column(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def text_key(text: Column) -> list[Column]:
    """Two columns (k1 long, k2 int) that name a text by its content; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.hash(F.concat(t, F.lit("\x01"))).alias("k2")]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; kept between blocks of usual size."""
    if n > 2 * BLOCK_BYTES:
        return _powers(_MULT, n), _powers(_INV, n)
    if not _tables or len(_tables["up"]) < n:
        _tables.update(up=_powers(_MULT, max(n, BLOCK_BYTES)), down=_powers(_INV, max(n, BLOCK_BYTES)))
    return _tables["up"][:n], _tables["down"][:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a block of rows: byte ranges into ``data``, rows as ranges of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # word range of row i: rows[i]..rows[i + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def row_of(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Split an Arrow string array into row ranges of about ``limit`` bytes and find their words.

    A null text has no words.  ``lower`` folds A-Z first.
    """
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        raw = whole[off[first]:off[last]]
        if lower:
            raw = _LOWER[raw]
        yield first, last, find_words(raw, off[first:last + 1] - off[first])
        first = last


def find_words(data: np.ndarray, off: np.ndarray) -> Words:
    """Words of the rows whose texts are ``data[off[i]:off[i + 1]]``."""
    word = ~_IS_SPACE[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    cuts = off[:-1][off[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def windows(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all runs of ``size`` words that lie within one row."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = np.repeat(rows[1:], np.diff(rows)) - np.arange(n) >= size
    at = np.flatnonzero(room)
    return at, run_hashes(h, at, at + size)


def run_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences ``a[i]..b[i]``, from the words' hashes."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

