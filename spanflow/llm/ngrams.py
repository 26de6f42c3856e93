"""Numpy kernels for n-grams inside tasks: words of byte blocks, xxhash64, interning, CRC-32 of joined words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_P1, _P2, _P3 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_P4, _P5 = _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true for the bytes of the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


def byte_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes with A-Z lower-cased, offsets) of row ranges of about ``limit`` bytes; a null text is empty."""
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
        yield first, last, _LOWER[whole[off[first]:off[last]]], off[first:last + 1] - off[first]
        first = last


def find_words(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows): words are runs of bytes outside ``gap``; the words of row i are rows[i]..rows[i + 1]."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64_longs(x: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the eight little-endian bytes of each 64-bit value."""
    return _avalanche(_rotl((_P5 + _U(8)) ^ (_rotl(x * _P2, 31) * _P1), 27) * _P1 + _P4)


def _avalanche(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    return h ^ (h >> _U(32))


def xxh64_rows(rows: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the rows of a uint8 matrix of fewer than 32 columns."""
    n, width = rows.shape
    h = np.full(n, _P5 + _U(width), dtype=np.uint64)
    at = 0
    while at + 8 <= width:
        lane = np.ascontiguousarray(rows[:, at:at + 8]).view("<u8")[:, 0]
        h ^= _rotl(lane * _P2, 31) * _P1
        h = _rotl(h, 27) * _P1 + _P4
        at += 8
    if at + 4 <= width:
        h ^= np.ascontiguousarray(rows[:, at:at + 4]).view("<u4")[:, 0].astype(np.uint64) * _P1
        h = _rotl(h, 23) * _P2 + _P3
        at += 4
    for i in range(at, width):
        h ^= rows[:, i].astype(np.uint64) * _P5
        h = _rotl(h, 11) * _P1
    return _avalanche(h)


def _by_width(starts: np.ndarray, ends: np.ndarray) -> tuple[Iterator[tuple[int, np.ndarray]], np.ndarray]:
    """(width, numbers of the spans of that width) for widths below 32, and the numbers of the longer spans."""
    size = np.minimum(ends - starts, 32).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(size, minlength=33))]
    return ((w, order[cuts[w]:cuts[w + 1]]) for w in range(32) if cuts[w] < cuts[w + 1]), order[cuts[32]:]


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 of the byte spans of ``data``; spans of equal length are hashed together."""
    out = np.empty(len(starts), dtype=np.uint64)
    widths, long = _by_width(starts, ends)
    for width, at in widths:
        out[at] = xxh64_rows(data[starts[at][:, None] + np.arange(width)])
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test whether the byte spans numbered a[i] and b[i] hold the same bytes."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    mask = np.r_[(_U(1) << (_U(8) * np.arange(8, dtype=np.uint64))) - _U(1), ~_U(0)].astype(np.uint64)

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = size[a] == size[b]
        live, at = np.flatnonzero(out & (a != b)), 0
        while len(live):
            x, y = a[live], b[live]
            left = size[x] - at
            keep = mask[np.minimum(left, 8)]
            differ = (lanes[starts[x] + at].view("<u8")[:, 0] ^ lanes[starts[y] + at].view("<u8")[:, 0]) & keep != 0
            out[live[differ]] = False
            live, at = live[~differ & (left > 8)], at + 8
        return out

    return same


def intern(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every item, item that owns each slot or -1) in an open-addressed table with linear probing.

    ``keys`` are 64-bit hashes; an item shares a slot only if its key equals the
    owner's and ``same(owners, items)`` confirms equal content.
    """
    size = 1 << max(4, (2 * len(keys) - 1).bit_length())
    owner = np.full(size, -1, dtype=np.int64)
    slot = (keys & _U(size - 1)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        at = slot[todo]
        free = owner[at] < 0
        owner[at[free]] = todo[free]  # of several items, one becomes the owner
        own = owner[at]
        hit = keys[own] == keys[todo]
        hit[hit] = same(own[hit], todo[hit])
        todo = todo[~hit]
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return slot, owner


def _zero_tables(levels: int) -> np.ndarray:
    """[k, j, v]: a CRC-32 register that holds v in byte j, after 2 ** k zero bytes."""
    v = np.arange(256, dtype=np.uint32)
    step = v.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.zeros((levels, 4, 256), dtype=np.uint32)
    for j in range(4):
        x = v << np.uint32(8 * j)
        out[0, j] = (x >> np.uint32(8)) ^ step[x & 255]
    for k in range(1, levels):
        for j in range(4):
            out[k, j] = _apply(out[k - 1], out[k - 1, j])
    return out


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (table[0][c & 255] ^ table[1][(c >> np.uint32(8)) & 255]
            ^ table[2][(c >> np.uint32(16)) & 255] ^ table[3][c >> np.uint32(24)])


_ZEROS = _zero_tables(40)
#: A register after one zero byte, by its low byte.
_STEP = _ZEROS[0, 0]


def _short_tables() -> np.ndarray:
    """[j, n * 256 + v]: a register that holds v in byte j, after n zero bytes, for n below 32."""
    out = np.zeros((4, 32, 256), dtype=np.uint32)
    for j in range(4):
        out[j, 0] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        for n in range(1, 32):
            out[j, n] = _apply(_ZEROS[0], out[j, n - 1])
    return out.reshape(4, -1)


_SHORT = _short_tables()


def crc_join(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, from their CRCs and the byte length of the second."""
    row = (size & 31) << 8
    out = (_SHORT[0][row + (first & 255)] ^ _SHORT[1][row + ((first >> np.uint32(8)) & 255)]
           ^ _SHORT[2][row + ((first >> np.uint32(16)) & 255)] ^ _SHORT[3][row + (first >> np.uint32(24))])
    for k in range(5, int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero((size >> k) & 1)
        out[at] = _apply(_ZEROS[k], out[at])
    return out ^ second


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte spans of ``data``; spans of equal length are summed together."""
    out = np.empty(len(starts), dtype=np.uint32)
    widths, long = _by_width(starts, ends)
    for width, at in widths:
        c = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(width):
            c = (c >> np.uint32(8)) ^ _STEP[(c ^ data[starts[at] + i]) & np.uint32(255)]
        out[at] = ~c
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return out
