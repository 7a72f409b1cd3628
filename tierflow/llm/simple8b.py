"""Simple-8b word-aligned coding of integers, vectorised over numpy arrays.

A 64-bit word holds a selector in its upper 4 bits and up to 60 bits of values below. Selectors 1 to
14 stand for the counts in ``COUNTS``, each value getting ``60 // count`` bits, the first value
lowest. Selector 0 is an escape for a value of more than 60 bits: its payload is an index into a list
of raw values behind the words. Values are cut into blocks of ``block`` values; no word crosses a
block, and an offset per block tells where its words begin, so blocks can be decoded alone and all
together without a loop over words. The last word of a block may have unused fields, which are zero.

Layout, little endian: ``S8B1``, count of values (u64), values per block, blocks, words, escapes (u32
each), block offsets (u32 each, one more than blocks), words (u64 each), escaped values (u64 each).
"""

from __future__ import annotations

import struct

import numpy as np

# Fields per word for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK = 4096
_HEAD = struct.Struct("<4sQIIII")
_FIELDS = np.array((1, *COUNTS), dtype=np.int64)  # by selector


# Widths in rising order, as limits: a value needs the first width whose limit is above it.
_LIMITS = np.array([1 << (60 // count) for count in COUNTS], dtype=np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each position the selector that packs most values from there on, 0 where none does. Packing
    stops early only at the end of a block."""
    n = len(values)
    blocks = -(-n // block)
    # By place in the block, with room behind that every width fits: the width that each value needs.
    need = np.zeros((blocks, block + max(COUNTS)), dtype=np.uint8)
    own = _SMALL[values] if n and values.max() < len(_SMALL) else np.searchsorted(_LIMITS, values, side="right")
    padded = np.zeros(blocks * block, dtype=np.uint8)
    padded[:n] = own
    need[:, :block] = padded.reshape(blocks, block)
    chosen = np.where(need[:, :block] < len(COUNTS), len(COUNTS), 0).astype(np.uint8)
    widest, reach = need, 1  # the widest need of so many values from each place on
    for selector in range(len(COUNTS) - 1, 0, -1):
        count = COUNTS[selector - 1]
        while reach < count:
            step = min(reach, count - reach)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            reach += step
        fits = widest[:, :block] < selector
        if not fits.any():
            break  # more values of a smaller width do not fit either
        chosen[fits] = selector
    return chosen.reshape(-1)[:n].astype(np.int64)


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Values (any unsigned 64-bit integers) as one coded byte string; an empty array is allowed."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    at = np.arange(n)
    room = np.minimum(block - at % block, n - at)
    selector = _selectors(values, block)
    steps = np.minimum(_FIELDS[selector], room).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    first = np.array(starts, dtype=np.int64)
    selector = selector[first]
    words = selector.astype(np.uint64) << np.uint64(60)
    escapes = values[first[selector == 0]]
    words[selector == 0] |= np.arange(len(escapes), dtype=np.uint64)
    padded = np.append(values, np.zeros(max(COUNTS), dtype=np.uint64))
    for s, count in enumerate(COUNTS, start=1):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        # A word's fields side by side; those behind the end of its block stay empty.
        step = np.arange(count)
        fields = padded[first[rows][:, None] + step] << (step * (60 // count)).astype(np.uint64)
        fields[step >= room[first[rows]][:, None]] = 0
        words[rows] |= np.bitwise_or.reduce(fields, axis=1)
    offsets = np.append(np.searchsorted(first, np.arange(0, n, block)), len(first)).astype("<u4")
    head = _HEAD.pack(b"S8B1", n, block, len(offsets) - 1, len(words), len(escapes))
    return head + offsets.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def _open(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    magic, n, block, blocks, words, escapes = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b byte string")
    at = _HEAD.size
    offsets = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    coded = np.frombuffer(data, "<u8", words, at)
    raw = np.frombuffer(data, "<u8", escapes, at + 8 * words)
    return n, block, offsets, coded, raw


def decode(data: bytes) -> np.ndarray:
    """All values of a coded byte string."""
    n, block, offsets, words, raw = _open(data)
    return _unpack(words, raw, offsets, block, n)


def decode_range(data: bytes, start: int, count: int) -> np.ndarray:
    """``count`` values from ``start`` on; only the blocks that hold them are unpacked."""
    n, block, offsets, words, raw = _open(data)
    if start < 0 or count < 0 or start + count > n:
        raise IndexError("range outside the coded values")
    if not count:
        return np.empty(0, dtype=np.uint64)
    low, high = start // block, (start + count - 1) // block + 1
    part = _unpack(
        words[offsets[low] : offsets[high]],
        raw,
        offsets[low : high + 1] - offsets[low],
        block,
        min(n, high * block) - low * block,
    )
    return part[start - low * block : start - low * block + count]


def _unpack(words: np.ndarray, raw: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _FIELDS[selector]
    before = np.cumsum(counts) - counts
    of_block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # Fields left over at the end of a block are taken back at the start of the next.
    place = before - before[offsets[:-1]][of_block] + of_block * block if len(words) else before
    end = np.minimum((of_block + 1) * block, n)
    out = np.zeros(n, dtype=np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s, count in enumerate(COUNTS, start=1):
        rows = np.flatnonzero(selector == s)
        width, mask = 60 // count, np.uint64((1 << (60 // count)) - 1)
        for j in range(count if len(rows) else 0):
            to = place[rows] + j
            inside = to < end[rows]
            out[to[inside]] = ((payload[rows] >> np.uint64(width * j)) & mask)[inside]
    rows = np.flatnonzero(selector == 0)
    out[place[rows]] = raw[payload[rows].astype(np.int64)]
    return out
