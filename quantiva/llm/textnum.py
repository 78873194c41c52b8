"""Vectorised kernels over Arrow text buffers: words, word hashes and window hashes.

A batch of texts is one UTF-8 byte buffer plus the offsets of its rows. All word classes used here are sets
of bytes (bytes of 0x80 and more never separate words), so words are found without decoding. Hashes are
polynomials modulo 2**64 over randomised byte values, taken from prefix sums; two bases give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 18  # bytes of text handled at once; a longer text is a chunk of its own

_rng = np.random.default_rng(20_240_607)
_BYTE = [_rng.integers(1 << 62, 1 << 63, 256, dtype=U64) | U64(1) for _ in range(2)]
_BASE = [int(_rng.integers(1 << 62, 1 << 63)) | 5 for _ in range(2)]
_INV = [pow(b, -1, 1 << 64) for b in _BASE]
_STEP = [int(_rng.integers(1 << 62, 1 << 63)) | 1 for _ in range(2)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes outside [0-9a-z] and 0x80-0xFF, once A-Z are lower case
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = U64((_INV if inverse else _BASE)[which])
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK:
            _POWERS[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@dataclass
class Texts:
    """Some consecutive rows of an Arrow batch."""

    rows: slice
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, len(rows) + 1, from 0


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[Texts]:
    """The column's texts (null: empty) in runs of about ``chunk`` bytes of whole rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + chunk, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Texts(slice(at, to), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    first: np.ndarray  # per row: index of its first word; len(rows) + 1
    row: np.ndarray  # per word: index of its row in the chunk


def words(t: Texts, separators: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are no separators, within each row."""
    data = t.data if data is None else data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separators[data], out=inside[:n])
    edge = inside.copy()
    edge[1:] ^= inside[:-1]
    cuts = t.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    split = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # a row starts within what would be one word
    found = np.flatnonzero(edge)
    if len(split):
        found = np.sort(np.concatenate([found, split, split]), kind="stable")
    start, end = found[0::2], found[1::2]
    first = np.searchsorted(start, t.offsets, "left")
    row = np.repeat(np.arange(len(t.offsets) - 1), np.diff(first))
    return Words(start, end, first, row)


def word_hashes(data: np.ndarray, w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash for each word; ``which`` (0 or 1) picks one of two independent hashes."""
    if not len(w.start):
        return np.zeros(0, U64)
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[which][data] * _powers(which, False, n), out=total[1:])
        return mix((total[w.end] - total[w.start]) * _powers(which, True, n)[w.start])


def window_hashes(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all ``width`` consecutive items of ``h`` (rows not regarded); len(h) - width + 1 of them."""
    if len(h) < width:
        return np.zeros(0, U64)
    out, have, step, at = None, h, _STEP[which], 0
    power, span = step, 1
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = have[at:]
                if out is None:
                    out = part
                else:
                    m = min(len(out), len(part))
                    out = out[:m] * U64(power) + part[:m]
                at += span
            left >>= 1
            if left:
                have = have[:-span] * U64(power) + have[span:] if len(have) > span else have[:0]
                power = power * power & 0xFFFFFFFFFFFFFFFF
                span *= 2
    return mix(out[: len(h) - width + 1] + U64(width))


def row_windows(w: Words, width: int) -> np.ndarray:
    """Of the windows that window_hashes gives: the indexes of those within one row."""
    n = len(w.start) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[:n] == w.row[width - 1 :])


def runs(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [s, s + width) of sorted starts, as two arrays of begins and ends."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > width)
    return np.concatenate([starts[:1], starts[gap + 1]]), np.concatenate([starts[gap], starts[-1:]]) + width


def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the index of its first least one."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = g, np.arange(len(g)), 1

    def join(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        right = best[shift : shift + size] < best[:size]
        return np.where(right, best[shift : shift + size], best[:size]), np.where(right, at[shift : shift + size], at[:size])

    while 2 * span <= width:
        best, at = join(span, len(best) - span)
        span *= 2
    return join(width - span, n)[1] if span < width else at[:n]


def ranges(sorted_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive integers, as first ones and lengths."""
    if not len(sorted_at):
        return sorted_at, sorted_at
    cut = np.flatnonzero(np.diff(sorted_at) != 1)
    first = np.concatenate([sorted_at[:1], sorted_at[cut + 1]])
    last = np.concatenate([sorted_at[cut], sorted_at[-1:]])
    return first, last - first + 1
