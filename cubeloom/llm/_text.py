"""Vectorised text primitives over Arrow string columns (numpy, no per-word Python).

A word is a maximal run of bytes other than space and 0x09-0x0D.  All hashes are 64 bit,
seeded by fixed constants, and equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random odd-ish 64-bit value per byte, and one odd multiplier per place in a word.
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_MUL = _U(0x9E3779B97F4A7C15)
_PLACES = 1 << 12
_PLACE = _rng.integers(0, 2**63, _PLACES, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes' values under a second hash.
_SECOND = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1] if off is not None and off.size else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - offsets[0] if n else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes, whole rows only."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte places) of all words, and for each text its first word (n+1 values)."""
    solid = ~IS_SPACE[raw]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    before[cut] = False  # a text starts anew
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    if len(solid):
        after[-1] = False
        after[:-1] = solid[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if ``lower``); ``second`` gives one independent of the first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = np.concatenate([[0], np.cumsum(lens)])
    gap = np.repeat(starts - total[:-1], lens)
    packed = raw[np.arange(total[-1]) + gap]
    if lower:
        packed = _LOWER[packed]
    place = np.arange(total[-1]) - np.repeat(total[:-1], lens)
    if lens.max() > _PLACES:  # places beyond the table: the table again, turned by the lap
        lap = (place // _PLACES).astype(np.uint64)
        weight = _PLACE[place % _PLACES] * (mix(lap) | _U(1))
    else:
        weight = _PLACE[place]
    part = (_SECOND if second else _BYTE)[packed] * weight
    part ^= part >> _U(29)
    return mix(np.add.reduceat(part, total[:-1]) + lens.astype(np.uint64) * _MUL)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (across text borders too: callers mask), by doubling.

    Element i covers h[i:i+k]; the result has len(h)-k+1 values.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    done, step, power = 0, 1, h
    rest = k
    while rest:
        if rest & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else mix(out * _MUL + piece)
            done += step
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - step] * _MUL + power[step:])
            step *= 2
    return mix(out + _U(k))


def byte_window_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive bytes, k a power of two; cheaper than ``window_hashes`` on bytes."""
    x, step = _BYTE[raw], 1
    while step < k:
        if len(x) <= step:
            return np.zeros(0, np.uint64)
        x = x[:-step] * _U(0x9E3779B97F4A7C15 + 2 * step) + x[step:]
        step *= 2
    return mix(x)


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n places start a k-window that stays in its text; first: the texts' first places."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(len(ends)) + k <= ends


def sliding_min_args(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its least value by the high 32 bits, the leftmost of equal ones.

    Places ride in the low bits, so that one minimum per doubling step does both.  What is
    compared doesn't depend on the number of values, so equal windows choose alike anywhere.
    """
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << 32) - 1)
    val, step = (x & ~low) | np.arange(len(x), dtype=np.uint64), 1
    while step * 2 <= w:
        val = np.minimum(val[:-step], val[step:])
        step *= 2
    if step < w:
        val = np.minimum(val[: step - w], val[w - step :])
    return (val[:n] & low).astype(np.int64)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n places covered by [s, s+length) for any s of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
