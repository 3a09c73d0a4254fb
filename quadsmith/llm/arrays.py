"""NumPy primitives on batches of UTF-8 text: word bounds, rolling hashes, window minima, ragged gathers.

Everything works on the contiguous buffer of an Arrow string column, for all its texts at once.
Words are the runs of bytes outside space, tab, LF, VT, FF and CR; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1  # odd, hence invertible modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Values of bytes in polynomial hashes. Their lowest bytes differ, so that strings of two symbols of fewer than 1024 places
#: that agree in no place differ in their sums, in whatever pattern.
BYTES = (np.random.default_rng(99).integers(0, 1 << 55, 256).astype(_U) << _U(8)) | np.arange(256, dtype=_U)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=_U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a longer text comes alone."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text its first word's index (one more entry than texts)."""
    space = SPACE[buf]
    edge = np.ones(len(buf) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offs] = True  # a word ends with its text
    cut = np.flatnonzero(edge)
    if len(cut) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    keep = ~space[cut[:-1]]
    starts, ends = cut[:-1][keep], cut[1:][keep]
    return starts, ends, np.searchsorted(starts, offs, side="left")


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for every span (sorted, none overlapping another).

    The sum of a mixed value of each byte and its place in the span: no polynomial, whose sums modulo 2**64 agree for some
    different spans of 1024 bytes.
    """
    n = len(buf)
    place = np.zeros(n, np.int64)
    place[starts] = np.diff(starts, prepend=0)
    place = np.arange(n) - np.cumsum(place)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(mix((place * 257 + buf).astype(_U) + _U(_R)), out=total[1:])
    return mix(total[ends] - total[starts] ^ ((ends - starts).astype(_U) << _U(48)))


def window_hashes(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k consecutive values (len - k + 1 of them; across texts too: mask those out)."""
    n = len(values)
    if n < k:
        return np.zeros(0, _U)
    v = mix(values ^ _U((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)) if salt else values
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(v * powers(_R, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_R_INV, n - k + 1))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """min(values[i:i+w]) for every i, by doubling."""
    n = len(values)
    if n < w:
        return np.zeros(0, values.dtype)
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(values: np.ndarray, texts: np.ndarray, k: int, span: int) -> np.ndarray:
    """Positions of k-windows such that any `span` consecutive values of one text contain one of them, chosen by content alone.

    values: hashes of all k-windows; texts: offsets of the texts in units of the values hashed. A window of minimal
    hash is taken (all of them on ties), so equal stretches choose equal positions.
    """
    n = int(texts[-1])
    if len(values) == 0:
        return np.zeros(0, np.int64)
    w = span - k + 1
    lengths = np.diff(texts)
    owner_end = np.repeat(texts[1:], lengths)[: len(values)]
    valid = np.arange(len(values)) + k <= owner_end
    v = np.where(valid, values, _U(0xFFFFFFFFFFFFFFFF))
    low = window_minima(v, w)
    if not len(low):
        return np.zeros(0, np.int64)
    full = np.arange(len(low)) + span <= owner_end[: len(low)]
    low = np.where(full, low, _U(0))  # windows that leave their text choose nothing
    pad = np.zeros(w - 1, dtype=low.dtype)
    highest = ~window_minima(~np.concatenate([pad, low, pad]), w)  # over the windows that hold each place
    return np.flatnonzero((v == highest[: len(v)]) & valid)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. for each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for some s."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def cells(values: np.ndarray, texts: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share out all windows of `span` values inside a text: each belongs to the leftmost k-window of least hash in it.

    Returns, for each run of windows with one owner, the owner's place, the first window's start and the last one's.
    The owner depends on the window's content alone, so that equal windows have owners at equal distances.
    """
    none = np.zeros(0, np.int64)
    n = len(values)
    if not n:
        return none, none, none
    w = span - k + 1
    low = window_minima(values, w)
    end = np.repeat(texts[1:], np.diff(texts))
    inside = np.arange(len(low)) + span <= end[: len(low)]
    if not inside.any():
        return none, none, none
    change = np.ones(len(low), dtype=bool)
    change[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    at = np.flatnonzero(low == values[: len(low)]) + 1  # a window that starts with its owner is its last
    change[at[at < len(low)]] = True
    change[texts[:-1][texts[:-1] < len(low)]] = True
    change &= inside
    first = np.flatnonzero(change)
    stop = np.append(first[1:], len(low))
    before_end = np.searchsorted(np.flatnonzero(~inside), first)
    outside = np.append(np.flatnonzero(~inside), len(low))
    last = np.minimum(stop, outside[before_end]) - 1
    owner = first.copy()
    pad = np.zeros(w - 1, dtype=low.dtype)
    highest = ~window_minima(~np.concatenate([pad, low, pad]), w)  # over the windows that hold each place
    hits = np.flatnonzero(values == highest)  # few places, the least of some window; owners are among them
    j = np.searchsorted(hits, first)
    owner = hits[np.minimum(j, len(hits) - 1)]
    while len(open_at := np.flatnonzero(values[owner] != low[first])):
        j[open_at] += 1
        owner[open_at] = hits[j[open_at]]
    return owner, first, last


def prefix_totals(values: np.ndarray) -> np.ndarray:
    """Sums of value * base**place up to each place, for range_hashes."""
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(_R, len(values)), out=total[1:])
    return total


def range_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values in each [start, end), wherever it stands."""
    return mix((total[ends] - total[starts]) * powers(_R_INV, len(total))[starts] ^ ((ends - starts).astype(_U) << _U(40)))
