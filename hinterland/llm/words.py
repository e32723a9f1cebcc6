"""Words, word shingles and MinHash values of Arrow text columns, with numpy.

Words are runs of bytes other than space and 0x09 to 0x0D, so they never split a UTF-8
character; A to Z are lower-cased. Hashes have 64 bits and depend on nothing but the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_ROWS = 1 << 11
#: Shingles whose hash values are held at once.
_VALUES = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(_BASE))


_VALUE = _numbers(256, 1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about 1 MB: first row, bytes, and row offsets. NULL is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _BLOCK, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of each word; a row's end always ends a word."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    if not len(start):
        return np.zeros(0, _U)
    power = np.multiply.accumulate(np.full(n, _BASE, _U))
    total = np.zeros(n + 1, _U)
    np.cumsum(_VALUE[data] * power, out=total[1:])
    back = np.multiply.accumulate(np.full(n, _INVERSE, _U))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(_U))


def _sequence(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    x = np.full(len(first), k, _U)
    for j in range(k):
        x = mix(x * _U(0xD6E8FEB86659FD93) + words[first + j])
    return x


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle; none, an empty set."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    return np.unique(_sequence(words, np.arange(n - k + 1), k))


def run_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of each ``k`` running words; ``second`` takes another polynomial."""
    n = len(words)
    if n < k:
        return np.zeros(0, _U)
    base = 0xD6E8FEB86659FD93 if second else _BASE
    power = np.multiply.accumulate(np.full(n, base, _U))
    total = np.zeros(n + 1, _U)
    np.cumsum(words * power, out=total[1:])
    back = np.multiply.accumulate(np.full(n, pow(base, -1, 1 << 64), _U))
    return mix((total[k:] - total[:-k]) * back[:n - k + 1] + _U(k))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


class MinHash:
    """``count`` MinHash values of a set, combined by runs of ``rows`` into one value each."""

    def __init__(self, count: int, rows: int, seed: int) -> None:
        self.count, self.rows = count, rows
        self._a = (_numbers(count * rows, seed) | _U(1))
        self._b = _numbers(count * rows, seed + 1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self._a), np.iinfo(_U).max, _U)
        for i in range(0, len(shingles), _ROWS):
            part = shingles[i:i + _ROWS, None] * self._a
            part += self._b
            np.minimum(low, part.min(axis=0), out=low)
        return self._combined(low[None, :])[0]

    def of_sets(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Values of many sets, which begin at ``starts`` and are not empty: a row each."""
        ends = np.append(starts[1:], len(shingles))
        low = np.empty((len(starts), len(self._a)), _U)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _VALUES, "right")))
            if ends[i] - starts[i] > _VALUES:
                own = np.full(len(self._a), np.iinfo(_U).max, _U)
                for a in range(starts[i], ends[i], _ROWS):
                    part = shingles[a:min(a + _ROWS, ends[i]), None] * self._a
                    part += self._b
                    np.minimum(own, part.min(axis=0), out=own)
                low[i], j = own, i + 1
            else:
                part = shingles[starts[i]:ends[j - 1], None] * self._a
                part += self._b
                low[i:j] = np.minimum.reduceat(part, starts[i:j] - starts[i], axis=0)
            i = j
        return self._combined(low)

    def _combined(self, low: np.ndarray) -> np.ndarray:
        out = np.zeros((len(low), self.count), _U)
        for j in range(self.rows):
            out = mix(out * _U(0xD6E8FEB86659FD93) + low[:, j::self.rows])
        return out.view(np.int64)


def unit_spans(
    data: np.ndarray, at: np.ndarray, start: np.ndarray, by_line: bool, least: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in its text, first word and end word of each unit of a block: whole texts, also
    those without words, or lines of at least ``least`` words."""
    if not by_line:
        cut = np.searchsorted(start, at)
        n = len(at) - 1
        return np.arange(n), np.zeros(n, np.int64), cut[:-1], cut[1:]
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks + 1, at)
    cut = np.searchsorted(start, edges)
    row = np.searchsorted(at, edges, "right") - 1
    line = np.searchsorted(breaks, edges) - np.searchsorted(breaks, at)[row]
    held = np.flatnonzero(np.diff(cut) >= max(1, least))
    return row[held], line[held], cut[held], cut[held + 1]


def shingle_sets(words: np.ndarray, first: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all units after each other, and how many each unit has."""
    unit = np.full(len(words), -1)
    length = end - first
    unit[np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.repeat(
        np.arange(len(first)), length)
    place = np.arange(max(len(words) - k + 1, 0))
    place = place[(unit[place] >= 0) & (unit[place] == unit[place + k - 1])]
    values, owners = [_sequence(words, place, k)], [unit[place]]
    for n in range(1, k):
        short = np.flatnonzero(length == n)
        values.append(_sequence(words, first[short], n))
        owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(first))


def units(texts: pa.Array, by_line: bool, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, unit, word hashes) of each text, or of each ``\\n`` line of at least ``least`` words."""
    for first, data, at in blocks(texts):
        start, end = word_spans(data, at)
        words = word_hashes(data, start, end)
        if not by_line:
            cut = np.searchsorted(start, at)
            for i in range(len(at) - 1):
                yield first + i, 0, words[cut[i]:cut[i + 1]]
            continue
        breaks = np.flatnonzero(data == 10)
        edges = np.union1d(breaks + 1, at)
        cut = np.searchsorted(start, edges)
        row = np.searchsorted(at, edges, "right") - 1
        lines = np.searchsorted(breaks, edges)
        base = np.searchsorted(breaks, at)
        for i in np.flatnonzero(np.diff(cut) >= max(1, least)):
            r = row[i]
            yield first + int(r), int(lines[i] - base[r]), words[cut[i]:cut[i + 1]]
