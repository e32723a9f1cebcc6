"""CRC-32 of any run of words from two running CRCs of the text that holds it.

A text is normalised once, to its words with one space between them, and scanned once, keeping
the CRC of every prefix. CRC-32 is linear over GF(2): crc(AB) = shift(crc(A), bytes of B) xor
crc(B), so what stands between two prefixes has the CRC of the longer one with the shifted CRC
of the shorter one cancelled from it, however many words it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from hinterland.llm.words import blocks
from hinterland.llm.worker import kept

_U = np.uint32
_POLYNOMIAL = 0xEDB88320
#: Bytes of a lane. Lanes of a block are scanned side by side and joined by shifts.
_LANE = 1024
_DIGIT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of digits, letters and bytes of characters outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _byte_table() -> np.ndarray:
    def make() -> tuple[np.ndarray]:
        table = np.arange(256, dtype=_U)
        for _ in range(8):
            table = np.where(table & _U(1), (table >> _U(1)) ^ _U(_POLYNOMIAL), table >> _U(1))
        return (table,)

    return kept("crc bytes", make)[0]


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each byte of its argument."""
    return (tables[0][crc & _U(255)] ^ tables[1][(crc >> _U(8)) & _U(255)]
            ^ tables[2][(crc >> _U(16)) & _U(255)] ^ tables[3][crc >> _U(24)])


def _shift_tables(level: int) -> np.ndarray:
    """Maps that append d * 64**level zero bytes, for each d up to 64."""

    def make() -> tuple[np.ndarray]:
        out = np.empty((_DIGIT + 1, 4, 256), _U)
        for k in range(4):
            out[0, k] = np.arange(256, dtype=_U) << _U(8 * k)
        for d in range(_DIGIT):
            if level:
                out[d + 1] = _apply(_shift_tables(level - 1)[_DIGIT], out[d])
            else:
                out[d + 1] = _byte_table()[out[d] & _U(255)] ^ (out[d] >> _U(8))
        return (out,)

    return kept(("crc shifts", level), make)[0]


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What appending ``n`` zero bytes makes of the linear part of each CRC."""
    level = 0
    while n.size and n.max() > 0:
        digit, n = n % _DIGIT, n // _DIGIT
        t = _shift_tables(level)
        moved = np.flatnonzero(digit)
        some, d = crc[moved], digit[moved]
        crc = crc.copy()
        crc[moved] = (t[d, 0, some & _U(255)] ^ t[d, 1, (some >> _U(8)) & _U(255)]
                      ^ t[d, 2, (some >> _U(16)) & _U(255)] ^ t[d, 3, some >> _U(24)])
        level += 1
    return crc


class Prefixes:
    """Running CRCs of a byte string; ``at(i)`` is the CRC-32 of its first ``i`` bytes."""

    def __init__(self, data: np.ndarray) -> None:
        lanes = max(1, -(-len(data) // _LANE))
        text = np.zeros(lanes * _LANE, np.uint8)
        text[:len(data)] = data
        steps = np.ascontiguousarray(text.reshape(lanes, _LANE).T)
        table = _byte_table()
        self._own = np.empty((_LANE + 1, lanes), _U)
        register = np.full(lanes, 0xFFFFFFFF, _U)
        self._own[0] = 0
        for i in range(_LANE):
            register = table[(register ^ steps[i]) & _U(255)] ^ (register >> _U(8))
            self._own[i + 1] = ~register
        # CRC of all that lies before each lane.
        whole = _shift_tables(1)[_LANE // _DIGIT].tolist()
        before, crc = [], 0
        for own in self._own[_LANE].tolist():
            before.append(crc)
            crc = (whole[0][crc & 255] ^ whole[1][crc >> 8 & 255] ^ whole[2][crc >> 16 & 255]
                   ^ whole[3][crc >> 24] ^ own)
        self._before = np.array(before, _U)

    def at(self, i: np.ndarray) -> np.ndarray:
        lane = np.minimum(i // _LANE, len(self._before) - 1)
        within = i - lane * _LANE
        return self._own[within, lane] ^ shift(self._before[lane], within)


def _normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words with one space after each: bytes, first and end byte of each word, and the
    number of words before each text."""
    low = _LOWER[data]
    inside = _WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    start = np.flatnonzero(first)
    held = np.flatnonzero(inside)
    word = np.cumsum(first)[held] - 1
    length = np.bincount(word, minlength=len(start))
    out = np.full(len(held) + len(start), 32, np.uint8)
    out[np.arange(len(held)) + word] = low[held]
    new = np.cumsum(length + 1) - (length + 1)
    return out, new, new + length, np.searchsorted(start, at)


def run_crcs(texts: pa.Array, longest: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By blocks of texts: first row, words of each text, and for each length of runs from 1 to
    ``longest`` the CRC-32 of every run of so many words and the number of runs of each text.

    Runs lie in text order. NULL counts as an empty text; whole texts are read at any length.
    """
    for first, data, at in blocks(texts):
        joined, start, end, cut = _normalised(data, at)
        words = np.diff(cut)
        prefixes = Prefixes(joined)
        opened, closed = prefixes.at(start), prefixes.at(end)
        text = np.repeat(np.arange(len(words)), words)
        found = []
        for n in range(1, longest + 1):
            i = np.arange(max(len(start) - n + 1, 0))
            i = i[text[i] == text[i + n - 1]]
            crc = closed[i + n - 1] ^ shift(opened[i], end[i + n - 1] - start[i])
            found.append((crc, np.maximum(words - n + 1, 0)))
        yield first, words, found
