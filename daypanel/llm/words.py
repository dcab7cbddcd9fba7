"""Words of Arrow text columns as 64-bit hashes.

A word is a maximal run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, ASCII letters and everything from U+0080 on. The work is done on the UTF-8 bytes
of a batch with array operations; no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5  # words in a shingle

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xA0761D6478BD642F)


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for segments of up to ``size`` bytes."""
    if size not in _powers:
        _powers.clear()
        up = np.full(size + 1, _BASE, dtype=np.uint64)
        down = np.full(size + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def parts(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text makes a range of its own."""
    at, _ = utf8(texts)
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield begin, min(end, n)
        begin = end


class Words:
    """Words of some rows: hashes ``h``, byte spans ``starts``/``ends`` in ``data``, row bounds ``ptr``."""

    def __init__(self, texts: pa.Array):
        at, data = utf8(texts)
        self.rows, self.data, self.at = len(at) - 1, data, at
        inside = _IN_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[(at > 0) & (at < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, at)
        self.h = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        begin = 0
        while begin < len(out):
            base = self.starts[begin]
            end = max(begin + 1, int(np.searchsorted(self.ends, base + _SEGMENT, side="right")))
            s, e = self.starts[begin:end] - base, self.ends[begin:end] - base
            size = max(_SEGMENT, int(e[-1]))
            up, down = _power_table(size)
            run = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(_CODE[self.data[base : base + e[-1]]] * up[: e[-1]], out=run[1:])
            out[begin:end] = mixed((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
            begin = end
        return out

    def _run_hashes(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on, whichever rows they belong to."""
        run = np.zeros(max(0, len(self.h) - k + 1), np.uint64)
        for j in range(k):
            run = run * np.uint64(_BASE) + self.h[j : j + len(run)]
        return mixed(run + np.uint64(k))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first word of each run of ``k`` words inside a row, and the row bounds of these arrays."""
        where = np.flatnonzero(np.arange(len(self.h)) + k <= np.repeat(self.ptr[1:], np.diff(self.ptr)))
        return self._run_hashes(k)[where], where, np.searchsorted(where, self.ptr)

    def shingles(self, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``k`` words and their row bounds.

        A row of fewer words, but not none, has one shingle of all its words.
        """
        h, where, _ = self.runs(k)
        many = np.diff(self.ptr)
        for n in range(1, k):
            rows = np.flatnonzero(many == n)
            if len(rows):
                h = np.append(h, self._run_hashes(n)[self.ptr[rows]])
                where = np.append(where, self.ptr[rows])
        order = np.argsort(where, kind="stable")
        return h[order], np.searchsorted(where[order], self.ptr)

    def digests(self) -> list[bytes | None]:
        """128 bits per row that equal word sequences share; null for a row without words."""
        return [
            hashlib.blake2b(self.h[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(self.ptr[:-1], self.ptr[1:])
        ]
