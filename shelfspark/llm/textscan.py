"""Vectorised scans of UTF-8 text: words, lines and rolling hashes on numpy arrays.

Texts come as Arrow string arrays and are never turned into Python strings.
Work is cut into slices of whole documents, about ``SLICE`` bytes each, so the
memory of a worker does not depend on the size of an Arrow batch; one longer
document is a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the table is kept up to slice size."""
    key = str(base)
    have = _tables.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, _U(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE:
            _tables[key] = have
    return have[:n]


def rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix sums H with which ``span_hash`` gives the hash of any span of ``codes``."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hash(H: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of [start, end)."""
    inverse = powers(len(H), BASE_INV)
    return mix((H[end] - H[start]) * inverse[start] + (end - start).astype(np.uint64))


class Slice:
    """Bytes of some whole documents: ``buf``, and ``offs`` with each document's bounds."""

    __slots__ = ("buf", "first", "offs")

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs = first, buf, offs

    @property
    def n(self) -> int:
        return len(self.offs) - 1


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Cut an Arrow column of strings or bytes into slices; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Slice(at, buf[offs[at] : offs[end]], (offs[at : end + 1] - offs[at]).astype(np.int64))
        at = end


def byte_class(pattern: str) -> np.ndarray:
    """A 256-entry table: ``space`` marks what is not [\\x20\\x09-\\x0D], ``alnum`` digits, letters and bytes from 0x80."""
    out = np.zeros(256, dtype=bool)
    if pattern == "space":
        out[:] = True
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            out[a:b] = True
    return out


SPACED, ALNUM = byte_class("space"), byte_class("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a slice: byte bounds, document index, hash, and each document's first word."""

    __slots__ = ("doc", "end", "first", "hash", "start")

    def __init__(self, s: Slice, kind: np.ndarray, fold: bool, H: np.ndarray | None = None):
        buf = s.buf
        inside = np.zeros(len(buf) + 2, dtype=bool)
        inside[1:-1] = kind[buf]
        edge = inside[1:] != inside[:-1]
        starts = np.flatnonzero(edge[:-1] & inside[1:-1])
        ends = np.flatnonzero(edge[1:] & inside[1:-1]) + 1
        cut = s.offs[1:-1]  # a word that would run on into the next document
        cut = np.unique(cut[(cut > 0) & (cut < len(buf))])
        cut = cut[inside[cut] & inside[cut + 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        if H is None:
            H = rolling(BYTE[LOWER[buf] if fold else buf])
        self.start, self.end = starts, ends
        self.hash = span_hash(H, starts, ends)
        self.first = np.searchsorted(starts, s.offs)
        self.doc = np.repeat(np.arange(s.n), np.diff(self.first))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of k words inside one document."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _U(BASE) + words.hash[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 : k - 1 + n])
    return at, mix(h[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """A mask of the entries whose key occurs at least twice."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
