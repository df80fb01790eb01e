"""Numpy helpers that run inside tasks: words and shingles of a whole Arrow batch at once.

Word hashes are polynomial hashes over the bytes modulo 2**64, taken from one
prefix sum per segment, so no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
#: space and \t \n \v \f \r
WHITE = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (shifts and odd multipliers), on a copy."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_EXACT = _stream(11, 256)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_COEF = _stream(23, 64) | np.uint64(1)
_LENGTH = _stream(37, 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def parts(batches: Iterator[pa.RecordBatch], text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most `size` bytes of text, or one longer row."""
    for batch in batches:
        _, offs = utf8(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    data, offs = utf8(col)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def _hash_segment(seg: np.ndarray, docs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a segment; a word never crosses the start of a document."""
    first = np.zeros(len(seg), bool)
    first[docs[docs < len(seg)]] = True
    space = _SPACE[seg]
    begin = ~space
    end = begin.copy()
    begin[1:] &= space[:-1] | first[1:]
    end[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(seg) + 1)
    acc = np.zeros(len(seg) + 1, np.uint64)
    np.cumsum(table[seg] * down[: len(seg)], out=acc[1:])
    return starts, mix((acc[ends] - acc[starts]) * up[starts] + np.uint64(1))


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` and, per document, the range of its words. `fold` lower-cases A-Z."""
    table = _FOLDED if fold else _EXACT
    hashes: list[np.ndarray] = []
    bounds = np.zeros(len(offs), np.int64)
    total, i, n = 0, 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SEGMENT, side="right")) - 1)
        lo, hi = int(offs[i]), int(offs[j])
        if hi - lo <= SEGMENT:
            starts, h = _hash_segment(data[lo:hi], offs[i:j] - lo, table)
            bounds[i + 1 : j + 1] = total + np.searchsorted(starts, offs[i + 1 : j + 1] - lo)
            hashes.append(h)
            total += len(h)
        else:  # one long document, in pieces that end at white space
            at = lo
            while at < hi:
                to = min(hi, at + SEGMENT)
                while to < hi:
                    gap = np.flatnonzero(_SPACE[data[at:to]])
                    if len(gap):
                        to = at + int(gap[-1]) + 1
                        break
                    to = min(hi, to + SEGMENT)
                _, h = _hash_segment(data[at:to], np.zeros(1, np.int64), table)
                hashes.append(h)
                total += len(h)
                at = to
            bounds[j] = total
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds


def word_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word, in the order of `word_hashes`."""
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    space = _SPACE[data]
    begin = ~space
    end = begin.copy()
    begin[1:] &= space[:-1] | edge[1:]
    end[:-1] &= space[1:] | edge[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, as if all were one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _COEF[0]
    for j in range(1, k):
        out += h[j : j + n] * _COEF[j]
    return mix(out + _LENGTH[k])


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; fewer words: the whole sequence as one; no words: empty."""
    every = windows(h, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix((h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64)[None] + _LENGTH[b - a])
        else:
            yield np.zeros(0, np.uint64)
