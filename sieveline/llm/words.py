"""Words, lines and word windows of a whole Arrow column at once, as numpy operations on its UTF-8 bytes.

A word is a maximal run without space and \\x09-\\x0D. Nothing here looks at rows one by one, so the cost per
byte does not depend on how the text is cut into documents. Hashes are 64 bits wide, fixed by constants of this
module (no per-process seed), and mixed, so that every worker of a cluster gives a word the same number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes handled at once; numpy needs about 40 bytes of memory for each of them.
SLICE = 1 << 16

_TABLE = np.random.Generator(np.random.PCG64(5)).integers(1 << 62, 1 << 64, 256, dtype=np.uint64)
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, a bijection of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return buf, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(offs: np.ndarray, most: int = SLICE):
    """Runs (i, j) of rows with at most so many bytes; a longer row is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def each_slice(column: pa.Array, most: int = SLICE):
    """(first row, buf, offs) of each slice of a column."""
    buf, offs = utf8(column)
    for i, j in slices(offs, most):
        yield i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes; a run never crosses the end of a row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
    after = np.ones(n, bool)
    np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[buf], offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-empty lines, cut at \\n."""
    return runs(buf != 10, offs)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 2 * SLICE) -> np.ndarray:
    """64 bits for each span of bytes, equal for equal bytes. Spans are ordered and don't overlap."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        lo, part = starts[i], buf[starts[i] : ends[j - 1]]
        power, inverse = _power(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_TABLE[part] * power[:-1], out=total[1:])
            out[i:j] = mix((total[ends[i:j] - lo] - total[starts[i:j] - lo]) * inverse[starts[i:j] - lo] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def grams(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words and the positions of their first words; windows stay within a row."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = word[:n].copy()
        for j in range(1, k):
            total *= _GRAM
            total += word[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return mix(total[at]), at


def repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each key, whether its row has it more than once."""
    with np.errstate(over="ignore"):
        own = mix(keys ^ (row.astype(np.uint64) * np.uint64(_BASE)))
    order = np.sort(own)
    found = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(found, own), len(found) - 1) if len(found) < 64 else None
    return found[at] == own if at is not None else np.isin(own, found)


def distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The number of different keys in each row."""
    if not len(keys):
        return np.zeros(rows, np.int64)
    with np.errstate(over="ignore"):
        own = mix(keys ^ (row.astype(np.uint64) * np.uint64(_BASE)))
    order = np.argsort(own)
    own = own[order]
    return np.bincount(row[order[np.concatenate([[True], own[1:] != own[:-1]])]], minlength=rows)


def per_row_all(buf: np.ndarray, offs: np.ndarray, classes: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """How many bytes of each row are in each of the classes (flags of the 256 bytes)."""
    out: list[np.ndarray] = []
    wide = 21 if len(buf) < 1 << 21 else 63  # three running sums fit into one of 64 bits if the slice is short
    for i in range(0, len(classes), 63 // wide):
        some = classes[i : i + 63 // wide]
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(sum(c.astype(np.int64) << (wide * k) for k, c in enumerate(some))[buf], out=total[1:])
        of = total[offs[1:]] - total[offs[:-1]]
        out += [(of >> (wide * k)) & ((1 << wide) - 1) for k in range(len(some))]
    return out
