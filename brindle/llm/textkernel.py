"""Words and shingles of whole Arrow string columns, as numpy arrays.

Works on the bytes of a column: no Python string is made. Texts of any length pass in
blocks of a quarter megabyte, so memory follows the number of words and not eight bytes a
character.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {}

#: Bytes that end a word: blank and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A to Z as a to z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def tidy(run):
    """A function over Arrow batches that gives freed memory back to the system after each partition.

    Python workers outlive their tasks; what their allocators keep would add up beside the
    executor's heap.
    """

    @functools.wraps(run)
    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library, which has its own ways

    return go


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK + 1), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 4 * BLOCK:
            _powers[int(base)] = table
    return table


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words; first[i] is the number of words before text i."""
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    finish[tails] = inside[tails]
    if len(data):
        finish[-1] = inside[-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes after fold."""
    out = np.empty(len(starts), np.uint64)
    at, values = 0, _BYTE_VALUES[fold]
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[to - 1]
        n = int(high - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _power_table(MULTIPLIER, n + 1)[:n], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * _power_table(INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all runs of width words; a text of fewer words, but some, has its whole run as the only one."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    k = np.uint64(0xD1B54A32D192ED03)
    if len(words) >= width:
        whole = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            whole *= k
            whole += words[j : j + len(whole)]
        whole = mix(whole + np.uint64(width))
        where = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
        ok = where < len(whole)
        out[ok] = whole[where[ok]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.zeros(1, np.uint64)
        for w in words[first[i] : first[i + 1]]:
            h = h * k + w
        out[begin[i]] = mix(h + np.uint64(counts[i]))[0]
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repetition."""
    out = np.empty_like(values)
    ends = np.zeros(len(begin), np.int64)
    at = 0
    for i in range(len(begin) - 1):
        u = values[begin[i] : begin[i + 1]]
        if len(u):
            u = np.sort(u)
            u = u[np.concatenate(([True], u[1:] != u[:-1]))]
            out[at : at + len(u)] = u
            at += len(u)
        ends[i + 1] = at
    return out[:at].copy(), ends


def signatures(values: np.ndarray, begin: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """MinHash signatures, one row of size coordinates for each text; texts without values have a row of ones."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    turn = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    out = np.full((len(begin) - 1, size), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(np.diff(begin))
    step = 1 << 16
    while len(some):
        take = max(1, int(np.searchsorted(begin[some + 1], begin[some[0]] + step, "right")))
        rows, some = some[:take], some[take:]
        part = values[begin[rows[0]] : begin[rows[-1] + 1]]
        at = begin[rows] - begin[rows[0]]
        for k in range(size):
            out[rows, k] = np.minimum.reduceat((part ^ turn[k]) * factor[k], at)
    return out


def text_chunks(batches, text: str = "text", limit: int = 1 << 19):
    """Cuts record batches into pieces of about limit bytes of text; yields (piece, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
