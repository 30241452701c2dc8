"""Vectorised kernels over ragged byte batches.

A batch of texts is one flat uint8 array plus row offsets (as Arrow lays strings
out).  Words, word hashes, shingles and per-row reductions are numpy passes over
that array; no Python object is made per word.  Word classes in this package
only name ASCII separators, so working on UTF-8 bytes and on code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; one longer row forms a slice of its own.
SLICE_BYTES = 1 << 20
_ROOT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads every input bit over the word."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_CODES = _byte_codes()
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash root and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, root in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
                table = np.full(size, U64(root & _MASK), dtype=U64)
                table[0] = U64(1)
                _powers[name] = np.multiply.accumulate(table, dtype=U64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    at, rows = 0, len(offs) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


def parts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of a column."""
    data, offs = flat(column)
    for a, b in slices(offs, limit):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def byte_class(separators: str) -> np.ndarray:
    """Boolean table of the bytes that are no separator; `separators`: inclusive ranges as pairs of characters."""
    table = np.ones(256, bool)
    for low, high in zip(separators[::2], separators[1::2], strict=True):
        table[ord(low) : ord(high) + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class("\x20\x20\x09\x0d")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = byte_class("\x00\x2f\x3a\x60\x7b\x7f")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class: (starts, ends, first run of each row and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes give equal hashes everywhere."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=U64, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of fewer words, but not none, gives its whole sequence.

    Rows come in order; shingles of a row in text order.
    """
    n = np.diff(first)
    with np.errstate(over="ignore"):
        c = U64(0x9FB21C651E98DF25)
        size = len(words) - k + 1
        if size > 0:
            h = words[:size].copy()
            for j in range(1, k):
                h = h * c + words[j : j + size]
            h = mix(h + U64(k))
        else:
            h = np.zeros(0, U64)
        row_of = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
        at = np.arange(len(row_of)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0))
        h = h[first[row_of] + at] if len(row_of) else np.zeros(0, U64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = []
            for r in short:
                x = words[first[r]]
                for j in range(first[r] + 1, first[r + 1]):
                    x = x * c + words[j]
                extra.append(x + U64(n[r]))
            h = np.concatenate([h, mix(np.array(extra, U64))])
            row_of = np.concatenate([row_of, short])
            order = np.argsort(row_of, kind="stable")
            h, row_of = h[order], row_of[order]
    return h, row_of


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for every row, empty rows 0; exact for integers."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
