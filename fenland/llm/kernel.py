"""Vectorised numpy text kernel: words and their 64-bit hashes for a block of texts, without Python objects per word.

Words are the runs of bytes outside x20 and x09-x0D; A-Z are lower-cased. A word's hash is a polynomial over its bytes
modulo 2**64, mixed; shingle hashes combine word hashes by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled at once.
BLOCK = 800_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), BASE, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about limit bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    c = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = c.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(column: pa.Array, separators: np.ndarray = SPACE, hashed: np.ndarray = LOWER) -> dict[str, np.ndarray]:
    """Row, start, end and hash of each word of a string column, and its bytes and offsets.

    separators is a table of bytes, hashed the byte that stands for each one in the hash.
    """
    data, off = raw(column)
    n = len(data)
    solid = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    gap = np.ones(n + 1, bool)
    gap[1:] = ~solid
    start = np.flatnonzero(solid & (gap[:-1] | first[:-1]))
    nxt = np.ones(n, bool)
    nxt[: n - 1] = ~solid[1:] | first[1:n]
    end = np.flatnonzero(solid & nxt) + 1
    out = {"row": np.searchsorted(off, start, "right") - 1, "start": start, "end": end, "bytes": data, "offsets": off}
    if not len(start):
        return out | {"hash": np.zeros(0, U)}
    size = end - start
    at = np.flatnonzero(solid)
    power = powers(int(size.max()))
    head = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=head[1:])
    term = (hashed[data[at]].astype(U) + U(1)) * power[np.arange(len(at)) - np.repeat(head, size)]
    return out | {"hash": mix(np.add.reduceat(term, head) + size.astype(U))}


def shingles(w: dict[str, np.ndarray], rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes, distinct and sorted within a row, of the k-word shingles; a row of 1 to k-1 words has one of them all."""
    row, h = w["row"], w["hash"]
    n = len(h)
    count = np.bincount(row, minlength=rows)
    full = max(n - k + 1, 0)
    s = np.full(full, k, U)
    for j in range(k):
        s += mix(h[j : j + full] + U(j + 1)) * U(2 * j + 3)
    keep = row[:full] == row[k - 1 : k - 1 + full] if full else np.zeros(0, bool)
    of, s = row[:full][keep], mix(s[keep])
    if len(few := np.flatnonzero(np.isin(row, np.flatnonzero((count > 0) & (count < k))))):
        r = row[few]
        at = few - np.searchsorted(row, r)
        term = mix(h[few] + U(1) + at.astype(U)) * (U(2) * at.astype(U) + U(3))
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        of = np.r_[of, r[head]]
        s = np.r_[s, mix(np.add.reduceat(term, head) + count[r[head]].astype(U))]
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (of[1:] != of[:-1]) | (s[1:] != s[:-1])
    return of[new], s[new]


def heads(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def squeezed(*columns: np.ndarray) -> bytes:
    """Numbers by planes, the first bytes of all, then the second ones and so on: those of small numbers compress to nothing."""
    return pa.compress(b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def opened(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    """The columns of n numbers each that squeezed was given."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd"), np.uint8)
    ends = np.cumsum([0, *sizes]) * n
    return [np.ascontiguousarray(flat[a:b].reshape(size, n).T).view(k).ravel() for a, b, size, k in zip(ends[:-1], ends[1:], sizes, kinds, strict=True)]
