"""Packing by first-fit decreasing with a tournament tree, in randomised groups of document pieces (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import blocks
from .tokens import EOS, encoder

LENGTH = 4096
#: Documents of a group on average; groups are drawn by a hash, so their number follows the input and their size does not.
GROUP = 4000


class Bins:
    """Open bins in order of opening, with a tournament tree of their free space: the root knows the largest."""

    def __init__(self, most: int, capacity: int) -> None:
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.capacity, self.opened = capacity, 0
        self.free = [0] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset in it: the first bin with room, else a new one."""
        free, at = self.free, 1
        if free[1] >= size:
            while at < self.leaves:
                at *= 2
                if free[at] < size:
                    at += 1
        else:
            at = self.leaves + self.opened
            self.opened += 1
            free[at] = self.capacity
        offset = self.capacity - free[at]
        free[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best and at > 1 and offset:
                break
            free[at] = best
        return bin_, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (0 < size <= capacity); equal sizes go in the order given."""
    bins, at, offset = Bins(len(sizes), capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        at[i], offset[i] = bins.put(int(sizes[i]))
    return at, offset


def cut(batches: Iterator[pa.RecordBatch], path: str | None, length: int, groups: int, seed: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of at most length ids of each document, with a random group."""
    from xxhash import xxh64_intdigest

    encode, turn = encoder(path), 0
    for batch in batches:
        for b in blocks(batch, "text"):
            out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "ids")}
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode.ids(b.column("text"), EOS), strict=True):
                turn += 1  # parts repeated rows; the same after a retry, as the scan's order is
                for start in range(0, len(ids), 4 * length):
                    piece = ids[start : start + 4 * length]
                    crc = zlib.crc32(piece)
                    row = (doc, start // 4, len(piece) // 4, crc, len(ids) // 4, xxh64_intdigest(f"{doc}/{start}/{crc}/{turn}", seed) % groups, piece if keep_ids else None)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            kinds = (pa.int64(),) * 6 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def fill(table: pa.Table, length: int) -> pa.Table:
    # The largest first; equal ones in a fixed order, so that a retried task packs the same way.
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    at, offset = first_fit_decreasing(table.column("length").to_numpy(), length)
    group = table.column("grp").to_numpy()
    return table.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 32) + at)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, seed: int = 7, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    Each text's ids, then id 2, are cut into pieces of length and a rest; pieces are packed into sequences of at most length
    within their random group. Null and empty texts are the id 2 alone; null ids stay null; repeated rows are packed each.
    ids (little-endian unsigned 32-bit) is null without keep_ids. Columns besides the two named are left out.
    """
    groups = max(1, docs.count() // GROUP)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = slim.mapInArrow(partial(cut, path=path, length=length, groups=groups, seed=seed, keep_ids=keep_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, ids binary")

    def filled(table: pa.Table) -> pa.Table:
        return fill(table, length)

    return pieces.groupBy("grp").applyInArrow(filled, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, keep_ids=False).drop("ids")
