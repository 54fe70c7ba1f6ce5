"""Token ids of whole texts by a public tokenizer file, with a bounded cache of blank-separated chunks.

The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks one after another. A
test compares this with encoding whole texts. Chunks are told apart by 64 bits of hash, as words are in the other operators;
those of a block are looked up and put together on arrays.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernel import LOWER, U, raw, words

EOS = 2
#: Chunks that a worker remembers, about 30 bytes each, and the longest one it does.
CACHE, CHUNK = 2_500_000, 48
#: Punctuation that the tokenizer keeps apart between blanks, as one id, and that no other character turns into.
MARK = "|"
#: Bytes as they stand: upper and lower case differ, as letters with marks need not fold alike.
AS_IS = np.arange(256, dtype=np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, as the tokenizer has them, where no mark on a letter and no name of a special token can differ."""
    data, offsets = raw(column)
    plain = pc.and_(pc.string_is_ascii(column), pc.invert(pc.match_substring(column, "<|"))).fill_null(True).to_numpy(zero_copy_only=False)
    data = np.where(np.repeat(plain, np.diff(offsets)), LOWER[data], data)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(data))


class Encoder:
    """known, first, size: sorted hashes of the remembered chunks and where their ids stand in store; used: met again."""

    def __init__(self, path: str | None, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path or default_path()), cache
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known, self.first, self.size, self.used = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.store, self.filled = np.zeros(1 << 16, np.uint32), 0

    def of_chunks(self, chunks: list[str], alone: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many of each chunk. Those of chunks are encoded many at once, with the mark after
        each, and cut at its id; those that have the mark in them are given in alone."""
        many = [f" {MARK} ".join(chunks[i : i + 200]) + f" {MARK}" for i in range(0, len(chunks), 200)]
        ids, size = array("I"), array("q")
        for x in self.tokenizer.encode_batch_fast(many, add_special_tokens=False):
            ids.extend(x.ids)
        ids = np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(chunks):
            raise ValueError("the tokenizer does not keep the mark apart")
        last = array("I")
        for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            last.extend(of := x.ids)
            size.append(len(of))
        return np.r_[np.delete(ids, marks), np.asarray(last, np.uint32)], np.r_[np.diff(marks, prepend=-1) - 1, np.asarray(size, np.int64)]

    def sweep(self) -> None:
        """Only chunks met again since the last sweep stay."""
        kept = np.flatnonzero(self.used)
        size = self.size[kept].astype(np.int64)
        ids = self.store[spread(self.first[kept], size)]
        self.known, self.size, self.used = self.known[kept], self.size[kept], np.zeros(len(kept), bool)
        self.first, self.store, self.filled = np.cumsum(size) - size, np.r_[ids, np.zeros(1 << 16, np.uint32)], len(ids)

    def places(self, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word stand in store, and how many; new chunks are encoded and stored."""
        if len(self.known) > self.cache:
            self.sweep()
        key, example, at = np.unique(w["hash"], return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, key)
        hit = np.zeros(len(key), bool)
        inside = place < len(self.known)
        hit[inside] = self.known[place[inside]] == key[inside]
        self.used[place[hit]] = True
        first, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        first[hit], size[hit] = self.first[place[hit]], self.size[place[hit]]
        new = np.flatnonzero(~hit)
        start, end = w["start"][example[new]], w["end"][example[new]]
        data = w["bytes"].tobytes() if len(new) else b""
        text = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        # Long chunks and those with the mark stand last, where the next block writes over them.
        marked = np.asarray([MARK.encode() in x for x in text], bool)
        order = np.argsort(2 * marked + (~marked & (end - start > CHUNK)), kind="stable")
        new, text, n = new[order], [text[i].decode() for i in order.tolist()], int((~marked).sum())
        short = int((~marked & (end - start <= CHUNK)).sum())
        ids, size[new] = self.of_chunks(text[:n], text[n:])
        first[new] = self.filled + np.cumsum(size[new]) - size[new]
        if self.filled + len(ids) > len(self.store):
            self.store = np.r_[self.store, np.zeros(max(len(self.store) // 2, len(ids)), np.uint32)]
        self.store[self.filled : self.filled + len(ids)] = ids
        new = np.sort(new[:short])
        self.filled += int(size[new].sum())
        place = place[new]
        self.known, self.first, self.size = np.insert(self.known, place, key[new]), np.insert(self.first, place, first[new]), np.insert(self.size, place, size[new])
        self.used = np.insert(self.used, place, False)
        return first[at], size[at]

    def encoded(self, column: pa.Array, eos: int | None = EOS) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with eos at its end, and the n + 1 offsets of the texts; null is an empty text."""
        w = words(folded(column), hashed=AS_IS)
        first, size = self.places(w)
        ids = self.store[spread(first, size)]
        ends = 0 if eos is None else 1
        of = np.bincount(w["row"], weights=size, minlength=len(column)).astype(np.int64) + ends
        offsets = np.r_[0, np.cumsum(of)]
        if ends:
            out = np.full(int(offsets[-1]), eos, np.uint32)
            out[np.arange(len(ids)) + np.repeat(w["row"], size)] = ids
            ids = out
        return ids, offsets

    def ids(self, column: pa.Array, eos: int | None = EOS) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit."""
        ids, offsets = self.encoded(column, eos)
        data, at = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first .. first + size - 1 of each pair, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
