"""Cross-tokenizer alignment by products of token-byte incidence matrices (operator 13).

Two public tokenizers cut the same bytes into tokens A and B. The incidence of tokens with bytes is kept in CSR form, built by
hand with numpy; rows of the product A B' (each row of A gathers the rows of B' that its columns name) are the links between
tokens: with all bytes of a token those that overlap, with its last byte those that end together, and with the group between
two common ends those that share a group. The query's links are those that end together.

Neither tokenizer joins a character to a blank after it, so a text's tokens are those of its chunks, which begin at single
blanks between other characters. What a chunk gives is worked out once, for many chunks together, and remembered until a worker
has CACHE chunks; tests compare it with whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, scratch, written
from .kernel import blocks
from .tokens import spread

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a worker remembers before it forgets them all; bytes of text handled at once; ids of B, for the code a * WIDTH + b of a pair.
CACHE, BYTES, WIDTH = 150_000, 1_000_000, 1 << 20
#: Rows of an Arrow batch, which may hold long texts and their links.
ROWS = 1000
#: Pairs whose counts are broadcast (20 bytes each); beyond, the links are joined to the counts. Pairs a task holds.
PAIRS, HELD = 2_000_000, 1_000_000
#: A chunk begins at a blank between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Csr:
    """Row i has the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @classmethod
    def of(cls, first: np.ndarray, size: np.ndarray, columns: int) -> Csr:
        """Rows of runs of columns."""
        return cls(np.r_[0, np.cumsum(size)], spread(first, size), columns)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.r_[0, np.cumsum(np.bincount(self.indices, minlength=self.columns))], row[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the product's entries, by rows: each row gathers other's rows of its columns and adds up
        equal columns."""
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        size = np.diff(other.indptr)[self.indices]
        code = np.repeat(row, size) * other.columns + other.indices[spread(other.indptr[self.indices], size)]
        code, value = np.unique(code, return_counts=True)
        return code // max(other.columns, 1), code % max(other.columns, 1), value


def common_ends(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The places in bytes where tokens of both end; a_end and b_end rise."""
    return np.intersect1d(a_end, b_end)


def links(a_end: np.ndarray, b_end: np.ndarray, total: int, kind: str = "end") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, shared columns) of all linked pairs of tokens that end at a_end and b_end of total bytes. kind:
    "overlap" links tokens with a byte in common, "end" those with the last byte in common, "group" those of one group."""
    a_size, b_size = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
    if kind == "overlap":
        a, b = Csr.of(a_end - a_size, a_size, total), Csr.of(b_end - b_size, b_size, total)
    elif kind == "end":
        a, b = Csr.of(a_end - 1, np.ones(len(a_end), np.int64), total), Csr.of(b_end - 1, np.ones(len(b_end), np.int64), total)
    else:
        ends = common_ends(a_end, b_end)
        a, b = (Csr.of(np.searchsorted(ends, e), np.ones(len(e), np.int64), len(ends)) for e in (a_end, b_end))
    return a.times(b.transposed())


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. n - 1 one after another, and where each number's stand and how many."""
    text = [b"%d" % i for i in range(n)]
    size = np.array([len(x) for x in text], np.int64)
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size


class Aligner:
    """The two tokenizers, the bytes of their ids, and what chunks gave. known has the place of a chunk; of those, at hand are its
    groups as text, whether both tokenizers give its bytes back, n_a, n_b, and the codes of its linked pairs in store."""

    def __init__(self, a_path: str | None, b_path: str | None, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or default_path(A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or default_path(B_FILE))
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        # A chunk's first blank must never follow another character inside a piece.
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        self.digits = decimals(max(len(self.a_bytes), len(self.b_bytes)))
        self.cache = cache
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.whole, self.store = np.zeros(0, bool), np.zeros(0, np.int64)
        self.n_a, self.n_b, self.first, self.size = (np.zeros(0, np.int64) for _ in range(4))

    def chunks(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    @staticmethod
    def given_back(ids: np.ndarray, n: np.ndarray, flat: np.ndarray, sizes: np.ndarray, want: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the n ids of each chunk have the bytes that want has for it."""
        row = np.repeat(np.arange(len(n)), n)
        own = np.bincount(row, weights=sizes[ids], minlength=len(n)).astype(np.int64)
        same = own == lengths
        first = np.cumsum(sizes) - sizes
        of = ids[same[row]]
        got = flat[spread(first[of], sizes[of])]
        chunk = np.repeat(np.flatnonzero(same), lengths[same])
        wrong = got != want[np.repeat(same, lengths)]
        same[chunk[wrong]] = False
        return same

    def text_of(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all tokens as text, each with a ";" at its end, and where each group's text ends. a_group, b_group: the
        group of each token, from 0 on without gaps."""
        n = int(a_group[-1]) + 1 if len(a_group) else 0
        of_a, of_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        # A group's tokens of A, then those of B; each with the mark that follows it.
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[a_group]
        at_b = np.arange(len(b)) + np.cumsum(of_a)[b_group]
        ids[at_a], ids[at_b] = a, b
        ends = np.cumsum(of_a + of_b)
        mark[ends - 1], mark[ends - of_b - 1] = ord(";"), ord("|")
        data, first, size = self.digits
        length = size[ids]
        out = np.repeat(mark, length + 1)
        stop = np.cumsum(length + 1)
        out[spread(stop - 1 - length, length)] = data[spread(first[ids], length)]
        return out, stop[ends - 1] if n else ends

    def learn(self, chunks: list[str]) -> None:
        """Aligns new chunks, each of which stands after a blank, all at once."""
        texts = [" " + c for c in chunks]
        of_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        of_b = self.b.encode(chunks, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, of), np.int64, len(of)) for of in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(of), np.int64, int(n.sum())) for of, n in ((of_a, n_a), (of_b, n_b)))
        coded = [t.encode() for t in texts]
        lengths, want = np.fromiter(map(len, coded), np.int64, len(coded)), np.frombuffer(b"".join(coded), np.uint8)
        whole = self.given_back(a, n_a, self.a_flat, self.a_size, want, lengths) & self.given_back(b, n_b, self.b_flat, self.b_size, want, lengths)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
        # All chunks stand one after another; each ends both a token of A and of B, so none is linked with another chunk's.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ta, tb, _ = links(a_end, b_end, int(a_end[-1]) if len(a_end) else 0, "end")
        size = np.diff(np.searchsorted(ta, np.r_[0, np.cumsum(n_a)]))
        data, stop = self.text_of(a, b, np.searchsorted(ta, np.arange(len(a))), np.searchsorted(tb, np.arange(len(b))))
        last = np.r_[0, stop][np.cumsum(size)]
        data, ends = data.tobytes(), last.tolist()
        self.groups += [data[p : max(q - 1, p)] for p, q in zip([0, *ends[:-1]], ends, strict=True)]
        base = len(self.known)
        self.known.update((c, base + i) for i, c in enumerate(chunks))
        self.first = np.r_[self.first, len(self.store) + np.cumsum(size) - size]
        self.store = np.r_[self.store, a[ta] * WIDTH + b[tb]]
        self.whole, self.n_a, self.n_b, self.size = np.r_[self.whole, whole], np.r_[self.n_a, n_a], np.r_[self.n_b, n_b], np.r_[self.size, size]

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest of the groups, codes one after another, links, n_a, n_b) of the texts; those without tokens have none."""
        if len(self.known) > self.cache:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        new = list({c for x in cut for c in x if c not in self.known})
        for first in range(0, len(new), 20_000):
            self.learn(new[first : first + 20_000])
        place = list(map(self.known.__getitem__, chain.from_iterable(cut)))
        at, row = np.array(place, np.int64), np.repeat(np.arange(len(cut)), n)
        good = (np.bincount(row[~self.whole[at]], minlength=len(cut)) == 0) & (n > 0)
        total = lambda x: np.bincount(row, weights=x[at], minlength=len(cut)).astype(np.int64) * good
        used = at[good[row]]
        codes = self.store[spread(self.first[used], self.size[used])]
        ends = np.cumsum(n).tolist()
        digests = [hashlib.sha256(b";".join([self.groups[i] for i in place[q - k : q]])).hexdigest() if ok else "" for q, k, ok in zip(ends, n.tolist(), good.tolist(), strict=True)]
        return digests, codes, total(self.size), total(self.n_a), total(self.n_b)


@lru_cache(maxsize=1)
def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


#: A row for each text, and rows with the counts of pairs (code, n), which have no row number.
FIELDS = "row long, doc_id {id}, n_a long, n_b long, n_links long, groups_sha256 string, codes array<long>, counts array<long>"
NAMES = ["row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "codes", "counts"]


def align(batches: Iterator[pa.RecordBatch], a_path: str | None, b_path: str | None) -> Iterator[pa.RecordBatch]:
    """Rows as FIELDS says: the texts with the codes of their links, and sums of pairs over blocks of texts."""
    tool = aligner(a_path, b_path)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = pa.list_(pa.int64())

    def sums() -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return code, np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

    def counts(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        code, n = sums()
        for a in range(0, len(code), 50_000):
            c, m = code[a : a + 50_000], n[a : a + 50_000]
            none = [pa.nulls(1, t) for t in (pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([c], kinds), pa.array([m], kinds)], NAMES)

    id_type = None
    for batch in batches:
        id_type = batch.column("doc_id").type
        for b in blocks(batch, "text", BYTES):
            digests, codes, size, n_a, n_b = tool.texts(b.column("text").to_pylist())
            of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(codes))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(size), pa.array(digests, pa.string()), of, pa.nulls(len(b), kinds)], NAMES)
            held.append(np.unique(codes, return_counts=True))
            if sum(len(x[0]) for x in held) > HELD:
                held = [sums()]
                if len(held[0][0]) > HELD // 2:
                    yield from counts(id_type)
                    held = []
    if held:
        yield from counts(id_type)
    # A worker lives on with other work.
    tool.forget()


def looked_up(batches: Iterator[pa.RecordBatch], pairs: Broadcast) -> Iterator[pa.RecordBatch]:
    """The texts with n_best and count_sum, from the counts of all pairs, in place of their codes."""
    code, n, best = pairs.value
    for batch in batches:
        lists = batch.column("codes")
        off = lists.offsets.to_numpy().astype(np.int64)
        at = np.searchsorted(code, lists.flatten().to_numpy(zero_copy_only=False))
        sums = [pa.array(np.diff(np.r_[0, np.cumsum(x[at])][off - off[0]])) for x in (best, n)]
        columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_links")] + [*sums, batch.column("groups_sha256")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, pairs_sent: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Tokens of A are those of blank + text, tokens of B those of the text; links are the pairs that end together, one for each
    group. Null and empty texts, and those whose bytes one tokenizer does not give back, have zeros and ''. Repeated rows have
    rows of their own and count each; null ids stay null; other columns are left out.
    """
    spark = docs.sparkSession
    with scratch(spark), arrow_rows(spark, ROWS):
        slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        kind = slim.schema["doc_id"].dataType.simpleString()
        done = written(slim.mapInArrow(partial(align, a_path=a_path, b_path=b_path), FIELDS.format(id=kind)), "aligned")
        counts = done.where("row is null").select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("n"))
        b_id = F.pmod(F.col("code"), F.lit(WIDTH))
        counts = written(counts.withColumn("b", b_id), "pair-counts")
        # At most one row for each id of B.
        top = counts.groupBy("b").agg(F.max("n").alias("most"))
        pairs = written(counts.join(top, "b").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")
        texts = done.where("row is not null")
        if pairs.count() <= pairs_sent:
            rows = pairs.orderBy("code").toArrow()
            sent = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("code", "n", "best")))
            found = texts.select("row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "codes").mapInArrow(partial(looked_up, pairs=sent), f"doc_id {kind}, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string")
        else:
            each = texts.select("row", F.explode("codes").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
            sums = each.join(pairs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
            found = texts.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
        return written(found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"), "alignment", kept=True)
