"""N-gram Jaccard join by PartEnum signatures (operator 4).

Two sets of sizes a and b with Jaccard similarity of at least 3/4 differ in at most (a + b) / 7 elements. Sets are put
into size bands [L, 2L) with L a power of two; a band's scheme also takes the sets up to 2L * 4/3, so that two linked
sets meet in a scheme. A scheme cuts the hashed feature domain into partitions and enumerates subsets of them:

* L < SMALL: PartEnum with two levels, n2 = 3 partitions in each of n1 groups and k2 = 1: of n1 > k // 2 groups one at
  least has a single difference, so one of its three 2-subsets of partitions agrees. d differences spoil at most
  min(2 d, n1 + d) of the 3 n1 subsets.
* L >= SMALL: the subsets are single partitions (n2 = k2 + 1), of which d differences spoil at most d.

If at most x subsets can be spoilt, the first x + 1 in any order that all sets share are enough (pigeonhole): the first one
that two linked sets have in common is among them in both. The order puts subsets with rare features first, so that passages
which many texts share seldom make a group, and void ones last, which would be one hot key. What is rare is estimated on the
features of about ORDERED texts; the estimate decides the order alone, so no link depends on it.
Sets are keyed by a 64-bit digest, so equal sets are one node. The sets of a signature are paired while they are read if
they are at most HOT. The sets of larger groups (hot sets) enumerate subsets of the finest partition, that of single
features: two linked sets share enough features that, in any common order, an l-subset of the first features of both is
the same. The order puts features of few hot sets first, so that what many share seldom makes a subset. With l = 1, 2, ...
groups of a subset that are still large are tested as stars around leaders; the sets of those that keep different
components go on to l + 1, where only subsets that begin with an open one are made. Every member of a subset carries its
size and the largest size of a set that it can still be linked with; pairs beyond these are never made. A group is closed
when all that can be linked are in one component, or when the few rows outside its largest one have been compared with
all others. So no link between different texts is lost, no group is expanded into all its pairs, and a group is split
further as long as many of its rows are apart.

Nulls and empty texts have an empty set and are linked with nothing; null ids keep their row; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import arrow_rows, scratch, sized_join, text_key, written
from fenland.operators.graph import connected_components
from .kernel import U, blocks, heads, mix, shingles, words

SMALL = 64
HOT = 48
#: Leader rounds before the sets of groups that stay open go on to larger subsets.
ROUNDS = 4
#: After the first round a group is settled by comparing its rows outside the largest component with all others, if these are
#: at most STARS.
STARS = 256
#: What is known of a row of a large group.
END = ("node", "n", "reach", "comp")
#: Features in more than HOT hot sets whose counts are broadcast (16 bytes each), and open subsets broadcast at once; beyond,
#: only more frequent features are told apart, and open subsets are taken in several passes.
FREQUENT, OPEN = 1_000_000, 1_000_000
#: Texts whose features are counted for the order of signatures; they are counted if ORDERED_LEAST of these have them.
ORDERED, ORDERED_LEAST = 16_000, 3
#: Signature rows that a task sorts at once to take the excess of hot groups out.
SORTED = 1_000_000
#: Groups are closed by classes of sizes, each CLASS times the one before.
CLASS = 1.02
#: The bits of two sets' parities that differ are at most as many as the elements that do. Sets of LONG and more elements,
#: which fill the short parity, have one of LONG_PARITY bits too.
PARITY, LONG, LONG_PARITY = 512, 700, 8192
#: Sizes and parities are broadcast for at most so many nodes (about 100 bytes each).
WIDE_ROWS = 150_000
#: Rows that are handed to Python at once, which bounds the memory of a worker and of its executor.
BATCH = 2000
#: What a row is known by: its id and 128 bits of its text.
KEY = ("doc_id", "key1", "key2")


def linked(same, a, b):
    """100 * intersection >= 75 * union."""
    return 100 * same >= 75 * (a + b - same)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle rows and hashes of a block, and each row's set size and digest."""
    n = len(column)
    row, h = shingles(words(column), n)
    size = np.bincount(row, minlength=n)
    digest = np.zeros(n, U)
    if len(row):
        digest[row[heads(row)]] = mix(np.add.reduceat(mix(h ^ U(0x5DEECE66D)), heads(row)))
    return row, h, size, digest


def parity(row: np.ndarray, h: np.ndarray, n: int, width: int) -> pa.ListArray:
    """width bits of each set as longs: whether an odd number of its elements falls on the bit."""
    cell = row * width + (mix(h + U(77)) % U(width)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * width) & 1).astype(np.uint8)
    bits = np.packbits(odd.reshape(n, width), axis=1, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, width // 64, dtype=np.int32)), pa.array(bits.ravel()))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text"):
            row, h, size, digest = sets(b.column("text"))
            large = size >= LONG
            place = np.cumsum(large) - 1
            in_large = large[row]
            wide = parity(place[row[in_large]], h[in_large], int(large.sum()), LONG_PARITY)
            wide = wide.take(pa.array(place, mask=~large))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(size, pa.int64()), pa.array(digest.view(np.int64)), parity(row, h, len(size), PARITY), wide], [*KEY, "n_shingles", "node", "bits", "wide"])


def schemes(size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Sets (positions), L and the largest difference k to a linked set for each scheme that takes some of the sets."""
    known = np.flatnonzero(size)
    level = np.zeros(len(size), np.int64)
    level[known] = np.floor(np.log2(size[known])).astype(np.int64)
    for j in np.unique(np.r_[level[known], level[known] - 1]):
        if j < 0:
            continue
        low = 1 << int(j)
        core = known[level[known] == j]
        upper = known[(level[known] == j + 1) & (3 * size[known] < 4 * 2 * low)]
        own = np.r_[core, upper]
        most = np.r_[(size[core] + 4 * size[core] // 3) // 7, (size[upper] + 2 * low - 1) // 7]
        yield own, low, most


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Set (position) and signature. often: how frequent each feature is, the same for equal ones in all calls."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    often = np.zeros(len(h), np.int64) if often is None else often
    never = np.iinfo(np.int32).max
    for own, low, most in schemes(size):
        k = np.full(len(size), -1, np.int64)
        k[own] = most
        take = k[row] > 0  # with no difference allowed, linked sets are equal
        r, f = row[take], h[take]
        if not len(r):
            continue
        top = (2 * low + 4 * 2 * low // 3) // 7
        salt = U(low * 2654435761)
        n1 = top // 2 + 2 if low < SMALL else max(top + 2, 8 * low // 10)
        width = 3 * n1 if low < SMALL else n1
        cell = (mix(f + salt) % U(width)).astype(np.int64)
        order = np.argsort(r * width + cell, kind="stable")
        key, g = (r * width + cell)[order], mix(f[order] ^ U(0xD1B54A32D192ED03))
        at = heads(key)
        # A subset's place in the order is that of its rarest feature.
        cells, sums, rank = key[at], np.add.reduceat(g, at), np.minimum.reduceat(often[take][order], at)
        if low < SMALL:
            sets_here = np.unique(r)
            dense, rare = np.zeros((len(sets_here), n1, 3), U), np.full((len(sets_here), n1, 3), never)
            place = np.searchsorted(sets_here, cells // width)
            dense[place, (cells % width) // 3, cells % 3] = sums
            rare[place, (cells % width) // 3, cells % 3] = rank
            pairs = ((0, 1), (0, 2), (1, 2))
            sig = np.stack([mix(dense[:, :, x] + mix(dense[:, :, y] + U(x * 3 + y + 1))) for x, y in pairs], 2)
            sig = mix(sig + salt + np.arange(n1, dtype=U)[None, :, None] * U(0x9E3779B97F4A7C15) + np.arange(3, dtype=U)[None, None, :])
            rank = np.stack([np.minimum(rare[:, :, x], rare[:, :, y]) for x, y in pairs], 2)
            sig, rank = (x.reshape(len(sets_here), width) for x in (sig, rank))
            first = np.argsort(rank, axis=1, kind="stable")
            spoilt = np.minimum(2 * k[sets_here], n1 + k[sets_here])
            emit = np.arange(width) <= spoilt[:, None]
            out.append((np.broadcast_to(sets_here[:, None], sig.shape)[emit], np.take_along_axis(sig, first, 1)[emit]))
            continue
        of = cells // width
        sig = mix(sums + salt + (cells % width).astype(U) * U(0x9E3779B97F4A7C15))
        m = np.bincount(of, minlength=len(size))
        first = np.argsort(of * (int(rank.max()) + 1) + rank, kind="stable")
        emit = first[np.arange(len(of)) - np.searchsorted(of, of) <= k[of]]
        out.append((of[emit], sig[emit]))
        for s in np.unique(of[m[of] <= k[of]]):
            missing = np.setdiff1d(np.arange(n1), cells[of == s] % width)[: k[s] + 1 - m[s]].astype(U)
            out.append((np.full(len(missing), s), mix(salt + missing * U(0x9E3779B97F4A7C15))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Frequency:
    """Counts of listed features (sorted), 0 for others."""

    def __init__(self, listed: np.ndarray, count: np.ndarray) -> None:
        self.listed, self.n = listed, count
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.low(listed)] = True

    def low(self, h: np.ndarray) -> np.ndarray:
        return (h & U(len(self.maybe) - 1)).astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(self.maybe[self.low(h)])
        if len(some):
            at = np.minimum(np.searchsorted(self.listed, h[some]), len(self.listed) - 1)
            out[some] = np.where(self.listed[at] == h[some], self.n[at], 0)
        return out


class Dealer:
    """Rows (sig, node, ...) of a task, sorted and freed of repeated ones. Of a sig with more than HOT nodes here the first
    HOT + 1, which make its group known as hot, go to the group; the others are dealt at random, marked by another deal."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.parts, self.size = names, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > SORTED:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        sig, node = columns[:2]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        columns = [c[new] for c in columns]
        sig, node = columns[:2]
        at = heads(sig)
        rank = np.arange(len(sig)) - np.repeat(at, np.diff(np.r_[at, len(sig)]))
        away = np.where(rank > HOT, mix(node.view(U) + U(3)).view(np.int64), sig)
        for i in range(0, len(sig), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (away, *columns)], ["deal", *self.names])


def emit_signatures(batches: Iterator[pa.RecordBatch], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """deal, sig: the signature, or for a node of a hot group that is dealt at random another deal than sig; node."""
    often = Frequency(*frequent.value)
    rows = Dealer(["sig", "node"])
    for batch in batches:
        for b in blocks(batch, "text"):
            row, h, size, digest = sets(b.column("text"))
            copies = np.ones(len(size), bool)
            copies[np.unique(digest, return_index=True)[1]] = False
            size[copies] = 0  # the same node as one before it in this block
            of, sig = signatures(row, h, size, often.of(h))
            yield from rows.add(sig.view(np.int64), digest[of].view(np.int64))
    yield from rows.rest()


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): the pairs (a, b) of different nodes of each sig that has 2 to HOT of them, with sig null;
    (sig, a, n, reach) for each node of a larger one, with b null. Where rows have n and reach, only nodes that are within each
    other's reach are paired. Rows held: those of a batch and HOT + 1."""
    names = ["sig", "a", "b", "n", "reach"]
    columns: list[np.ndarray] = []
    hot = None  # the sig whose nodes are being sent one by one

    def large(rows: list[np.ndarray]) -> pa.RecordBatch:
        k = len(rows[0])
        more = [pa.array(c) for c in rows[2:]] or [pa.nulls(k, pa.int32())] * 2
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(k, pa.int64()), *more], names)

    def sent(rows: list[np.ndarray], long: bool) -> Iterator[pa.RecordBatch]:
        """long: the last run goes on and is large."""
        nonlocal hot
        s, n = rows[:2]
        at = heads(s)
        size = np.diff(np.r_[at, len(s)])
        big = (size > HOT) | (s[at] == hot) if hot is not None else size > HOT
        big[-1] |= long
        of_big = np.repeat(big, size)
        if of_big.any():
            yield large([c[of_big] for c in rows])
        hot = s[-1] if big[-1] else None
        pairs = [np.zeros((0, 2), np.int64)]
        for k in np.unique(size[~big]):
            if k > 1:
                block = at[~big & (size == k)][:, None] + np.arange(k)
                i, j = np.triu_indices(k, 1)
                x, y = block[:, i].ravel(), block[:, j].ravel()
                if len(rows) > 2:
                    ok = (rows[2][x] <= rows[3][y]) & (rows[2][y] <= rows[3][x])
                    x, y = x[ok], y[ok]
                pairs.append(np.stack([n[x], n[y]], 1))
        found = np.concatenate(pairs)
        if len(found):
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            new = np.r_[True, (found[1:] != found[:-1]).any(1)]
            k = int(new.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(found[new, 0]), pa.array(found[new, 1]), *[pa.nulls(k, pa.int32())] * 2], names)

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("deal", "sig", "node", "n", "reach") if c in batch.schema.names]
        away = rows[0] != rows[1]
        if away.any():
            yield large([c[away] for c in rows[1:]])
        rows = [c[~away] for c in rows[1:]]
        columns = [np.r_[x, y] for x, y in zip(columns, rows, strict=True)] if columns else rows
        if not len(columns[0]):
            continue
        sig, node = columns[:2]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        columns = [c[new] for c in columns]
        sig = columns[0]
        # The last run waits if it is short; of a long one the last row does, as the next batch may bring its double.
        tail = len(sig) - heads(sig)[-1]
        keep = tail if tail <= HOT and sig[-1] != hot else 1
        if len(sig) > keep:
            yield from sent([c[:-keep] for c in columns], keep < tail)
            columns = [c[-keep:] for c in columns]
    if columns and len(columns[0]):
        yield from sent(columns, False)


def meetings(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (a, b) that meet in small groups, and the rows (sig, node, n, reach) of large ones."""
    dealt = rows.repartition("deal").sortWithinPartitions("deal", "sig", "node")
    out = written(dealt.mapInArrow(met, "sig long, a long, b long, n int, reach int"), name)
    return out.where("b is not null").select("a", "b").distinct(), out.where("b is null").select("sig", F.col("a").alias("node"), "n", "reach")


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with their number of sets, added up over as many texts as SORTED features hold."""
    held, size = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])], ["feature", "n"])

    for batch in batches:
        for b in blocks(batch, "text"):
            held.append(sets(b.column("text"))[1])
            size += len(held[-1])
            if size > SORTED:
                yield from summed()
                held, size = [], 0
    if size:
        yield from summed()


def subset_key(before: np.ndarray | np.uint64, feature: np.ndarray) -> np.ndarray:
    """The key of a subset that goes on with a feature."""
    return mix(mix(feature ^ U(0xA0761D6478BD642F)) + before * U(3) + U(1))


def subsets(key: np.ndarray, n: int, opened: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the l-subsets of a set's ordered features, l = len(opened) + 1, whose beginnings are open, and how many
    features there may be in common with a set that shares the subset as its first l common features."""
    least = -(-3 * n // 4)  # the fewest features in common with any linked set
    ends, keys = np.array([-1]), np.zeros(1, U)
    for level in range(1, len(opened) + 2):
        last = n - least - 1 + level  # the last place at which the l-th common feature may stand
        many = np.maximum(last - ends, 0)
        of = np.repeat(np.arange(len(ends)), many)
        at = ends[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        keys, ends = subset_key(keys[of], key[at]), at
        if level <= len(opened):
            stay = np.isin(keys, opened[level - 1])
            keys, ends = keys[stay], ends[stay]
    return keys, n - ends - 1 + len(opened) + 1


def emit_subsets(batches: Iterator[pa.RecordBatch], frequent: Broadcast, opened: Broadcast) -> Iterator[pa.RecordBatch]:
    """deal, sig, node, n, reach for each subset of a set's features that may be the first ones in common with a linked set."""
    often = Frequency(*frequent.value)
    rows = Dealer(["sig", "node", "n", "reach"])
    for batch in batches:
        for b in blocks(batch, "text"):
            row, h, size, digest = sets(b.column("text"))
            h = h[np.lexsort((h, often.of(h), row))]
            start = np.cumsum(size) - size
            if not opened.value:
                place = np.arange(len(h)) - start[row]
                n = size[row]
                take = place <= n - -(-3 * n // 4)
                of, key, most = row[take], subset_key(U(0), h[take]), (n - place)[take]
            else:
                found = [(i, *subsets(h[start[i] : start[i] + size[i]], int(size[i]), opened.value)) for i in np.flatnonzero(size).tolist()]
                of = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                key, most = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in ((1, U), (2, np.int64)))
            n = size[of]
            yield from rows.add(key.view(np.int64), digest[of].view(np.int64), n.astype(np.int32), ((7 * most - 3 * n) // 3).astype(np.int32))
    yield from rows.rest()


def emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text"):
            row, h, size, digest = sets(b.column("text"))
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["node", "features"])


def texts_of(slim: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one document at least of each wanted node; texts of other nodes may be among them."""
    firsts = written(sized_join(nodes.select("node", "doc_id"), wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first")).select("first").distinct(), "jaccard-firsts")
    return sized_join(slim, firsts, slim["doc_id"].eqNullSafe(firsts["first"]), "left_semi").select("text")


def made_again(slim: DataFrame, nodes: DataFrame, wanted: DataFrame, make, kind: str) -> DataFrame:
    """What make yields (kind, with node) for the wanted nodes, from the text of one document each; rows may repeat."""
    return sized_join(texts_of(slim, nodes, wanted).mapInArrow(make, kind), wanted, "node", "left_semi")


def compared(pairs: DataFrame, slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by their whole sets. b's set travels to a's, so a set that many are compared
    with is not repeated for each of them."""
    pairs = written(pairs, "jaccard-compared")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-tested")
    features = made_again(slim, nodes, wanted, emit_features, "node long, features array<long>")
    firsts = written(pairs.select(F.col("a").alias("node")).distinct(), "jaccard-first-of-pairs")
    left = sized_join(features, firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("features").alias("fa"))
    right = sized_join(features, pairs, features["node"] == pairs["b"], "inner").select("a", "b", F.col("features").alias("fb"))
    both = right.join(left, "a")
    return written(both.where(linked(F.size(F.array_intersect("fa", "fb")), F.size("fa"), F.size("fb"))).select("a", "b"), "jaccard-links")


def apart(p: str, q: str) -> Column:
    """How many bits of two parities differ."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)


def verified(pairs: DataFrame, slim: DataFrame, nodes: DataFrame, stars: bool = False) -> DataFrame:
    """Links (a, b) that join the same nodes as all links among the pairs do.

    Sizes and parities sort most pairs out before texts are read; then each node is compared with its first partner, and
    what is left between different components pair by pair. Pairs of stars are compared all at once.
    """
    known = written(sized_join(nodes.select(F.col("node"), F.col("n_shingles").alias("n"), "bits"), written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-met-nodes"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-known")
    for x in "ab":
        pairs = sized_join(pairs, known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), x, "inner", limit=WIDE_ROWS)
    near = pairs.where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * apart("bitsa", "bitsb") <= F.col("na") + F.col("nb")))
    near = written(near.select("a", "b", "na", "nb"), "jaccard-near")
    long = near.where(F.least("na", "nb") >= LONG)
    ends = written(long.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-long-nodes")
    wide = written(sized_join(nodes.where(F.col("n_shingles") >= LONG).select("node", "wide"), ends, "node", "left_semi").dropDuplicates(["node"]), "jaccard-wide")
    for x in "ab":
        long = sized_join(long, wide.select(F.col("node").alias(x), F.col("wide").alias(f"w{x}")), x, "inner", limit=WIDE_ROWS // 10)
    long = long.where(7 * apart("wa", "wb") <= F.col("na") + F.col("nb")).select("a", "b")
    near = written(near.where(F.least("na", "nb") < LONG).select("a", "b").union(long), "jaccard-nearer")
    if stars:
        return compared(near.select("a", "b"), slim, nodes)
    first = compared(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), slim, nodes)
    comp = written(connected_components(first), "jaccard-first-comp")
    rest = written(apart_yet(near.select("a", "b"), comp), "jaccard-rest")
    return first if rest.isEmpty() else first.union(compared(rest, slim, nodes))


def frequent_features(spark: SparkSession, texts: DataFrame, least: int) -> Broadcast:
    """Features of more than least of the texts and their counts, sorted: at most FREQUENT, the most frequent."""
    each = texts.mapInArrow(count_features, "feature long, n long")
    count = written(each.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") > least), "jaccard-frequent")
    while count.where(F.col("n") > least).count() > FREQUENT:
        least *= 2
    found = count.where(F.col("n") > least).toArrow()
    key = found.column("feature").to_numpy().view(U)
    order = np.argsort(key)
    return spark.sparkContext.broadcast((key[order], found.column("n").to_numpy()[order]))


def open_rows(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Of the rows (sig, node, n, reach) of large groups those, with comp, that may be linked with one of another component.

    Rows are summed up by group and class of sizes; a class meets 1 + log(4/3) / log(CLASS) classes at most.
    """
    here = sized_join(groups, comp.toDF("node", "c"), "node", "left").withColumn("comp", F.coalesce("c", "node")).drop("c").withColumn("class", F.floor(F.log("n") / np.log(CLASS)).cast("int"))
    here = written(here, "jaccard-here")
    sums = written(here.groupBy("sig", "class").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach")), "jaccard-classes")
    several = sums.groupBy("sig").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("sig")
    sums = sums.join(several, "sig", "left_semi")
    steps = int(np.log(4 / 3) / np.log(CLASS)) + 2
    x = sums.select("sig", F.explode(F.sequence("class", F.col("class") + steps)).alias("class"), F.col("class").alias("class2"), *(F.col(c).alias(f"{c}2") for c in ("low", "high", "least", "most", "reach")))
    both = x.join(sums, ["sig", "class"]).where((F.least("low", "low2") < F.greatest("high", "high2")) & (F.col("least") <= F.col("reach2")) & (F.col("least2") <= F.col("reach")))
    # A row is open if a class with other components is in its reach and reaches it.
    ends = both.select("sig", "class", F.col("least2").alias("from"), F.col("reach2").alias("to")).union(both.select("sig", "class2", "least", "reach"))
    ends = written(ends.groupBy("sig", "class").agg(F.min("from").alias("from"), F.max("to").alias("to")), "jaccard-open")
    return sized_join(here, ends, ["sig", "class"], "inner").where("reach >= from and n <= to").drop("from", "to")


def linked_components(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that are linked with another."""
    spark = slim.sparkSession
    every = max(nodes.count() // ORDERED, 1)
    some = written(nodes.where((F.col("n_shingles") > 0) & (F.pmod("node", F.lit(every)) == 0)).select("node").distinct(), "jaccard-ordered")
    order = frequent_features(spark, texts_of(slim, nodes, some), ORDERED_LEAST - 1)
    pairs, large = meetings(slim.select("text").mapInArrow(partial(emit_signatures, frequent=order), "deal long, sig long, node long"), "jaccard-met")
    wanted = written(large.select("node").distinct(), "jaccard-hot")
    if wanted.isEmpty():
        return connected_components(verified(pairs, slim, nodes))
    frequent = frequent_features(spark, texts_of(slim, nodes, wanted), HOT)
    opened: list[list[np.ndarray]] = [[]]  # for each pass the keys of open subsets, by their size
    edges = comp = None
    kind = "deal long, sig long, node long, n int, reach int"
    while True:
        groups, level = [], len(opened[0])
        for keys in opened:
            # Texts of other nodes may be among those of the wanted ones; their subsets do no harm.
            made = texts_of(slim, nodes, wanted).mapInArrow(partial(emit_subsets, frequent=frequent, opened=spark.sparkContext.broadcast(keys)), kind)
            more, large = meetings(made, f"jaccard-met-{level}")
            if comp is not None:
                more = apart_yet(more, comp)
            pairs = more if pairs is None else pairs.union(more).distinct()
            groups.append(large)
        found = verified(pairs, slim, nodes)
        edges, pairs = found if edges is None else edges.union(found), None
        comp = written(connected_components(edges), "jaccard-comp")
        large = groups[0]
        for more in groups[1:]:
            large = large.union(more)
        for turn in range(ROUNDS + 1):
            rows = written(open_rows(large, comp), "jaccard-open-rows")
            if rows.isEmpty():
                return comp
            if turn == ROUNDS:
                break
            by_comp = rows.groupBy("sig", "comp").agg(F.count("*").alias("rows"))
            mains = by_comp.groupBy("sig").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), (F.sum("rows") - F.max("rows")).alias("others"))
            few = written(mains.where(F.col("others") <= (STARS if turn else 0)).select("sig", "main"), "jaccard-few")
            # A leader of each size: one that many can be linked with may be of a size that few have.
            lead = sized_join(rows, few, "sig", "left_anti").groupBy("sig", (F.col("class") / 4).cast("int").alias("sizes")).agg(F.min_by(F.struct(*END), F.xxhash64("node", F.lit(turn + ROUNDS * level))).alias("lead")).select("sig", "lead.*")
            rest = sized_join(rows, few, "sig", "inner").where("comp <> main").select("sig", *END)
            ends = written(lead.union(rest).toDF("sig", *(f"{c}2" for c in END)), "jaccard-leaders")
            stars = sized_join(rows, ends, "sig", "inner").where("n <= reach2 and n2 <= reach and comp <> comp2")
            edges = edges.union(verified(stars.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), slim, nodes, stars=True))
            comp = written(connected_components(edges), "jaccard-comp")
            edges = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            large = sized_join(large, few, "sig", "left_anti")
        wanted = written(rows.select("node").distinct(), "jaccard-hot")
        keys = rows.select("sig").distinct()
        passes = -(-keys.count() // OPEN)
        by_pass = [keys.where(F.pmod(F.xxhash64("sig"), F.lit(passes)) == i).toArrow().column("sig").to_numpy().view(U) for i in range(passes)]
        opened = [[*before, np.sort(k)] for before in opened for k in by_pass]


def apart_yet(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    for x in "ab":
        pairs = sized_join(pairs, comp.toDF(x, f"c{x}"), x, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def components_by_row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key1, key2, n_shingles, node for each document: node is equal for linked documents and null for empty sets."""
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, BATCH):  # every Python step below is written before this ends
        slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *text_key(F.col(text).cast("string")))
        nodes = written(slim.mapInArrow(digests, "doc_id long, key1 long, key2 long, n_shingles long, node long, bits array<long>, wide array<long>"), "jaccard-nodes")
        comp = linked_components(slim.select("doc_id", "text"), nodes)
        named = nodes.select(*KEY, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
        named = sized_join(named, comp, "node", "left").select(*KEY, "n_shingles", F.coalesce("comp", "node").alias("node"))
        return written(named, "jaccard-rows", kept=True)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document; see the module."""
    named = components_by_row(docs, doc_id, text)
    least = written(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1").select("node", "least"), "jaccard-least")
    return sized_join(named, least, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked ones, that of the smallest id (of rows without ids or with the same, that of the
    least text key), and all documents without a word; columns stay as they are.

    Rows are told apart by id and text, so that another text under the same id, or without one, is judged for itself. Of rows
    equal in both one stays, the least by a hash of all its columns.
    """
    named = components_by_row(docs, doc_id, text).where("node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    least = written(named.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("members")).where("members > 1").select("node", *(F.col(f"first.{c}").alias(f"first_{c}") for c in KEY)), "jaccard-least")
    of = sized_join(named, least, "node", "inner")
    first = F.lit(True)
    for c in KEY:
        first = first & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    of = written(of.groupBy(*KEY).agg(F.max(first).alias("first"), F.count("*").alias("rows")), "jaccard-decided")
    marked = docs.withColumns({"_fl_doc_id": F.col(doc_id).cast("long")} | {f"_fl_{c.removeprefix('_fl_')}": v for c, v in zip(("key1", "key2"), text_key(F.col(text).cast("string")), strict=True)})

    def joined(keys: DataFrame, how: str) -> DataFrame:
        keys = written(keys.select(*(F.col(c).alias(f"_fr_{c}") for c in KEY)), "jaccard-keys")
        on = F.lit(True)
        for c in KEY:
            on = on & F.col(f"_fl_{c}").eqNullSafe(F.col(f"_fr_{c}"))
        return sized_join(marked, keys, on, how)

    out = joined(of.where("not first or rows > 1"), "left_anti").select(*docs.columns)
    several = of.where("first and rows > 1")
    if several.isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = joined(several, "left_semi")
    rows = rows.groupBy(*(f"_fl_{c}" for c in KEY)).agg(F.min_by(F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True))), F.xxhash64(*docs.columns)).alias("row"))
    return out.union(rows.select(*(F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True))))
