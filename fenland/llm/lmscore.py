"""Cross-entropy difference of matched bigram models (operator 9).

Both models share one vocabulary, one list of bigrams, the order and the smoothing; the target model is counted on the
documents labelled as target, the background model on all documents. A token's loss is -log p under each model; a document's
score is the mean over its tokens of target loss minus background loss: the lower, the closer to the target.

Words and pairs are counted over all texts. Every word and pair seen LEAST times or more is in the written table of the
models, which grows with the corpus; any other word is the word 'other', and what no pair is listed for backs off to the
word's own probability by absolute discounting, so each model is a proper distribution. The table's most frequent rows, at
most 2 / WORD_SHARE + 1 / PAIR_SHARE of them, are broadcast, as most tokens need only these; what a text has besides is
counted by text and key and meets the rest of the table in buckets of keys. To the buckets go packed rows, each with the keys
of many texts, sorted, as differences; pairs are counted in the same way. No bucket is large, as any key frequent enough to fill one is among those broadcast.
Where a row is looked up does not change the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, sized_join, text_key, written
from .kernel import BLOCK, U, blocks, heads, mix, opened, squeezed, words

WORD_SHARE, PAIR_SHARE, LEAST, DISCOUNT = 1e-5, 1e-6, 2, 0.75
#: Counts that a task holds before it sends them on.
HELD = 1_500_000
#: Words of the corpus for each bucket of keys at most; there are BUCKETS for each shuffle partition at least.
BUCKET_WORDS, BUCKETS = 2_000_000, 4
#: More than the frequent words, of which there are at most 1 / WORD_SHARE.
PLACES = U(1 << 20)
#: What stands before the first word of a text.
START = 0x5DEECE66D


def context_key(word: np.ndarray) -> np.ndarray:
    """Of a word known by its hash the number after it, so that both pack as one; of others a hash."""
    return np.where(word >> U(63) == 1, word | U(1), mix(word + U(0x2545F4914F6CDD1D)))


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Two frequent words' places side by side, which pack small; of other pairs a hash."""
    mixed = mix(mix(before + U(0x9E3779B97F4A7C15)) * U(3) + word)
    return np.where((before < PLACES) & (word < PLACES), (before + U(1)) * PLACES + word, mixed)


#: The counts of a word: occurrences, those before another word of the text, and both in target documents.
COUNTS = ("n", "n_before", "n_target", "n_before_target")


class Counter:
    """Sums of COUNTS for 64-bit keys; sends them on when it holds too many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> None:
        self.parts.append(self.summed(keys, counts))
        self.size += len(self.parts[-1][0])

    @staticmethod
    def summed(keys: np.ndarray, counts) -> tuple[np.ndarray, ...]:
        found, at = np.unique(keys, return_inverse=True)
        return found, *(np.bincount(at, weights=c, minlength=len(found)).astype(np.int64) for c in counts)

    def sums(self) -> tuple[np.ndarray, ...]:
        keys, *counts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        return self.summed(keys, counts)

    def flushed(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size <= least:
            return
        self.parts = [self.sums()]
        self.size = len(self.parts[0][0])
        if least == 0 or self.size > least // 2:
            key, *counts = self.parts[0]
            self.parts, self.size = [], 0
            for a in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (key.view(np.int64), *counts)], ["key", *COUNTS])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Counter()
    for batch in batches:
        for b in blocks(batch, "text"):
            w = words(b.column("text"))
            row = w["row"]
            if len(row):
                target = b.column("target").to_numpy(zero_copy_only=False)
                inner = np.r_[row[1:] == row[:-1], False]
                held.add(w["hash"], np.ones(len(row)), inner, target[row], target[row] * inner)
                first = row[np.r_[True, ~inner[:-1]]]
                held.add(np.array([START], U), np.zeros(1), np.array([len(first)]), np.zeros(1), np.array([target[first].sum()]))
            yield from held.flushed(HELD)
    yield from held.flushed(0)


def coded(h: np.ndarray, short: np.ndarray) -> np.ndarray:
    """What words are known by: their places in short, the sorted hashes of frequent words, which shuffle small; others by hash, even numbers."""
    rare = (h | U(1 << 63)) & ~U(1)
    if not len(short):
        return rare
    at = np.minimum(np.searchsorted(short, h), len(short) - 1)
    return np.where(short[at] == h, at.astype(U), rare)


def befores(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The code of the word before each word, START for the first of a text."""
    before = np.full(len(code), START, U)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    before[inner] = code[inner - 1]
    return before


def coded_words(batches: Iterator[pa.RecordBatch], short: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("key").to_numpy().view(U)
        key = np.where(key == U(START), key, coded(key, short.value)).view(np.int64)
        yield batch.set_column(0, "key", pa.array(key))


def bucket_count(spark: SparkSession, total: int) -> int:
    """Buckets of keys for so many words; an odd number, so that both words of a pair decide."""
    return 2 * max(BUCKETS // 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * BUCKET_WORDS)) + 1


def summed_pairs(before: np.ndarray, word: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The keys of pairs, once each in order, the pairs and the sums of their counts."""
    key = pair_key(before, word)
    order = np.argsort(key)
    key = key[order]
    new = heads(key)
    return [key[new], before[order[new]], word[order[new]], *(np.add.reduceat(c[order], new) for c in counts)]


def packed_pairs(parts: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """A row for each bucket with its pairs, sorted, and their counts."""
    key, *columns = summed_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    bucket = key.view(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = [*heads(bucket), len(bucket)]
    rows = [(int(bucket[i]), j - i, squeezed(*(c[i:j] for c in columns))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "size", "packed"])


def count_pairs(batches: Iterator[pa.RecordBatch], short: Broadcast, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs with their counts, packed by bucket whenever a task holds HELD of them."""
    held, size = [], 0
    for batch in batches:
        for b in blocks(batch, "text"):
            w = words(b.column("text"))
            if len(w["hash"]):
                word = coded(w["hash"], short.value)
                target = b.column("target").to_numpy(zero_copy_only=False)[w["row"]].astype(np.int64)
                held.append((befores(w["row"], word), word, np.ones(len(word), np.int64), target))
                size += len(held[-1][0])
            if size > HELD:
                yield packed_pairs(held, buckets)
                held, size = [], 0
    if held:
        yield packed_pairs(held, buckets)


def sum_pairs(t: pa.Table) -> pa.Table:
    """The pairs of a bucket seen LEAST times or more with their counts."""
    parts = [opened(data, n, U, U, np.int64, np.int64) for data, n in zip(t.column("packed").to_pylist(), t.column("size").to_pylist(), strict=True)]
    _, before, word, *counts = summed_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    kept = counts[0] >= LEAST
    return pa.table([pa.array(x[kept]) for x in (before.view(np.int64), word.view(np.int64), *counts)], ["before", "word", "n", "n_target"])


def keyed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, word = (batch.column(c).to_numpy().view(U) for c in ("before", "word"))
        yield batch.set_column(0, "key", pa.array(pair_key(before, word).view(np.int64))).select(["key", "n", "target", "background"])


def keyed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = context_key(batch.column("before").to_numpy().view(U)).view(np.int64)
        yield batch.set_column(0, "key", pa.array(key)).select(["key", "n", "target", "background"])


class Model:
    """Log probabilities of one of the two models for codes of pairs, on arrays: what the written table is compared with."""

    def __init__(self, pairs: np.ndarray, count: np.ndarray, word: np.ndarray, context: np.ndarray) -> None:
        size = len(word) + 1  # codes of contexts: the words, the other words, the start
        self.word = np.log(word + 1.0) - np.log(word.sum() + len(word))
        kept = np.maximum(count - DISCOUNT, 0.0)
        of = context[pairs // size]
        part = np.divide(kept, of, out=np.zeros(len(kept)), where=of > 0)
        rest = np.clip(1.0 - np.bincount(pairs // size, weights=part, minlength=size), 1e-9, 1.0)
        self.rest = np.log(rest)
        self.pair = np.log(part + rest[pairs // size] * np.exp(self.word[pairs % size]))


def looked_up(b: pa.RecordBatch, short: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; row, key and place in listed (-1: none) of all that the words of a block look up."""
    w = words(b.column("text"))
    word = coded(w["hash"], short)
    before = befores(w["row"], word)
    key = np.concatenate([word, context_key(before), pair_key(before, word)])
    at = np.searchsorted(listed, key)
    at[at == len(listed)] = 0
    return np.bincount(w["row"], minlength=b.num_rows), np.tile(w["row"], 3), key, np.where(listed[at] == key, at, -1) if len(listed) else np.full(len(key), -1)


def score_texts(batches: Iterator[pa.RecordBatch], short: Broadcast, table: Broadcast, other: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Each text's words and its sums over the broadcast rows."""
    listed, values = table.value
    for batch in batches:
        for b in blocks(batch, "text"):
            n, of, _, at = looked_up(b, short.value, listed)
            hit = at >= 0
            sums = [n * o + np.bincount(of[hit], weights=v[at[hit]], minlength=b.num_rows) for v, o in zip(values, other, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), *(pa.array(x) for x in sums)], ["doc_id", "text_key", "n_tokens", "target", "background"])


def packed(text: np.ndarray, key: np.ndarray, c: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: the texts that have keys of it; the keys, sorted, as differences, with places in texts and counts."""
    # A word's own key and that of its context share the bucket and follow each other.
    order = np.argsort(key)
    order = order[np.argsort((key[order] >> 1) % buckets, kind="stable")]
    key, c = key[order], c[order].astype(np.int32)
    bucket = (key >> 1) % buckets
    key = (key >> 1) // buckets * 2 + (key & 1)
    text, of = np.unique(text, return_inverse=True)
    of = of[order]
    edges = [*heads(bucket), len(bucket)]
    rows = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        own, at = np.unique(of[i:j], return_inverse=True)
        rows.append((int(bucket[i]), j - i, text[own].tobytes(), squeezed(np.diff(key[i:j], prepend=0), at.astype(np.int32), c[i:j])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "size", "texts", "packed"])


def keys_to_join(batches: Iterator[pa.RecordBatch], short: Broadcast, table: Broadcast, buckets: int) -> Iterator[pa.RecordBatch]:
    """What each text looks up that is not among the broadcast rows, with its count in the text, packed by bucket."""
    held, size = [], 0
    for batch in batches:
        for b in blocks(batch, "text"):
            _, of, key, at = looked_up(b, short.value, table.value[0])
            of, key = of[at < 0], key[at < 0]
            order = np.argsort(key)
            order = order[np.argsort(of[order].astype(np.int32), kind="stable")]
            of, key = of[order], key[order]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
            held.append((b.column("text_key").to_numpy()[of[new]], key[new].view(np.int64), np.diff(np.r_[new, len(key)])))
            size += len(new)
            if size > HELD:
                yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                held, size = [], 0
    if size:
        yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)


def joined(found: pa.Table, rest: pa.Table, buckets: int) -> pa.Table:
    """The sums over the keys of a bucket for the texts that have some."""
    listed = rest.column("key").to_numpy()
    order = np.argsort(listed)
    listed = listed[order]
    values = [rest.column(k).to_numpy()[order] for k in ("target", "background")]
    parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for bucket, n, texts, data in zip(*(found.column(k).to_pylist() for k in ("bucket", "size", "texts", "packed")), strict=True):
        if not len(listed):
            break
        key, of, c = opened(data, n, np.int64, np.int32, np.int32)
        key = np.cumsum(key)
        key = ((key >> 1) * buckets + bucket) * 2 + (key & 1)
        at = np.minimum(np.searchsorted(listed, key), len(listed) - 1)
        hit = listed[at] == key
        of, c = of[hit], c[hit]
        text = np.frombuffer(texts, np.int64)
        some = np.bincount(of, minlength=len(text)) > 0
        parts.append((text[some], *(np.bincount(of, weights=c * v[at[hit]], minlength=len(text))[some] for v in values)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["text_key", "target", "background"])


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) for each row; targets has the ids of the target documents.

    Texts without a word, null ones too, have null losses and score. Null ids are never targets. Repeated rows count and are
    scored each. Without a target document the target model is uniform. Columns besides the two named are not read. What a
    text has besides the broadcast rows is summed by a 64-bit key of the text; equal texts share the sum.
    """
    spark = docs.sparkSession
    part = {"target": "n_target", "background": "n"}
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(F.col(text).cast("string"))[0].alias("text_key"))
    with scratch(spark):
        table, short, other, total = tables_of_models(slim.select("doc_id", "text"), targets, part)
        frequent = F.col("n") >= F.col("share") * total
        top = table.where(frequent).select("key", *part).toArrow()
        key = top.column("key").to_numpy().view(U)
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], tuple(top.column(k).to_numpy()[order] for k in part)))
        rest = table.where(~frequent).select("key", *part)
        buckets = bucket_count(spark, total)
        found = slim.select("text_key", "text").mapInArrow(partial(keys_to_join, short=short, table=sent, buckets=buckets), "bucket long, size int, texts binary, packed binary")
        rest = rest.withColumn("bucket", F.pmod(F.shiftright("key", 1), F.lit(buckets).cast("long")))
        sums = found.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(lambda a, b: joined(a, b, buckets), "text_key long, target double, background double")
        more = sums.groupBy("text_key").agg(*(F.sum(k).alias(f"more_{k}") for k in part))
        more = written(more, "lm-more", kept=True)
        copies = written(slim.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1"), "lm-copies", kept=True)
    scored = slim.mapInArrow(partial(score_texts, short=short, table=sent, other=other), "doc_id long, text_key long, n_tokens long, target double, background double")
    out = sized_join(sized_join(scored, more, "text_key", "left"), copies, "text_key", "left")
    loss = {k: F.when(F.col("n_tokens") > 0, -(F.col(k) + F.coalesce(f"more_{k}", F.lit(0.0)) / F.coalesce("copies", F.lit(1))) / F.col("n_tokens")) for k in part}
    return out.select("doc_id", "n_tokens", *(v.alias(f"loss_{k}") for k, v in loss.items())).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def tables_of_models(slim: DataFrame, targets: DataFrame, part: dict[str, str]) -> tuple[DataFrame, Broadcast, tuple[float, ...], int]:
    """The written table (key, n, target, background, share) of both models, the sorted hashes of frequent words, the logarithms
    for other words, and the words of all texts. A context's count is that of its word before another one, so that pairs
    seen once are counted but not kept."""
    spark = slim.sparkSession
    with scratch(spark):
        wanted = written(targets.select(F.col(targets.columns[0]).cast("long").alias("_fl_id")).where("_fl_id is not null").distinct().withColumn("_fl_target", F.lit(1)), "lm-targets")
        marked = sized_join(slim, wanted, slim["doc_id"] == wanted["_fl_id"], "left").select("text", F.coalesce("_fl_target", F.lit(0)).alias("target"))
        kind = "key long, " + ", ".join(f"{c} long" for c in COUNTS)
        one = written(marked.mapInArrow(count_words, kind).groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS)), "lm-words")
        kept = one.where(F.col("n") >= LEAST)
        total, target = (x or 0 for x in one.agg(F.sum("n"), F.sum("n_target")).first())
        size, n, n_target = (x or 0 for x in kept.agg(F.count("*"), F.sum("n"), F.sum("n_target")).first())
        wholes = {"target": np.log(target + size + 1), "background": np.log(total + size + 1)}
        other = float(np.log(target - n_target + 1) - wholes["target"]), float(np.log(total - n + 1) - wholes["background"])
        # At most 1 / WORD_SHARE rows.
        often = kept.where(F.col("n") >= WORD_SHARE * total).select("key").toArrow().column("key").to_numpy()
        short = spark.sparkContext.broadcast(np.sort(often.view(U)))
        two = marked.mapInArrow(partial(count_pairs, short=short, buckets=bucket_count(spark, total)), "bucket long, size int, packed binary")
        two = written(two.groupBy("bucket").applyInArrow(sum_pairs, "before long, word long, n long, n_target long"), "lm-pairs")
        named = one.mapInArrow(partial(coded_words, short=short), kind)
        before = named.where(F.col("n_before") >= LEAST).select(F.col("key").alias("before"), F.col("n_before").alias("of_background"), F.col("n_before_target").alias("of_target"))
        kept_part = [F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(k) for k, c in part.items()]
        contexts = two.groupBy("before").agg(*kept_part).join(before, "before")
        left = {k: F.log(F.least(F.greatest(1 - F.coalesce(F.col(k) / F.nullif(F.col(f"of_{k}"), F.lit(0)), F.lit(0.0)), F.lit(1e-9)), F.lit(1.0))) for k in part}
        contexts = written(contexts.withColumns(left).withColumn("n", F.col("of_background")), "lm-contexts")
        vocabulary = written(named.where(F.col("n") >= LEAST).select("key", "n", *((F.log(F.col(c) + 1.0) - float(wholes[k])).alias(k) for k, c in part.items())), "lm-vocabulary")
        pairs = sized_join(two, contexts.drop("n").withColumnsRenamed({k: f"rest_{k}" for k in part}), "before", "inner")
        pairs = sized_join(pairs, vocabulary.select(F.col("key").alias("word"), *(F.col(k).alias(f"word_{k}") for k in part)), "word", "inner")
        share = {k: F.coalesce(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.nullif(F.col(f"of_{k}"), F.lit(0)), F.lit(0.0)) for k, c in part.items()}
        # What a listed pair adds to the logarithms of its context's rest and of its word.
        pairs = pairs.select("before", "word", "n", *(F.log1p(share[k] / F.exp(F.col(f"rest_{k}") + F.col(f"word_{k}"))).alias(k) for k in part))
        pairs = pairs.mapInArrow(keyed_pairs, "key long, n long, target double, background double").withColumn("share", F.lit(PAIR_SHARE))
        single = contexts.select("before", "n", *part).mapInArrow(keyed_contexts, "key long, n long, target double, background double")
        single = single.where("target <> 0 or background <> 0").unionByName(vocabulary.select("key", "n", *((F.col(k) - o).alias(k) for k, o in zip(part, other, strict=True))))
        table = written(single.withColumn("share", F.lit(WORD_SHARE)).unionByName(pairs), "lm-table", kept=True)
    return table, short, other, total


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The target: documents labelled as of good quality."""
    return cross_entropy_difference(docs, labels.where("quality = 1").select("doc_id"))
