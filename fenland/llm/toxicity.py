"""Toxic spans and scores by a linear-chain conditional random field (operator 1).

Lines are sequences of words, each word has the state clean or toxic. Words of labelled documents are labelled through
their document: a word of a toxic document is toxic if it, or its beginning, stands in toxic documents far more often than
in clean ones. The field has weights for hashed words and word beginnings, a bias, and the transitions; it is trained on
those lines. Forward-backward gives each word's marginal of being toxic; the largest of a document and the expected number of
toxic words, put through a logistic curve fitted on the training documents, are its score, and the words of marginals over 1/2 are its offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import sized_join, written
from .kernel import LOWER, U, blocks, heads, mix, words

#: The classifier is fitted on at most so many labelled documents of each class, drawn by a hash of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
#: Lines without a toxic word for each line with one, and lines with one, in training.
LINES_CLEAN, LINES_TOXIC = 3, 4000
#: Training lines are cut after so many words, which keeps the steps of forward-backward few; scored lines are not cut.
CUT = 128
BITS, PREFIXES, STEPS, RATE, L2 = 20, (3, 4, 5, 6), 50, 0.5, 1e-4
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False


def features(w: dict[str, np.ndarray]) -> np.ndarray:
    """The feature numbers of each word: itself and its first 3 to 6 bytes."""
    mask, data, start, size = U((1 << BITS) - 1), w["bytes"], w["start"], w["end"] - w["start"]
    out = [(w["hash"] & mask).astype(np.int32)]
    h = np.zeros(len(start), U)
    for i in range(max(PREFIXES)):
        here = size > i
        h[here] = (h[here] + LOWER[data[start[here] + i]].astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        if i + 1 in PREFIXES:
            out.append((mix(h + U(i + 1)) & mask).astype(np.int32))
    return np.stack(out, 1) if len(start) else np.zeros((0, 1 + len(PREFIXES)), np.int32)


def lines_of(w: dict[str, np.ndarray]) -> np.ndarray:
    """Where the sequences start: the first words of texts and lines."""
    breaks = np.cumsum(w["bytes"] == 10)[w["start"]] if len(w["start"]) else w["start"]
    new = np.ones(len(breaks), bool)
    new[1:] = (w["row"][1:] != w["row"][:-1]) | (breaks[1:] != breaks[:-1])
    return np.flatnonzero(new)


@dataclass
class Field:
    """Weights of the toxic state against the clean one; change[i, j]: from state i to state j."""

    weights: np.ndarray
    bias: float
    change: np.ndarray
    curve: tuple[float, ...] = (0.0, 1.0, 0.0)

    def unary(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), self.bias)
        for j in range(f.shape[1]):
            out += self.weights[f[:, j]]
        return out

    def marginals(self, unary: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's marginal of being toxic and the expected transitions; all sequences go forward and back together."""
        n = len(unary)
        size = np.diff(np.r_[start, n])
        order = np.argsort(-size, kind="stable")
        first, size = start[order], size[order]
        e = np.exp(np.clip(unary, -30, 30))
        t = np.exp(self.change)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than i
        ahead, back = np.empty(n), np.empty(n)  # probability of toxic given what is before; weight of toxic by what is after
        last = None
        for i in range(longest):
            at = first[: active[i]] + i
            if i:
                p = last[: active[i]]
                toxic = (1 - p) * t[0, 1] + p * t[1, 1]
                clean = (1 - p) * t[0, 0] + p * t[1, 0]
            else:
                toxic = clean = 1.0
            toxic = toxic * e[at]
            last = toxic / (toxic + clean)
            ahead[at] = last
        pairs = np.zeros((2, 2))
        for i in range(longest - 1, -1, -1):
            at = first[: active[i]] + i
            b = np.full(active[i], 0.5)
            if i + 1 < longest:
                k = active[i + 1]
                nxt = at[:k] + 1
                one, zero = back[nxt] * e[nxt], 1 - back[nxt]
                from_toxic, from_clean = t[1, 1] * one + t[1, 0] * zero, t[0, 1] * one + t[0, 0] * zero
                p = ahead[at[:k]]
                joint = np.stack([(1 - p) * t[0, 0] * zero, (1 - p) * t[0, 1] * one, p * t[1, 0] * zero, p * t[1, 1] * one])
                pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
                b[:k] = from_toxic / (from_toxic + from_clean)
            back[at] = b
        m = ahead * back
        return m / np.maximum(m + (1 - ahead) * (1 - back), 1e-300), pairs


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and features of each word, and where lines start; block by block, which bounds memory."""
    rows, found, starts = [np.zeros(0, np.int64)], [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(0, np.int64)]
    n = done = 0
    for b in blocks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        w = words(b.column("text"), SEPARATORS)
        rows.append(w["row"] + done)
        done += b.num_rows
        found.append(features(w))
        starts.append(lines_of(w) + n)
        n += len(w["row"])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(starts)


def toxic_features(doc: np.ndarray, f: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which feature numbers stand in toxic documents far more often than in clean ones. doc is sorted."""
    df, n = np.zeros((2, 1 << BITS), np.int64), [(toxic == y).sum() for y in (0, 1)]
    edges = np.searchsorted(doc, np.arange(0, len(toxic) + 200, 200))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        seen = np.unique((np.repeat(doc[a:b].astype(np.int64), f.shape[1]) << BITS) | f[a:b].ravel())
        for y in (0, 1):
            df[y] += np.bincount(seen[toxic[seen >> BITS] == y] & ((1 << BITS) - 1), minlength=1 << BITS)
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    for z in (3.0, 2.0, 1.0):  # fewer documents ask for less
        found = (odds - z * error > 0) & (odds > np.log(8)) & (df[1] >= 2)
        if found.any():
            break
    return found


def fit(texts: list[str], labels: list[int]) -> Field:
    """The field of labelled texts without copies, as all words of copies would look alike toxic or clean."""
    field = Field(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)))
    if len(set(labels)) < 2:
        field.curve = (6.0 if set(labels) == {1} else 0.0, 1.0, 0.0)
        return field
    row, f, start = prepared(pa.array(texts, pa.large_string()))
    y = np.asarray(labels)
    found = toxic_features(row, f, y)
    truth = (np.any([found[f[:, j]] for j in range(f.shape[1])], 0) & (y[row] == 1)).astype(float)
    line = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(truth)]))
    has = np.bincount(line, weights=truth, minlength=len(start)) > 0
    draw = np.random.default_rng(5)
    good = np.flatnonzero(has)
    other = np.flatnonzero(~has)
    good = np.sort(draw.permutation(good)[:LINES_TOXIC])
    other = np.sort(draw.permutation(other)[: LINES_CLEAN * len(good) + 200])
    chosen = np.zeros(len(start), bool)
    chosen[good] = chosen[other] = True
    take = chosen[line]
    tf, ty = f[take], truth[take]
    begin = heads(line[take])
    begin = np.unique(np.r_[begin, np.flatnonzero((np.arange(len(ty)) - np.repeat(begin, np.diff(np.r_[begin, len(ty)]))) % CUT == 0)])
    inner = np.ones(len(ty), bool)
    inner[begin] = False
    pair = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (ty[pair - 1].astype(int), ty[pair].astype(int)), 1)
    flag = np.zeros(1 << BITS, bool)
    flag[tf] = True
    used, code = np.flatnonzero(flag), (np.cumsum(flag, dtype=np.int32) - 1)[tf]
    weight, square = np.zeros(len(used)), np.full(len(used) + 5, 1e-8)
    for _ in range(STEPS):
        field.weights = weight
        m, pairs = field.marginals(field.unary(code), begin)
        gap = m - ty
        g = np.r_[sum(np.bincount(c, weights=gap, minlength=len(used)) for c in code.T) + L2 * weight * len(ty), gap.sum(), (pairs - seen).ravel()]
        square += g * g
        step = RATE * g / np.sqrt(square)
        weight = weight - step[: len(used)]
        field.bias -= step[len(used)]
        field.change = field.change - step[len(used) + 1 :].reshape(2, 2)
    field.weights = np.zeros(1 << BITS, np.float32)
    field.weights[used] = weight
    # The logistic curve from the largest marginal to the document's label, by Newton's method.
    m, _ = field.marginals(field.unary(f), start)
    z = evidence(m, row, len(texts))
    a = np.zeros(z.shape[1])
    for _ in range(40):
        p = sigmoid(z @ a)
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-2 * np.eye(len(a))
        a -= np.clip(np.linalg.solve(h, z.T @ (p - y) + 1e-2 * a), -2, 2)
    field.curve = tuple(a.tolist())
    return field


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(m: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """What a text's marginals say of it: a constant, the logit of the largest, and the logarithm of the expected toxic words."""
    sure = np.bincount(row, weights=np.where(m > 0.1, m, 0.0), minlength=n)
    return np.stack([np.ones(n), logit(largest(m, row, n)), np.log1p(sure)], 1)


def largest(m: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Each text's largest marginal; 0 for texts without words."""
    out = np.zeros(n)
    if len(row):
        at = heads(row)
        out[row[at]] = np.maximum.reduceat(m, at)
    return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def score_texts(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    field: Field = model.value
    for batch in batches:
        for b in blocks(batch, "text"):
            w = words(b.column("text"), SEPARATORS)
            m, _ = field.marginals(field.unary(features(w)), lines_of(w))
            n = b.num_rows
            score = sigmoid(evidence(m, w["row"], n) @ np.array(field.curve))
            bad = np.flatnonzero(m > 0.5)
            letters = np.r_[0, np.cumsum((w["bytes"] & 0xC0) != 0x80)]  # code points before a byte
            of = w["row"][bad]
            base = letters[w["offsets"][of]]
            spans = pa.StructArray.from_arrays([pa.array(letters[w[k][bad]] - base, pa.int64()) for k in ("start", "end")], ["start", "end"])
            ends = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)], ["doc_id", "score", "spans"])


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def words_key(text):
    """A 64-bit key of a text's whole sequence of words; texts without words, null ones too, share one."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.btrim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row; spans are code point offsets of offending words.

    labels(doc_id, label) of 0 and 1; null ids and labels are not learned from, of repeated ones the largest counts. Without
    labels of both classes all documents get one score. Of labelled documents of one class with the same words all through,
    one is learned from; the sample is drawn from what is left. Null and empty texts get the score of a text without words.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = written(known.where(~held_out(F.col("id"))), "toxic-labels")
    keyed = slim.where("doc_id is not null").select("doc_id", words_key(F.col("text")).alias("key"))
    keyed = sized_join(keyed, known, keyed["doc_id"] == known["id"], "inner").groupBy("id", "y").agg(F.min("key").alias("key"))
    distinct = written(keyed.groupBy("key", "y").agg(F.min(F.struct(F.xxhash64("id", F.lit(17)).alias("draw"), "id")).alias("of")).select("key", "y", "of.draw", "of.id"), "toxic-distinct")
    # The bound of the sample is a parameter; the ids are drawn by a hash, whatever the size.
    drawn = [distinct.where(F.col("y") == y).orderBy("draw", "id").limit(most) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = written(drawn[0].union(drawn[1]), "toxic-sample")
    rows = sized_join(slim, sample, slim["doc_id"] == sample["id"], "inner").where(words_key(F.col("text")) == F.col("key")).select("id", "text", "y").dropDuplicates(["id"]).orderBy("id").toArrow()
    field = fit(["" if t is None else t for t in rows.column("text").to_pylist()], rows.column("y").to_pylist())
    sent = spark.sparkContext.broadcast(field)
    out = slim.mapInArrow(partial(score_texts, model=sent), "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


query = toxicity
