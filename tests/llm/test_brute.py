"""The random field against an enumeration of all taggings, and decontamination against all alignments on a table."""

from itertools import product

import numpy as np
import regex

from fenland.llm import decontam, toxicity

D = "/root/testdata/sf0.001"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity.Field.__new__(toxicity.Field)
    field.change = rng.normal(0, 1.5, (2, 2))
    sizes = [5, 1, 8, 3, 2]
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    unary = rng.normal(0, 2, sum(sizes))
    got, pairs = field.marginals(unary, start)
    want, moves = np.zeros(len(unary)), np.zeros((2, 2))
    for s, n in zip(start, sizes, strict=True):
        every = list(product((0, 1), repeat=n))
        weight = np.exp([sum(unary[s + i] * y[i] for i in range(n)) + sum(field.change[a, b] for a, b in zip(y, y[1:])) for y in every])
        weight /= weight.sum()
        for y, p in zip(every, weight, strict=True):
            want[s : s + n] += p * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += p
    assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_leaks_equal_all_alignments(spark):
    """Every document against every item at every shift, with the same rule of equal words."""
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    tokens = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    code: dict[str, int] = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in tokens(t)], np.int64)
    known: dict[tuple, int] = {}
    for x in items.collect():
        t = tuple(coded(x.text).tolist())
        known[t] = min(known.get(t, x.item_id), x.item_id)
    texts = [(x.doc_id, coded(x.text)) for x in docs.collect()]
    want = {}
    for t, item in known.items():
        m = len(t)
        if m < decontam.LEAST_WORDS:
            continue
        width = min(decontam.WINDOW, m)
        for doc, words in texts:
            padded = np.r_[np.full(m, -1), words, np.full(m, -1)]
            equal = padded[np.arange(m)[:, None] + np.arange(len(words) + m)] == np.array(t)[:, None]
            sums = np.cumsum(np.r_[np.zeros((1, equal.shape[1]), int), equal], 0)
            best = int((sums[width:] - sums[:-width]).max())
            if best * decontam.WINDOW >= width * decontam.MATCHES:
                want[doc, item] = (max(best, want.get((doc, item), (0,))[0]), width)
    got = {(x.doc_id, x.item_id): (x.n_equal, x.n_window) for x in decontam.contaminated(docs, items).collect()}
    assert got == want and len(want) >= 3
