"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fenland.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, support, top):
    """rows(lang, text) -> the contract's rows, by counting every phrase of every piece."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= support}
        held = set()
        for p, a in often.items():
            held |= {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= often[p[i:j]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in held:
                s, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, rows):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ää", "THE", "the", "é#"]
    made = []
    for i in range(rows):
        w = [r.choices(words, [16 - k for k in range(16)])[0] for _ in range(r.randrange(60))]
        text = "".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for x in w)
        made.append((i, r.choice(["en", "de", None, ""]), r.choice([text] * 9 + ["", None, " . \n"])))
    return made


@pytest.mark.parametrize(("chunk", "shard", "tries"), [(1_000_000, 400_000, 4), (300, 40, 2)])
def test_equals_plain_count(spark, monkeypatch, chunk, shard, tries):
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co, "SHARD", shard)
    monkeypatch.setattr(co, "TRIES", tries)
    rows = corpus(1, 400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = co.collocations(docs, support=7, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain([x[1:] for x in rows], 7, 40)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert {x[0] for x in want} == {"en", "de", "und", ""}


def test_without_the_list_of_frequent_words(spark, monkeypatch):
    """Beyond KNOWN frequent words none are sent; the result is the same."""
    monkeypatch.setattr(co, "KNOWN", 0)
    rows = corpus(2, 150)
    got = co.collocations(spark.createDataFrame(rows, SCHEMA), support=5, top=1000)
    assert sorted(tuple(x) for x in got.collect()) == plain([x[1:] for x in rows], 5, 1000)


def test_bound_keeps_every_frequent_phrase():
    """Phrases spread thinly over chunks are among the candidates, and bounds are never below the counts."""
    r = np.random.default_rng(3)
    chunks = [r.integers(0, 9, r.integers(20, 400)).astype(np.uint64) for _ in range(12)]
    total, support = np.array([sum(map(len, chunks))]), 30
    for m in (2, 3):
        bound, slack, true = Counter(), 0, Counter()
        for c in chunks:
            same = np.zeros(len(c), int)
            state = c.astype(int) if m == 2 else np.r_[c[:-1].astype(int) * 9 + c[1:].astype(int), -1]
            (_, _, least), *parts = co.searched(c, same, same, state, m, True, total, support)
            slack += int(least[0])
            for _, grams, excess in parts:
                for g, e in zip(grams.tolist(), excess.tolist(), strict=True):
                    bound[tuple(g)] += e
            true.update(tuple(c[i : i + m].tolist()) for i in range(len(c) - m + 1))
        assert slack < support
        for p, a in true.items():
            assert bound[p] + slack >= a
            assert a < support or p in bound


def test_double_array_accepts_its_phrases_alone():
    r = random.Random(5)
    grams = {tuple(r.randrange(1, 30) for _ in range(r.randrange(2, 6))) for _ in range(900)}
    grams |= {(7, i) for i in range(1, 30)}
    grams = sorted({g[:k] for g in grams for k in range(2, len(g) + 1)}, key=lambda g: r.random())
    lengths = np.array([len(g) for g in grams])
    table = np.array([g + (0,) * (5 - len(g)) for g in grams], np.uint64)
    letters, base, check, slot = co.double_array(table, lengths)
    assert len(set(slot.tolist())) == len(grams)
    text = np.array([r.randrange(0, 31) for _ in range(3000)], np.uint64)
    piece = np.cumsum([r.random() < 0.05 for _ in text])
    counts = co.accepted(text, piece, letters, base, check)
    want = Counter(tuple(text[i : i + k].tolist()) for i in range(len(text)) for k in range(2, 6) if i + k <= len(text) and piece[i] == piece[i + k - 1])
    assert counts[slot].tolist() == [want[g] for g in grams]
    assert counts.sum() == sum(want[g] for g in grams)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", rank int, _fl_x int")
    assert co.collocations(empty).count() == 0
    rows = [(None, None, None), (1, "en", ""), (1, "en", "a" * 200_000), (2, None, "x y " * 3)]
    got = co.collocations(spark.createDataFrame(rows, SCHEMA).withColumn("score", co.F.lit(None).cast("int")), support=2)
    assert [tuple(x) for x in got.orderBy("rank").collect()] == plain([x[1:] for x in rows], 2, 2000)


class Sent:
    def __init__(self, value):
        self.value = value


def test_coded_texts_keep_all_runs_of_frequent_words():
    """What is read again instead of texts: per language the same runs of frequent words, and the number of all words."""
    rows = [x[1:] for x in corpus(4, 300)]
    names = {x: i - 2 for i, x in enumerate(("en", "de", None, ""))}
    batch = co.pa.RecordBatch.from_arrays([co.pa.array([names[x] for x, _ in rows], co.pa.int64()), co.pa.array([t or "" for _, t in rows])], ["lh", "text"])
    every = list(co.streams([batch], None, np.arange(-2, 2)))
    key = np.concatenate([x[0] for x in every])
    found, n = np.unique(key, return_counts=True)
    known = found[n >= 40]
    assert 0 < len(known) < len(found)
    want, all_words = Counter(), sum(x[4] for x in every)
    for key, _, piece, lang, _ in every:
        run = np.cumsum(np.r_[True, (piece[1:] != piece[:-1]) | ~np.isin(key[1:], known) | ~np.isin(key[:-1], known)])
        for r in np.split(np.arange(len(key)), np.flatnonzero(np.diff(run)) + 1):
            if len(r) > 1:
                want[int(lang[r[0]]), tuple(key[r].tolist())] += 1
    got, words = Counter(), 0
    for key, code, piece, lang, own in co.streams(co.coded([batch], Sent(known)), known, np.arange(-2, 2)):
        assert np.array_equal(known[code], key)
        words += own
        for r in np.split(np.arange(len(key)), np.flatnonzero(np.diff(piece)) + 1):
            got[int(lang[r[0]]), tuple(key[r].tolist())] += 1
    assert got == want and np.array_equal(words, all_words)
