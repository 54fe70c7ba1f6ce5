"""Token alignment against whole texts, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fenland.llm import alignment as al

SCHEMA = "doc_id long, text string"


def ends(ids, size):
    return np.cumsum([size[i] for i in ids]).tolist()


def plain(rows):
    """The contract's rows, from each whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(al.default_path(al.A_FILE)), sentencepiece.SentencePieceProcessor(model_file=al.default_path(al.B_FILE))
    a.encode_special_tokens = True
    tool = al.Aligner(None, None)
    out, count = [], Counter()
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((tool.a_bytes, x), (tool.b_bytes, y))):
            out.append((doc, 0, 0, [], ""))
            continue
        p, q = ends(x, tool.a_size), ends(y, tool.b_size)
        pairs = [(i, j) for i, e in enumerate(p) for j, f in enumerate(q) if e == f] if len(p) < 3000 else [(p.index(e), q.index(e)) for e in sorted(set(p) & set(q))]
        groups, i, j = [], 0, 0
        for k, m in pairs:
            groups.append(",".join(map(str, x[i : k + 1])) + "|" + ",".join(map(str, y[j : m + 1])))
            i, j = k + 1, m + 1
        got = [(x[k], y[m]) for k, m in pairs]
        count.update(got)
        out.append((doc, len(x), len(y), got, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(doc, n_a, n_b, len(g), len(g), sum(count[c] == most[c[1]] for c in g), sum(count[c] for c in g), h) for doc, n_a, n_b, g, h in out]


def odd_text(r):
    some = ["the", "House", "house.", " ", "  ", "\n", "\t ", " \n ", " ", "é", "naïve", "😀😀", "日本語", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "▁", "don't", "123456", "a" * 40, "\r\n", "​", "\x1c", "　", "ﬁ", "é", "\x00", "supercalifragilistic", "-", "...", " ,"]
    return "".join(r.choice(some) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(1, 14)))


def rows(seed, n):
    r = random.Random(seed)
    return [(i, odd_text(r)) for i in range(n)]


def test_equals_whole_texts(spark):
    some = rows(1, 500) + [(900, None), (901, ""), (902, " "), (903, "word " * 4000), (903, "word " * 4000), (None, "the house"), (904, "x" * 20_000)]
    got = al.alignment(spark.createDataFrame(some, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(some)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert 50 < sum(x[1] == 0 for x in want) < 450


def test_counts_beyond_the_bound_are_joined(spark):
    docs = spark.createDataFrame(rows(2, 60) + [(7, None), (7, "the house")], SCHEMA)
    first = sorted(map(tuple, al.alignment(docs).collect()))
    assert sorted(map(tuple, al.alignment(docs, pairs_sent=0).collect())) == first


def test_forgotten_chunks_give_the_same():
    some = [t for _, t in rows(3, 80)] * 2
    small, large = al.Aligner(None, None, cache=5), al.Aligner(None, None)
    assert large.cuts
    for i in range(0, len(some), 10):
        for x, y in zip(small.texts(some[i : i + 10]), large.texts(some[i : i + 10]), strict=True):
            assert list(x) == list(y)
    assert len(small.known) < len(large.known)


@pytest.mark.parametrize("kind", ["overlap", "end", "group"])
def test_products_equal_all_pairs(kind):
    r = random.Random(8)
    for _ in range(50):
        n = r.randrange(1, 40)
        p, q = (sorted({*r.sample(range(1, n + 1), r.randrange(0, n)), n}) for _ in range(2))
        common = sorted(set(p) & set(q))
        want = []
        for i, e in enumerate(p):
            for j, f in enumerate(q):
                s, t = ([0] + p)[i], ([0] + q)[j]
                shared = {"overlap": min(e, f) - max(s, t), "end": e == f, "group": np.searchsorted(common, e) == np.searchsorted(common, f)}[kind]
                if shared > 0:
                    want.append((i, j, int(shared)))
        got = al.links(np.array(p), np.array(q), n, kind)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert al.alignment(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], SCHEMA).withColumn("codes", al.F.lit(3)).withColumn("row", al.F.lit("x"))
    assert sorted(map(tuple, al.alignment(none).collect()), key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)
