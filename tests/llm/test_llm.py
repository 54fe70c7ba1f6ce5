"""The numbered operators against brute force, and their edge cases."""

import hashlib
import base64
import itertools
import zlib
from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fenland.llm.common import text_key
from fenland.llm import decontam, jaccard, linededup, lines, lmscore, packing, quality, registry, sharding, tokenbin, tokens, toxicity, warc

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, host string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "", 0, 1, "x"), (None, "a b c", "en", "s", 5, 1, "x"), (4, " \n\t\n ", None, "s", 4, None, None), (5, "word " * 30000, "en", "s", 1, 1, "x"), (6, "x" * 100000, "en", "s", 1, 1, "x"), (7, "a b c", "en", "s", 5, 1, "x"), (7, "a b c", "en", "s", 5, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    found = con.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    want = sorted((tuple(dict(zip(found.columns, r))[c] for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, D).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("host_lines", [lines.HOST_LINES, 0])
def test_repeated_lines_go_at_every_host_size(spark, monkeypatch, host_lines):
    """Hosts of 9, 300 and 3,000 pages with one line on a tenth of them at least, and 1,000 equal pages of 1,100; with the lines of
    hosts broadcast and with each page joined to its own."""
    for module in (linededup, quality):
        monkeypatch.setattr(module, "with_line_marks", partial(lines.with_line_marks, host_lines=host_lines))
    rows, boiler = [], "This line stands on many pages of the site"
    for host, n in (("small", 9), ("middle", 300), ("hot", 3000)):
        for i in range(n):
            own = "\n".join(f"{host} page {i} line {j} has words of its own here" for j in range(3))
            rows.append((len(rows), f"{own}\n{boiler}" if i % 10 == 0 or n < 10 else own, host))
    depleted = {}
    for host in ("small", "hot"):
        for _ in range(3 if host == "small" else 80):
            depleted[len(rows)] = host
            rows.append((len(rows), "\n".join(" ".join(f"mark{k}{j}" for j in range(9)) for k in "abcdefgh") + f"\nfew words of its own {len(rows)}", host))
    rows += [(len(rows) + i, "an equal page of many words and more words\nand another line of it", "copies") for i in range(1000)]
    rows += [(len(rows) + i, f"another page {i} with words of its own", "copies") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in linededup.query(docs).collect()}
    for i, t, host in rows:
        every = t.split("\n")
        stay = [x for x in every if not x.startswith((boiler, "mark")) and host != "copies" or x.startswith("another page")]
        assert got[i].text == "\n".join(stay) and got[i].n_dropped == len(every) - len(stay), (i, host)
    kept = {x.doc_id: (x.base_failed, x.kept) for x in quality.query(docs).collect()}
    for i, t, host in rows:
        n = len(t.split())
        assert i not in depleted or not kept[i][0]
        assert kept[i][1] == (n >= 20 and not kept[i][0] and i not in depleted and host != "copies"), (i, host)


def test_frequent_lines_of_odd_pages(spark, monkeypatch):
    """Null and empty texts, null hosts, repeated rows, lines that stand twice and clashing columns, both ways of joining."""
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, None, None, 1), (4, "one\n\none\ntwo", None, 1), (4, "one\n\none\ntwo", None, 1), (5, "ONE \nthree\n", None, 1), (None, "four\n one", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    want = sorted([(1, None), (2, ""), (3, None), (4, "\ntwo"), (4, "\ntwo"), (5, "three\n"), (None, "four")], key=repr)
    for bound in (lines.HOST_LINES, 0):
        monkeypatch.setattr(linededup, "with_line_marks", partial(lines.with_line_marks, host_lines=bound))
        out = linededup.drop_boilerplate_lines(docs)
        assert out.columns == [*docs.columns, "_fl_n_lines", "_fl_kept"]
        assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == want


def words_of(text):
    return (text or "").encode().lower().split()


def test_jaccard_equals_brute_force(docs):
    sets = {}
    for x in docs.collect():
        w = words_of(x.text)
        sets[x.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_signatures_meet_for_random_sets():
    rng = np.random.default_rng(0)
    for size in (3, 5, 9, 20, 40, 63, 64, 90, 127, 130, 300, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = a.copy()
            while True:
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.r_[b, rng.integers(0, 2**63, 1).astype(np.uint64)]
                if not jaccard.linked(len(np.intersect1d(a, c)), len(a), len(c)):
                    break
                b = c
            n = np.array([len(a), len(b)])
            of, sig = jaccard.signatures(np.repeat([0, 1], n), np.r_[np.sort(a), np.sort(b)], n)
            assert np.array_equal(np.sort(a), np.sort(b)) or set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (len(a), len(b))


def test_jaccard_signatures_in_order_of_rarity():
    """Linked sets meet in any order of their features, and a passage that all sets share makes no group."""
    rng = np.random.default_rng(5)
    for size in (3, 9, 20, 40, 63, 64, 90, 127, 130, 300, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = a.copy()
            while True:
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.r_[b, rng.integers(0, 2**63, 1).astype(np.uint64)]
                if not jaccard.linked(len(np.intersect1d(a, c)), len(a), len(c)):
                    break
                b = c
            n, h = np.array([len(a), len(b)]), np.r_[np.sort(a), np.sort(b)]
            often = (h % np.uint64(7)).astype(np.int64) * (h % np.uint64(3) > 0)
            of, sig = jaccard.signatures(np.repeat([0, 1], n), h, n, often)
            assert np.array_equal(np.sort(a), np.sort(b)) or set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (len(a), len(b))
    for size, common in ((40, 4), (100, 20), (300, 60)):
        passage = rng.integers(0, 2**63, common).astype(np.uint64)
        each = [np.sort(np.r_[passage, rng.integers(0, 2**63, size - common).astype(np.uint64)]) for _ in range(100)]
        h = np.concatenate(each)
        of, sig = jaccard.signatures(np.repeat(np.arange(100), size), h, np.full(100, size), np.isin(h, passage) * 100)
        assert np.unique(sig, return_counts=True)[1].max() <= jaccard.HOT, size


def test_meetings_stream_in_any_batches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        sig, node = np.sort(rng.choice(int(rng.integers(1, 30)), n)), rng.integers(0, int(rng.choice([3, 48, 50, 90])), n)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        cuts = [0, *sorted(rng.integers(0, n + 1, 5).tolist()), n]
        out = [r for b in jaccard.met(iter(pa.RecordBatch.from_arrays([pa.array(sig[x:y]), pa.array(sig[x:y]), pa.array(node[x:y])], ["deal", "sig", "node"]) for x, y in zip(cuts, cuts[1:]))) for r in zip(*(c.to_pylist() for c in b.columns[:3]))]
        pairs, large = set(), set()
        for s in set(sig.tolist()):
            m = sorted(set(node[sig == s].tolist()))
            pairs |= set(itertools.combinations(m, 2)) if len(m) <= jaccard.HOT else set()
            large |= {(s, x) for x in m} if len(m) > jaccard.HOT else set()
        assert {(a, b) for s, a, b in out if s is None} == pairs and {(s, a) for s, a, b in out if s is not None} == large


def test_jaccard_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        w[int(rng.integers(120))] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"u{i}_{j}" for j in range(100)] + base[:14])) for i in range(100)]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}


def test_jaccard_subsets_of_features_lose_no_link(spark, monkeypatch):
    """Sets that share a passage and are seldom linked: all links are found where groups stay large."""
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = np.random.default_rng(6)
    common = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        k = int(rng.integers(2, 16))
        own = [f"o{i}_{j}" for j in range(k)] if i % 3 else [f"s{int(rng.integers(3))}_{j}" for j in range(k)]
        rows.append((i, " ".join(own + common[: int(rng.integers(40, 61))])))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_subsets_of_features_meet_for_random_sets():
    """Any linked pair shares its first l common features as a subset, within the reach of both."""
    rng = np.random.default_rng(7)
    for size in (4, 9, 20, 60):
        for _ in range(30):
            a = rng.permutation(10_000)[:size].astype(np.uint64)
            b = a[rng.random(size) < 0.9]
            b = np.unique(np.r_[b, rng.integers(20_000, 30_000, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)])
            if not len(b) or not jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                continue
            a, b, opened = np.sort(a), np.sort(b), []
            for _level in range(min(3, len(np.intersect1d(a, b)))):
                (ka, ra), (kb, rb) = jaccard.subsets(a, len(a), opened), jaccard.subsets(b, len(b), opened)
                key = np.intersect1d(ka, kb)
                reach = lambda keys, most, n: {k: (7 * m - 3 * n) // 3 for k, m in zip(keys.tolist(), most.tolist())}
                x, y = reach(ka, ra, len(a)), reach(kb, rb, len(b))
                assert any(len(a) <= y[k] and len(b) <= x[k] for k in key.tolist())
                opened.append(np.sort(key))


def test_jaccard_of_unlinked_sets_with_one_passage(spark):
    """5,000 sets of which 80 % are one passage are not linked; a few that are it nearly are linked with all."""
    passage = [f"p{i}" for i in range(160)]
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(20)] + passage + [f"v{i}_{j}" for j in range(20)])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert jaccard.jaccard_components(docs).where("component_id <> doc_id").count() == 0
    more = spark.createDataFrame([(10_000 + i, " ".join([f"x{i}_{j}" for j in range(8)] + passage)) for i in range(50)], "doc_id long, text string")
    assert jaccard.jaccard_components(docs.union(more)).where("component_id <> 0").count() == 0


def test_packing_covers_each_id_once(docs):
    got = packing.pack(docs).collect()
    tk = tokens.Encoder(None).tokenizer
    ids = {x.doc_id: tk.encode(x.text or "", add_special_tokens=False).ids + [2] for x in docs.collect()}
    seen = {}
    for x in got:
        piece = ids[x.doc_id][x.start : x.start + x.length]
        assert np.frombuffer(x.ids, "<u4").tolist() == piece and zlib.crc32(x.ids) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
        seen.setdefault(x.doc_id, []).append((x.start, x.length))
    assert {k: sum(n for _, n in v) for k, v in seen.items()} == {k: len(v) for k, v in ids.items()}
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096


def test_chunks_encode_like_whole_texts():
    rng = np.random.default_rng(3)
    e = tokens.Encoder(None, cache=300)
    alphabet = [*"abc ABC éÉß \n\t 12'.,!İΣς漢　|H\u0331\u0307\u212a\x85\x1c\x00", " | ", "long" * 20, "<|endoftext|>", "<|ENDOFTEXT|>"]
    for rows in rng.integers(0, 12, 400):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(int(rows))]
        want = [np.array(e.tokenizer.encode(s or "", add_special_tokens=False).ids, "<u4").tobytes() for s in texts]
        column = pa.array([None, *texts], pa.string())[1:]
        assert e.ids(column, None) == want
        assert e.ids(column) == [x + np.array([2], "<u4").tobytes() for x in want]
        assert np.all(e.known[1:] > e.known[:-1])


def test_first_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 101, int(rng.integers(1, 80)))
        at, offset = packing.first_fit_decreasing(sizes, 100)
        bins = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, b in enumerate(bins) if b + sizes[i] <= 100), len(bins))
            if k == len(bins):
                bins.append(0)
            assert (at[i], offset[i]) == (k, bins[k])
            bins[k] += sizes[i]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 257, 5000):
        assert sorted(tokenbin.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def test_token_shards_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, "a b"), (5, "a b"), (5, "a b"), (7, "")], "doc_id long, text string"))
    tokenbin.materialise(odd, folder, length=128, per_shard=64)
    got = {x.slot: np.frombuffer(x.ids, "<u2").tolist() for x in tokenbin.read(spark, folder, 128).collect()}
    assert sorted(got) == list(range(len(got)))
    order = tokenbin.feistel(np.arange(len(got)), len(got), tokenbin.KEY)
    stream = [t for i in order.tolist() for t in got[i]]
    rows = odd.select(odd.doc_id.cast("string").alias("id"), "text", *text_key(odd.text)).orderBy("id", "key1", "key2").collect()
    want = np.concatenate([np.frombuffer(b, "<u4") for b in tokens.Encoder(None).ids(pa.array([x.text for x in rows]))]).tolist()
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {2} and len(stream) - len(want) < 128


def test_token_shards_do_not_depend_on_splits(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "GROUP", 20)
    one, two = (f"file://{tmp_path}/{x}" for x in ("one", "two"))
    tokenbin.materialise(docs.repartition(1), one, length=128, per_shard=64)
    monkeypatch.setattr(tokenbin, "TASKS", 3)
    tokenbin.materialise(docs.repartition(7).orderBy("n_chars"), two, length=128, per_shard=64)
    files = sorted(x.name for x in (tmp_path / "one").glob("*.bin"))
    assert len(files) > 3 and all((tmp_path / "one" / x).read_bytes() == (tmp_path / "two" / x).read_bytes() for x in files)
    later = tokenbin.read(spark.newSession(), two, 128, from_slot=100).collect()
    total = sum(x.n_sequences for x in tokenbin.manifest_of(spark, one).collect())
    assert sorted(x.slot for x in later) == list(range(100, total))
    assert all((tmp_path / "one" / f"shard-{x.shard:08d}.bin").read_bytes()[x.byte_offset :][:256] == x.ids for x in later)
    empty = f"file://{tmp_path}/empty"
    assert tokenbin.materialise(docs.limit(0), empty).count() == 0 and tokenbin.read(spark, empty).count() == 0


def test_shards_are_even_and_mixed(docs):
    got = sharding.query(docs).collect()
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x)
    counts = [len(v) for v in by.values()]
    assert len(by) == 8 and max(counts) - min(counts) <= 1
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    total = {}
    for x in got:
        total[x.source] = total.get(x.source, 0) + 1
    for v in by.values():
        for s, n in total.items():
            assert abs(sum(x.source == s for x in v) - n / 8) <= 2


def test_shards_equal_brute_force(spark):
    """One source of 1,000 rows, one of 300 and 900 of a single row: ranks, places and cuts of plain Python."""
    rows = [(i, f"text {i}", "big" if i < 1000 else "mid" if i < 1300 else f"s{i}") for i in range(2200)] + [(None, None, None), (5, "text 5", "big"), (5, "text 5", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = docs.selectExpr("doc_id", "text", "coalesce(source, '') as host", "crc32(encode(coalesce(text, ''), 'utf-8')) as crc").withColumn("key", sharding.F.shiftrightunsigned(sharding.F.xxhash64(sharding.F.lit(sharding.SEED), "doc_id", "crc"), 1)).withColumn("u", sharding.offset_of(sharding.SEED)).collect()
    by = {}
    for x in key:
        by.setdefault(x.host, []).append(x)
    places = []
    for host, v in by.items():
        v.sort(key=lambda x: (x.key, x.doc_id is not None, x.doc_id or 0, x.crc))
        places += [((i + 1 - x.u) / len(v), host, i + 1, x.doc_id, x.crc) for i, x in enumerate(v)]
    places.sort(key=lambda x: x[:3])
    n = len(places)
    want = [(x[3], x[4], i * 8 // n, i - -(-(i * 8 // n) * n // 8)) for i, x in enumerate(places)]
    got = [(x.doc_id, x.text_crc32, x.shard, x.slot) for x in sharding.query(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for s in range(8):  # small sources are in all shards alike
        assert 75 <= sum(x[1][:1] == "s" for i, x in enumerate(places) if i * 8 // n == s) <= 150


def test_rows_go_for_their_own_text(spark):
    """Null and repeated ids: one of two texts under an id is a leak, or a copy; repeated rows of one text are one."""
    item = " ".join(f"item{i}" for i in range(20))
    clean = lambda n: " ".join(f"c{n}w{i}" for i in range(30))
    rows = [(None, item, "a"), (None, clean(1), "b"), (5, item, "c"), (5, clean(2), "d"), (6, clean(2), "e"), (7, clean(3), "f"), (7, clean(3), "f"), (7, clean(3), "g"), (8, None, "h"), (8, "", "i"), (None, clean(3), "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key1 string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(left.collect(), key=repr) == sorted((r for r in docs.collect() if r.text != item), key=repr)
    got = jaccard.one_of_each(docs).collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None and x.text) == sorted([(5, item), (5, clean(2)), (7, clean(3))])
    assert sorted((x.text for x in got if x.doc_id is None)) == [clean(1)] and sum(x.doc_id == 8 for x in got) == 2


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é b", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (None, "v", "same"), (5, "w", "é" * 100_000), (2, "http://b", "same")]
    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read_warc(warc.write_warc(pages, folder), folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for p, _, h in rows:
        last = max(q for q, _, g in rows if (g or "") == (h or "") and q is not None)
        want.append((p, len((h or "").encode()), digest(h), "response" if p == last else "revisit", None if p == last else last))
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=repr) == sorted(want, key=repr)


def test_warc_detects_damage():
    member = warc.record(1, "u", b"payload", None)
    plain = zlib.decompress(member, 31)
    assert warc.parsed(plain)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(plain.replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n"))


def test_leaks_are_found_and_clean_documents_left(spark, docs):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    found = {x.doc_id for x in decontam.contaminated(docs, bench).collect()}
    items = [x.text for x in bench.collect()]
    exact = {x.doc_id for x in docs.collect() if any(t and t in (x.text or "") for t in items)}
    assert exact <= found and len(found) < 0.2 * docs.count()
    item = items[0].split()
    item[3] = item[9] = "changed"
    near = spark.createDataFrame([(1, "Before it. " + " ".join(item) + " And after."), (2, "quite another text of no leak " * 5)], "doc_id long, text string")
    assert {x.doc_id for x in decontam.contaminated(near, bench).collect()} == {1}


def test_masks_hit_every_pattern_that_is_accepted():
    for n in range(decontam.LEAST_WORDS, decontam.WINDOW + 1):
        least = -(-n * decontam.MATCHES // decontam.WINDOW)
        for equal in map(set, itertools.combinations(range(n), least)):
            assert any({at + i for i in mask} <= equal for mask in decontam.MASKS for at in range(n - mask[-1])), (n, equal)


def test_leaks_with_substituted_words_are_found(spark):
    items, rows = [], []
    for n in (6, 7, 8, 9, 12, 13, 20, 40):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        # Every fourth word of long items, one word of shorter ones, at each place.
        for at in range(4 if n >= 13 else n):
            gone = range(at, n, 4) if n >= 13 else (at,)
            if n == 13 and len(gone) > 3:
                continue
            rows.append((100 * n + at, "Before. " + " ".join("other" if i in gone else w for i, w in enumerate(item)) + " After.", n))
        # One word less than is accepted is equal.
        few = -(-min(n, 13) * 10 // 13) - 1
        rows.append((100 * n + 99, "Before. " + " ".join(w if i < few else "other" for i, w in enumerate(item)) + " After.", None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), bench).collect()}
    assert got == {(r[0], r[2]) for r in rows if r[2]}


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {x.doc_id: x for x in toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()}
    held = [(got[x.doc_id].predicted, x.toxic) for x in labels.collect() if got[x.doc_id].held_out]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in got.items())


def test_toxicity_learns_from_all_documents_of_a_common_opening(spark, monkeypatch):
    header = "this is the common header of every page of the site and more"
    rows, labels = [], []
    for i in range(120):
        bad = i % 2
        rows.append((i, f"{header} item{i} {'vilefoo' if bad else 'nicebar'} ends{i}"))
        labels.append((i, bad))
    # Copies of one toxic and of one clean document, which differ in case and signs only.
    for i in range(120, 200):
        bad = i % 2
        rows.append((i, f"{header.upper()}, Copied {'vilefoo' if bad else 'nicebar'}!" + "." * (i % 3)))
        labels.append((i, bad))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert all(x.predicted == x.doc_id % 2 for x in got if x.held_out)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.extend(zip(texts, labels, strict=True)) or toxicity.Field(np.zeros(1 << toxicity.BITS), 0.0, np.zeros((2, 2))))
    toxicity.toxicity(docs, known)
    copies = sorted(y for t, y in seen if "Copied" in t)
    assert copies == [0, 1] and len(seen) - 2 == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(120))


def test_models_are_distributions(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = lmscore.query(docs, labels).collect()
    n = {x.doc_id: len(words_of(x.text)) for x in docs.collect()}
    assert {x.doc_id: x.n_tokens for x in got} == n and all(abs(x.loss_target - x.loss_background - x.score) < 1e-9 for x in got if x.n_tokens)
    m = lmscore.Model(np.array([0, 1, 5]), np.array([3, 1, 2]), np.array([5.0, 4.0, 3.0]), np.array([4.0, 5.0, 3.0, 1.0]))
    for v in range(4):
        p = [np.exp(m.rest[v] + m.word[w]) for w in range(3)]
        for i, key in enumerate([0, 1, 5]):
            if key // 4 == v:
                p[key % 4] = np.exp(m.pair[i])
        assert abs(sum(p) - 1) < 1e-9


def test_models_keep_all_pairs_seen_twice(spark, monkeypatch):
    rows = [(i, " ".join(f"v{(i * 7 + j * j) % 23}" for j in range(40))) for i in range(30)] + [(30, "rare pair alone"), (31, "rare pair"), (32, "v1 once v2"), (33, ""), (33, None)]
    docs, targets = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in (1, 2, 3, 30, 31, 32)], "doc_id long")
    # The two models by plain counts; 'other' stands for words seen once, a context of one has no pairs.
    scores = {}
    texts = [(i, (t or "").split()) for i, t in rows]
    both = [[w for i, w in texts if i in (1, 2, 3, 30, 31, 32)], [w for _, w in texts]]
    seen = [(Counter(x for t in c for x in t), Counter(p for t in c for p in zip(["^", *t], t))) for c in both]
    listed = {p for p, n in seen[1][1].items() if n >= 2}
    vocabulary = {x for x, n in seen[1][0].items() if n >= 2}
    for (n, m), k in zip(seen, ("loss_target", "loss_background"), strict=True):
        of = Counter()
        for p, c in m.items():
            of[p[0]] += c
        whole, other = sum(n.values()) + len(vocabulary) + 1, sum(c for x, c in n.items() if x not in vocabulary)
        for i, t in texts:
            total = 0.0
            for p in zip(["^", *t], t):
                part = {q: max(m[q] - lmscore.DISCOUNT, 0) / of[q[0]] if of[q[0]] else 0 for q in listed if q[0] == p[0]}
                one = ((n[p[1]] if p[1] in vocabulary else other) + 1) / whole
                total -= np.log(part.get(p, 0) + (1 - sum(part.values())) * one)
            scores[i, k] = total / len(t) if t else None
    # Shares that leave all rows, some, or none to the join.
    for share in (2.0, 0.01, 0.0):
        monkeypatch.setattr(lmscore, "WORD_SHARE", share)
        monkeypatch.setattr(lmscore, "PAIR_SHARE", share)
        got = lmscore.cross_entropy_difference(docs, targets).collect()
        assert len(got) == len(rows)
        for x in got:
            for k in ("loss_target", "loss_background"):
                assert (x[k] is None and scores[x.doc_id, k] is None) or abs(x[k] - scores[x.doc_id, k]) < 1e-9, (share, x, k)


def test_odd_rows(spark, odd):
    bench, labels = spark.read.parquet(f"{D}/benchmark.parquet"), odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "1 as quality")
    n = odd.count()
    for f in (quality.query, packing.query, jaccard.jaccard_components, sharding.query, linededup.query, lambda x: toxicity.toxicity(x, labels), lambda x: lmscore.query(x, labels)):
        assert len({(x.doc_id, i) for i, x in enumerate(f(odd).collect())}) >= n
    assert decontam.contaminated(odd, bench).count() == 0 and tokenbin.query(odd).count() > 0
    none = odd.limit(0)
    for f in (quality.query, packing.query, jaccard.jaccard_components, sharding.query, linededup.query, tokenbin.query, lambda x: decontam.contaminated(x, bench), lambda x: toxicity.toxicity(x, labels.limit(0)), lambda x: lmscore.query(x, labels)):
        assert f(none).count() == 0


def test_pipeline_stages(spark, docs):
    now, before = docs, {x.doc_id for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, D)
        assert now.columns == docs.columns, name
        after = {x.doc_id for x in now.collect()}
        assert after <= before and (after == before) == (name == "line_dedup" or after == before)
        before = after
    got = {x.doc_id for x in corpus_pipeline.run(spark, D).collect()}
    assert got == before
    components = [x.component_id for x in jaccard.jaccard_components(now).collect()]
    assert len(components) == len(set(components))
