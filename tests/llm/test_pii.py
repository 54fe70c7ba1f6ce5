"""Personal data against plain patterns, and planted terms that reveal an entity."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fenland.llm import pii

SCHEMA = "doc_id long, text string"


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in x) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m.group())]


def odd_text(r):
    card = "".join(str(r.randrange(10)) for _ in range(r.randrange(14, 20)))
    card += next(d for d in "0123456789" if luhn(card + d))
    joined = "".join(c + r.choice(["", "", "", "-", " "]) for c in card)
    some = ["a@b.c", "a@b.c_x@d.e.f", "a@b..c", "@b.c", "x.%+-@y-.z-", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "001.2.3.255", "1.2.3", "256.1.1.1", card, joined, card + "1", "5", "5 5", "+12 (345) 678-90", "+1", "+1234567", "+1(2)3.4-5 6 7 8 ) (", "++49 30 12345678", "é", "ß", "😀", "word", "ÄÖ", ".", "-", " ", "\n", "0" * r.randrange(30), "1 " * r.randrange(30)]
    return "".join(r.choice(some) + r.choice(["", "", " ", " é", "\n", ".", "-"]) for _ in range(r.randrange(25)))


def test_base_equals_plain_patterns(spark):
    r = random.Random(4)
    rows = [(i, odd_text(r)) for i in range(600)] + [(1000, None), (1001, ""), (1002, None), (0, "a@b.c"), (None, "😀 1.2.3.4")]
    got = pii.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = []
    for doc, text in rows:
        s = plain(text)
        want.append((doc, *(sum(x.startswith(k + ":") for x in s) for k in PLAIN), hashlib.sha256(",".join(s).encode()).hexdigest()))
    assert sorted((tuple(x)[:6] for x in got), key=repr) == sorted(want, key=repr)
    for x in got:
        assert hashlib.sha256(",".join(s for s in x["spans"].split(",") if s and not s.startswith("term")).encode()).hexdigest() == x["base_sha256"]


def test_very_long_texts(spark):
    """Long runs neither overflow nor take time that grows with their square."""
    many = 3000
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * (4 * many), "+1" * 100_000, "+" + "1(" * 100_000, "a@" + "b." * 100_000 + "c", "x@y.z " * many, "1.1.1.1 " * many]
    got = {x["doc_id"]: [s for s in x["spans"].split(",") if s] for x in pii.query(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [got[i] for i in (0, 1, 2, 4, 5)] == [[]] * 5
    assert got[3] == [f"ip:{8 * i}:{8 * i + 7}" for i in range(many)]
    assert got[6] == ["email:0:200003"]
    assert got[7] == [f"email:{6 * i}:{6 * i + 5}" for i in range(many)]
    assert got[8] == [f"ip:{8 * i}:{8 * i + 7}" for i in range(many)]


def planted(extra=()):
    """Zorblax stands beside one address alone, quimby mostly, common words everywhere; copies of one text repeat a rare word."""
    r = random.Random(6)
    common = [f"{a}{b}" for a in ("tor", "mel", "sun", "pal", "gri") for b in ("en", "ada", "ist", "ort", "ule", "ina")]
    say = lambda n: " ".join(r.choice(common) for _ in range(n))
    texts = [f"{say(20)} Zorblax {say(2)} max@mail.example.com {say(20)}" for _ in range(6)]
    texts += [f"{say(20)} Gnarfle {say(2)} sue@mail.example.com {say(20)}" for _ in range(5)]
    texts += [f"{say(15)} ZORBLAX wrote {say(5)}", f"{say(9)} quimby {say(9)}", f"nobody knows zorblaxes, {say(4)}"]
    texts += [f"{say(10)} quimby, +49 30 1234567 {say(10)}" for _ in range(7)]
    texts += [f"{say(10)} onlycopies joe@mail.example.com {say(10)}"] * 9
    texts += [f"{say(12)} lone{chr(97 + i)} one{i}@mail.example.com {say(12)}" for i in range(20)]
    texts += [say(30) for _ in range(300)] + [f"{say(9)} Quimby {say(9)}" for _ in range(2)]
    return [(i, t) for i, t in enumerate([*texts, *extra])]


def test_terms_that_reveal_an_entity(spark):
    rows = planted([None, "", "zorblax@mail.example.com"])
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_term", F.lit("other")).repartition(3)
    got = {x["doc_id"]: x for x in pii.query(docs).collect()}
    marked = {(i, t[int(a) : int(b)]) for i, t in rows for s in got[i]["spans"].split(",") if s.startswith("term") for _, a, b in [s.split(":")]}
    want = {(i, w) for i, t in rows for w in re.findall(r"\b(?:zorblax|quimby|gnarfle)\b", t or "", re.I) if "zorblax@" not in t}
    assert marked == want
    assert all(x["base_sha256"] == hashlib.sha256(",".join(plain(t)).encode()).hexdigest() for i, t in rows for x in [got[i]])
    clean = {x["doc_id"]: x for x in pii.sanitised(docs).collect()}
    assert clean[0].asDict().keys() == {"doc_id", "text", "n_term"}
    assert "Zorblax" not in clean[0]["text"] and "max@" not in clean[0]["text"] and "[email]" in clean[0]["text"]
    assert clean[7]["text"] == rows[7][1].replace("Gnarfle", "").replace("sue@mail.example.com", "[email]")
    assert clean[11]["text"] == rows[11][1].replace("ZORBLAX", "[email]")
    assert clean[12]["text"] == rows[12][1].replace("quimby", "[phone]")
    assert clean[13]["text"] == rows[13][1]
    assert clean[len(rows) - 3]["text"] is None and clean[len(rows) - 1]["text"] == "[email]"


def test_terms_with_joins_that_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(planted(), SCHEMA)
    first = sorted(map(tuple, pii.query(docs).collect()))
    monkeypatch.setattr(pii, "within_bytes", lambda df: df)
    assert sorted(map(tuple, pii.query(docs).collect())) == first


def test_no_rows(spark):
    assert pii.query(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pii.sanitised(spark.createDataFrame([], SCHEMA)).count() == 0
