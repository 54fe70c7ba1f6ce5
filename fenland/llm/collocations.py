"""Phrase collocation mining (operator 11): frequent phrases of 2 to 5 words and how far their words attract one another.

Texts are cut at sentence marks into pieces, pieces at blanks into words; everything is counted per language. Words are counted
first. Then texts are written once as the places of their frequent words, in runs that no other word and no sentence mark
interrupts, as no frequent phrase has another word; the steps below read these instead of texts. For 2 to 5 words, one length
after the other:

* Candidates. A phrase is safe if both phrases of one word less in it are frequent. A chunk of about CHUNK words or a task, with
  the share q of a language's words, reports the safe phrases that occur ceil(SUPPORT * q) times in it. The counts of the chunks
  that report a phrase, and the most that the others may have, bound its count from above; candidates are those whose bound
  reaches SUPPORT. Where chunks are so small a share that each reports all it has, the bound is the count.
* Counts. Candidates stand in double-array tries of about SHARD phrases, built in tasks and broadcast TRIES at once. numpy
  advances the states of all positions of a block together, a word at a time, and counts the accepting states; the counts of all
  tasks are added up. More candidates mean more tries and more passes, not larger ones. The tries tell what is safe for the next
  length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_rows, scratch, written
from .kernel import BLOCK, LOWER, SPACE, U, blocks, mix, opened, squeezed, words
from .tokens import spread

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Words that a chunk has before it is searched; phrases of a trie; tries that are broadcast together (about 20 MB each).
CHUNK, SHARD, TRIES = 2_500_000, 400_000, 4
#: Distinct words that a task counts before it sends them on, and frequent words that are broadcast (8 bytes each).
HELD, KNOWN = 400_000, 4_000_000
#: Words of texts that are handled at once, and rows of coded texts (a block's words of a language each) handed to Python.
AT_ONCE, ROWS = 500_000, 200
#: Bytes that end a piece, and those that end a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
ENDS = SPACE | PIECE
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def keyed(b: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The words of a block, their 64-bit keys by language and word, and the number of the piece that each stands in."""
    w = words(b.column("text"), ENDS, LOWER)
    key = mix(w["hash"] ^ b.column("lh").to_numpy().view(U)[w["row"]])
    piece = np.cumsum(PIECE[w["bytes"]])[w["start"]] + w["row"] if len(key) else np.zeros(0, np.int64)
    return w, key, piece


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, lh, h, word, n) for words, and with a null h for all words of a language."""
    held: list[tuple] = []
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        key, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        rows = pa.concat_tables([x[2] for x in held]).combine_chunks()
        found, first, at = np.unique(key, return_index=True, return_inverse=True)
        sums = np.bincount(at, weights=n).astype(np.int64)
        t = rows.take(pa.array(first)).append_column("h", pa.array(found.view(np.int64))).append_column("n", pa.array(sums))
        yield from t.select(["lang", "lh", "h", "word", "n"]).to_batches(50_000)

    for batch in batches:
        for b in blocks(batch, "text", 4 * BLOCK):
            w, key, _ = keyed(b)
            if not len(key):
                continue
            total = np.bincount(w["row"], minlength=len(b))
            lang = b.column("lang").dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)
            first = np.unique(code, return_index=True)[1]
            n = np.bincount(code, weights=total)[code[first]].astype(np.int64)
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(first)), b.column("lh").take(pa.array(first)), none, pa.nulls(len(first), pa.string()), pa.array(n)], ["lang", "lh", "h", "word", "n"])
            found, first, n = np.unique(key, return_index=True, return_counts=True)
            length = w["end"][first] - w["start"][first]
            data = LOWER[w["bytes"][spread(w["start"][first], length)]]
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            row = pa.array(w["row"][first])
            held.append((found, n, pa.table({"lang": b.column("lang").take(row), "lh": b.column("lh").take(row), "word": text})))
            size += len(found)
            if size > HELD:
                yield from flushed()
                held, size = [], 0
    if held:
        yield from flushed()


def walked(word: np.ndarray, piece: np.ndarray, base: np.ndarray, check: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and states after 2 .. level words, over all positions at once. word: places among the trie's words, or -1."""
    at = np.flatnonzero(word >= 0)
    state = word[at]
    for j in range(1, level):
        inside = at + j < len(word)
        at, state = at[inside], state[inside]
        t = base[state] + word[at + j]
        # A word that is not known, or a step outside, leads to the last slot, which is no state.
        t = np.where((word[at + j] >= 0) & (piece[at] == piece[at + j]) & (t >= 0) & (t < len(check)), t, len(check) - 1)
        on = check[t] == state
        at, state = at[on], t[on]
        yield at, state


def placed(key: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Places of keys in sorted letters, -1 for others."""
    if not len(letters):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(letters, key), len(letters) - 1)
    return np.where(letters[at] == key, at, -1)


def coded(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lh, words, size, packed) for each language of a block: all its words, and of size frequent ones the places in known and
    whether a run begins. Runs of one word are left out."""
    for batch in batches:
        for b in blocks(batch, "text", 4 * BLOCK):
            w, key, piece = keyed(b)
            if not len(key):
                continue
            code = placed(key, known.value)
            names, of, every = np.unique(b.column("lh").to_numpy()[w["row"]], return_inverse=True, return_counts=True)
            run = np.cumsum(np.r_[False, (piece[1:] != piece[:-1]) | (code[1:] < 0) | (code[:-1] < 0)])
            kept = np.flatnonzero((code >= 0) & (np.bincount(run)[run] > 1))
            rows = []
            for i in range(len(names)):
                at = kept[of[kept] == i]
                new = np.diff(run[at], prepend=-1) != 0
                rows.append((int(names[i]), int(every[i]), len(at), squeezed(code[at].astype(np.int32), new.astype(np.uint8))))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lh", "words", "size", "packed"])


def streams(batches: Iterator[pa.RecordBatch], known: np.ndarray | None, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts, or where known is given of rows of coded: keys, places in known, pieces and languages of words, and the number of
    all words of each language. Languages are places in names."""
    for batch in batches:
        if known is None:
            for b in blocks(batch, "text", 4 * BLOCK):
                w, key, piece = keyed(b)
                if len(key):
                    lang = np.searchsorted(names, b.column("lh").to_numpy())[w["row"]]
                    yield key, None, piece, lang, np.bincount(lang, minlength=len(names))
            continue
        lang, every, size = (batch.column(c).to_numpy() for c in ("lh", "words", "size"))
        lang = np.searchsorted(names, lang)
        part = np.cumsum(every) // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(every)] if len(every) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            code, new = (np.concatenate(x) for x in zip(*(opened(batch.column("packed")[k].as_py(), int(size[k]), np.int32, np.uint8) for k in range(i, j)), strict=True))
            yield known[code], code, np.cumsum(new, dtype=np.int64), np.repeat(lang[i:j], size[i:j]), np.bincount(lang[i:j], weights=every[i:j], minlength=len(names)).astype(np.int64)


class Letters:
    """Places of words among a trie's; those of all known words are looked up once."""

    def __init__(self, letters: np.ndarray, known: np.ndarray | None) -> None:
        self.letters = letters
        self.of_known = None if known is None else placed(known, letters).astype(np.int32)

    def of(self, key: np.ndarray, code: np.ndarray | None) -> np.ndarray:
        return placed(key, self.letters) if code is None else self.of_known[code].astype(np.int64)


def shorter(key: np.ndarray, code: np.ndarray | None, piece: np.ndarray, level: int, tries: list, letters: list[Letters]) -> np.ndarray:
    """For each position a number of the frequent phrase of level - 1 words there, or -1."""
    if level == 2:
        return np.unique(key, return_inverse=True)[1] if code is None else code.astype(np.int64)
    state = np.full(len(key), -1)
    for (number, _, base, check, often), places in zip(tries, letters, strict=True):
        *_, (at, t) = walked(places.of(key, code), piece, base, check, level - 1)
        on = often[t]
        state[at[on]] = t[on] + (number << 32)
    return state


def searched(key: np.ndarray, piece: np.ndarray, lang: np.ndarray, state: np.ndarray, level: int, both: bool, totals: np.ndarray, support: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The phrases of level words that a chunk reports. lang: places in totals, the words of each language; state as of shorter.
    (lang, words, excess): first for each language of the chunk the most that a phrase not reported may occur, without words;
    then the phrases reported, and by how much they pass that. both: states of all frequent phrases are known. own: the words of
    each language in the chunk, where not all of them are given."""
    own = np.bincount(lang, minlength=len(totals)) if own is None else own
    slack = -(-support * own // np.maximum(totals, 1)) - 1
    here = np.flatnonzero(own)
    yield here, np.zeros((len(here), 0), U), slack[here]
    if len(key) < level:
        return
    safe = (state[: len(key) - level + 1] >= 0) & (piece[: len(key) - level + 1] == piece[level - 1 :])
    if both:
        safe &= state[1 : len(key) - level + 2] >= 0
    at = np.flatnonzero(safe)
    if not len(at):
        return
    if both:
        found, code = np.unique(np.r_[state[at], state[at + 1]], return_inverse=True)
        code = code[: len(at)] * len(found) + code[len(at) :]
    else:
        code = mix(state[at].astype(U) + mix(key[at + level - 1])).view(np.int64)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    start = at[first]
    more = n > slack[lang[start]]
    begin = start[more]
    for a in range(0, len(begin), 100_000):
        part = begin[a : a + 100_000]
        yield lang[part], key[part[:, None] + np.arange(level)], n[more][a : a + 100_000] - slack[lang[part]]


def discover(batches: Iterator[pa.RecordBatch], level: int, known: Broadcast | None, tries: Broadcast | None, both: bool, languages: Broadcast, support: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """(lh, w1 .. w5, excess) of searched, for each chunk of the task; the last one has up to two chunks."""
    names, totals = languages.value
    listed = None if known is None else known.value
    letters = [] if tries is None else [Letters(x[1], listed) for x in tries.value]
    held: list[tuple[np.ndarray, ...]] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        key, piece, lang, state = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        if level == 2 and known is None:
            state = np.unique(key, return_inverse=True)[1]
        for of, grams, excess in searched(key, piece, lang, state, level, both, totals, support, sum(x[4] for x in held)):
            columns = [pa.array(names[of]), *(pa.array(np.ascontiguousarray(grams[:, j]).view(np.int64)) if j < grams.shape[1] else pa.nulls(len(of), pa.int64()) for j in range(LONGEST)), pa.array(excess.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lh", *WORDS, "excess"])

    last, size = 0, 0
    for key, code, piece, lang, own in streams(batches, listed, names):
        state = shorter(key, code, piece, level, [] if tries is None else tries.value, letters)
        # Pieces of one block never continue in the next one.
        piece = np.cumsum(np.r_[True, piece[1:] != piece[:-1]][: len(piece)]) + last
        last = int(piece[-1]) if len(piece) else last
        held.append((key, piece.astype(np.int32), lang.astype(np.int16), state, own))
        size += int(own.sum())
        if size >= 2 * chunk:
            rest: list[tuple[np.ndarray, ...]] = []
            while len(held) > 1 and size > chunk:
                rest.append(held.pop())
                size -= int(rest[-1][4].sum())
            yield from flushed()
            held = rest[::-1]
            size = sum(int(x[4].sum()) for x in held)
    if held:
        yield from flushed()


def double_array(grams: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """grams (n x 5 word keys) -> (sorted word keys, base, check, the slot of each gram's state). The state of a first word is
    its place among the keys; from state s the word of place w leads to t = base[s] + w if check[t] = s. Every part of a gram
    that starts where it starts must be among the grams, from two words on."""
    valid = np.arange(LONGEST) < lengths[:, None]
    letters = np.unique(grams[valid])
    v = len(letters)
    place = np.where(valid, np.searchsorted(letters, grams), 0)
    # Nodes of each level by (rank of the parent, word); rank 0 .. v - 1 of level 1 are the words.
    codes, rank = [], place[:, 0].astype(np.int64)
    for k in range(2, LONGEST + 1):
        of = np.flatnonzero(lengths >= k)
        code = rank[of] * v + place[of, k - 1]
        codes.append(np.unique(code[lengths[of] == k]))
        rank[of] = np.searchsorted(codes[-1], code)
    first = np.r_[0, v, v + np.cumsum([len(c) for c in codes])]
    parent = np.concatenate([c // v + first[k] for k, c in enumerate(codes)]) if codes else np.zeros(0, np.int64)
    word = np.concatenate([c % v for c in codes])
    slot = np.r_[np.arange(v), np.zeros(len(word), np.int64)]
    starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(parent)])
    bases = np.zeros(len(starts), np.int64)
    used = np.zeros(2 * (v + len(word)) + v + 4096, bool)
    used[:v] = True
    head = v
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if size < 2:
            break
        own = word[starts[i] : starts[i] + size]
        step, at = min(1024, max(16, 65_536 // size)), head
        while True:
            while at + step + v + 1 > len(used):
                used = np.r_[used, np.zeros(len(used), bool)]
            free = at + np.flatnonzero(~used[at : at + step])
            fits = ~used[free[:, None] + (own - own[0])].any(1) if len(free) else np.zeros(0, bool)
            if fits.any():
                bases[i] = int(free[np.argmax(fits)]) - int(own[0])
                used[bases[i] + own] = True
                break
            at += step
        # Where many slots are taken the search does not begin again.
        head = at if size < 64 else head
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        free = np.r_[free, np.arange(len(used), len(used) + len(single) - len(free))]
    bases[single] = free[: len(single)] - word[starts[single]]
    slot[v:] = np.repeat(bases, sizes) + word
    top = int(slot.max()) + 2 if len(slot) else 1
    base, check = np.zeros(top, np.int32), np.full(top, -1, np.int32)
    base[slot[parent[starts]]] = bases
    check[slot[v:]] = slot[parent]
    return letters, base, check, slot[first[lengths - 1] + rank]


def build(table: pa.Table) -> pa.Table:
    """The candidates of a trie with their slots, and in the first row its arrays."""
    columns = [c.combine_chunks() for c in (table.column(x) for x in WORDS)]
    lengths = sum(c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    grams = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).view(U) for c in columns], 1)
    letters, base, check, slot = double_array(grams, lengths)
    out = table.select(["lh", *WORDS, "excess", "new", "trie"]).append_column("slot", pa.array(slot.astype(np.int64)))
    for name, x in (("letters", letters), ("base", base), ("check", check)):
        out = out.append_column(name, pa.array([x.tobytes(), *[None] * (len(slot) - 1)], pa.binary()))
    return out


def accepted(key: np.ndarray, piece: np.ndarray, letters: np.ndarray, base: np.ndarray, check: np.ndarray, level: int = LONGEST) -> np.ndarray:
    """How often each state is reached, over all positions at once."""
    counts = np.zeros(len(check), np.int64)
    for _, state in walked(placed(key, letters), piece, base, check, level):
        counts += np.bincount(state, minlength=len(check))
    return counts


def count_states(batches: Iterator[pa.RecordBatch], tries: Broadcast, level: int, known: Broadcast | None, languages: Broadcast) -> Iterator[pa.RecordBatch]:
    """How often the states of level words are reached."""
    listed = None if known is None else known.value
    letters = [Letters(x[1], listed) for x in tries.value]
    counts = [np.zeros(len(check), np.int64) for _, _, _, check, _ in tries.value]
    for key, code, piece, *_ in streams(batches, listed, languages.value[0]):
        for c, (_, _, base, check, _), places in zip(counts, tries.value, letters, strict=True):
            *_, (_, state) = walked(places.of(key, code), piece, base, check, level)
            c += np.bincount(state, minlength=len(check))
    for c, (number, *_) in zip(counts, tries.value, strict=True):
        slot = np.flatnonzero(c)
        for a in range(0, len(slot), 100_000):
            s = slot[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), number, np.int64)), pa.array(s), pa.array(c[s])], ["trie", "slot", "n"])


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) on decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1000)) * wide(a) * wide(n), wide(left) * wide(right))


def phrase_counts(docs: DataFrame, lang: str, text: str, support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages: lang, lh, n), (frequent words: lh, h, word, a) and (phrases: lh, p, a) with support occurrences or more."""
    spark = docs.sparkSession
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    slim = docs.select(name.alias("lang"), F.xxhash64(name).alias("lh"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = slim.mapInArrow(count_words, "lang string, lh long, h long, word string, n long").groupBy("lang", "lh", "h", "word").agg(F.sum("n").alias("a"))
    counted = written(counted.where(F.col("h").isNull() | (F.col("a") >= support)), "words")
    languages, frequent = counted.where("h is null").select("lang", "lh", F.col("a").alias("n")), counted.where("h is not null").select("lh", "h", "word", "a")
    # One row a language.
    rows = languages.orderBy("lh").toArrow()
    names, totals = rows["lh"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64)
    known = None
    if frequent.count() <= KNOWN:
        known = spark.sparkContext.broadcast(np.sort(frequent.select("h").toArrow()["h"].to_numpy().view(U)))
    send, slim = spark.sparkContext.broadcast, slim.select("lh", "text")
    of, phrases, groups = send((names, totals)), None, [None]
    if known is not None:
        slim = written(slim.mapInArrow(partial(coded, known=known), "lh long, words long, size int, packed binary"), "coded")
    wide = ", ".join(f"{c} long" for c in ("lh", *WORDS))
    for level in range(2, LONGEST + 1):
        found, both = None, len(groups) == 1 and (level > 2 or known is not None)
        for tries in groups:
            part = slim.mapInArrow(partial(discover, level=level, known=known, tries=None if tries is None else send(tries), both=both or level == 2, languages=of, support=support, chunk=CHUNK), wide + ", excess long")
            found = part if found is None else found.union(part)
        with arrow_rows(spark, 10_000 if known is None else ROWS):
            found = written(found.groupBy("lh", *WORDS).agg(F.sum("excess").alias("excess")), "discovered")
        # Each pass over the tries has had all chunks.
        slack = found.where("w1 is null").select("lh", (F.col("excess") / len(groups)).cast("long").alias("slack"))
        candidates = found.where("w1 is not null").join(slack, "lh").where(F.col("excess") + F.col("slack") >= support).select("lh", *WORDS, "excess", F.lit(True).alias("new"))
        if phrases is not None:
            candidates = candidates.union(phrases.select("lh", *WORDS, F.col("a").alias("excess"), F.lit(False).alias("new")))
        candidates = written(candidates, "candidates")
        n, fresh = candidates.agg(F.count("*"), F.count_if("new")).first()
        if not fresh:
            break
        exact = not slack.agg(F.max("slack")).first()[0]
        n_tries = -(-n // SHARD)
        schema = wide + ", excess long, new boolean, trie long, slot long, letters binary, base binary, check binary"
        built = written(candidates.withColumn("trie", F.pmod(F.xxhash64("w1", "w2"), F.lit(n_tries))).groupBy("trie").applyInArrow(build, schema), "tries")
        groups, counts = [], None
        for first in range(0, n_tries, TRIES):
            mine = F.col("trie").between(first, first + TRIES - 1)
            rows = built.where(F.col("base").isNotNull() & mine).select("trie", "letters", "base", "check").collect()
            groups.append([(r["trie"], *(np.frombuffer(r[c], kind) for c, kind in (("letters", U), ("base", np.int32), ("check", np.int32))), np.zeros(len(r["base"]) // 4, bool)) for r in rows])
            if exact:
                part = built.where(F.col("new") & mine).select("trie", "slot", F.col("excess").alias("a"))
            else:
                sent = send(groups[-1])
                part = slim.mapInArrow(partial(count_states, tries=sent, level=level, known=known, languages=of), "trie long, slot long, n long").groupBy("trie", "slot").agg(F.sum("n").alias("a"))
                with arrow_rows(spark, 10_000 if known is None else ROWS):
                    part = written(part.join(built.where(F.col("new") & mine).select("trie", "slot"), ["trie", "slot"]).where(F.col("a") >= support), "counts")
                sent.destroy()
            slots = part.select("trie", "slot").toArrow()
            number, slot = slots["trie"].to_numpy(), slots["slot"].to_numpy()
            for i, *_, often in groups[-1]:
                often[slot[number == i]] = True
            counts = part if counts is None else counts.union(part)
        now = built.select("lh", *WORDS, "trie", "slot").join(counts, ["trie", "slot"]).select("lh", *WORDS, "a")
        phrases = written(now if phrases is None else phrases.union(now), "phrases")
    if phrases is None:
        return languages, frequent, spark.createDataFrame([], "lh long, p array<long>, a long")
    return languages, frequent, phrases.select("lh", F.filter(F.array(*WORDS), lambda w: w.isNotNull()).alias("p"), "a")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first top phrases by score, a (descending) and phrase.

    A-Z are lower-cased. a, l and r are the occurrences of the phrase and of its two parts at the cut of the least score (the
    first of equal ones), n those of all words. A phrase that stands only inside one longer frequent phrase is left out. Null
    and empty texts have no words, null languages are 'und'; repeated rows count each; a language without a frequent phrase
    has no row.
    """
    with scratch(docs.sparkSession):
        languages, frequent, phrases = phrase_counts(docs, lang, text, support)
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("p") - k + 1), lambda i: F.slice("p", i, k))))
        inside = phrases.where(F.size("p") > 2).select("lh", F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("lh", "p").agg(F.max("longer").alias("longer"))
        kept = phrases.join(inside, ["lh", "p"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
        each = written(phrases.union(frequent.select("lh", F.array("h").alias("p"), "a")), "parts")
        cuts = kept.select("lh", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
        cuts = cuts.withColumn("left", F.slice("p", F.lit(1), F.col("k"))).withColumn("right", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))
        cuts = cuts.join(each.select("lh", F.col("p").alias("left"), F.col("a").alias("l")), ["lh", "left"]).join(each.select("lh", F.col("p").alias("right"), F.col("a").alias("r")), ["lh", "right"])
        cuts = cuts.join(languages, "lh")
        least = cuts.groupBy("lang", "lh", "p", "a", "n").agg(F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("s"))
        # Words are looked up by language and key and put together again.
        spelt = least.select("lang", "lh", "a", "n", "s.*", "p", F.posexplode("p").alias("i", "h")).join(frequent.select("lh", "h", "word"), ["lh", "h"])
        spelt = spelt.groupBy("lang", "p", "a", "n", "score", "l", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
        # Each of many parts of a language sends its first ones only.
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        part = spelt.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        out = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        return written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", kept=True)


SQL = r"""
WITH pieces AS (SELECT doc, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn
                FROM (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                             regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents) d),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM runs GROUP BY lang),
grams AS (SELECT lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM runs, (SELECT unnest(range(1, 6)) AS m) ms WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
split AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_ AS (SELECT lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, max(a) AS longer
           FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT lang, w, a, m, unnest(range(2, m)) AS k FROM split WHERE m > 2)) GROUP BY 1, 2),
cuts AS (SELECT s.lang, s.phrase, s.a, k, list_aggregate(w[1:k], 'string_agg', ' ') AS p, list_aggregate(w[k + 1:m], 'string_agg', ' ') AS q
         FROM (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM split) s
         LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR i.longer < s.a),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS b FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
