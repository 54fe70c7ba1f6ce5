"""Personal data and what reveals it (operator 12). DataFrame functions only.

Base spans are emails, IP addresses, card and phone numbers, found by patterns and checks. Their values are the protected
entities. How strongly a term (a run of three letters or more, lower-cased) reveals an entity is estimated from the corpus:
IC(c) = log2(D / n(c)) is the information of entity c that stands in n(c) of the D different texts, and PMI(c; t) =
log2(D n(c, t) / (n(c) n(t))) the information that term t gives of it, where n(c, t) are the different surroundings of c (REACH
words on either side) with t, and at least LEAST. Their quotient, the disclosure, is 1 where t never stands without c. Terms of
REMOVED or more are removed wherever they stand, those of GENERALISED or more are replaced by the kind of data they reveal.
Copies have the same surroundings and the same text, so they count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import scratch, text_key, within_bytes, written

#: Words on either side of an entity; surroundings that a term must share with it; shares of its information.
REACH, LEAST, GENERALISED, REMOVED = 10, 3, 0.8, 0.95
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = r"[A-Za-z0-9._%+-]"
#: The patterns of the kinds, without backtracking: a match begins where a run begins or where the last match has ended, and
#: takes all of a run. Runs of digits with single blanks or hyphens count as cards from 16 to 19 digits, so others are passed over.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])(?:[0-9][\x20-]?){15,18}[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be worth a search.
HINT = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Lengths that are added up together.
BLOCK = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of card numbers."""
    d = F.reverse(number)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


CHECK = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda v: luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def starts(lengths: Column) -> Column:
    """The sums of all lengths before each one; blocks of lengths keep long arrays from being summed anew for each."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n = F.size(lengths)
    sums = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: add(F.slice(sums, F.lit(1), (i / BLOCK).cast("int"))) + add(F.slice(lengths, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))


def with_matches(df: DataFrame, out: str, text: str, pattern: Column, hint: Column) -> DataFrame:
    """df with the column out: the matches of pattern in the column text as SPAN, in code points, and the text between them."""
    df = df.withColumn("_fl_m", F.when(hint, F.regexp_extract_all(F.col(text), pattern, F.lit(0))))
    df = df.withColumn("_fl_p", F.when(F.size("_fl_m") > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn("_fl_l", F.when(F.size("_fl_m") > 0, F.transform("_fl_m", lambda v, i: F.length(v) + F.length(F.get("_fl_p", i)))))
    df = df.withColumn("_fl_s", F.when(F.size("_fl_m") > 0, starts(F.col("_fl_l"))))

    def span(v: Column, i: Column) -> Column:
        start = F.get("_fl_s", i) + F.length(F.get("_fl_p", i))
        return F.struct(start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), v.alias("value"), F.get("_fl_p", i).alias("before"), F.get("_fl_p", i + 1).alias("after"))

    spans = F.when(F.size("_fl_m") > 0, F.transform("_fl_m", span)).otherwise(F.array().cast(SPAN))
    return df.withColumn(out, spans).drop("_fl_m", "_fl_p", "_fl_l", "_fl_s")


def with_base(df: DataFrame, text: str) -> DataFrame:
    """df with _fl_email, _fl_ip, _fl_card and _fl_phone, the base spans of the column text, which has no nulls."""
    for kind in KINDS:
        df = with_matches(df, f"_fl_{kind}", text, F.lit(PATTERNS[kind]), HINT[kind](F.col(text)))
        check = CHECK[kind]
        df = df.withColumn(f"_fl_{kind}", F.filter(f"_fl_{kind}", lambda s: check(s["value"])))
    return df


def terms(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def surroundings(based: DataFrame) -> DataFrame:
    """based(key1, key2, _fl_email ..) -> (entity, kind, key1, key2, near): the terms around each base span."""

    def around(kind: str) -> Column:
        near = lambda s: F.concat(F.slice(before := terms(s["before"]), F.greatest(F.size(before) - (REACH - 1), F.lit(1)), REACH), F.slice(terms(s["after"]), 1, REACH))
        value = lambda v: F.lower(v) if kind in ("email", "ip") else digits(v)
        return F.transform(f"_fl_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), value(s["value"])).alias("entity"), F.array_distinct(F.transform(near(s), F.lower)).alias("near")))

    # The row's number keeps the filter above the patterns; pushed below, all arrays would be made again for each of their elements.
    some = based.withColumn("row", F.monotonically_increasing_id()).where(" or ".join(f"size(_fl_{k}) > 0" for k in KINDS)).where("row >= 0")
    return some.select("key1", "key2", F.explode(F.concat(*(around(k) for k in KINDS))).alias("s")).select("s.*", "key1", "key2")


def disclosures(near: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """near as of surroundings, texts(key1, key2, text) of all documents -> (term, disclosure, kind) for terms of GENERALISED
    or more, of several entities the one most revealed, and (key1, key2, term, form) where they stand; None if there are none."""
    total = texts.where("text <> ''").select("key1", "key2").distinct().count()
    if not total:
        return None
    entities = near.groupBy("entity").agg(F.count_distinct("key1", "key2").alias("n_entity"))
    each = near.select("entity", "kind", "key1", "key2", F.xxhash64("near").alias("context"), F.explode("near").alias("term")).distinct()
    both = each.groupBy("entity", "kind", "term").agg(F.least(F.count_distinct("context"), F.count_distinct("key1", "key2")).alias("n_both")).where(F.col("n_both") >= LEAST)
    seen = each.groupBy("term").agg(F.count_distinct("key1", "key2").alias("n_seen"))
    # A term stands in as many texts at least as it has beside entities; most common words are too many already.
    measure = lambda n: F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col(n))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    pairs = both.join(entities.where((F.col("n_entity") >= LEAST) & (F.col("n_entity") < total)), "entity").join(seen, "term").where(measure("n_seen") >= GENERALISED)
    pairs = written(pairs.select("entity", "kind", "term", "n_both", "n_entity"), "disclosure-pairs")
    if pairs.isEmpty():
        return None
    known = written(pairs.select("term").distinct(), "disclosure-terms")
    forms = texts.select("key1", "key2", "text").where("text <> ''").select("key1", "key2", F.explode(F.array_distinct(terms(F.col("text")))).alias("form")).withColumn("term", F.lower("form"))
    forms = written(forms.join(within_bytes(known), "term", "left_semi").distinct(), "disclosure-forms")
    count = forms.groupBy("term").agg(F.count_distinct("key1", "key2").alias("n_term"))
    strong = pairs.join(count, "term").withColumn("disclosure", measure("n_term")).where(F.col("disclosure") >= GENERALISED)
    strong = strong.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("m")).select("term", "m.*")
    return written(strong, "disclosing"), forms


def with_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _fl_email, _fl_ip, _fl_card, _fl_phone and _fl_term: arrays of spans (start, end in code points, value), sorted;
    those of _fl_term have kind and disclosure too.

    A null text counts as empty and has none. Texts are judged by their words alone, so repeated rows are treated alike, and
    other columns, also of the names of the results, are left alone. Terms inside a base span are not reported again.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    with scratch(spark):
        texts = docs.select(*text_key(t), t.alias("text"))
        near = written(surroundings(with_base(texts, "text")).distinct(), "surroundings")
        found = disclosures(near, texts)
        out = with_base(docs.withColumn("_fl_text", t).withColumns(dict(zip(("_fl_key1", "_fl_key2"), text_key(t), strict=True))), "_fl_text")
        for kind in KINDS:
            out = out.withColumn(f"_fl_{kind}", F.transform(f"_fl_{kind}", lambda s: s.dropFields("before", "after")))
        kind_of = "array<struct<start:int,end:int,value:string,kind:string,disclosure:double>>"
        if found is None:
            return out.withColumn("_fl_term", F.array().cast(kind_of)).drop("_fl_text", "_fl_key1", "_fl_key2")
        strong, forms = found
        here = forms.join(strong, "term").groupBy(F.col("key1").alias("_fl_key1"), F.col("key2").alias("_fl_key2")).agg(F.map_from_entries(F.collect_set(F.struct("form", F.struct("kind", "disclosure")))).alias("_fl_forms"))
        here = written(here, "disclosing-forms", kept=True)
        out = out.join(within_bytes(here), ["_fl_key1", "_fl_key2"], "left")
        # Forms have letters only, so they are patterns of themselves.
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.coalesce(F.array_join(F.map_keys("_fl_forms"), "|"), F.lit("-")), F.lit(r")(?!\p{L})"))
        out = with_matches(out.withColumn("_fl_pattern", pattern), "_fl_term", "_fl_text", F.col("_fl_pattern"), F.col("_fl_forms").isNotNull())
        base = F.concat(*(F.col(f"_fl_{k}") for k in KINDS))
        free = F.filter("_fl_term", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        of = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.col("_fl_forms")[s["value"]]["kind"].alias("kind"), F.col("_fl_forms")[s["value"]]["disclosure"].alias("disclosure"))
        return out.withColumn("_fl_term", F.transform(free, of)).drop("_fl_text", "_fl_key1", "_fl_key2", "_fl_forms", "_fl_pattern")


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their columns and texts in which base spans are replaced by [email], [ip], [card] or [phone], terms of REMOVED
    or more by nothing and other terms by the kind they reveal; of spans that overlap the first, longest one counts. Null texts stay."""
    out = with_personal_data(docs, text)
    replaced = lambda k: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.lit(f"[{k}]").alias("put"))
    every = F.concat(*(F.transform(f"_fl_{k}", replaced(k)) for k in KINDS))
    of_terms = F.transform("_fl_term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.when(s["disclosure"] >= REMOVED, "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("put")))
    out = out.withColumn("_fl_all", F.sort_array(F.concat(every, of_terms)))
    cut = F.aggregate(
        "_fl_all",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), s["put"]).alias("done"), (-s["last"]).alias("at"))),
        lambda a: F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, F.length(text) - a["at"])),
    )
    return out.withColumn(text, F.when(F.size("_fl_all") > 0, cut).otherwise(F.col(text))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, all spans, and n_term."""
    out = with_personal_data(docs.select("doc_id", "text"))
    spelt = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"])
    named = lambda kinds: F.array_join(F.concat(*(F.transform(f"_fl_{k}", spelt(k)) for k in kinds)), ",")
    return out.select("doc_id", *(F.size(f"_fl_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(named(KINDS), 256).alias("base_sha256"), named((*KINDS, TERM)).alias("spans"), F.size("_fl_term").cast("long").alias("n_term"))
