"""Personal data: base patterns, and terms that reveal who is meant.

Information-theoretic sanitisation: the corpus tells how much a term in the documents of a protected
entity (an address, number or card that the base patterns find) discloses it. A term whose
presence makes one entity likely, and far likelier than chance, is generalised, or removed
where it all but names the entity. Everything here is DataFrame expressions: patterns run
in the JVM, statistics are aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, shuffles_dropped, stored, stored_at

#: Kinds in the order of results, with patterns. Possessive repeats and look-behinds
#: only keep long runs linear; they match at the same places as the plain patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth running.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}_]+"

SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["found"])


def _placed(pieces: Column, hits: Column, kind: str) -> Column:
    """Hits with their places: a hit starts after all pieces and hits before it."""

    def more(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["h"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["h"].alias("found")))).alias("out"),
            end.alias("at"),
        )

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(pairs, F.struct(F.array().cast(SPAN).alias("out"), F.lit(0).alias("at")), more, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Array of a text's base spans by kind: kind, start, end (code points, end exclusive) and what was found."""

    def of(kind: str) -> Column:
        hint = text.contains(HINTS[kind]) if kind in ("email", "phone") else text.rlike(HINTS[kind])
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(hint, F.filter(_placed(F.split(text, PATTERNS[kind], -1), hits, kind), _keeps(kind))).otherwise(F.array().cast(SPAN))

    return F.concat(*[of(k) for k in KINDS])


def _redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its label; overlapping spans are cut at the end of the one before."""

    def add(acc: Column, x: Column) -> Column:
        start = F.greatest(x["start"], acc["at"])
        one = F.array(F.struct(start.alias("start"), x["end"].alias("end"), x["label"].alias("label")))
        return F.struct(
            F.when(x["end"] > start, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"), F.greatest(x["end"], acc["at"]).alias("at")
        )

    kind = "array<struct<start:int,end:int,label:string>>"
    cuts = F.aggregate(spans, F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at")), add, lambda acc: acc["out"])
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(cuts, i)["end"])
    parts = F.transform(cuts, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), x["label"]))
    tail = F.substring(text, F.coalesce(F.try_element_at(cuts, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.concat(F.array_join(parts, ""), tail)


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k"), text).alias("k2")]


def _words(text: Column) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), lambda w: F.xxhash64(w))


def _free_words(text: Column, spans: Column) -> Column:
    """Hashes of the distinct terms that stand at least once outside of what the spans found."""
    found = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["found"])), lambda a, b: F.length(b) - F.length(a))
    rest = F.lower(F.aggregate(found, F.translate(text, "\x00", " "), lambda t, f: F.replace(t, f, F.lit("\x00"))))
    # A term that a span cuts off is not free.
    hits = F.regexp_extract_all(rest, F.lit(r"(?<![\p{L}\p{N}_\x00])[\p{L}\p{N}_]++(?!\x00)"), F.lit(0))
    return F.when(F.size(spans) > 0, F.transform(F.array_distinct(hits), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, times, t): every distinct text once, keyed by two hashes, and how many rows have it; null is empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*_keys(t), t.alias("t")).groupBy("k1", "k2").agg(F.count("*").alias("times"), F.first("t").alias("t"))


def _read(texts: DataFrame) -> DataFrame:
    """Base spans of every distinct text, and its free terms where it has spans."""
    return texts.select("k1", "k2", "times", "t", base_spans(F.col("t")).alias("base")).select("k1", "k2", "times", "base", _free_words(F.col("t"), F.col("base")).alias("free"))


def disclosing_terms(texts: DataFrame, read: DataFrame, min_support: int, min_share: float, min_bits: float) -> DataFrame:
    """(entity, word, share, bits) of the pairs beyond the thresholds, by counts over all distinct texts; word is a term's hash.

    share is the part of the texts with the term that have the entity; bits the pointwise
    mutual information of the two. Copies count once: that a text stands often does not make
    its words signs of who is in it. Entities and terms that cannot reach the thresholds go
    before they are paired.
    """
    entity = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["found"]))))
    held = read.where(F.size("base") > 0).select("k1", "k2", F.explode(entity).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= min_support)
    held = stored(held.join(entities, "entity"))
    most = held.groupBy("k1", "k2").agg(F.max("with_entity").alias("most"))
    # Counts of hashes, so only two numbers are shuffled.
    words = texts.select(F.explode(_words(F.col("t"))).alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("with_term")).where(F.col("with_term") >= min_support)
    free = read.select("k1", "k2", F.explode("free").alias("word")).join(most, ["k1", "k2"]).join(frequency, "word")
    free = free.where(F.col("most") >= F.col("with_term") * min_share).select("k1", "k2", "word", "with_term")
    joint = held.join(free, ["k1", "k2"]).groupBy("entity", "word").agg(F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term"))
    scored = joint.where(F.col("both") >= min_support).select(
        "entity", "word", (F.col("both") / F.col("with_term")).alias("share"),
        F.log2(F.col("both") * F.lit(float(read.count())) / (F.col("with_term") * F.col("with_entity"))).alias("bits"),
    )
    return scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits))


def _occurrences(text: Column, base: Column) -> Column:
    """Spans (start, end, action, found) of all occurrences of the terms of _marks that no base span overlaps."""
    code = lambda s: F.xxhash64(F.lower(s))
    forms = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), lambda s: F.array_contains("generalised", code(s)) | F.array_contains("removed", code(s)))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    placed = _placed(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), "term")
    free = F.filter(placed, lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    action = lambda t: F.when(F.array_contains("removed", code(t["found"])), "removed").otherwise("generalised")
    return F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), action(t).alias("action"), t["found"].alias("found")))


def _marks(docs: DataFrame, text_col: str, settings: dict) -> DataFrame:
    """Stored (k1, k2, times, base, terms) of every distinct text: its base spans and those of the disclosing terms in it."""
    with shuffles_dropped(docs.sparkSession):
        texts, texts_at = stored_at(_distinct_texts(docs, text_col))
        read, read_at = stored_at(_read(texts))
        marks = stored(_marked(texts, read, settings))
        discard(docs.sparkSession, texts_at, read_at)
    return marks


def _marked(texts: DataFrame, read: DataFrame, settings: dict) -> DataFrame:
    """The rows of _marks, of stored texts and their base spans."""
    terms = disclosing_terms(texts, read, settings["min_support"], settings["min_share"], settings["min_bits"])
    action = stored(terms.groupBy("word").agg((F.max("share") >= settings["remove_share"]).alias("remove")))
    pick = lambda c: F.collect_set(F.when(c, F.col("word")))
    held = texts.select("k1", "k2", F.explode(_words(F.col("t"))).alias("word")).join(action, "word")
    hits = held.groupBy("k1", "k2").agg(pick(~F.col("remove")).alias("generalised"), pick(F.col("remove")).alias("removed"))
    found = texts.select("k1", "k2", "t").join(hits, ["k1", "k2"]).join(read.select("k1", "k2", "base"), ["k1", "k2"]).select("k1", "k2", _occurrences(F.col("t"), F.col("base")).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,action:string,found:string>>")
    return read.drop("free").join(found, ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", none))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _settings(**more) -> dict:
    return {"min_support": 3, "min_share": 0.5, "min_bits": 6.0, "remove_share": 0.9} | more


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans.

    spans lists base spans by kind (email, ip, card, phone) and start, then the method's as
    kind term, wherever a disclosing term occurs, in documents without base spans too;
    n_terms and n_removed count them. Settings: min_support (distinct texts that must hold
    term and entity), min_share and min_bits (disclosure thresholds), remove_share (from
    which a term is removed instead of generalised).

    Null and empty texts have no spans. Repeated rows and exact copies each get their own
    row, and count as one text in the statistics. An empty table gives no rows. Other columns
    are not read. Texts are shuffled once, to keep one of each.
    """
    marks = _marks(docs, text_col, _settings(**settings))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _text(F.col("base"))
    term = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = marks.select(
        "k1", "k2", "times", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(term, F.lit(""))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"), F.size(F.filter("terms", lambda x: x["action"] == "removed")).cast("long").alias("n_removed"),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keys(F.coalesce(F.col(text_col), F.lit(""))))
    return join_by_key(rows, found, ["k1", "k2"], docs.count()).drop("k1", "k2")


def _level(term: Column) -> Column:
    """What a generalised term becomes: the kind of word that it is."""
    return (
        F.when(term.rlike(r"^\p{N}+$"), "[NUMBER]").when(term.rlike(r"[\p{N}_]"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    )


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with personal data replaced: [EMAIL], [IP], [CARD], [PHONE]; the kind of word for generalised terms ([NUMBER], [CODE], [NAME], [WORD]), nothing for removed ones.

    All columns, whatever their names, and all rows are kept, repeated ones too. Null texts
    stay null, empty ones empty. Disclosing terms are replaced in every document, with base
    spans or without. An empty table stays empty.
    """
    marks = _marks(docs, text_col, _settings(**settings)).where((F.size("base") > 0) | (F.size("terms") > 0))
    label = "struct<start:int,end:int,label:string>"
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("label")))
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "removed", "").otherwise(_level(x["found"])).alias("label")))
    spans = marks.select("k1", "k2", F.sort_array(F.concat(base.cast(f"array<{label}>"), terms.cast(f"array<{label}>"))).alias("spans"))
    row, text = F.col("row"), F.col("row")[text_col]
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(F.coalesce(F.col(text_col), F.lit("")))).join(spans, ["k1", "k2"], "left")
    clean = F.when(F.col("spans").isNull(), text).otherwise(_redacted(text, F.col("spans")))
    return one.select(*[clean.alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])
