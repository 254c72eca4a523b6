"""Personal data: base patterns, and information-theoretic sanitisation of terms that give protected entities away.

Base patterns are e-mail addresses, IP addresses, card numbers and phone numbers. Each value found is a protected
entity, also one that a single text holds. Over the whole corpus, texts are counted that hold an entity (n_e), a term
(n_t), and both (n_et), of N texts. With half a text added to those of a term, so that it isn't taken to stand in no
other text because none was seen, p(e | t) = n_et / (n_t + 1/2). A term discloses an entity if both hold:

- PMI(e, t) / IC(e) is at or above `disclosure`: of the IC(e) = -log2 p(e) bits that the entity's identity is worth,
  PMI(e, t) = log2 p(e | t) / p(e) are given away;
- at most `residual` bits, -log2 p(e | t), are left: with 1, the entity is as likely as not where the term stands.
  A share of IC(e) alone would let terms through, in a large corpus, that mostly stand in texts without the entity.

Disclosing terms are generalised, where a table gives a more general term that doesn't disclose the entity itself, or
removed, wherever they stand. Copies of one text count once. Entities that stand in the same texts are one class, and
so are terms; only classes are paired, so a text of many unique entities and terms gives one pair and not their product.

All of it is DataFrame functions. Terms are words outside of base spans; a whole text is the context of its entities.

Edge cases: a null text is empty; repeated rows each get their spans; spans of several kinds may overlap, and the
sanitised text covers their union; a null id is kept; columns of any other name pass through; a corpus of one text
has no disclosing terms, for its entities carry no information; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hidden, shown, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, written so that Java's matcher never goes back over a run of characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}]+"
#: Share of an entity's information and bits left of it at which a term goes, texts added to those of a term, shortest term.
DISCLOSURE, RESIDUAL, UNSEEN, TERM_CHARS = 0.9, 1.0, 0.5, 3
#: Rows of a few numbers, or of a term, that a broadcast may hold; beyond that the same join is shuffled.
BROADCAST_ROWS = 1_000_000
KEY = ["__k1", "__k2"]
_RUN, _PIECE = 32, 1024
#: Terms and more general ones, in the languages of the documents.
GENERAL = {
    "day": "monday tuesday wednesday thursday friday saturday sunday",
    "month": "january february march april may june july august september october november december",
    "tag": "montag dienstag mittwoch donnerstag freitag samstag sonntag",
    "monat": "januar februar märz juni juli oktober dezember",
    "jour": "lundi mardi mercredi jeudi vendredi samedi dimanche",
    "mois": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "día": "lunes martes miércoles jueves viernes sábado domingo",
    "mes": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}


def general_terms(spark: SparkSession) -> DataFrame:
    """term, general: the table that is used where none is given."""
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("general"), F.split(F.lit(terms), " ").alias("terms")) for g, terms in GENERAL.items()]))
    return spark.range(1).select(rows).select(F.explode("terms").alias("term"), "general")


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda over one row binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def found(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and value of all matches."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("between"))
    return _bound(parts, lambda p: F.when(F.size(p["matches"]) > 0, _placed(p["between"], p["matches"])))


def _before(xs: Column, op, then) -> Column:
    """then(at), where at(i) is op over the elements of xs before place i, from 0: sums, or what the greatest was.

    The elements are run through in runs of _RUN, the runs' results again, and theirs once more: the work per element
    hardly grows with their number."""
    last = lambda xs: F.element_at(xs, -1)
    none = F.array().cast("array<int>")
    running = lambda xs: F.aggregate(xs, none, lambda got, x: F.concat(got, F.array(op(F.coalesce(F.get(got, F.size(got) - 1), F.lit(0)), x))))
    runs = lambda xs: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(xs) - 1, 5)), lambda b: running(F.slice(xs, b * _RUN + 1, _RUN)))
    before = lambda xs, i: F.coalesce(F.get(xs, i - 1), F.lit(0))
    high, low = lambda i: F.shiftright(i, 5), lambda i: i.bitwiseAND(F.lit(_RUN - 1))
    at = lambda one, two, three: lambda i: op(op(before(three, high(high(i))), before(F.get(two, high(high(i))), low(high(i)))), before(F.get(one, high(i)), low(i)))
    tops = lambda one: _bound(runs(F.transform(one, last)), lambda two: _bound(running(F.transform(two, last)), lambda three: then(at(one, two, three))))
    return _bound(xs, lambda xs: _bound(runs(xs), tops))


def _placed(between: Column, matches: Column) -> Column:
    """Text between matches, match, text, ... have lengths whose running sums are the places."""

    def places(before) -> Column:
        def at(m: Column, i: Column) -> Column:
            return _bound(before(i) + F.char_length(F.get(between, i)), lambda at: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), m.alias("value")))

        return F.transform(matches, at)

    return _before(F.transform(matches, lambda m, i: F.char_length(m) + F.char_length(F.get(between, i))), lambda a, b: a + b, places)


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with put(span, end of the spans before it) in place of each of the spans, which are sorted and may overlap.

    A place in a text is found by going through it from its start, so pieces of _PIECE code points are cut once and gaps
    are taken out of them; all of them are joined at the end."""

    def gap(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.shiftright(a, 10), F.shiftright(b, 10)
        head, tail = F.substr(F.get(pieces, i), a % _PIECE + 1, F.lit(_PIECE)), F.substr(F.coalesce(F.get(pieces, j), F.lit("")), F.lit(1), b % _PIECE)
        long = F.concat(head, F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), tail)
        return F.when(b <= a, "").when(i == j, F.substr(F.get(pieces, i), a % _PIECE + 1, b - a)).otherwise(long)

    def out(pieces: Column) -> Column:
        size = F.size(spans)
        parts = lambda before: F.concat(F.transform(spans, lambda s, i: _bound(before(i), lambda pos: F.concat(gap(pieces, pos, s["start"]), put(s, pos)))), F.array(gap(pieces, before(size), F.char_length(text))))
        return F.array_join(_before(F.transform(spans, lambda s: s["end"]), F.greatest, parts), "")

    return F.when(F.size(spans) > 0, _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0)), out)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))


def _is_card(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    n = F.char_length(digits)

    def weighed(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + weighed(i))
    return F.when((n >= 16) & (n <= 19), luhn % 10 == 0).otherwise(F.lit(False))


def _is_phone(value: Column) -> Column:
    n = F.char_length(_digits(value))
    return (n >= 8) & (n <= 15)


def base_spans(text: Column) -> Column:
    """kind (number in KINDS), start, end, value of the base patterns, by kind and start."""
    none = F.array().cast("array<struct<kind: int, start: int, end: int, value: string>>")

    def one(kind: int, pattern: str, good=None) -> Column:
        at = found(text, pattern)
        if good is not None:
            at = F.filter(at, lambda s: good(s["value"]))
        return F.coalesce(F.transform(at, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))), none)

    email = F.when(F.contains(text, F.lit("@")), one(0, EMAIL)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), one(3, PHONE, _is_phone)).otherwise(none)
    return F.concat(email, one(1, IP, _is_ip), one(2, CARD, _is_card), phone)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64("text", "doc_id")})


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans: what is left keeps its places."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return _replaced(text, places, lambda s, pos: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], pos), F.lit(0))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, __uid (its number), __h (hash of the text), __base (spans) and __rest (the text with blanks for them). Written."""
    rows = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.select("doc_id", *KEY, F.monotonically_increasing_id().alias("__uid"), F.xxhash64("text").alias("__h"), "text", base_spans(F.col("text")).alias("__base"))
    return stored(rows.select("doc_id", *KEY, "__uid", "__h", "__base", _blanked(F.col("text"), F.col("__base")).alias("__rest")))


def _entity(span: str) -> Column:
    """The same value written otherwise is the same entity."""
    value = F.col(f"{span}.value")
    return F.xxhash64(f"{span}.kind", F.when(F.col(f"{span}.kind") == 0, F.lower(value)).when(F.col(f"{span}.kind") == 1, value).otherwise(_digits(value)))


def _terms(texts: DataFrame) -> DataFrame:
    """__h, term: the different terms of every text."""
    words = F.array_distinct(F.split(F.lower("__rest"), r"[^\p{L}\p{M}]+"))
    return texts.select("__h", F.explode(words).alias("term")).where(F.char_length("term") >= TERM_CHARS)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(base: DataFrame) -> DataFrame:
    """The first row of every different text."""
    copied = stored(base.groupBy("__h").agg(F.min("__uid").alias("__one"), F.count("*").alias("n")).where("n > 1").select("__h", "__one"))
    return base.join(_few(copied), "__h", "left").where("__one is null or __one = __uid").drop("__one")


def _set_of_texts() -> list[Column]:
    """What two entities, or two terms, that stand in the same different texts have in common."""
    return [F.bit_xor("__h").alias("s1"), F.bit_xor(F.xxhash64("__h", F.lit(1))).alias("s2")]


def disclosing(texts: DataFrame, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From different texts: the pairs (entity, lead) of classes that disclose, the terms (term, lead: of its class,
    n_t, n_held: texts with entities among them) and where they stand in texts with entities (__h, term). Written."""
    n = float(texts.count())
    counted = _terms(texts).groupBy("term").agg(F.count("*").alias("n_t"), *_set_of_texts())
    held = texts.where(F.size("__base") > 0)
    entities = held.select("__h", F.explode("__base").alias("s")).select("__h", _entity("s").alias("entity")).distinct()
    entities = stored(entities)
    classes = entities.groupBy("entity").agg(F.count("*").alias("n_e"), *_set_of_texts()).groupBy("n_e", "s1", "s2").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    entities = stored(entities.join(classes, "entity"))
    most = entities.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    # n_et is n_e or n_t at most, so a term in more texts can't reach p(e | t)
    likely = F.lit(2.0**-residual - 1e-9)
    near = _terms(held).join(counted.where(F.lit(most) >= likely * (F.col("n_t") + UNSEEN)), "term")
    near = stored(near)
    terms = near.groupBy("term", "n_t", "s1", "s2").agg(F.count("*").alias("n_held"))
    terms = stored(terms.join(terms.groupBy("n_t", "s1", "s2").agg(F.min("term").alias("lead")), ["n_t", "s1", "s2"]).select("term", "lead", "n_t", "n_held"))
    leads = near.select("__h", "term", "n_t").join(terms.where("term = lead").select("term"), "term", "left_semi").withColumnRenamed("term", "lead")
    at_most = F.least("n_e", "n_t") >= likely * (F.col("n_t") + UNSEEN)
    pairs = leads.join(entities, "__h").where(at_most).groupBy("entity", "lead", "n_e", "n_t").agg(F.count("*").alias("n_et"))
    p = F.col("n_et") / (F.col("n_t") + UNSEEN)
    ic = F.log2(F.lit(n) / F.col("n_e"))
    pairs = pairs.where((p >= likely) & (ic > 0) & (ic + F.log2(p) >= ic * disclosure - 1e-9))
    return stored(pairs.select("entity", "lead")), terms, near.select("__h", "term")


def removed(pairs: DataFrame, terms: DataFrame, general: DataFrame | None = None) -> DataFrame:
    """term, put (the general term, or null) of every disclosing term, and whether it stands in texts without entities (elsewhere). Written."""
    own = terms.join(pairs.select("lead").distinct(), "lead").select("term", "lead", (F.col("n_t") > F.col("n_held")).alias("elsewhere"))
    own = stored(own)
    spark = pairs.sparkSession
    of = (general_terms(spark) if general is None else general).select(F.lower("term").alias("term"), F.col("general").alias("put")).groupBy("term").agg(F.min("put").alias("put"))
    # a term is only generalised if the more general one discloses no entity that it discloses itself
    can = own.join(of, "term").select("term", "lead", "put")
    worse = can.withColumn("__put", F.lower("put")).join(terms.select(F.col("term").alias("__put"), F.col("lead").alias("__lead")), "__put")
    worse = worse.join(pairs, "lead").join(pairs.select(F.col("entity").alias("__e"), F.col("lead").alias("__lead")), "__lead").where(F.col("entity") == F.col("__e"))
    can = can.join(worse.select("term").distinct(), "term", "left_anti").select("term", "put")
    return stored(own.select("term", "elsewhere").join(can, "term", "left"))


def all_spans(docs: DataFrame, general: DataFrame | None = None, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """doc_id, row key, __base and __terms (start, end, put: the general term or null) of every row."""
    base = find(docs)
    texts = _texts(base)
    pairs, terms, near = disclosing(texts, disclosure, residual)
    gone = removed(pairs, terms, general)
    hits = near.join(_few(gone.select("term", "put")), "term")
    more = gone.where("elsewhere").select("term", "put")
    if not more.isEmpty():
        hits = hits.unionByName(_terms(texts.where(F.size("__base") == 0)).join(_few(more), "term").select(*hits.columns))
    hits = stored(hits)
    # places are only looked for in different texts that hold such terms, and then given to their copies
    some = texts.join(_few(hits.select("__h").distinct()), "__h", "left_semi").select("__h", F.explode(found(F.col("__rest"), TERM)).alias("t"))
    some = some.select("__h", "t.start", "t.end", F.lower("t.value").alias("term")).join(_few(hits), ["__h", "term"])
    places = stored(some.groupBy("__h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "put"))).alias("__terms")))
    spans = places.agg(F.coalesce(F.sum(F.size("__terms") + 1), F.lit(0))).first()[0]
    return base.select("doc_id", *KEY, "__h", "__base").join(F.broadcast(places) if spans <= BROADCAST_ROWS else places, "__h", "left").drop("__h")


def report(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row."""
    rows = all_spans(docs, disclosure=disclosure)
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    base = F.transform("__base", lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"]))
    more = F.coalesce(F.transform("__terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), F.array().cast("array<string>"))
    rows = rows.select("doc_id", "__base", base.alias("b"), more.alias("m"))
    of_kind = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [of_kind(k) for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(F.array_join("b", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat("b", "m"), ",").alias("spans"), F.size("m").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, general: DataFrame | None = None, disclosure: float = DISCLOSURE) -> DataFrame:
    """`docs` with base spans replaced by their kind in brackets, and disclosing terms by general ones or [TERM]; n_chars follows."""
    rows = all_spans(docs, general, disclosure)
    base = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")).alias("put")))
    more = F.transform("__terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["put"], F.lit("[TERM]")).alias("put")))
    some = rows.select(*KEY, F.array_sort(F.concat(base, F.coalesce(more, F.array().cast("array<struct<start: int, end: int, put: string>>")))).alias("__all"))
    some = some.where(F.size("__all") > 0).groupBy(*KEY).agg(F.first("__all").alias("__all"))
    names = docs.columns

    text = _replaced(F.col("text"), F.col("__all"), lambda s, pos: F.when(s["end"] > pos, s["put"]).otherwise(""))
    own = [c for c in ("doc_id", "text", "n_chars") if c in names]
    plain = F.coalesce("text", F.lit(""))
    out = hidden(docs, own).withColumns({"__k1": F.xxhash64("doc_id", plain), "__k2": F.xxhash64(plain, "doc_id")}).join(some, KEY, "left").withColumn("__new", F.when(F.col("__all").isNotNull(), text))
    out = out.withColumn("text", F.coalesce("__new", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__new").isNotNull(), F.char_length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return shown(out, names, own)


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """The base patterns as the contract writes them, for tests."""
    import re

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out
