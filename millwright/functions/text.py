"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def label_concat(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("/"), F.coalesce(b, F.lit("")))


def ellipsis(c: Column) -> Column:
    return F.when(F.char_length(c) > 9, F.concat(F.substring(c, 1, 5), F.lit("..."), F.right(c, F.lit(4)))).otherwise(c)


def date_text(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.coalesce(F.date_format(c, pattern), F.lit(""))


def split_trim(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def parse_serials(c: Column) -> Column:
    """A JSON array if it is one, else a comma list without empty entries; null gives an empty list."""
    listed = F.filter(split_trim(c), lambda x: x != "")
    parsed = F.when(F.trim(c).startswith("[") & F.trim(c).endswith("]"), F.from_json(c, "array<string>"))
    return F.coalesce(parsed, listed, F.array().cast("array<string>"))


def list_remove(c: Column, value: str) -> Column:
    return F.array_join(F.array_remove(F.split(c, ","), value), ",")


#: Reply and forward prefixes in the order in which they are taken off.
PREFIXES = ("re:", "fw:", "fwd:")


def clean_subject(c: Column) -> Column:
    """Prefixes are taken off one kind after another, so 'FW: RE: x' leaves 'RE: x'; white space becomes single."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    for p in PREFIXES:
        out = F.trim(F.regexp_replace(out, rf"(?i)^({p}\s*)+", ""))
    return out


#: Symbols of dimensions and how they are written after normalisation.
SYMBOLS = ((",", "."), ("Ø", "DIA"), ("Ų", "DIA"), ("Φ", "DIA"), ("⌀", "DIA"), ("×", "X"), ("°", "DEG"), ("±", "+/-"))
#: What goes then, in this order: white space, a unit at the end, zeros before a point, a zero behind it.
SHAPES = ((r"\s+", ""), ("MM$", ""), (r"^DIA0\.", "DIA."), (r"^0\.", "."), (r"\.0$", ""))


def normalize_dimension(c: Column) -> Column:
    """Upper case, one writing for each symbol, no white space, no unit at the end; null and NO_DIMENSION are empty."""
    c = F.when(c == "NO_DIMENSION", "").otherwise(F.upper(F.coalesce(c, F.lit(""))))
    for a, b in SYMBOLS:
        c = F.replace(c, F.lit(a), F.lit(b))
    for a, b in SHAPES:
        c = F.regexp_replace(c, a, b)
    return c


#: Kinds of callouts with their patterns, first match first.
GRAMMAR = (
    ("chamfer", r"^[0-9.]+\s*[X×]\s*45°?$"),
    ("thread", r"^M[0-9]+"),
    ("diameter", r"^Ø"),
    ("radius", r"^R[0-9.]"),
    ("angle", r"^[0-9.]+°$"),
    ("tolerance", r"±"),
    ("pair", r"^[0-9.]+/[0-9.]+$"),
    ("numeric", r"^[0-9]*\.?[0-9]+( ?MM)?$"),
)


def grammar_class(c: Column) -> Column:
    up = F.upper(F.trim(c))
    out = F.when(F.lit(False), "")
    for name, pattern in GRAMMAR:
        out = out.when(up.rlike(pattern), name)
    return out.otherwise("other")


def bubble_id(c: Column) -> Column:
    """Without parentheses and leading zeros, never empty."""
    bare = F.regexp_replace(F.trim(c), r"[()]", "")
    return F.when(bare.rlike("^0+$"), "0").otherwise(F.regexp_replace(bare, "^0+", ""))


#: Words that say nothing in a search.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def keywords(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[ ,.!?]"), lambda w: (w != "") & ~w.isin(list(STOP_WORDS)))


def sha256_dashed(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.sha2(F.encode(c, "UTF-8"), 256)), "(..)(?!$)", "$1-")


def duration_text(seconds: Column) -> Column:
    """hh:mm:ss; hours begin anew after a day."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; equal empty texts have 1."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(F.lit(1.0))


def value_match(detected: Column, expected: Column) -> Column:
    """Equal after normalisation, also without parentheses or the sign of a diameter; or the detected value holds the
    expected one of three characters or more, or is its whole-number part. Empty values match nothing."""
    d, e = normalize_dimension(detected), normalize_dimension(expected)
    bare = lambda x: F.regexp_replace(x, "[()]", "")
    plain = lambda x: F.regexp_replace(bare(x), "^DIA", "")
    same = (d == e) | (bare(d) == bare(e)) | ((plain(d) != "") & (plain(d) == plain(e)))
    part = plain(d).rlike("^[0-9]+$") & F.startswith(plain(e), F.concat(plain(d), F.lit(".")))
    return (d != "") & (e != "") & (same | ((F.char_length(e) >= 3) & F.contains(d, e)) | part)


#: Classes of callouts with the patterns of their upper-case text, first match first.
SEMANTICS = (
    ("numeric_pair", r"^[0-9]+(\.[0-9]+)?/[0-9]+(\.[0-9]+)?$"),
    ("tolerance", r"±|\+-|\+ -"),
    ("thread", r"[0-9]+h[0-9]+h|MJ?[0-9]+x[0-9]|M[0-9]+X[0-9]"),
    ("chamfer", r"[0-9]+(\.[0-9]+)?[xX][0-9]+°|[0-9]+°\s*CHAMFER"),
    ("coordinate", r"\+X|-Y|[0-9]+,[0-9]+"),
    ("diameter", r"Ø|[0-9]+\s*DIA|DIAM\s*[0-9]+|\[[0-9]+"),
    ("radius", r"R[0-9]+|[0-9]+R|RADIUS\s*[0-9]+"),
    ("angle", r"[0-9]+°|[0-9]+\s*DEG"),
    ("reference", r"[0-9]+\(REF\)|[0-9]+\s*REF|REF\s*[0-9]+"),
    ("surface_finish", r"[0-9]+\s*RA|RA\s*[0-9]+"),
    ("taper", r"[0-9]+:[0-9]+|[0-9]+(\.[0-9]+)?%"),
    ("numeric", r"[0-9]"),
)


def semantic_class(c: Column) -> Column:
    """The class of a callout; "unknown" for a text without digits or signs, and for null."""
    up, out = F.upper(c), F.when(F.lit(False), "")
    for name, pattern in SEMANTICS:
        out = out.when(up.rlike(pattern), name)
    return out.otherwise("unknown")


#: How a value is written for loose comparison, in this order. A group number is behind each $.
LOOSE = (
    (r"\s+", " "), (",", "."), ("Ø|⌀", "DIA"), ("°", "DEG"), ("×", "X"),
    (r"([0-9])\s*DIA\b", "$1 DIA"), (r"([0-9])\s*([HGF][0-9]+)\b", "$1 $2"), (r"(R[0-9]+(?:\.[0-9]+)?)\s*(TYP)\b", "$1 $2"),
    (r"(MJ?[0-9]+X[0-9]+[.,][0-9]+)[,.]([0-9]+H[0-9]+H)", "$1 $2"), (r"\s*/\s*", "/"), (r"\b0+(\.[0-9])", "$1"), (r"([0-9])F\b", "$1R"),
    (r"^[-=–—]+\s*", ""), (r"\s*[-=–—]+$", ""), (r"\(+", "("), (r"\)+", ")"), (r"^L([0-9])", "$1"), (r"^Q(\.[0-9])", "DIA$1"), (r"\.$", ""), (r"\.0$", ""),
    (r"\s*MM$", ""), (r"([0-9])X([0-9])", "$1 X $2"), (r"DEG\s*TYP", "DEG TYP"), (r"([0-9])\s*X\s*([0-9])", "$1 X $2"), (r"^0([0-9]{2,})", "DIA$1"),
)
#: Words of an expected value of three or more that a detected one has, as a share, to be taken for it.
COVERAGE = 0.6


def loose_value(c: Column) -> Column:
    """Upper case, single spaces, one writing for each sign; null is empty. Spaces stay, so that words can be compared."""
    c = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    for pattern, put in LOOSE:
        c = F.regexp_replace(c, pattern, put)
    return c


def loose_match(detected: Column, expected: Column) -> Column:
    """Whether a detected value is as good as the expected one: equal, equal without parentheses, sign of a diameter or degrees, its
    whole-number part, holding it between word boundaries, or having its words, all or COVERAGE of three and more. Values that
    aren't there match nothing, and expected values of two characters only what equals them in the first of these ways."""
    from .rules import bound

    cut = lambda x, *patterns: F.trim(cut(F.regexp_replace(x, patterns[0], ""), *patterns[1:])) if patterns else x
    paren, dia, deg = "[()]", r"^DIA\s*", r"\s*DEG\s*$"
    same = lambda d, e: (d != "") & (d == e)
    whole = lambda d, e: d.rlike("^[0-9]+$") & F.startswith(e, F.concat(d, F.lit(".")))
    # a text holds a value as a whole if taking it out at word boundaries changes the text
    inside = lambda d, e: F.rlike(d, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), e, F.lit(r"\E(?![\p{L}\p{N}_])")))

    def of(p: Column) -> Column:
        d, e = p["d"], p["e"]
        dw, ew = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (d, e))
        both = F.size(F.array_intersect(dw, ew))
        words = (F.size(ew) > 0) & (both == F.size(ew))
        most = (F.size(ew) >= 3) & (both == F.size(dw)) & (both / F.size(ew) >= COVERAGE)
        first = (d == e) | whole(d, e) | same(cut(d, paren), cut(e, paren)) | same(cut(d, paren, dia), cut(e, paren, dia))
        loose = inside(d, e) | same(cut(d, deg), cut(e, deg)) | same(cut(d, dia), cut(e, dia)) | whole(cut(d, dia), cut(e, dia)) | words | most
        return first | ((F.char_length(e) > 2) & loose)

    found = F.coalesce(detected, F.lit(""))
    return (found != "") & (found != "NO_DIMENSION") & bound(F.struct(loose_value(detected).alias("d"), loose_value(expected).alias("e")), of)


#: What is a bubble's text, upper-case: one or two digits with a revision letter, three in parentheses, which may be cut off.
BUBBLE = r"^([0-9]{1,2}[A-G]?|\([0-9]{1,3}\)|\([0-9]{1,2}|[0-9]{1,2}\))$"
#: Upper-case texts that are no dimension though they hold a digit, but for those that name one; and what else is one.
PLAIN_WORD, NAMED, OTHER_NOISE, AXES = r"^[A-Z]+\s*[0-9]*$", "DIA|REF", r"^[\\|/<>{}\[\]]+$", r"\+X|-Y"


def mark_type(c: Column) -> Column:
    """bubble, dimension or keyword."""
    up = F.upper(F.trim(c))
    dimension = ~(up.rlike(PLAIN_WORD) & ~up.rlike(NAMED)) & ~up.rlike(OTHER_NOISE) & (up.rlike("[0-9]") | up.rlike(AXES))
    return F.when(up.rlike(BUBBLE), "bubble").when(dimension, "dimension").otherwise("keyword")


#: Upper-case texts of diameters and radii.
DIAMETER, RADIUS = r"Ø|[0-9]+\s*DIA|DIAM\s*[0-9]+", r"R[0-9]+|[0-9]+R|RADIUS\s*[0-9]+"


def is_diameter(c: Column) -> Column:
    return F.upper(c).rlike(DIAMETER)


#: Share of the larger value by which two values above each other may differ to be the limits of one.
SPREAD = 0.30


def independent_values(a: Column, b: Column) -> Column:
    """Unsigned numbers of 1 or more that aren't written with the same number of decimals, or differ by more than SPREAD."""
    number, decimals = r"^[0-9]+(\.[0-9]+)?$", lambda c: F.char_length(F.regexp_extract(c, r"\.([0-9]+)$", 1))
    x, y = a.try_cast("double"), b.try_cast("double")
    far = F.abs(x - y) / F.greatest(x, y, F.lit(1.0)) > SPREAD
    return F.coalesce(a.rlike(number) & b.rlike(number) & (x >= 1) & (y >= 1) & ((decimals(a) != decimals(b)) | far), F.lit(False))
