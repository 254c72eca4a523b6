"""Repair, classes and loose equality of callouts: literal cases, and the rule tables against a plain interpreter over random texts."""

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millwright.functions import geometry as G, repair as R, text as X
from millwright.functions.rules import First, Swap, apply

REPAIRED = [
    ("", ""), ("12", "12"), ("10.5", "10.5"), (".800", "0.800"), ("3/4", "3/4"), ("0.5±0.1", "0.5±0.1"), ("45°", "45°"), ("45º", "45°"), ("  7 ", "7"),
    ("MJ5x0.8, 4h6h", "MJ5x0.8 4h6h"), ("4 DIA", "4 DIA"), ("MAJOR  DIA 4,85", "MAJOR DIA 4.85"), ("B2  0,5x45", "B2 0.5x45"),
    ("4ø1A", "4 DIA"), ("4·1A", "4 DIA"), ("Ø5Ø", "5"), ("Ø5", "5"), ("Ø52.28", "Ø52.28"), ("Φ52.28", "Ø52.28"), ("O/12.5", "Ø12.5"), ("O10", "Ø10"),
    ("052.28", "Ø52.28"), ("0204.98", "Ø204.98"), ("0.40h8", "Ø40 h8"), ("\ufffd63.1", "Ø63.1"), ("2\ufffd45", "2×45"), ("30\ufffd", "30°"),
    ("L9°(REF)", "9°(REF)"), ("L19", "L19"), ("9 REF", "9 (REF)"), ("9°(REF)", "9°(REF)"), ("3.5F", "3.5R"), ("1 23", "1.23"), ("5x45", "5×45"), ("5 X 45", "5×45"),
    ("+ - 0.1", "± 0.1"), ("+/-0.1", "±-0.1"), ("[-12.5]", "12.5"), ("r 5.2", "R5.2"), ("m 10", "M10"), ("2O5", "205"), ("·5", "0.5"), ("5·2", "5.2"), ("NOTE", "NOTE"), ("日本", ""), (None, None),
]
CLASSES = [
    ("Ø.800±.001", "tolerance"), ("0.5x45°", "chamfer"), ("M10x1.5", "thread"), ("10.0/9.8", "numeric_pair"), ("M10×1.5", "numeric"), ("R72.55", "radius"), ("59.50 mm", "numeric"), ("(08)", "numeric"),
    ("4 DIA", "diameter"), ("1,2", "coordinate"), ("+X", "coordinate"), ("30 deg", "angle"), ("9 REF", "reference"), ("3.2 RA", "surface_finish"), ("1:10", "taper"), ("NOTE", "unknown"), ("", "unknown"), (None, "unknown"),
]
EQUAL = [
    ("Ø63", "Ø63.1", True), ("63", "63.1", True), ("(8)", "8", True), ("Ø0.2", "0.2(", False), ("Ø2", "2(", True), ("45°", "45", False), ("145°", "145", True), ("MAJOR DIA 4.85", "4.85", True), ("14.85", "4.85", False),
    ("ALL AROUND", "ALL AROUND PROFILE", True), ("ALL", "ALL AROUND PROFILE", False), ("PROFILE OUTER", "OUTER PROFILE", True), ("", "", False), (None, "1", False), ("NO_DIMENSION", "NO_DIMENSION", False), ("12", "1", False), ("R5TYP", "R5 TYP", True), ("2X45°", "2×45°", True),
]


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_repair_of_literal_cases(spark):
    assert one(spark, [a for a, _ in REPAIRED], R.repair_text) == [b for _, b in REPAIRED]


def plain(rules, text):
    """The table read one rule after another."""
    holds = lambda g, t: bool(regex.search(g, t)) if isinstance(g, str) else sum(c.isdigit() for c in t) >= max(1, sum(c.isalpha() for c in t))
    ok = lambda r, t, some: (not r.when or (any if some else all)(holds(g, t) for g in r.when)) and not any(holds(g, t) for g in r.unless)
    put = lambda r, t: regex.sub(r.pattern, regex.sub(r"\$(\d)", r"\\g<\1>", r.put), t)
    for r in rules:
        if isinstance(r, Swap):
            text = put(r, text) if ok(r, text, False) else text
        elif isinstance(r, First):
            text = next((put(s, text) for s in r.swaps if ok(s, text, False)), text)
        elif ok(r, text, True):
            return plain(r.rules, text)
    return text


def test_tables_are_read_in_order(spark):
    rng = np.random.default_rng(3)
    parts = ["Ø", "ø", "O", "Q", "L", "0", "05", "12", ".5", "1", " ", "  ", "x", "X", "×", "°", "º", "+", "-", "/", "±", "(REF)", "REF", "DIA", "MAJOR", "MJ5", "MJS", "h", "H6", "g", "G", "b", "B2", "R", "r", "F", "·", "[", "]", "\ufffd", ",", "4h6h", "Φ", "O/", "ä¸", "é"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 7)))) for _ in range(1500)]
    want = [plain(R.AFTER, plain((R._OTHERWISE,), plain(R.BEFORE, t))) for t in texts]
    assert one(spark, texts, R.repair_text) == want and sum(a != b for a, b in zip(texts, want, strict=True)) > 600
    assert one(spark, ["Ã©Â°5", "Ã\x9812Â°"], R.repair_text)[1] == "Ø12°"


def test_rules_with_guards(spark):
    rules = (Swap("a", "b", when=("x",)), First((Swap("c", "d", when=("c",)), Swap("b", "z"))), Swap("d", "e", unless=("q",)))
    assert one(spark, ["ax", "a", "cb", "cbq", "", None], lambda c: apply(rules, c)) == ["zx", "a", "eb", "dbq", "", None]


def test_classes(spark):
    assert one(spark, [a for a, _ in CLASSES], X.semantic_class) == [b for _, b in CLASSES]


def test_loose_values(spark):
    df = spark.createDataFrame(EQUAL, "d string, e string, want boolean")
    assert [(r.d, r.e, r.got) for r in df.select("*", X.loose_match(F.col("d"), F.col("e")).alias("got")).collect()] == EQUAL


@pytest.mark.parametrize("dx,dy,want", [(10, 0, -40), (10, 10, -20), (4, 10, -5), (0, 10, 0), (-4, 10, 25), (-10, 1, 55), (0.5, 0, 0)])
def test_directions(spark, dx, dy, want):
    got = spark.range(1).select(G.direction_score(*map(F.lit, (float(dx), float(dy), 1.0, 0.0))).alias("s")).first().s
    assert got == want


def test_penalties(spark):
    f = lambda c: spark.range(1).select(c.alias("s")).first().s
    lit = lambda *v: map(F.lit, v)
    assert f(G.weak_direction_score(*lit(-100.0, 0.0))) == 10 and f(G.weak_direction_score(*lit(1.0, 900.0))) == 20 and f(G.weak_direction_score(*lit(5.0, 5.0))) == 0
    assert f(G.class_score(*lit("radius", "R5", "radius"))) == -30 and f(G.class_score(*lit("unknown", " x", "mixed"))) == 72 and f(G.class_score(*lit("numeric", "12", "numeric"))) == -5
    assert [f(G.shape_penalty(*lit(0.0, 0.0, w, 100.0))) for w in (10.0, 91.0, 200.0)] == [0, 8, 18]
    assert [f(G.density_penalty(F.lit(n))) for n in (0, 1, 2, 50)] == [0, 0, 1.6, 10]
