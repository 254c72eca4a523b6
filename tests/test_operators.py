"""Literal rows for the traps of the relational operators, and plans without nested loops."""

from decimal import Decimal

from pyspark.sql import functions as F

from millwright.functions import text as X
from millwright.operators import aggregates as A, filters as B, hierarchy as H, joins as J


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first().o


def test_serial_lists(spark):
    assert one(spark, None, X.parse_serials) == []
    assert one(spark, '["a","b"]', X.parse_serials) == ["a", "b"]
    assert one(spark, "[a,b", X.parse_serials) == ["[a", "b"]
    assert one(spark, " a ,, b ", X.parse_serials) == ["a", "b"]


def test_subject_prefixes_go_one_kind_after_another(spark):
    assert one(spark, "FW: RE: x", X.clean_subject) == "RE: x"
    assert one(spark, "re: RE:  a   b", X.clean_subject) == "a b"


def test_zero_means_all_drops_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "c int")
    assert B.zero_means_all(df, "c", 0).count() == 1


def test_milestones(spark):
    rows = [("a", 1, 33.33, 0), ("a", 2, 33.33, 0), ("a", 3, 0.0, 1), ("b", 1, 60.0, 0), ("b", 2, 60.0, 0), ("b", 3, 10.0, 0)]
    df = spark.createDataFrame(rows, "k string, n int, p double, l int").withColumns({"q": F.lit(10).cast("decimal(18,2)"), "p": F.col("p").cast("decimal(5,2)")})
    got = [r.allocated for r in A.allocate_milestones(df, ["k"], "n", "q", "p", "l").orderBy("k", "n").collect()]
    assert got == [Decimal(x) for x in ("3.33", "3.33", "3.34", "6.00", "4.00", "0.00")]


def test_value_match(spark):
    df = spark.createDataFrame([("DIA.800+/- .001", "Ø.800±.001", True), ("65.05", "65.05", True), ("59.5", "9(REF)", False)], "a string, b string, e boolean")
    assert all(r.g == r.e for r in df.select("e", X.value_match(F.col("a"), F.col("b")).alias("g")).collect())


def test_tree_ends_on_a_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "k int, p int")
    assert {(r.k, r.level) for r in H.tree(df, "k", "p").collect()} == {(1, 0), (2, 1), (3, 2)}


def test_no_nested_loops(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 500.0, 0.0)], "g int, px double, py double")
    b = spark.createDataFrame([(1, 3.0, 4.0)], "g int, ox double, oy double")
    near = J.radius_pairs(a, b, "g", 5.0)
    assert [r.dist for r in near.collect()] == [5.0]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_vectors_of_all_queries(spark, monkeypatch):
    import numpy as np

    from millwright import registry
    from millwright.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.35, 4)]) for i in range(650)] + [(700, [0.0] * 4), (701, [0.0] * 4), (800, [9.0] * 4), (900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = set()
    for q, a in rows:
        if q % 100 == 0 and a:
            d = sorted((round(sum((np.float32(x).astype(float) - np.float32(y).astype(float)) ** 2 for x, y in zip(a, b)), 9), i) for i, b in rows if b and i != q)
            want |= {(q, i, round(x, 6)) for x, i in d[:5] if x <= 1}
    got = [(r.query_id, r.vec_id, round(r.dist, 6)) for r in vectors.nearest(df, df.where("vec_id % 100 = 0")).collect()]
    assert len(got) == len(want) and set(got) == want and len({q for q, _, _ in got}) > 5 and 800 not in {q for q, _, _ in got}
    assert "vector_search" in registry.queries()


def test_upsert_keeps_keys_unique(spark):
    from millwright.operators import changes as C

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 5, 1), (1, "", 9, 2), (3, "c", None, 1), (3, "d", 7, 0)], "k int, v string, n int, at int")
    assert sorted(map(tuple, C.upsert(base, new, "k", ["v", "n"], "at").collect())) == [(1, "a", 9), (2, "b", 2), (3, "c", None)]
    assert C.upsert(base, new, "k", ["v", "n"]).count() == 3 and C.upsert(base, new.limit(0), "k", ["v", "n"]).count() == 2


def test_pairs_whose_rounded_distance_is_the_radius_are_kept(spark):
    import math

    at = [k * 60.0 + e for k in (-2, -1, 0, 1, 2) for e in (0.0, 1e-20, -1e-20, 1e-14, -1e-14, 12.0, 24.0)] + [1e17, 1e17 + 64]
    places = [(x, y) for x in at for y in (0.0, -1e-20, 36.0, 60.0)]
    near = lambda p, o: math.sqrt((p[0] - o[0]) * (p[0] - o[0]) + (p[1] - o[1]) * (p[1] - o[1])) <= 60
    want = sorted((*p, *o) for p in places for o in places if near(p, o))
    a, b = (spark.createDataFrame([(1, *p) for p in places], f"g int, {c}x double, {c}y double") for c in "po")
    got = sorted((r.px, r.py, r.ox, r.oy) for r in J.radius_pairs(a, b, "g", 60.0).collect())
    assert got == want and (-1e-20, 0.0, 60.0, 0.0) in got  # before, two cells apart
