"""Passes in turn against loops over all pairs, on generated tokens and as queries."""

import math

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import claims as C, turns as T
from millwright.plans import spatial_queries as S
from millwright.plans.bindings import Tables
from millwright.registry import queries

FOLDER = "/root/testdata/sf0.001"
BOX = lambda dx, dy: abs(dx) < 80 and 5 < dy < 60


def loop(rows, passes):
    """rows: (group, key, x, y, ...); passes: (asks, gives, fits) on rows."""
    taken, out, groups = set(), [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for n, (asks, gives, fits) in enumerate(passes):
        pairs = sorted((a[1], b[1]) for own in groups.values() for a in own if asks(a) for b in own if a[1] != b[1] and gives(b) and fits(b[2] - a[2], b[3] - a[3]))
        for a, b in pairs:
            if not {a, b} & taken:
                taken |= {a, b}
                out.append((n + 1, a, b))
    return sorted(out)


def test_claims_in_turn_are_those_of_the_pass_over_all_pairs(spark):
    rng = np.random.default_rng(31)
    keys = rng.permutation(700).tolist()
    rows = [(int(rng.integers(3)), keys.pop(), float(rng.integers(-150, 150)), float(rng.integers(-90, 90)), int(rng.integers(3))) for _ in range(400)]
    rows += [(0, keys.pop(), *(at := [(3.0, 4.0), (3.0, 24.0), (3.5, -61.25)][k % 3]), k % 2) for k in range(90)]  # crowds at few places
    odd = [(0, keys.pop(), None, 1.0, 0), (None, keys.pop(), 1.0, 1.0, 0), (0, keys.pop(), float("nan"), 1.0, 0), (0, keys.pop(), float("inf"), 1.0, 1)]
    df = spark.createDataFrame([*rows, *odd], "g int, k long, x double, y double, v int").repartition(5)
    near = lambda dx, dy: math.sqrt(dx * dx + dy * dy) <= 90
    passes = [T.Pass(F.col("v") < 2, F.col("v") == 2, **T.within(90.0)), T.Pass(F.col("v") < 2, F.col("v") < 2, BOX, (-80.0, 80.0), (0.0, 60.0))]
    want = loop(rows, [(lambda r: r[4] < 2, lambda r: r[4] == 2, near), (lambda r: r[4] < 2, lambda r: r[4] < 2, BOX)])
    for size in ("7", "10000"):  # groups go on from batch to batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = T.claim_in_turn(df, "g", "k", "x", "y", passes, ["v"]).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["pass"], r.a, r.b) for r in got) == want and {r["pass"] for r in got} == {1, 2} and len(got) > 150
        value = {r[1]: r[4] for r in rows}
        assert all((r.a_v, r.b_v) == (value[r.a], value[r.b]) for r in got)
    assert T.claim_in_turn(df.limit(0), "g", "k", "x", "y", passes).count() == 0


def _tokens(spark):
    rows = S._tokens(Tables(spark, FOLDER)).select("drawing_id", "token_key", "cx", "cy", "text").collect()
    return rows, {r.token_key: r for r in rows}


def test_stack_pairs_take_one_job_and_are_those_of_the_pass(spark, monkeypatch):
    monkeypatch.setattr(C, "stored", None)  # before, rounds of stored tables
    rows, at = _tokens(spark)
    number = lambda r: r[4] in ("10.0/9.8", "59.50 mm", "R72.55")
    want = loop(rows, [(number, number, lambda dx, dy: abs(dx) < 80 and 5 < abs(dy) < 60)])
    want = sorted((a, b) if at[a].cy < at[b].cy else (b, a) for _, a, b in want)
    got = queries()["stack_pairs"](spark, FOLDER).collect()
    assert sorted((r.top_key, r.bottom_key) for r in got) == want and len(want) > 50
    assert all(r.text == f"{at[r.top_key].text}/{at[r.bottom_key].text}" for r in got)


def test_priority_claims_take_one_job_and_are_those_of_the_passes(spark, monkeypatch):
    monkeypatch.setattr(C, "stored", None)  # before, all pairs in reach were listed and stored
    rows, _ = _tokens(spark)
    number = lambda r: r[4] in ("10.0/9.8", "59.50 mm", "R72.55")
    want = loop(rows, [(number, lambda r: "±" in r[4], lambda dx, dy: math.sqrt(dx * dx + dy * dy) <= 90), (number, number, BOX)])
    got = sorted((r["pass"], r.x, r.y) for r in queries()["priority_claim"](spark, FOLDER).collect())
    assert got == want and {r[0] for r in got} == {1, 2}
