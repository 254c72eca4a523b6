"""Pairs in reach by a sweep, against loops over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import sweep as W
from millwright.registry import queries

FOLDER = "/root/testdata/sf0.001"


def test_pairs_of_a_sweep_are_all_pairs_in_reach(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 50)
    rng = np.random.default_rng(41)
    rows = [(int(rng.integers(3)), float(x), float(y), int(k % 3), k) for k, (x, y) in enumerate(rng.integers(-40, 60, (260, 2)))]
    rows += [(0, -1e-20, 0.0, 0, 900), (0, 10.0, 0.0, 1, 901), (0, 0.0, -1e-20, 0, 902), (0, 0.0, 10.0, 1, 903), *[(1, 5.0, 5.0, k % 3, 910 + k) for k in range(8)]]
    odd = [(0, None, 1.0, 0, 950), (None, 1.0, 1.0, 1, 951), (0, float("nan"), 1.0, 2, 952), (0, 1.0, float("inf"), 2, 953)]
    df = spark.createDataFrame([*rows, *odd], "g int, x double, y double, v int, k long").repartition(4)
    near = lambda dx, dy: np.sqrt(dx * dx + dy * dy) <= 10
    below = lambda dx, dy: (np.abs(dx) < 8) & (dy > 2) & (dy < 9)
    loop = lambda a_of, b_of, fits: sorted((a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[3] in a_of and b[3] in b_of and bool(fits(np.float64(b[1] - a[1]), np.float64(b[2] - a[2]))))
    for size in ("9", "10000"):  # groups and bands go on from batch to batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = W.pairs_in_reach(df, "g", "x", "y", F.col("v") == 0, F.col("v") > 0, (10.0, 10.0), near, ["k"]).collect()
            assert sorted((r.a_k, r.b_k) for r in got) == loop({0}, {1, 2}, near) and (900, 901) in {(r.a_k, r.b_k) for r in got}
            at = {r[4]: r for r in rows}
            assert all((r.g, r.a_x, r.a_y, r.b_x, r.b_y) == (*at[r.a_k][:3], *at[r.b_k][1:3]) for r in got)
            got = W.pairs_in_reach(df, "g", "x", "y", F.col("v") < 2, F.col("v") > 0, (8.0, 9.0), below, ["k"], downwards=True, places=False).collect()
            assert sorted((r.a_k, r.b_k) for r in got) == loop({0, 1}, {1, 2}, below) and len(got) > 60
            got = W.pairs_in_reach(df, "g", "x", "y", F.col("v") == 0, F.col("v") > 0, (10.0, 10.0), near, ["v"], distinct=True).collect()
            want = {(a[0], *a[1:3], *b[1:3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[3] == 0 < b[3] and near(np.float64(b[1] - a[1]), np.float64(b[2] - a[2]))}
            assert sorted((r.g, r.a_x, r.a_y, r.b_x, r.b_y, r.b_v) for r in got) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert W.pairs_in_reach(df.limit(0), "g", "x", "y", F.col("v") == 0, F.col("v") > 0, (10.0, 10.0), near, ["k"]).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stacked_candidates_move_once(spark):
    plan = _plan(queries()["stack_pairs_candidates"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # before, six copies of each token with its text were joined


def test_points_of_the_radius_join_move_once(spark):
    plan = _plan(queries()["radius_join"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # before, made distinct twice, and nine copies of each label were joined
