"""The vector index against exact search, and regression: leaderboard, saved model, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import regression as R, vector_index as V
from millwright.operators.vectors import nearest


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 24))
    rows = [(k, [float(x) for x in centres[0 if k % 3 == 0 else k % 25] + rng.normal(size=24) * 0.7], 1) for k in range(2600)]
    rows += [(9000, rows[5][1], 2), (9001, None, 1), (9002, [], 1), (9003, [float("nan")] * 24, 1), (9004, [1.0] * 7, 1), (None, rows[6][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int").repartition(3)


def test_index_finds_what_exact_search_finds(vectors, monkeypatch):
    good = V.usable(vectors).where("size(embedding) = 24")
    queries = good.where("vec_id % 20 = 0")
    exact = nearest(good, queries, 5, float("inf")).collect()
    centres = V.fit(good)
    assert 45 <= len(centres) <= 51
    indexed = V.index(vectors, centres)
    assert indexed.count() == good.count()
    pairs = lambda rows: {(r.query_id, r.vec_id) for r in rows}
    got = V.search(indexed, vectors.where("vec_id % 20 = 0"), centres, most=float("inf")).collect()
    assert len(pairs(got) & pairs(exact)) / len(exact) >= 0.9 and len(got) == len(exact)
    monkeypatch.setattr(V, "BLOCK", 200)  # hot lists in many blocks
    monkeypatch.setattr(V, "QUERIES", 30)
    all_lists = V.search(indexed, queries, centres, most=float("inf"), probes=len(centres)).collect()
    assert sorted((r.query_id, r.vec_id, round(r.dist, 6)) for r in all_lists) == sorted((r.query_id, r.vec_id, round(r.dist, 6)) for r in exact)
    near = V.search(indexed, queries, centres, most=12.0).collect()
    assert near and all(r.dist <= 12 for r in near) and V.search(indexed, queries.limit(0), centres).count() == 0


def test_leaderboard_and_saved_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 9, (600, 3))
    rows = [(k, *(None if (k + j) % 11 == 0 else float(v) for j, v in enumerate(r)), float(3 * r[0] + 2 * r[1] + 10)) for k, r in enumerate(x)] + [(900, 1.0, 1.0, 1.0, None), (901, 1.0, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, label double")
    trials = (R.Trial("Tree", {"maxDepth": 2}), R.Trial("Linear"), R.Trial("Tree", {"maxDepth": 6}), R.Trial("Linear", {"regParam": -1.0}))
    board, best = R.leaderboard(df, ["a", "b", "c"], ["k"], trials)
    got = board.orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3, 4] and got[0].trial == 1 and got[0].r2 > 0.7 and got[3].r2 is None and got[3].trial == 3
    assert [r.r2 for r in got[:3]] == sorted((r.r2 for r in got[:3]), reverse=True)
    path = R.save(best, f"file://{tmp_path}/model")
    df.select("k", "a", F.when(F.col("k") % 7 == 0, "n/a").otherwise(F.col("b").cast("string")).alias("b")).write.option("header", True).csv(f"file://{tmp_path}/rows")
    scored = {int(r.k): r.prediction for r in R.score_csv(path, f"file://{tmp_path}/rows", ["k"], ["a", "b", "c"]).collect()}
    plain = {r.k: r.prediction for r in best.transform(df.select("k", "a", F.when(F.col("k") % 7 != 0, F.col("b")).alias("b"), F.lit(None).cast("double").alias("c"))).collect()}
    assert len(scored) == 602 and all(scored[k] == pytest.approx(plain[k]) for k in plain)


def test_what_trials_share_is_made_once_and_scores_are_the_evaluators(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator

    fits, real = [], R.Imputer._fit
    monkeypatch.setattr(R.Imputer, "_fit", lambda self, d: fits.append(1) or real(self, d))
    df = spark.createDataFrame([(k, None if k % 7 == 0 else k % 13 + 0.5, float(k % 13 * 3 + k % 5)) for k in range(300)], "k long, a double, label double")
    board, best = R.leaderboard(df, ["a"], ["k"], (R.Trial("Linear"), R.Trial("Tree", {"maxDepth": 3}), R.Trial("Tree", {"maxDepth": 1})))
    assert len(fits) == 1  # before, one for each trial
    train, valid = R.split(df, ["k"])
    for r in board.collect():
        model = R.Trial(r.trainer, dict(eval(r.params))).pipeline(["a"]).fit(train).transform(valid)
        want = [RegressionEvaluator(metricName=m, labelCol="label").evaluate(model) for m in ("r2", "rmse")]
        assert [r.r2, r.rmse] == pytest.approx(want, rel=1e-9)
    nothing = df.withColumn("a", F.lit(None).cast("double"))
    board, best = R.leaderboard(nothing, ["a"], ["k"], (R.Trial("Linear"),))
    assert best is None and board.first().r2 is None


def test_trainers_read_stored_rows_not_the_joins(spark):
    from millwright.plans.bindings import Tables
    from millwright.registry import queries

    folder = "/root/testdata/sf0.001"
    got = queries()["gbt_train_predict"](spark, folder)
    assert "lineitem" not in " ".join(got.inputFiles())
    held = Tables(spark, folder).lineitem.where("l_orderkey % 5 = 0")
    assert got.count() == held.count() and got.select("l_orderkey", "l_linenumber").exceptAll(held.select("l_orderkey", "l_linenumber")).isEmpty()


def test_all_models_score_in_one_pass_and_a_broken_one_takes_only_itself_out(spark, monkeypatch):
    df = spark.createDataFrame([(k, None if k % 7 == 0 else k % 13 + 0.5, float(k % 13 * 3 + k % 5)) for k in range(300)], "k long, a double, label double")
    trials, passes, real = (R.Trial("Linear"), R.Trial("Tree", {"maxDepth": 3}), R.Trial("Tree", {"maxDepth": 1})), [], R.scores
    monkeypatch.setattr(R, "scores", lambda vectors, models: passes.append(len(models)) or real(vectors, models))
    whole = R.leaderboard(df, ["a"], ["k"], trials)[0].collect()
    assert passes == [3]  # before, one for each trial, of cached rows

    def breaks(vectors, models):
        if 0 in models:
            raise ValueError
        return real(vectors, models)

    monkeypatch.setattr(R, "scores", breaks)
    board, best = R.leaderboard(df, ["a"], ["k"], trials)
    got = {r.trial: r.r2 for r in board.collect()}
    assert got == {r.trial: None if r.trial == 0 else pytest.approx(r.r2) for r in whole} and best is not None


def test_csv_numbers_are_read_as_numbers(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 9 + 0.5, float(k % 4), float(k % 9 * 2 + k % 4)) for k in range(200)], "k long, a double, `b c` double, label double")
    path = R.save(R.Trial("Linear").pipeline(["a", "b c"]).fit(df), f"file://{tmp_path}/model")
    (tmp_path / "rows.csv").write_text('x,b c,k,a\nq,2,1,1.5\n"a,b",3,2,n/a\nq,,3,1e0\nq,1,4\n,NaN,5, 2.5\n"q",7,006,"3"\n')
    scored = R.score_csv(path, f"file://{tmp_path}/rows.csv", ["k"], ["a", "b c"])
    mean = [df.agg(F.avg(f"`{c}`")).first()[0] for c in ("a", "b c")]
    want = {"1": (1.5, 2.0), "2": (mean[0], 3.0), "3": (1.0, mean[1]), "4": (mean[0], 1.0), "5": (2.5, mean[1]), "006": (3.0, 7.0)}
    assert {r.k: r.prediction for r in scored.collect()} == {k: pytest.approx(2 * a + b - 1, abs=1e-6) for k, (a, b) in want.items()}
    assert "a:double" in scored._jdf.queryExecution().toString()  # before, strings and a cast for each


def test_small_tasks_end_with_their_block(spark, tmp_path):
    from millwright.operators.lineage import small_tasks

    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    with pytest.raises(ValueError), small_tasks(spark):
        assert int(spark.conf.get(name)) >= 4 * spark.sparkContext.defaultParallelism
        raise ValueError
    assert spark.conf.get(name, None) == before


def test_engine_learns_all_of_the_originals_trees(spark, monkeypatch):
    from millwright.registry import queries

    class Asked(Exception):
        pass

    def asked(self, features):
        raise Asked(self)

    monkeypatch.setattr(R.Trial, "pipeline", asked)
    with pytest.raises(Asked) as e:
        queries()["gbt_train_predict"](spark, "/root/testdata/sf0.001")
    model = e.value.args[0].estimator()
    assert (model.getMaxIter(), model.getMaxDepth(), model.getMinInstancesPerNode(), model.getMaxBins()) == (485, 6, 126, 1022)  # before, 8 trees of depth 4 with 32 bins
    assert spark.sparkContext.getCheckpointDir()


def test_a_step_of_one_half_is_the_whole_error(spark):
    df = spark.createDataFrame([(k, float(k % 16), float((k % 16) ** 2)) for k in range(160)], "k long, a double, label double")
    error = lambda step: R.Trial("FastTree", {"maxIter": 12, "maxDepth": 2, "stepSize": step}).pipeline(["a"]).fit(df).transform(df).agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error(0.5) < 0.2 * error(1.0)


def test_a_search_makes_the_originals_number_of_trials(spark, monkeypatch):
    from collections import Counter

    assert len(R.TRIALS) == 60 == len({(t.trainer, str(t.params)) for t in R.TRIALS})  # before, 8
    assert Counter(t.trainer for t in R.TRIALS) == {"Linear": 10, "Poisson": 8, "Tweedie": 11, "Tree": 2, "FastForest": 10, "FastTree": 19}
    df = spark.createDataFrame([(k, k % 13 + 0.5, float(k % 13 * 3 + k % 5)) for k in range(120)], "k long, a double, label double")
    board, best = R.leaderboard(df, ["a"], ["k"], [t for t in R.TRIALS if t.trainer == "Tweedie"][:2])
    assert all(r.r2 > 0.5 for r in board.collect())
