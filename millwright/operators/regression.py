"""Regression on feature columns: a pipeline that fills missing values, a search over trials with a leaderboard, a saved model that scores files."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .lineage import checkpoints, shared_dir, small_tasks, stored

TRAINERS = {
    "FastTree": GBTRegressor, "FastForest": RandomForestRegressor, "Tree": DecisionTreeRegressor, "Linear": LinearRegression, "Poisson": GeneralizedLinearRegression, "Tweedie": GeneralizedLinearRegression,
}


@dataclass(frozen=True)
class Trial:
    trainer: str
    params: dict = field(default_factory=dict)

    def estimator(self) -> Estimator:
        fixed = {"family": "poisson", "link": "log"} if self.trainer == "Poisson" else {"family": "tweedie"} if self.trainer == "Tweedie" else {"seed": 7} if self.trainer in ("FastTree", "FastForest", "Tree") else {}
        return TRAINERS[self.trainer](featuresCol="__features", labelCol="label", **fixed, **self.params)

    def pipeline(self, features: Sequence[str]) -> Pipeline:
        """Missing values (null or NaN) become the column's mean, features one vector, then the trainer."""
        return Pipeline(stages=[*inputs(features), self.estimator()])


def inputs(features: Sequence[str]) -> list:
    full = [f"{c}__full" for c in features]
    return [Imputer(inputCols=list(features), outputCols=full), VectorAssembler(inputCols=full, outputCol="__features")]


#: The first of the trials: those of a short search.
FIRST = (
    Trial("Linear"), Trial("Linear", {"regParam": 10.0, "elasticNetParam": 0.5}), Trial("Poisson", {"maxIter": 10}), Trial("Tree", {"maxDepth": 4}), Trial("Tree", {"maxDepth": 8, "minInstancesPerNode": 20}),
    Trial("FastForest", {"numTrees": 8, "maxDepth": 6}), Trial("FastTree", {"maxIter": 5, "maxDepth": 4}), Trial("FastTree", {"maxIter": 8, "maxDepth": 5, "stepSize": 0.3}),
)
#: The trials that a search without others makes: 60, as many as the original's. Its history has 10 forests, 32 trials of boosted trees by three trainers, 8 of Poisson
#: and 10 of linear regression, and its parameters but for the best trial aren't known. Spark has one trainer of boosted trees; for the
#: third of them, by Tweedie's distribution, stands a linear one of that distribution.
TRIALS = (
    *FIRST,
    *(Trial("Linear", {"regParam": r, "elasticNetParam": e}) for r in (0.01, 0.1, 1.0, 100.0) for e in (0.0, 0.5)),
    *(Trial("Poisson", {"maxIter": n, "regParam": r}) for n, r in ((10, 0.01), (10, 0.1), (10, 1.0), (25, 0.0), (25, 0.01), (25, 0.1), (25, 1.0))),
    *(Trial("Tweedie", {"variancePower": v, "linkPower": 0.0, "maxIter": 25, "regParam": r}) for v, r in ((1.1, 0.0), (1.2, 0.0), (1.3, 0.0), (1.4, 0.0), (1.5, 0.0), (1.5, 0.01), (1.5, 0.1), (1.6, 0.0), (1.7, 0.0), (1.8, 0.0), (1.9, 0.0))),
    *(Trial("FastForest", {"numTrees": n, "maxDepth": d, "maxBins": b}) for n, d, b in ((4, 4, 255), (8, 8, 255), (16, 6, 255), (16, 8, 255), (20, 5, 32), (20, 10, 255), (32, 6, 255), (32, 8, 1022), (48, 7, 255))),
    *(Trial("FastTree", {"maxIter": n, "maxDepth": d, "stepSize": s, "maxBins": b}) for n, d, s, b in ((4, 2, 0.1, 255), (4, 5, 0.5, 255), (10, 3, 0.2, 255), (10, 5, 0.1, 255), (10, 6, 0.3, 1022), (20, 4, 0.2, 255), (20, 5, 0.1, 1022), (20, 6, 0.2, 255), (30, 5, 0.3, 255))),
    *(Trial("FastTree", {"maxIter": n, "maxDepth": d, "stepSize": s, "maxBins": 255, "minInstancesPerNode": 20, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}) for n, d, s in ((4, 2, 0.1), (4, 5, 0.5), (10, 4, 0.2), (10, 5, 0.1), (10, 6, 0.3), (20, 5, 0.2), (20, 6, 0.1), (30, 5, 0.1))),
)


def split(rows: DataFrame, key: Sequence[str], share: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and one in `share` to validate on, by a hash of the key: the same rows whatever the partitions."""
    held = F.pmod(F.xxhash64(*key), F.lit(share)) == 0
    return rows.where(~held), rows.where(held)


def leaderboard(rows: DataFrame, features: Sequence[str], key: Sequence[str], trials: Sequence[Trial] = TRIALS, is_stored: bool = False) -> tuple[DataFrame, PipelineModel]:
    """rank, trial, trainer, params, r2, rmse and seconds of each trial, the best R2 on held-out rows first (ties: the earlier trial), and the
    best model. Rows without a label are left out. A trial that can't be fitted has no R2 and the last ranks.

    What all trials begin with, the means and the vectors, is made once; trainers read the cached vectors many times, and held-out rows are read
    once for all models. seconds are those of the fit."""
    spark = rows.sparkSession
    rows = rows.where(F.col("label").isNotNull() & ~F.isnan("label")).select(*key, *[F.col(c).cast("double").alias(c) for c in features], F.col("label").cast("double").alias("label"))
    rows = rows if is_stored else stored(rows)
    checkpoints(spark)
    learn, held = split(rows, key)
    models, seconds, cached = {}, {}, None
    with small_tasks(spark):
        try:
            try:
                fill = Pipeline(stages=inputs(features)).fit(learn)
                cached = fill.transform(learn).select("__features", "label").persist()
            except Exception:  # a column without any value has no mean, so no trial can be made
                fill = None
            for n, trial in enumerate(trials):
                began = time.time()
                try:
                    if fill is not None:
                        models[n] = trial.estimator().fit(cached)
                except Exception:  # a trial's parameters may be out of what its trainer takes
                    pass
                seconds[n] = round(time.time() - began, 3)
        finally:
            if cached is not None:
                cached.unpersist()
        found = {}
        if models:
            vectors = fill.transform(held).select("__features", "label")
            try:
                found = scores(vectors, models)
            except Exception:  # a model that can't score takes only itself out
                for n, model in models.items():
                    try:
                        found |= scores(vectors, {n: model})
                    except Exception:
                        pass
    got = [(n, trial.trainer, str(sorted(trial.params.items())), *found.get(n, (None, None)), seconds[n]) for n, trial in enumerate(trials)]
    order = sorted(got, key=lambda t: (t[3] is None, -(t[3] or 0.0), t[0]))
    best = next((PipelineModel(stages=[*fill.stages, models[t[0]]]) for t in order if t[3] is not None), None)
    return spark.createDataFrame([(k + 1, *t) for k, t in enumerate(order)], "rank int, trial int, trainer string, params string, r2 double, rmse double, seconds double"), best


def scores(vectors: DataFrame, models: dict) -> dict:
    """R2 and RMSE of each model's predictions, in one pass for all of them."""
    for n, model in models.items():
        vectors = model.copy({model.predictionCol: f"__p{n}"}).transform(vectors)
    error = lambda n: F.col("label") - F.col(f"__p{n}")
    count, spread, *wrong = vectors.agg(F.count("*"), F.var_pop("label") * F.count("*"), *[F.sum(error(n) * error(n)) for n in models]).first()
    return {n: (1 - w / spread if spread else float("-inf") if w else float("nan"), math.sqrt(w / count)) for n, w in zip(models, wrong)}


def save(model: PipelineModel, path: str | None = None) -> str:
    """Writes the model, to a new folder that all share unless a path is given; returns where it is."""
    path = path or shared_dir(SparkSession.active())
    model.write().overwrite().save(path)
    return path


def score_csv(path: str, csv: str, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """key and prediction of each row of CSV files with a header, by a saved model. Columns that aren't numbers, or aren't there, are missing values."""
    spark = SparkSession.active()
    names = spark.read.option("header", True).csv(csv).columns
    # the reader makes the numbers, which is cheaper than casts of strings
    schema = StructType([StructField(c, DoubleType() if c in features and c not in key else StringType()) for c in names])
    raw = spark.read.option("header", True).schema(schema).csv(csv)
    number = lambda c: (F.col(f"`{c}`") if c in names else F.lit(None)).cast("double").alias(c)
    return PipelineModel.load(path).transform(raw.select(*[F.col(f"`{c}`") for c in key], *map(number, features))).select(*key, "prediction")
