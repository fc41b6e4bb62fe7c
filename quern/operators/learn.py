"""Models, ensembles and metrics: MLlib's, and leaf-wise boosting of this library under the name lgbm."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import boosting

GBT = {"maxIter": 400, "stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 30, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9"}
FOREST = {"numTrees": 300, "maxDepth": 24, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}
DECLARED = ("gbt", "rf", "linear", "lgbm", "cat", "xgb")


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def estimator(model: str, params: Mapping[str, object] | None = None, seed: int = 42):
    if model == "gbt":
        return GBTRegressor(labelCol="target", seed=seed, **(GBT | dict(params or {})))
    if model == "rf":
        return RandomForestRegressor(labelCol="target", seed=seed, **(FOREST | dict(params or {})))
    if model == "linear":
        return LinearRegression(labelCol="target", **dict(params or {}))
    raise ValueError(f"model {model!r} isn't available" if model in DECLARED else f"unknown model {model!r}")


def best_round(errors: Sequence[float], patience: int) -> int:
    """Number of rounds up to the least error, not looking further once so many rounds brought none that is less."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit(train: DataFrame, features: Sequence[str], model: str, params: Mapping[str, object] | None = None, valid: DataFrame | None = None, seed: int = 42, patience: int = 50) -> Model | boosting.Boosted:
    """With validation rows, boosting keeps the rounds up to the best one. Leaf-wise boosting (lgbm) stops `patience` rounds
    after it. MLlib's can't stop: it is fitted once to see the errors of all rounds, and again with as many rounds as are
    kept (see `best_round`), which gives the same trees."""
    if model == "lgbm":
        return boosting.fit(train, features, boosting.Settings(**{"seed": seed, "patience": patience} | dict(params or {})), valid)
    est = estimator(model, params, seed)
    rows = assembled(train, features)
    fitted = est.fit(rows)
    if valid is None or model != "gbt":
        return fitted
    rounds = best_round(fitted.evaluateEachIteration(assembled(valid, features).select("features", "target"), "squared"), patience)
    return fitted if rounds == fitted.getNumTrees else est.setMaxIter(rounds).fit(rows)


def refit(train: DataFrame, valid: DataFrame, features: Sequence[str], fitted: Model | boosting.Boosted, model: str, params: Mapping[str, object] | None = None, seed: int = 42) -> Model | boosting.Boosted:
    """On training and validation rows, with as many boosting rounds as the first fit kept."""
    kept = {"gbt": "maxIter", "lgbm": "rounds"}.get(model)
    params = dict(params or {}) | ({kept: fitted.getNumTrees} if kept else {})
    return fit(train.unionByName(valid), features, model, params, seed=seed)


def predict(fitted: Model | boosting.Boosted, df: DataFrame, features: Sequence[str]) -> DataFrame:
    if isinstance(fitted, boosting.Boosted):
        return fitted.transform(df)
    return fitted.transform(assembled(df, features)).drop("features")


def importance(fitted: Model | boosting.Boosted, features: Sequence[str]) -> DataFrame:
    """(feature, share in percent, place) by falling share."""
    from pyspark.sql import SparkSession

    shares = fitted.gains() if isinstance(fitted, boosting.Boosted) else fitted.featureImportances.toArray()
    values = [(f, float(v)) for f, v in zip(features, shares)]
    df = SparkSession.getActiveSession().createDataFrame(values, "feature string, gain double")
    share = F.col("gain") / F.sum("gain").over(W.partitionBy()) * 100
    return df.select("feature", share.alias("percent")).orderBy(F.desc("percent"), "feature")


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def blend(predictions: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean; weights are made to sum to 1."""
    total = float(sum(weights.get(k, 0.0) for k in predictions))
    if total <= 0:
        raise ValueError("weights sum to 0")
    return reduce(lambda a, b: a + b, [c * F.lit(weights.get(k, 0.0) / total) for k, c in predictions.items()])


def joined_predictions(parts: Mapping[str, DataFrame], key: str = "_org_idx", column: str = "prediction") -> DataFrame:
    frames = [d.select(key, F.col(column).alias(k)) for k, d in parts.items()]
    return reduce(lambda a, b: a.join(b, key), frames)


def best_by(errors: DataFrame, n: int = 3) -> DataFrame:
    """The n models with the least error, those with NaN left out; ties by name."""
    return errors.filter(F.col("error").isNotNull() & ~F.isnan("error")).orderBy("error", "model").limit(n)


def sampled(space: Mapping[str, Sequence[object]], n: int = 100, seed: int = 42) -> list[dict[str, object]]:
    """n parameter sets, each value drawn from its list; equal seeds give equal sets."""
    draw = random.Random(seed)
    return [{k: draw.choice(list(v)) for k, v in space.items()} for _ in range(n)]


def search(train: DataFrame, valid: DataFrame, features: Sequence[str], model: str, trials: Sequence[Mapping[str, object]], inverse: Callable[[DataFrame], DataFrame] = lambda d: d, seed: int = 42) -> DataFrame:
    """(trial, params, rmse) of each parameter set on the given split."""
    rows = []
    for i, params in enumerate(trials):
        done = inverse(predict(fit(train, features, model, params, seed=seed), valid, features))
        rows.append((i, str(dict(params)), done.agg(rmse(F.col("target"), F.col("prediction"))).first()[0]))
    return train.sparkSession.createDataFrame(rows, "trial int, params string, rmse double").orderBy("rmse", "trial")
