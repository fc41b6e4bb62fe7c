"""Training, prediction and ensembles from a builder to files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import parameter_tag
from quern.operators import learn
from quern.plans.builder import ID, Bundle, DatasetBuilder, restored
from quern.sources.files import run_id, write_meta, write_predictions

SHORT = {"maxIter": "n", "numTrees": "n", "stepSize": "lr", "maxDepth": "d", "minInstancesPerNode": "leaf"}


@dataclass(frozen=True)
class RunResult:
    predictions: DataFrame
    meta: dict
    run: str
    path: str | None


class Runner:
    def __init__(self, builder: DatasetBuilder, params: Mapping[str, Mapping[str, object]] | None = None) -> None:
        self.builder, self.params = builder, {k: dict(v) for k, v in (params or {}).items()}

    def train_predict(self, bundle: Bundle, model: str, seed: int = 42) -> tuple[DataFrame, DataFrame | None, dict]:
        """Test predictions and, with a split, validation ones, on the original scale; the model refitted on both parts."""
        features, params = list(self.builder.features or ()), self.params.get(model)
        fitted = learn.fit(bundle.train, features, model, params, bundle.valid, seed)
        meta: dict = {"tag": parameter_tag(params or {}, SHORT)}
        valid = None
        if bundle.valid is not None:
            kind = self.builder.target_transform
            valid = restored(restored(learn.predict(fitted, bundle.valid, features), kind), kind, "target").select(ID, "target", "prediction")
            meta["valid_rmse"] = valid.agg(learn.rmse(F.col("target"), F.col("prediction"))).first()[0]
            fitted = learn.refit(bundle.train, bundle.valid, features, fitted, model, params, seed)
        test = restored(learn.predict(fitted, bundle.test, features), self.builder.target_transform).select(ID, "prediction")
        return test, valid, meta

    def run(self, model: str, split_policy: Mapping[str, object] | None = None, out: str | None = None, prefix: str = "submission", seed: int = 42) -> RunResult:
        bundle = self.builder.build(model, split_policy=split_policy)
        test, _, more = self.train_predict(bundle, model, seed)
        return self._finished(test, bundle.meta | more, out, prefix)

    def run_ensemble(self, weights: Mapping[str, float] | None = None, split_policy: Mapping[str, object] | None = None, out: str | None = None, prefix: str = "submission", seed: int = 42) -> RunResult:
        weights = dict(weights or {"gbt": 0.5, "rf": 0.5})
        if sum(weights.values()) <= 0:
            raise ValueError("weights sum to 0")
        tests, valids, meta = {}, {}, {"ensemble": weights}
        for model in weights:
            bundle = self.builder.build(model, split_policy=split_policy)
            tests[model], valids[model], meta[model] = self.train_predict(bundle, model, seed)
            meta |= {k: v for k, v in bundle.meta.items() if k not in meta}
        mix = learn.blend({m: F.col(m) for m in weights}, weights)
        both = learn.joined_predictions(tests, ID).withColumn("prediction", mix)
        if all(v is not None for v in valids.values()):
            done = learn.joined_predictions(valids, ID).withColumn("prediction", mix).join(next(iter(valids.values())).select(ID, "target"), ID)
            meta["valid_rmse"] = done.agg(learn.rmse(F.col("target"), F.col("prediction"))).first()[0]
        return self._finished(both, meta, out, prefix)

    def _finished(self, predictions: DataFrame, meta: dict, out: str | None, prefix: str) -> RunResult:
        run = run_id(prefix, "spark")
        if out:
            write_predictions(predictions, f"{out}/{run}/predictions", order=ID)
            write_meta(predictions.sparkSession, meta, f"{out}/{run}/meta.json")
        return RunResult(predictions, meta, run, f"{out}/{run}" if out else None)
