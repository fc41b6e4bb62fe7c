"""From raw tables to a bundle of training, validation and test rows, with no state learned outside training."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import to_number
from quern.operators import encode, lookups
from quern.plans.blocks import Pipeline
from quern.sources.files import settled

ID = "_org_idx"


@dataclass(frozen=True)
class Bundle:
    """Features with ID and, but for the test rows, `target` (transformed)."""

    train: DataFrame
    test: DataFrame
    valid: DataFrame | None
    meta: dict = field(default_factory=dict)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """All names must be there; Spark alone would pass over those that aren't."""
    if absent := [c for c in names if c not in df.columns]:
        raise KeyError(f"columns to rename that aren't there: {absent}; there are {df.columns}")
    return df.withColumnsRenamed(dict(names))


def with_id(df: DataFrame, order: str | None = None) -> DataFrame:
    """df with a stable row number from a real key; a column of that name that is there stays."""
    if ID in df.columns:
        return df
    if order is None:
        raise KeyError(f"rows need {ID}, or a key to make it from")
    return df.withColumn(ID, F.col(order).cast("long"))


def selected(df: DataFrame, columns: Sequence[str] | None, meta: Sequence[str] = (ID,)) -> DataFrame:
    """Exactly these columns in this order; None: all but the meta columns."""
    if columns is None:
        return df.drop(*meta)
    if absent := [c for c in columns if c not in df.columns]:
        raise KeyError(f"features that aren't there: {absent}")
    return df.select(*columns)


def transformed(df: DataFrame, kind: str, column: str = "target") -> DataFrame:
    if kind == "none":
        return df
    if kind != "log1p":
        raise ValueError(f"unknown target transform {kind!r}")
    return df.withColumn(column, F.log1p(column))


def restored(df: DataFrame, kind: str, column: str = "prediction") -> DataFrame:
    return df if kind == "none" else df.withColumn(column, F.expm1(column))


@dataclass
class DatasetBuilder:
    """load() gives train and test with raw names; ext() reference tables; pipeline(ext) the blocks, built afresh each time."""

    load: Callable[[], tuple[DataFrame, DataFrame]]
    ext: Callable[[], dict[str, DataFrame]]
    pipeline: Callable[[dict[str, DataFrame]], Pipeline]
    names: Mapping[str, str]
    features: Sequence[str] | None
    categorical: Sequence[str]
    integers: Sequence[str] = ()
    target: str = "target"
    target_transform: str = "log1p"
    order: str | None = None
    _raw: tuple[DataFrame, DataFrame] | None = None
    _ext: dict[str, DataFrame] | None = None
    _features: dict[str, tuple] = field(default_factory=dict)

    def raw(self, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
        if not use_cache or self._raw is None:
            self._raw = self.load()
        return self._raw

    def references(self, use_cache: bool = True) -> dict[str, DataFrame]:
        if not use_cache or self._ext is None:
            self._ext = self.ext()
        return self._ext

    def feature_meta(self) -> dict[str, list[str]]:
        names = list(self.features or ())
        return {"numeric": [c for c in names if c not in self.categorical], "categorical": [c for c in names if c in self.categorical]}

    def finalized(self, train: DataFrame, others: Sequence[DataFrame], model: str) -> list[DataFrame]:
        """Encoders and casts for the model, fitted on train, applied to train and the others."""
        frames = [train, *others]
        cats = [c for c in self.categorical if c in train.columns]
        numbers = [c for c in (self.features or ()) if c in train.columns and c not in cats]
        for c in cats:
            if model == "rf":
                codes = encode.first_seen_codes(train, c, ID)
                frames = [encode.apply_map(f, codes, F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")), c, -1) for f in frames]
            else:
                known = encode.sorted_codes(train.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("__NA__"))), c)
                frames = [encode.apply_map(f, known, F.coalesce(F.col(c).cast("string"), F.lit("__NA__")), c, -1) for f in frames]
        frames = [f.withColumns({c: to_number(F.col(c)) for c in numbers}) for f in frames]
        if model == "rf" and numbers:
            values = encode.medians(frames[0], numbers)
            frames = [encode.impute(f, values) for f in frames]
        return [f.withColumns({c: F.col(c).cast("short" if c in self.integers else "float") for c in numbers}) for f in frames]

    def featured(self, split_policy: Mapping[str, object] | None, use_cache: bool = True) -> tuple:
        """Targets by part, the features of training, test and validation rows, and the fitted pipeline; with the cache, what the
        same split gave before, for whatever model."""
        known = json.dumps(split_policy, sort_keys=True, default=str)
        if use_cache and known in self._features:
            return self._features[known]
        train, test = self.raw(use_cache)
        ext = self.references(use_cache)
        train, test = (with_id(renamed(d, self.names), self.order) for d in (train, test))
        test = test.drop(self.target)
        valid = None
        if split_policy is not None:
            train, valid = encode.time_holdout(train, split_policy)
        y = {k: d.select(ID, F.col(self.target).cast("double").alias("target")) for k, d in (("train", train), ("valid", valid)) if d is not None}
        pipe = self.pipeline(ext)
        # computed once: encoders and models go over them many times
        x_train = settled(pipe.fit_transform(train.drop(self.target)))
        x_test = settled(pipe.transform(test))
        x_valid = settled(pipe.transform(valid.drop(self.target))) if valid is not None else None
        self._features[known] = (y, x_train, x_test, x_valid, pipe)
        return self._features[known]

    def build(self, model: str = "gbt", use_cache: bool = True, split_policy: Mapping[str, object] | None = None) -> Bundle:
        y, x_train, x_test, x_valid, pipe = self.featured(split_policy, use_cache)
        done = self.finalized(x_train, [d for d in (x_test, x_valid) if d is not None], model)
        keep = [ID, *self.features] if self.features is not None else [c for c in x_train.columns]
        done = [selected(d, keep) for d in done]
        rows = {"train": done[0], "test": done[1], "valid": done[2] if x_valid is not None else None}
        for k in y:
            rows[k] = transformed(lookups.aligned(rows[k], y[k], ID), self.target_transform)
        meta = {"model": model, "split_policy": dict(split_policy) if split_policy else None, "target_transform": self.target_transform, "features": self.feature_meta(), "blocks": [b.name() for b in pipe.blocks]}
        return Bundle(rows["train"], rows["test"], rows["valid"], meta)
