"""Encoders with state fitted on training rows, splits, and imputation. State is a small DataFrame, joined when applied."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.scalars import filled
from quern.operators.stats import numbered, quantiles


def frequencies(train: DataFrame, column: str, token: str = "__NA__") -> DataFrame:
    """(value, freq): share of all training rows; missing and empty count as the token."""
    counts = train.groupBy(filled(F.col(column), token).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("freq"))  # total is one row


def apply_map(df: DataFrame, state: DataFrame, value: Column, to: str, default: object) -> DataFrame:
    """df with the state's second column where the first equals value, else the default."""
    key, out = state.columns
    named = state.select(F.col(key).alias("state key"), F.col(out).alias("state value"))
    met = df.join(named, value == F.col("state key"), "left")
    return met.withColumn(to, F.coalesce("state value", F.lit(default))).drop("state key", "state value")


def sorted_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in the order of values."""
    return numbered(train.select(F.col(column).alias("value")).dropna().distinct(), "value", "code")


def first_seen_codes(train: DataFrame, column: str, order: str = "_org_idx", token: str = "UNKNOWN") -> DataFrame:
    """(value, code): codes from 0 in the order in which values first appear; missing reads as the token."""
    first = train.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(token)).alias("value")).agg(F.min(order).alias("first"))
    return numbered(first, "first", "code").select("value", "code")


def fixed_categories(df: DataFrame, categories: DataFrame, column: str) -> DataFrame:
    """Values that training didn't have become missing."""
    known = categories.select(F.col("value").alias("known"))
    return df.join(known, F.col(column) == F.col("known"), "left").withColumn(column, F.col("known")).drop("known")


def medians(train: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each column, None for one without values: one number a column comes to the driver."""
    return dict.fromkeys(columns) | {r["column"]: r["value"] for r in quantiles(train, columns, [0.5]).collect()}


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def time_holdout(df: DataFrame, policy: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows up to train_until, and those from valid_from to valid_until; rows without a time are in neither."""
    policy = {"kind": "time_holdout", "ym_col": "계약년월", "train_until": 202303, "valid_from": 202304, "valid_until": 202306} | dict(policy or {})
    if policy["kind"] != "time_holdout":
        raise NotImplementedError(f"split kind {policy['kind']!r}")
    ym = F.col(str(policy["ym_col"]))
    return df.filter(ym <= policy["train_until"]), df.filter((ym >= policy["valid_from"]) & (ym <= policy["valid_until"]))


def threshold_split(df: DataFrame, column: str, until: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to the threshold, and all others, those without a value included."""
    early = F.coalesce(F.col(column) <= until, F.lit(False))
    return df.filter(early), df.filter(~early)


def hash_split(df: DataFrame, key: str, fifths: int = 4) -> tuple[DataFrame, DataFrame]:
    """A split that doesn't depend on partitioning: so many fifths of the keys, and the rest."""
    edge = f"{fifths * (16**8) // 5:08x}" if fifths < 5 else "g"
    early = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8) < edge
    return df.filter(early), df.filter(~early)


def drawn_order(key: str, seed: int = 42) -> Column:
    """A text that sorts rows in a drawn order; no two keys share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def ordered_statistics(df: DataFrame, key: str, column: str, target: str, to: str, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """df with the mean target of the rows with the same category that come before in a drawn order, drawn towards the mean
    of all by `weight` rows: a row never sees its own target. A missing category is one of its own; keys differ.

    A category is cut into 256 ranges of the order. Sums run within a range and over the ranges' totals, so that no task
    holds a hot category.
    """
    order, part = unused_name(df, "order"), unused_name(df, "part")
    y = F.col(target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    held = df.withColumn(order, drawn_order(key, seed)).withColumn(part, F.substring(order, 1, 2))
    totals = held.groupBy(F.col(column).alias("its category"), F.col(part).alias("its part")).agg(F.sum(y).alias("part sum"), F.count(y).alias("part n"))
    before = W.partitionBy("its category").orderBy("its part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({"sum before": F.sum("part sum").over(before), "n before": F.sum("part n").over(before)}).drop("part sum", "part n")
    within = W.partitionBy(column, part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = held.withColumns({"own sum": F.sum(y).over(within), "own n": F.count(y).over(within)})
    met = own.join(totals, F.col(column).eqNullSafe(F.col("its category")) & (F.col(part) == F.col("its part")))
    total = lambda kind: F.coalesce(F.col(f"{kind} before"), F.lit(0)) + F.coalesce(F.col(f"own {kind}"), F.lit(0))
    value = (total("sum") + F.lit(weight) * F.lit(prior)) / (total("n") + F.lit(weight))
    return met.withColumn(to, value).select(*df.columns, to)


def target_statistics(train: DataFrame, column: str, target: str, weight: float = 1.0) -> DataFrame:
    """(value, to): what rows outside of training get for a category, by all training rows."""
    y = F.col(target).cast("double")
    prior = train.agg(F.avg(y)).first()[0]
    return train.groupBy(F.col(column).alias("value")).agg(((F.sum(y) + F.lit(weight) * F.lit(prior)) / (F.count(y) + F.lit(weight))).alias("to"))


def unused_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
