"""Summaries of tables, each one aggregation over all columns asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.files import settled


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def distinct_with_null(c: str) -> Column:
    """Distinct values, missing counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))


def without_null_columns(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """The frames without the columns that miss any value in train."""
    counts = null_counts(train, train.columns).first().asDict()
    gone = [c for c, n in counts.items() if n]
    return [d.drop(*gone) for d in (train, *others)]


def in_ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df sorted over all tasks, each of which has a range of `by`; part numbers the ranges in their order."""
    return settled(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, by: str, to: str) -> DataFrame:
    """df with a number from 0 in the order of `by`, whose values differ. Tasks number their own ranges; only the ranges'
    sizes, a row for each, meet in one place."""
    ranged = in_ranges(df, [by])
    sizes = ranged.groupBy(F.col("part").alias("its part")).agg(F.count("*").alias("n"))
    before = sizes.select("its part", (F.sum("n").over(W.orderBy("its part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(by)) - 1
    met = ranged.withColumn(to, own).join(before, F.col("part") == F.col("its part"))
    return met.withColumn(to, F.col(to) + F.col("before")).drop("part", "its part", "before")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, share, value): exact quantiles of each column, interpolated between neighbours; none for a column of nulls.

    Equal values are counted first; the counts are sorted in ranges, and the ranges' sums tell which of them hold the
    places asked for. Only those are looked into, so that no task ever holds all values of a column.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").dropna()
    ranged = in_ranges(long.groupBy("column", "value").agg(F.count("*").alias("n")), ["column", "value"])
    sums = ranged.groupBy("column", "part").agg(F.sum("n").alias("own"))
    up_to = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("own").over(up_to) - F.col("own")).withColumn("total", F.sum("own").over(W.partitionBy("column")))
    asked = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).withColumn("place", F.col("share") * (F.col("total") - 1))
    asked = asked.withColumn("rank", F.explode(F.array(F.floor("place"), F.ceil("place")))).filter("rank >= before and rank < before + own")
    asked = asked.select("column", "part", "share", "place", "rank")
    needed = ranged.join(sums.join(asked.select("column", "part").distinct(), ["column", "part"]).select("column", "part", "before"), ["column", "part"])
    within = W.partitionBy("column", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    counted = needed.withColumn("until", F.col("before") + F.sum("n").over(within))
    found = counted.join(asked, ["column", "part"]).filter("rank < until and rank >= until - n")
    ends = found.groupBy("column", "share", "place").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("column", "share", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"))


def quantile_row(df: DataFrame, named: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles: name -> (column, share)."""
    found = quantiles(df, sorted({c for c, _ in named.values()}), sorted({x for _, x in named.values()}))
    return found.agg(*[F.max(F.when((F.col("column") == c) & (F.col("share") == x), F.col("value"))).alias(k) for k, (c, x) in named.items()])


def described(df: DataFrame, c: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles (interpolated), greatest."""
    named = dict(zip(("n", "mean", "std", "lo", "hi"), (F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c))))
    sums = df.agg(*[v.alias(k) for k, v in named.items()])
    q = quantile_row(df, {"q1": (c, 0.25), "q2": (c, 0.5), "q3": (c, 0.75)})
    return sums.crossJoin(q).select("n", "mean", "std", "lo", "q1", "q2", "q3", "hi")  # one row each


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def outlier_share(df: DataFrame, column: str, times: float = 1.5) -> DataFrame:
    """Share of rows more than so many interquartile ranges outside the quartiles."""
    q = quantile_row(df, {"q1": (column, 0.25), "q3": (column, 0.75)})
    far = (F.col(column) < F.col("q1") - times * (F.col("q3") - F.col("q1"))) | (F.col(column) > F.col("q3") + times * (F.col("q3") - F.col("q1")))
    return df.crossJoin(F.broadcast(q)).agg(F.avg(far.cast("double")).alias("share"))  # q is one row


def by_dtype(df: DataFrame, times: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns by kind: those named as times, numeric ones, all others."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    out: dict[str, list[str]] = {"time": [], "numeric": [], "other": []}
    for c, kind in df.dtypes:
        out["time" if c in times else "numeric" if kind in numeric or kind.startswith("decimal") else "other"].append(c)
    return out
