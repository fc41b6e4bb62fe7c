"""Lookup joins: fill-only-missing, cascades, last-wins references, group means, best fuzzy match, alignment.

References are DataFrames. No join is forced to broadcast: the planner does that for sides whose size it knows to be
small, and adaptive execution splits what is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalars import strip
from quern.sources.files import Scratch, scratch, settled


def last_wins(ref: DataFrame, key: str, values: Sequence[str], order: str) -> DataFrame:
    """One row per key, that with the greatest `order`; rows with an empty key or a missing value don't count."""
    valid = F.coalesce(F.col(key), F.lit("")) != ""
    for v in values:
        valid = valid & F.col(v).isNotNull()
    return ref.filter(valid).groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def missing_any(columns: Sequence[str]) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out = out | F.col(c).isNull()
    return out


def fill_missing(df: DataFrame, ref: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Where any of the values is missing and the reference has the key, all of them become the reference's."""
    named = ref.select(F.col(key).alias("ref key"), *[F.col(v).alias(f"ref {v}") for v in values])
    met = df.join(named, F.col(key) == F.col("ref key"), "left")
    use = missing_any(values) & F.col("ref key").isNotNull()
    return met.withColumns({v: F.when(use, F.col(f"ref {v}")).otherwise(F.col(v)) for v in values}).select(*df.columns)


def overwrite_missing(df: DataFrame, ref: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Where any of the values is missing all of them become the reference's, missing too if it lacks the key."""
    named = ref.select(F.col(key).alias("ref key"), *[F.col(v).alias(f"ref {v}") for v in values])
    met = df.join(named, F.col(key) == F.col("ref key"), "left")
    use = missing_any(values)
    return met.withColumns({v: F.when(use, F.col(f"ref {v}")).otherwise(F.col(v)) for v in values}).select(*df.columns)


def cascade(df: DataFrame, refs: Sequence[tuple[DataFrame, str]], values: Sequence[str]) -> DataFrame:
    """fill_missing by one reference after another; each sees what is still missing."""
    for ref, key in refs:
        df = fill_missing(df, ref, key, values)
    return df


def group_mean_fill(df: DataFrame, fit_on: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Missing values become the mean of the row's group in `fit_on`."""
    means = fit_on.groupBy(F.col(group).alias("mean group")).agg(*[F.avg(v).alias(f"mean {v}") for v in values])
    met = df.join(means, F.col(group) == F.col("mean group"), "left")
    return met.withColumns({v: F.coalesce(v, f"mean {v}") for v in values}).select(*df.columns)


@F.pandas_udf(T.DoubleType())
def matching_ratio(candidate: pd.Series, target: pd.Series) -> pd.Series:
    """The matching ratio of difflib, which isn't symmetric."""
    return pd.Series([SequenceMatcher(None, t, c).ratio() for c, t in zip(candidate, target)])


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def most_ratio(a: Column, b: Column) -> Column:
    """A bound of the matching ratio: what two texts have in common at most, letter by letter, whatever the order."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    common = F.aggregate(F.array_distinct(_letters(a)), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, 1.0).otherwise(2.0 * common / size)


#: A target's first candidates are those that share one of its SEEDS rarest grams, up to HEADS of each. They give a ratio to
#: reach, and bound nothing else.
SEEDS, HEADS = 4, 32
#: Parts that the candidates of a key are dealt to, as a key may be hot.
PARTS = 16
EVEN = 1e-12


def _tokens(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """(by, text, kind, token): letters (kind 1) and pairs of letters (2), numbered where a text has them several times."""
    letters = _letters(F.col(text))
    held = texts.select(*by, text, letters.alias("letters"))
    pairs = F.transform(F.slice("letters", 2, F.greatest(F.size("letters") - 1, F.lit(0))), lambda c, i: F.concat(F.get("letters", i), c))

    def of_kind(kind: int, grams: Column) -> Column:
        return F.transform(grams, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("gram")))

    grams = F.concat(of_kind(1, F.col("letters")), of_kind(2, pairs))
    counted = held.select(*by, text, F.explode(grams).alias("g")).groupBy(*by, text, "g.kind", "g.gram").agg(F.count("*").alias("n"))
    return counted.select(*by, text, "kind", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat("gram", k.cast("string")))).alias("token"))


def _in_size(sub: str, candidate: str) -> Column:
    """Texts of such different sizes can't have more in common than the ratio asks for."""
    a, b = F.length(sub), F.length(candidate)
    return 2 * F.least(a, b) >= (F.col("reached") - EVEN) * (a + b)


def to_compare(asked: DataFrame, texts: DataFrame, keys: Sequence[str], sub: str, tables: Scratch) -> DataFrame:
    """(keys, sub, candidate sub, bound, reached): pairs of which one at least has the greatest ratio of its target, ties included.

    Candidates stand in an inverted index of numbered letters and pairs of letters, by key. A target's tokens are looked up from
    the rarest on. A candidate that none of them has found can only share the rest: its ratio is 2r / (t + r) at most if r
    of a target's t letters are left, and 2/3 + (s + 1)(2 - ratio) / 3t if s pairs are (blocks that match are set apart by
    letters that don't). The look-up stops where that is below a ratio that some candidate is known to reach. Each
    target takes the kind that costs least by the lengths of its lists, or all candidates of its key if these are fewer.
    """
    of, target = [*keys], [*keys, sub]
    index = tables.keep(_tokens(texts, of, "candidate sub"))
    lists = tables.keep(index.groupBy(*of, "kind", "token").agg(F.count("*").alias("long")))
    mine = _tokens(asked, of, sub).join(lists, [*of, "kind", "token"], "left").withColumn("long", F.coalesce("long", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*target, "kind").orderBy("long", "token"))
    mine = tables.keep(mine.withColumn("rank", rank))

    # a ratio to reach: equal texts, else the likeliest of a few that share rare pairs
    heads = index.filter("kind = 2").withColumn("head", F.row_number().over(W.partitionBy(*of, "token").orderBy("candidate sub"))).filter(F.col("head") <= HEADS)
    rare = mine.filter("kind = 2 and long > 0").withColumn("seed", F.row_number().over(W.partitionBy(*target).orderBy("long", "token"))).filter(F.col("seed") <= SEEDS)
    equal = asked.join(texts, of).filter(F.col(sub) == F.col("candidate sub")).select(*target, "candidate sub")
    seeds = rare.join(heads.select(*of, "token", "candidate sub"), [*of, "token"]).select(*target, "candidate sub").distinct()
    likely = seeds.unionByName(equal).groupBy(*target).agg(F.max_by("candidate sub", most_ratio(F.col("candidate sub"), F.col(sub))).alias("likely"))
    goal = asked.join(likely, target, "left").withColumn("reached", F.when(F.col("likely").isNull(), 0.0).otherwise(matching_ratio(F.coalesce("likely", F.lit("")), sub)))
    goal = tables.keep(goal.select(*target, "reached"))

    # which tokens are needed for that, and what they cost
    size, before = F.length(sub), F.col("rank") - 1
    left = F.greatest(size - before, F.lit(0))
    unseen = F.when(F.col("kind") == 1, 2 * left / (size + left)).otherwise(F.lit(2 / 3) + (size - before) * (2 - F.col("reached")) / (3 * size))
    needed = mine.join(goal, target).filter(unseen >= F.col("reached") - EVEN)
    whole = F.when(F.col("kind") == 1, 0.0).otherwise(2 / 3)  # what a candidate may reach that no token of the kind finds
    costs = needed.groupBy(*target, "kind").agg(F.sum("long").alias("cost"), F.max("reached").alias("reached")).filter(F.col("reached") - EVEN > whole)
    sizes = texts.groupBy(*of).agg(F.count("*").alias("cost"))
    every = goal.join(sizes, of).select(*target, F.lit(0).alias("kind"), "cost", "reached")
    ways = tables.keep(costs.unionByName(every).groupBy(*target).agg(F.min(F.struct("cost", "kind")).alias("way"), F.first("reached").alias("reached")).select(*target, "way.kind", "reached"))

    by_token = needed.drop("reached").join(ways, [*target, "kind"]).select(*target, "kind", "token", "reached")
    dealt = F.pmod(F.xxhash64("candidate sub"), F.lit(PARTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    found = by_token.withColumn("part", parts).join(index.withColumn("part", dealt), [*of, "kind", "token", "part"]).filter(_in_size(sub, "candidate sub"))
    listed = ways.filter("kind = 0").withColumn("part", parts).join(texts.withColumn("part", dealt), [*of, "part"]).filter(_in_size(sub, "candidate sub"))
    columns = [*target, "candidate sub", "reached"]
    both = found.select(*columns).distinct().unionByName(listed.select(*columns))
    return both.withColumn("bound", most_ratio(F.col("candidate sub"), F.col(sub))).filter(F.col("bound") >= F.col("reached") - EVEN)


def best_match(targets: DataFrame, candidates: DataFrame, keys: Sequence[str], sub: str, values: Sequence[str], row_no: str) -> DataFrame:
    """For each distinct (keys, sub) of the targets the values of the best candidate with equal keys.

    An empty sub takes the mean of all candidates; else the candidate whose sub has the greatest ratio, the first by
    row_no on ties. Which texts are compared, `to_compare` tells; each distinct pair is compared once, and only where its
    bound reaches the ratio of the pair that has the greatest bound. Candidates with equal keys and texts are one row first,
    and best candidates are maxima; both combine before the shuffle: a key, or a text, may be hot.
    """
    with scratch(targets.sparkSession) as tables:
        asked = tables.keep(targets.select(*keys, sub).distinct())  # used several times, whatever it took to make the targets
        named = tables.keep(candidates.select(*keys, F.col(sub).alias("candidate sub"), *values, row_no))
        means = asked.filter(F.col(sub) == "").join(named, list(keys)).groupBy(*keys, sub).agg(*[F.avg(v).alias(v) for v in values])
        head = F.max(F.struct((-F.col(row_no)).alias("before"), *values)).alias("head")
        heads = tables.keep(named.filter(F.col("candidate sub").isNotNull()).groupBy(*keys, "candidate sub").agg(head))
        texts = heads.select(*keys, "candidate sub")
        bounded = tables.keep(to_compare(tables.keep(asked.filter(F.col(sub) != "")), texts, keys, sub, tables))
        first = bounded.groupBy(*keys, sub).agg(F.max_by("candidate sub", "bound").alias("likely")).withColumn("first", matching_ratio("likely", sub))
        able = bounded.join(first.drop("likely"), [*keys, sub]).filter(F.col("bound") >= F.col("first") - EVEN)
        pairs = able.select(sub, "candidate sub").distinct().withColumn("ratio", matching_ratio("candidate sub", sub))
        scored = able.select(*keys, sub, "candidate sub").join(pairs, [sub, "candidate sub"]).join(heads, [*keys, "candidate sub"])
        best = scored.groupBy(*keys, sub).agg(F.max(F.struct("ratio", "head")).alias("best"))
        return settled(means.unionByName(best.select(*keys, sub, *[F.col("best.head")[v].alias(v) for v in values])))


def fill_by_best_match(df: DataFrame, candidates: DataFrame, keys: Sequence[str], sub: str, values: Sequence[str], row_no: str) -> DataFrame:
    """Rows that miss any of the values take those of their best match; rows without a candidate stay as they are.

    Keys and sub are compared as texts without the blanks around them; a missing one reads as the text nan. Candidates
    that miss a value don't count.
    """
    read = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("nan")))
    texts = {c: read(c) for c in (*keys, sub)}
    found = best_match(df.filter(missing_any(values)).withColumns(texts), candidates.dropna(subset=list(values)).withColumns(texts), keys, sub, values, row_no)
    ref = found.toDF(*[f"ref {c}" for c in found.columns])
    same = read(sub) == F.col(f"ref {sub}")
    for k in keys:
        same = same & (read(k) == F.col(f"ref {k}"))
    met = df.join(ref, same, "left")
    use = missing_any(values) & F.col(f"ref {values[0]}").isNotNull()
    return met.withColumns({v: F.when(use, F.col(f"ref {v}")).otherwise(F.col(v)) for v in values}).select(*df.columns)


def aligned(rows: DataFrame, y: DataFrame, key: str = "_org_idx") -> DataFrame:
    """rows with their targets; raises if a key repeats or lacks a target."""
    if repeated := rows.groupBy(key).count().filter("count > 1").limit(10).collect():
        raise ValueError(f"{key} repeats: {[r[0] for r in repeated]}")
    if absent := rows.join(y, key, "left_anti").select(key).limit(10).collect():
        raise KeyError(f"no target for {[r[0] for r in absent]}")
    return rows.join(y, key)
