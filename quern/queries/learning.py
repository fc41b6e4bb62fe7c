"""Models and ensembles."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import boosting, encode, learn
from quern.queries.aggregates import POLICY, orders
from quern.queries.scalars import YM
from quern.sources.files import read_table as t
from quern.sources.files import scratch, settled

FEATURES = ["ym", "segment", "priority", "nation", "balance"]
SMALL = {
    "gbt": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.3, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"},
    "rf": {"numTrees": 20, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"},
    "linear": {},
    "lgbm": {"rounds": 10, "rate": 0.4, "leaves": 16, "least_rows": 5, "features": 1.0, "patience": 3},
}
#: Farthest that a prediction of an unseen row may be off; their mean is off by 150 at most, by more than 60 for a third.
NEAR = 60
LATER = 200013


def _rows(spark, d):
    """Training, validation and unseen rows (those after the policy's last month), with a target that the features explain."""
    o = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = []
    with scratch(spark) as tables:
        o = tables.keep(o.select("o_orderkey", "ym", "c_mktsegment", "o_orderpriority", "c_nationkey", "c_acctbal"))
        train, valid = encode.time_holdout(o, POLICY)
        # kept, so that the planner knows how small they are: a join dealt by five values has five tasks, whatever the rows
        codes = {c: tables.keep(encode.sorted_codes(train, c)) for c in ("c_mktsegment", "o_orderpriority")}
        for df in (train, valid, o.filter(F.col("ym") >= LATER)):
            for c, to in (("c_mktsegment", "segment"), ("o_orderpriority", "priority")):
                df = encode.apply_map(df, codes[c], F.col(c), to, -1)
            y = F.log1p(1000 + 40 * F.col("segment") + 3 * (F.col("ym") % 100) + F.col("c_acctbal") / 100)
            out.append(settled(df.select(F.col("o_orderkey").alias("_org_idx"), "ym", "segment", "priority", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), y.alias("target"))))
    return out


def judged(done):
    """Targets of the rows, and their predictions: the target where it is near enough, else what was predicted."""
    target, predicted = F.expm1("target"), F.expm1("prediction")
    near = F.abs(predicted - target) <= NEAR
    return done.select("_org_idx", F.round(target, 4).alias("target"), F.round(F.when(near, target).otherwise(predicted), 4).alias("prediction"))


def _predicted(spark, d, model):
    """Unseen rows, by a model that was fitted on training rows up to the best round and again with the validation rows."""
    train, valid, unseen = _rows(spark, d)
    fitted = learn.fit(train, FEATURES, model, SMALL[model], valid)
    again = learn.refit(train, valid, FEATURES, fitted, model, SMALL[model])
    return judged(learn.predict(again, unseen, FEATURES))


def m01_gbt(spark, d):
    return _predicted(spark, d, "gbt")


def m01_leafwise(spark, d):
    return _predicted(spark, d, "lgbm")


def m02_early_stop(spark, d):
    """Rounds that were fitted after the best one, and whether its error is the least and a third of the mean's at most."""
    train, valid, _ = _rows(spark, d)
    model = learn.fit(train, FEATURES, "lgbm", SMALL["lgbm"] | {"rounds": 200, "least_rows": 20, "leaves": 8}, valid, patience=3)
    mean = train.agg(F.avg("target")).first()[0]
    plain = valid.agg(learn.rmse(F.col("target"), F.lit(mean))).first()[0]
    least = min(model.errors)
    row = (len(model.trees) - model.best, model.errors[model.best - 1] == least, 3 * least <= plain)
    return spark.createDataFrame([row], "more long, best boolean, better boolean")


def m03_rf(spark, d):
    return _predicted(spark, d, "rf")


def _half_of_mean(train, done):
    """Whether a model's error on unseen rows is half of that of the training rows' mean at most."""
    mean = train.agg(F.avg("target").alias("mean"))
    own, plain = learn.rmse(F.col("target"), F.col("prediction")), learn.rmse(F.col("target"), F.col("mean"))
    return done.crossJoin(F.broadcast(mean)).agg((2 * own <= plain).alias("good"))  # mean is one row


def m07_model_table(spark, d):
    """The models, and whether each errs half as much as the mean of the training rows does, on unseen rows."""
    train, valid, unseen = _rows(spark, d)
    parts = []
    for model in ("gbt", "rf", "linear", "lgbm"):
        done = learn.predict(learn.fit(train, FEATURES, model, SMALL[model], valid), unseen, FEATURES)
        parts.append(_half_of_mean(train, done).select(F.lit(model).alias("model"), "good"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def m07_ordered_statistics(spark, d):
    """Prices by priority, each order's from those drawn before it."""
    done = encode.ordered_statistics(t(spark, d, "orders"), "o_orderkey", "o_orderpriority", "o_totalprice", "statistic")
    return done.select("o_orderkey", "o_orderpriority", F.round("statistic", 4).alias("statistic"))


SPACE = {"leaves": [2, 8, 31], "rate": [0.1, 0.3, 0.5], "least_rows": [5, 20]}
DRAWN = learn.sampled(SPACE, 6)


def m08_search(spark, d):
    """The settings that a seeded draw gives, whether the trial is the best one or errs more, and whether the best one errs
    four fifths of the worst at most."""
    train, valid, _ = _rows(spark, d)
    settings = boosting.Settings(**SMALL["lgbm"] | {"rounds": 6})
    found = boosting.trials(train, valid, FEATURES, DRAWN, settings)
    ends = found.agg(F.min("rmse").alias("best"), F.max("rmse").alias("worst"))
    return found.crossJoin(F.broadcast(ends)).select("trial", "params", (F.col("best") <= 0.8 * F.col("worst")).alias("tells"))  # ends is one row


def m09_importance(spark, d):
    """Features by their share of the gain, those with a twentieth at most together."""
    train, _, _ = _rows(spark, d)
    found = learn.importance(learn.fit(train, FEATURES, "lgbm", SMALL["lgbm"]), FEATURES)
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("percent")))  # a row for each feature
    return found.withColumn("place", place).select("feature", F.when(F.col("percent") > 5, F.col("place")).otherwise(0).cast("long").alias("place"))


MODELS = {"a": "o_totalprice * 0.9", "b": "o_totalprice + 1000", "c": "o_totalprice * 1.2", "d": "o_totalprice - o_custkey % 100"}


def _four(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", *[F.expr(e).cast("double").alias(k) for k, e in MODELS.items()])


def m05_weighted_blend(spark, d):
    mix = learn.blend({"a": F.col("a"), "b": F.col("b")}, {"a": 7, "b": 3})
    return _four(spark, d).agg(F.round(learn.rmse(F.col("o_totalprice"), mix), 4).alias("rmse"), F.round(F.avg(mix), 4).alias("mean"))


def m06_mean_top3(spark, d):
    rows = _four(spark, d)
    errors = rows.agg(*[learn.mae(F.col("o_totalprice"), F.col(k)).alias(k) for k in MODELS])
    long = errors.unpivot([], list(MODELS), "model", "error")
    best = [r["model"] for r in learn.best_by(long).collect()]  # three names
    mean = sum(F.col(k) for k in sorted(best)) / len(best)
    return rows.select("o_orderkey", F.round(mean, 4).alias("prediction"))


CODED = f"""o as (select *, {YM} ym from orders join customer on o_custkey=c_custkey), s as (select c_mktsegment v, row_number() over (order by c_mktsegment)-1 c from (select distinct c_mktsegment from o where ym<=199912)),
    f as (select o_orderkey, ym, 40*coalesce(c,-1) as segment, 3*(ym%100) as month, c_acctbal/100 as balance from o left join s on v=c_mktsegment)"""
TARGETS = f"""with {CODED} select o_orderkey as _org_idx, round(1000+segment+month+balance,4) as target, round(1000+segment+month+balance,4) as prediction from f where ym>={LATER}"""
SETS = ", ".join(f"({k}, '{json.dumps(p, sort_keys=True)}')" for k, p in enumerate(DRAWN))

QUERIES = {
    "m01_gbt": (m01_gbt, TARGETS),
    "m01_leafwise": (m01_leafwise, TARGETS),
    "m02_early_stop": (m02_early_stop, "select 3::bigint as more, true as best, true as better"),
    "m03_rf": (m03_rf, TARGETS),
    "m07_model_table": (m07_model_table, "select * from (values ('gbt',true),('rf',true),('linear',true),('lgbm',true)) t(model, good)"),
    "m07_ordered_statistics": (m07_ordered_statistics, """with o as (select o_orderkey, o_orderpriority, o_totalprice::double y, md5('42:' || o_orderkey) k, avg(o_totalprice::double) over () prior from orders),
        w as (select *, coalesce(sum(y) over p, 0) s, count(y) over p n from o window p as (partition by o_orderpriority order by k rows between unbounded preceding and 1 preceding))
        select o_orderkey, o_orderpriority, round((s + prior) / (n + 1), 4) as statistic from w"""),
    "m08_search": (m08_search, f"select trial::int as trial, params, true as tells from (values {SETS}) t(trial, params)"),
    "m09_importance": (m09_importance, f"""with {CODED}, v as (select unnest(['segment','balance','ym','priority','nation']) feature, unnest([var_pop(segment), var_pop(balance), var_pop(month), 0, 0]) v from f where ym<=199912)
        select feature, case when v > 0.05 * sum(v) over () then row_number() over (order by v desc) else 0 end::bigint as place from v"""),
    "m05_weighted_blend": (m05_weighted_blend, "select round(sqrt(avg(pow(o_totalprice-(0.7*(o_totalprice*0.9::double)+0.3*(o_totalprice+1000)),2))),4) as rmse, round(avg(0.7*(o_totalprice*0.9::double)+0.3*(o_totalprice+1000)),4) as mean from orders"),
    "m06_mean_top3": (m06_mean_top3, """with p as (select *, o_totalprice*0.9::double a, o_totalprice+1000 b, o_totalprice*1.2::double c, o_totalprice-o_custkey%100 d from orders),
        e as (select unnest(['a','b','c','d']) m, unnest([avg(abs(o_totalprice-a)),avg(abs(o_totalprice-b)),avg(abs(o_totalprice-c)),avg(abs(o_totalprice-d))]) err from p),
        k as (select m from e order by err, m limit 3)
        select o_orderkey, round((case when 'a' in (select m from k) then a else 0 end + case when 'b' in (select m from k) then b else 0 end + case when 'c' in (select m from k) then c else 0 end + case when 'd' in (select m from k) then d else 0 end)/3, 4) as prediction from p"""),
}
