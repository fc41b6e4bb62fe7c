"""Aggregations, sorts, set operations, encoders and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import encode, learn, stats
from quern.queries.scalars import YM, r6
from quern.sources.files import read_table as t

POLICY = {"kind": "time_holdout", "ym_col": "ym", "train_until": 199912, "valid_from": 200001, "valid_until": 200012}


def orders(spark, d):
    return t(spark, d, "orders").withColumn("ym", F.expr(YM))


def a01_freq_encode(spark, d):
    status = S.values_to_null(F.col("o_orderstatus"), ["P"])
    train, valid = encode.time_holdout(orders(spark, d).withColumn("o_orderstatus", status), POLICY)
    state = encode.frequencies(train, "o_orderstatus").filter("value <> 'O'")
    return encode.apply_map(valid, state, S.filled(F.col("o_orderstatus")), "freq", 0.0).select("o_orderkey", r6(F.col("freq")).alias("freq"))


def a02_count_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.max("l_quantity").alias("most"))


def a06_median(spark, d):
    return stats.quantile_row(t(spark, d, "lineitem"), {"price": ("l_extendedprice", 0.5), "quantity": ("l_quantity", 0.5)})


def e06_median_impute(spark, d):
    df = t(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    return encode.impute(df, encode.medians(df, ["l_quantity"])).select("l_orderkey", "l_linenumber", "l_quantity")


def a08_value_counts(spark, d):
    return stats.top_values(t(spark, d, "part"), "p_brand")


def a09_describe(spark, d):
    df = stats.described(t(spark, d, "lineitem"), "l_extendedprice")
    return df.select("n", *[F.round(c, 2).alias(c) for c in ("mean", "std", "lo", "q1", "q2", "q3", "hi")])


def a12_tiers(spark, d):
    o = t(spark, d, "orders").filter("o_orderstatus <> 'F'")
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "road").when(F.col("o_totalprice") > 200000, "lot").when(F.col("o_custkey") % 2 == 0, "main").otherwise("none")
    return o.agg(*[F.count_if(tier == k).alias(f"n_{k}") for k in ("road", "lot", "main", "none")], F.count("*").alias("n"))


def a13_range(spark, d):
    return orders(spark, d).agg(F.min("ym").cast("long").alias("first_ym"), F.max("ym").cast("long").alias("last_ym"))


def a18_shape(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    n = train.agg(F.count("*").alias("n_train")).crossJoin(valid.agg(F.count("*").alias("n_valid")))  # one row each
    return n.withColumn("share", r6(F.col("n_valid") / F.col("n_train")))


def a19_all_match(spark, d):
    o = orders(spark, d)
    return o.agg(F.bool_and(F.col("ym").cast("string").rlike(r"^\d{6}$")).alias("all_match"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), (F.count_distinct("o_orderkey") < F.count("*")).alias("repeats"))


def _predicted(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    means = train.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    return valid.join(means, "o_orderpriority")


def a15_rmse(spark, d):
    return _predicted(spark, d).agg(F.round(learn.rmse(F.col("o_totalprice"), F.col("prediction")), 4).alias("rmse"))


def a16_mae(spark, d):
    return _predicted(spark, d).agg(F.round(learn.mae(F.col("o_totalprice"), F.col("prediction")), 4).alias("mae"))


def a17_pct_total(spark, d):
    rev = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("revenue"))
    return rev.select("l_returnflag", r6(F.col("revenue") / F.sum("revenue").over(W.partitionBy()) * 100).alias("percent")).orderBy(F.desc("percent"), "l_returnflag")


def a20_iqr_share(spark, d):
    return stats.outlier_share(t(spark, d, "orders"), "o_totalprice", 0.5).select(r6(F.col("share")).alias("share"))


def w02_top_k(spark, d):
    per = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return per.orderBy(F.desc("q"), "l_partkey").limit(15)


def u01_union(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    return train.unionByName(valid).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _customers(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    return train.select("o_custkey").distinct(), valid.select("o_custkey").distinct()


def u02_set_overlap(spark, d):
    a, b = _customers(spark, d)
    flags = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "o_custkey", "full")
    both, only = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count_if(F.col("a").isNull())
    return flags.agg(both.alias("n_both"), only.alias("n_only_valid"), F.count("b").alias("n_valid"), r6(F.try_divide(both, F.count("b"))).alias("overlap"))


def u03_union_values(spark, d):
    a, b = _customers(spark, d)
    return a.union(b).distinct()


def u04_distinct(spark, d):
    return t(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropna().dropDuplicates()


def u05_partition_check(spark, d):
    seg = t(spark, d, "customer").select("c_mktsegment").distinct()
    a = seg.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    b = seg.subtract(a)
    return a.select("c_mktsegment", F.lit("a").alias("part")).unionByName(b.select("c_mktsegment", F.lit("b").alias("part")))


def e02_fixed_categories(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    known = encode.sorted_codes(p.filter("p_size <= 1"), "p_brand")  # categories of the smallest parts
    return encode.fixed_categories(p, known.select("value"), "p_brand").select("p_partkey", "p_brand")


def e03_first_seen(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    codes = encode.first_seen_codes(train, "o_orderpriority", "o_orderkey").filter("code < 4")
    return encode.apply_map(valid, codes, F.col("o_orderpriority"), "code", -1).select("o_orderkey", F.col("code").cast("int").alias("code"))


def e04_label(spark, d):
    return encode.sorted_codes(t(spark, d, "part"), "p_brand").select("value", F.col("code").cast("int").alias("code"))


def e07_time_holdout(spark, d):
    train, valid = encode.time_holdout(orders(spark, d), POLICY)
    parts = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def e08_threshold(spark, d):
    o = orders(spark, d).withColumn("ym", F.when(F.col("o_orderkey") % 11 != 0, F.col("ym")))
    early, late = encode.threshold_split(o, "ym", 199806)
    parts = early.withColumn("part", F.lit("early")).unionByName(late.withColumn("part", F.lit("late")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def e09_hash_split(spark, d):
    a, b = encode.hash_split(t(spark, d, "orders"), "o_orderkey")
    return a.select("o_orderkey", F.lit("train").alias("part")).unionByName(b.select("o_orderkey", F.lit("valid").alias("part")))


def flagship(spark, d):
    """Scan, value rules, time holdout, frequencies fitted on training rows, group means, error by segment."""
    status = S.filled(S.values_to_null(F.col("o_orderstatus"), ["P"]))
    o = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("o_orderstatus", status)
    train, valid = encode.time_holdout(o, POLICY)
    means = train.groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("prediction"))
    rows = encode.apply_map(valid, encode.frequencies(train, "o_orderstatus"), F.col("o_orderstatus"), "freq", 0.0).join(means, "c_mktsegment")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), r6(F.avg("freq")).alias("freq"), F.round(learn.rmse(F.col("o_totalprice"), F.col("prediction")), 4).alias("rmse"))


O = f"with o as (select *, {YM} ym from orders), tr as (select * from o where ym<=199912), va as (select * from o where ym>=200001 and ym<=200012)"
PRED = f"{O}, m as (select o_orderpriority, avg(o_totalprice) p from tr group by 1), j as (select o_totalprice y, p from va join m using (o_orderpriority))"

QUERIES = {
    "flagship": (flagship, f"""with o as (select *, {YM} ym, coalesce(nullif(o_orderstatus,'P'),'__NA__') st from orders join customer on o_custkey=c_custkey), tr as (select * from o where ym<=199912), va as (select * from o where ym>=200001 and ym<=200012),
        f as (select st, count(*)*1.0::double/(select count(*) from tr) freq from tr group by 1), m as (select c_mktsegment, avg(o_totalprice) p from tr group by 1)
        select va.c_mktsegment as c_mktsegment, count(*) as n, round(avg(coalesce(freq,0.0)),6) as freq, round(sqrt(avg(pow(o_totalprice-p,2))),4) as rmse from va left join f on va.st=f.st join m on va.c_mktsegment=m.c_mktsegment group by 1"""),
    "a01_freq_encode": (a01_freq_encode, f"{O}, f as (select coalesce(nullif(o_orderstatus,'P'),'__NA__') v, count(*)*1.0::double/(select count(*) from tr) freq from tr group by 1) select o_orderkey, round(coalesce(freq,0.0),6) as freq from va left join (select * from f where v<>'O') f on coalesce(nullif(o_orderstatus,'P'),'__NA__')=v"),
    "a02_count_distinct": (a02_count_distinct, "select l_suppkey, count(distinct l_partkey) as n_parts, max(l_quantity) as most from lineitem group by 1"),
    "a06_median": (a06_median, "select median(l_extendedprice) as price, median(l_quantity) as quantity from lineitem"),
    "e06_median_impute": (e06_median_impute, "select l_orderkey, l_linenumber, coalesce(case when l_linenumber>1 then l_quantity end, (select median(l_quantity) from lineitem where l_linenumber>1)) as l_quantity from lineitem"),
    "a08_value_counts": (a08_value_counts, "select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 5"),
    "a09_describe": (a09_describe, "select count(l_extendedprice) as n, round(avg(l_extendedprice),2) as mean, round(stddev_samp(l_extendedprice),2) as std, round(min(l_extendedprice),2) as lo, round(quantile_cont(l_extendedprice,0.25),2) as q1, round(quantile_cont(l_extendedprice,0.5),2) as q2, round(quantile_cont(l_extendedprice,0.75),2) as q3, round(max(l_extendedprice),2) as hi from lineitem"),
    "a12_tiers": (a12_tiers, "with o as (select case when o_orderpriority='1-URGENT' then 'road' when o_totalprice>200000 then 'lot' when o_custkey%2=0 then 'main' else 'none' end k from orders where o_orderstatus<>'F') select " + ", ".join(f"count(*) filter (k='{k}') as n_{k}" for k in ("road", "lot", "main", "none")) + ", count(*) as n from o"),
    "a13_range": (a13_range, f"select cast(min({YM}) as bigint) as first_ym, cast(max({YM}) as bigint) as last_ym from orders"),
    "a18_shape": (a18_shape, f"{O} select a as n_train, b as n_valid, round(b/a,6) as share from (select (select count(*) from tr) a, (select count(*) from va) b)"),
    "a19_all_match": (a19_all_match, rf"{O} select bool_and(regexp_full_match(cast(ym as varchar), '\d{{6}}')) as all_match, bool_or(o_totalprice>400000) as any_large, count(distinct o_orderkey)<count(*) as repeats from o"),
    "a15_rmse": (a15_rmse, f"{PRED} select round(sqrt(avg(pow(y-p,2))),4) as rmse from j"),
    "a16_mae": (a16_mae, f"{PRED} select round(avg(abs(y-p)),4) as mae from j"),
    "a17_pct_total": (a17_pct_total, "with r as (select l_returnflag, sum(l_extendedprice) v from lineitem group by 1) select l_returnflag, round(v/sum(v) over ()*100,6) as percent from r"),
    "a20_iqr_share": (a20_iqr_share, "with q as (select quantile_cont(o_totalprice,0.25) a, quantile_cont(o_totalprice,0.75) b from orders) select round(avg(case when o_totalprice<a-0.5*(b-a) or o_totalprice>b+0.5*(b-a) then 1.0 else 0.0 end),6) as share from orders, q"),
    "w02_top_k": (w02_top_k, "select l_partkey, sum(l_quantity) as q from lineitem group by 1 order by q desc, l_partkey limit 15"),
    "u01_union": (u01_union, f"{O} select o_orderstatus, count(*) as n from (select * from tr union all select * from va) group by 1"),
    "u02_set_overlap": (u02_set_overlap, f"{O}, a as (select distinct o_custkey k from tr), b as (select distinct o_custkey k from va) select x as n_both, z-x as n_only_valid, z as n_valid, round(x/nullif(z,0),6) as overlap from (select (select count(*) from (select k from a intersect select k from b)) x, (select count(*) from b) z)"),
    "u03_union_values": (u03_union_values, f"{O} select o_custkey from tr union select o_custkey from va"),
    "u04_distinct": (u04_distinct, "select distinct c_nationkey, c_mktsegment from customer where c_nationkey is not null and c_mktsegment is not null"),
    "u05_partition_check": (u05_partition_check, "with s as (select distinct c_mktsegment from customer) select c_mktsegment, 'a' as part from s where c_mktsegment in ('BUILDING','MACHINERY') union all (select c_mktsegment, 'b' as part from s where c_mktsegment not in ('BUILDING','MACHINERY'))"),
    "e02_fixed_categories": (e02_fixed_categories, "select p_partkey, case when p_brand in (select p_brand from part where p_size<=1) then p_brand end as p_brand from part"),
    "e03_first_seen": (e03_first_seen, f"{O}, f as (select o_orderpriority v, row_number() over (order by min(o_orderkey))-1 c from tr group by 1) select o_orderkey, cast(coalesce(c,-1) as integer) as code from va left join (select * from f where c<4) f on o_orderpriority=v"),
    "e04_label": (e04_label, "select p_brand as value, cast(row_number() over (order by p_brand)-1 as integer) as code from (select distinct p_brand from part)"),
    "e07_time_holdout": (e07_time_holdout, f"{O} select 'train' as part, count(*) as n from tr union all select 'valid' as part, count(*) as n from va"),
    "e08_threshold": (e08_threshold, f"{O}, h as (select case when o_orderkey%11<>0 then ym end ym from o) select case when coalesce(ym<=199806,false) then 'early' else 'late' end as part, count(*) as n from h group by 1"),
    "e09_hash_split": (e09_hash_split, "select o_orderkey, case when substr(md5(cast(o_orderkey as varchar)),1,8)<'cccccccc' then 'train' else 'valid' end as part from orders"),
}
