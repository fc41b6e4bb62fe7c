"""Scans, projections, conditional columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import stats
from quern.plans.builder import renamed, selected, with_id
from quern.sources.files import read_csv, shared_csv, typed
from quern.sources.files import read_table as t

YM = "year(o_orderdate) * 100 + month(o_orderdate)"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, d, "customer").withColumns({"y": 37.43 + ((k * 37) % 1000) * 0.00027, "x": 126.8 + ((k * 91) % 1000) * 0.0004})


CUSTOMER_SQL = "(select *, 37.43 + ((c_custkey*37)%1000)*0.00027::double as y, 126.8 + ((c_custkey*91)%1000)*0.0004::double as x from customer)"


def s01_scan_project(spark, d):
    df = renamed(t(spark, d, "orders"), {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "price"})
    return selected(df, ["order_id", "customer_id", "price"])


def s02_ext_join(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.select("c_custkey", "n_name", "r_name")


def s06_round_even_sink(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.half_even(F.col("l_quantity") / 4).alias("target"))


def s12_truncate_int(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("long").alias("target"))


def p02_org_idx(spark, d):
    df = with_id(t(spark, d, "orders"), "o_orderkey")
    return df.select(F.col("_org_idx").alias("org_idx"), "o_orderstatus")


def p04_value_to_null(spark, d):
    df = t(spark, d, "orders").withColumn("o_orderstatus", S.values_to_null(F.col("o_orderstatus"), ["P"]))
    return df.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus").isNull()).alias("n_null"), F.count("*").alias("n"))


def p05_category_clean(spark, d):
    c = S.filled(S.values_to_null(F.col("o_orderstatus"), ["P"]))
    return t(spark, d, "orders").select("o_orderkey", c.alias("status"))


def p06_keep_others(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.keep_or(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("segment"))


BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#34", "Brand#45"]


def p07_membership_flag(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", S.flag(F.col("p_brand").isin(BRANDS)).alias("premium"), S.flag(F.col("p_size") <= 10).alias("small"))


def p08_bucket_share(spark, d):
    q = F.col("l_quantity")
    bands = [(q <= 10), (q > 10) & (q <= 20), (q > 20) & (q <= 35), (q > 35)]
    per = t(spark, d, "lineitem").groupBy("l_partkey").agg(*[F.sum(F.when(b, q)).alias(f"b{i}") for i, b in enumerate(bands)])
    rows = t(spark, d, "part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    b = [F.col(f"b{i}") for i in range(4)]
    total, own = S.sum_of_known(b), S.by_range(F.col("p_size"), list(zip((10, 20, 35), b)), b[3])
    return rows.select("p_partkey", r6(S.ratio(own, total)).alias("share"), total.isNull().cast("int").alias("no_info"))


def p09_guarded_ratio(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.ratio(F.col("l_extendedprice"), F.col("l_quantity") - 10), 9).alias("price_per_extra"))


def p10_right_closed_bins(spark, d):
    bins = S.right_closed(F.col("p_size"), [0, 10, 20, 35, 45], ["tiny", "small", "middle", "large"])
    return t(spark, d, "part").select("p_partkey", bins.alias("size_class"))


def _with_gaps(spark, d):
    gap = F.col("c_custkey") % 3 == 0
    return customer_points(spark, d).withColumns({"y": F.when(~gap, F.col("y")), "x": F.when(~gap, F.col("x"))})


def p13_drop_unresolved(spark, d):
    known = F.col("y").isNotNull() & F.col("x").isNotNull()
    df = _with_gaps(spark, d)
    return df.agg(F.count("*").alias("n"), F.count_if(known).alias("n_kept"), r6(F.avg((~known).cast("double")) * 100).alias("dropped_percent"), r6(F.avg(F.col("y").isNotNull().cast("int")) * 100).alias("covered_percent"))


def p14_null_columns(spark, d):
    df = t(spark, d, "orders").withColumn("o_orderstatus", S.values_to_null(F.col("o_orderstatus"), ["P"]))
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols], *[stats.distinct_with_null(c).cast("long").alias(f"distinct_{c}") for c in cols])


def p15_constant(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.lit(0).alias("target"))


def p17_regex_filter(spark, d):
    return t(spark, d, "customer").filter(F.col("c_name").rlike(r"\d")).select("c_custkey", "c_name")


def p18_to_number(spark, d):
    c = S.to_number(F.regexp_extract("props", r"(\d+)", 1))
    return t(spark, d, "events").select("event_id", c.alias("k"))


def p20_cast(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("short").cast("int").alias("y"), F.round(F.col("o_totalprice").cast("float").cast("double") / 1000, 1).alias("price"))


def f01_regex_extract(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", S.first_match(F.col("p_name"), r"(\S+e)").alias("a"), S.first_match(F.col("p_name"), r"(\S+zz)").alias("b"))


def f02_split_token(spark, d):
    return t(spark, d, "part").select("p_partkey", S.token(F.col("p_name"), 0).alias("a"), S.token(F.col("p_name"), 1).alias("b"), S.token(F.col("p_name"), 5).alias("c"))


def f03_split_once(spark, d):
    full, main, sub = S.split_once(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
    return t(spark, d, "part").select("p_partkey", full.alias("full_name"), main.alias("main"), sub.alias("sub"))


def f04_concat_fallback(spark, d):
    main = F.when(F.col("p_partkey") % 5 != 0, S.token(F.col("p_name"), 0))
    sub = F.when(F.col("p_partkey") % 7 != 0, S.token(F.col("p_name"), 1))
    return t(spark, d, "part").select("p_partkey", S.joined_key(main, sub).alias("road"))


def f07_token_filter(spark, d):
    return t(spark, d, "part").select("p_partkey", S.without_tokens(F.col("p_name"), "t").alias("kept"))


def f08_text_key(spark, d):
    sub = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    return t(spark, d, "part").select("p_partkey", S.text_key(F.col("p_brand"), sub).alias("key_text"))


def f09_ym_parts(spark, d):
    y, m, q = S.year_month_quarter(F.expr(YM))
    return t(spark, d, "orders").select("o_orderkey", y.alias("y"), m.alias("m"), q.alias("q"))


def f12_age_delay(spark, d):
    a, b = F.year("l_shipdate"), F.year("o_orderdate") + F.col("l_linenumber") % 3
    met = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", S.positive_gap(a, b).alias("age"), S.positive_gap(b, a).alias("delay"))


def f13_haversine(spark, d):
    y, x = F.lit(37.5), F.lit(127.0)
    return customer_points(spark, d).select("c_custkey", r6(S.haversine(F.col("y"), F.col("x"), y, x)).alias("km"))


def f14_haversine_sine(spark, d):
    y, x = F.lit(37.5), F.lit(127.0)
    return customer_points(spark, d).select("c_custkey", r6(S.haversine_by_sine(F.col("y"), F.col("x"), y, x)).alias("km"))


def f15_planar(spark, d):
    py, px = S.planar(F.col("y"), F.col("x"), F.lit(37.5))
    return customer_points(spark, d).select("c_custkey", r6(py).alias("py"), r6(px).alias("px"))


def f17_log1p_roundtrip(spark, d):
    c = F.col("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", r6(F.log1p(c)).alias("logged"), F.round(F.expm1(F.log1p(c)), 2).alias("back"))


def f20_fill(spark, d):
    c = S.values_to_null(F.col("o_orderpriority"), ["1-URGENT"])
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(c, F.lit("")).alias("priority"))


def w03_preview(spark, d):
    return t(spark, d, "orders").orderBy("o_orderkey").limit(5).select("o_orderkey", "o_orderstatus")


HAV_A = "(pow(sin((radians(37.5)-radians(y))/2),2)+cos(radians(y))*cos(radians(37.5))*pow(sin(radians(127.0-x)/2),2))"
TOTAL = "(case when coalesce(b0,b1,b2,b3) is not null then coalesce(b0,0)+coalesce(b1,0)+coalesce(b2,0)+coalesce(b3,0) end)"
GAPS = f"(select c_custkey, c_nationkey, case when c_custkey%3<>0 then y end y, case when c_custkey%3<>0 then x end x from {CUSTOMER_SQL})"

def s01_csv_scan(spark, d):
    """A table through CSV: written once to the shared folder, and scanned with a schema and a header."""
    nation = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return read_csv(spark, shared_csv(nation, "nation"), nation.schema)


def s01_inferred_types(spark, d):
    """Text columns of a CSV file become whole numbers, fractions, truth values and texts."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 2 == 0).alias("even"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).cast("long").alias("nation"))
    return typed(read_csv(spark, shared_csv(c, "customer"))).withColumn("nation", F.coalesce("nation", F.lit(-1)))


QUERIES = {
    "s01_csv_scan": (s01_csv_scan, "select n_nationkey, n_name, n_regionkey from nation"),
    "s01_inferred_types": (s01_inferred_types, "select c_custkey, c_acctbal::double as c_acctbal, c_mktsegment, c_custkey%2=0 as even, (case when c_nationkey<>3 then c_nationkey else -1 end)::bigint as nation from customer"),
    "s01_scan_project": (s01_scan_project, "select o_orderkey as order_id, o_custkey as customer_id, o_totalprice as price from orders"),
    "s02_ext_join": (s02_ext_join, "select c_custkey, n_name, r_name from customer left join (nation join region on n_regionkey=r_regionkey) on c_nationkey=n_nationkey"),
    "s06_round_even_sink": (s06_round_even_sink, "select l_orderkey, l_linenumber, cast(round_even(l_quantity/4, 0) as bigint) as target from lineitem"),
    "s12_truncate_int": (s12_truncate_int, "select l_orderkey, l_linenumber, cast(trunc(l_extendedprice) as bigint) as target from lineitem"),
    "p02_org_idx": (p02_org_idx, "select o_orderkey as org_idx, o_orderstatus from orders"),
    "p04_value_to_null": (p04_value_to_null, "select o_orderpriority, count(*) filter (nullif(o_orderstatus,'P') is null) as n_null, count(*) as n from orders group by 1"),
    "p05_category_clean": (p05_category_clean, "select o_orderkey, coalesce(nullif(trim(nullif(o_orderstatus,'P')),''),'__NA__') as status from orders"),
    "p06_keep_others": (p06_keep_others, "select c_custkey, case when trim(c_mktsegment) in ('BUILDING','MACHINERY') then trim(c_mktsegment) else 'OTHERS' end as segment from customer"),
    "p07_membership_flag": (p07_membership_flag, "select p_partkey, case when p_brand in ('" + "','".join(BRANDS) + "') then 1 else 0 end as premium, case when p_size<=10 then 1 else 0 end as small from part"),
    "p08_bucket_share": (p08_bucket_share, f"""with per as (select l_partkey, sum(case when l_quantity<=10 then l_quantity end) b0, sum(case when l_quantity>10 and l_quantity<=20 then l_quantity end) b1,
        sum(case when l_quantity>20 and l_quantity<=35 then l_quantity end) b2, sum(case when l_quantity>35 then l_quantity end) b3 from lineitem group by 1),
        met as (select p_partkey, case when p_size<=10 then b0 when p_size<=20 then b1 when p_size<=35 then b2 else b3 end own, {TOTAL} total from part left join per on p_partkey=l_partkey)
        select p_partkey, round(case when total>0 then own/total end, 6) as share, case when total is null then 1 else 0 end as no_info from met"""),
    "p09_guarded_ratio": (p09_guarded_ratio, "select l_orderkey, l_linenumber, round(case when l_quantity-10>0 then l_extendedprice/(l_quantity-10) end, 9) as price_per_extra from lineitem"),
    "p10_right_closed_bins": (p10_right_closed_bins, "select p_partkey, case when p_size>0 and p_size<=10 then 'tiny' when p_size>10 and p_size<=20 then 'small' when p_size>20 and p_size<=35 then 'middle' when p_size>35 and p_size<=45 then 'large' else 'nan' end as size_class from part"),
    "p13_drop_unresolved": (p13_drop_unresolved, f"select count(*) as n, count(*) filter (y is not null and x is not null) as n_kept, round(avg(case when y is null or x is null then 1.0 else 0.0 end)*100,6) as dropped_percent, round(avg(case when y is not null then 1.0 else 0.0 end)*100,6) as covered_percent from {GAPS}"),
    "p14_null_columns": (p14_null_columns, "with o as (select nullif(o_orderstatus,'P') o_orderstatus, o_orderpriority, o_custkey from orders) select " + ", ".join(f"count(*) filter ({c} is null) as null_{c}, cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) as distinct_{c}" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + " from o"),
    "p15_constant": (p15_constant, "select o_orderkey, 0 as target from orders"),
    "p17_regex_filter": (p17_regex_filter, r"select c_custkey, c_name from customer where regexp_matches(c_name, '\d')"),
    "p18_to_number": (p18_to_number, r"select event_id, try_cast(regexp_extract(props, '(\d+)', 1) as double) as k from events"),
    "p20_cast": (p20_cast, "select o_orderkey, cast(year(o_orderdate) as integer) as y, round(cast(cast(o_totalprice as float) as double)/1000, 1) as price from orders"),
    "f01_regex_extract": (f01_regex_extract, r"select p_partkey, nullif(regexp_extract(p_name,'(\S+e)',1),'') as a, nullif(regexp_extract(p_name,'(\S+zz)',1),'') as b from part"),
    "f02_split_token": (f02_split_token, "select p_partkey, nullif(split_part(p_name,' ',1),'') as a, nullif(split_part(p_name,' ',2),'') as b, nullif(split_part(p_name,' ',6),'') as c from part"),
    "f03_split_once": (f03_split_once, "select p_partkey, trim(p_name) as full_name, split_part(trim(p_name),' ',1) as main, case when position(' ' in trim(p_name))>0 then substr(trim(p_name), position(' ' in trim(p_name))+1) else '' end as sub from part"),
    "f04_concat_fallback": (f04_concat_fallback, "select p_partkey, trim(concat(coalesce(case when p_partkey%5<>0 then split_part(p_name,' ',1) end,''),' ',coalesce(case when p_partkey%7<>0 then split_part(p_name,' ',2) end,''))) as road from part"),
    "f07_token_filter": (f07_token_filter, "select p_partkey, array_to_string(list_filter(string_split(p_name,' '), lambda x: not ends_with(x,'t')),' ') as kept from part"),
    "f08_text_key": (f08_text_key, "select p_partkey, concat(coalesce(p_brand,'nan'),' ',coalesce(case when p_partkey%7<>0 then cast(p_size as varchar) end,'nan')) as key_text from part"),
    "f09_ym_parts": (f09_ym_parts, "select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast((month(o_orderdate)-1)//3+1 as integer) as q from orders"),
    "f12_age_delay": (f12_age_delay, "select l_orderkey, l_linenumber, cast(greatest(year(l_shipdate)-(year(o_orderdate)+l_linenumber%3),0) as integer) as age, cast(greatest(year(o_orderdate)+l_linenumber%3-year(l_shipdate),0) as integer) as delay from lineitem join orders on l_orderkey=o_orderkey"),
    "f13_haversine": (f13_haversine, f"select c_custkey, round(2*6371.0*atan2(sqrt({HAV_A}), sqrt(1-{HAV_A})),6) as km from {CUSTOMER_SQL}"),
    "f14_haversine_sine": (f14_haversine_sine, f"select c_custkey, round(2*6371.0*asin(sqrt(least({HAV_A},1.0))),6) as km from {CUSTOMER_SQL}"),
    "f15_planar": (f15_planar, f"select c_custkey, round(radians(y)*6371.0,6) as py, round(radians(x)*cos(radians(37.5))*6371.0,6) as px from {CUSTOMER_SQL}"),
    "f17_log1p_roundtrip": (f17_log1p_roundtrip, "select o_orderkey, round(ln(1+o_totalprice),6) as logged, round(exp(ln(1+o_totalprice))-1,2) as back from orders"),
    "f20_fill": (f20_fill, "select o_orderkey, coalesce(nullif(o_orderpriority,'1-URGENT'),'') as priority from orders"),
    "w03_preview": (w03_preview, "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 5"),
}
