"""Joins, lookups and spatial joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import lookups, spatial
from quern.queries.scalars import CUSTOMER_SQL, GAPS, YM, _with_gaps, customer_points, r6
from quern.sources.asking import asked
from quern.sources.files import looked_up, shared_folder
from quern.sources.files import read_table as t

SUPPLIER_SQL = "(select *, 37.43 + ((s_suppkey*53)%1000)*0.00027::double as y, 126.8 + ((s_suppkey*17)%1000)*0.0004::double as x from supplier)"


def supplier_points(spark, d):
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").withColumns({"y": 37.43 + ((k * 53) % 1000) * 0.00027, "x": 126.8 + ((k * 17) % 1000) * 0.0004})


def _reference(spark, d):
    ref = supplier_points(spark, d).select(F.col("s_nationkey").cast("string").alias("k"), "y", "x", "s_suppkey")
    gaps = ref.withColumn("y", F.when(F.col("s_suppkey") % 4 != 0, F.col("y")))  # no place: not to be taken
    return lookups.last_wins(gaps, "k", ["y", "x"], "s_suppkey")


def _left(spark, d):
    return _with_gaps(spark, d).select("c_custkey", F.col("c_nationkey").cast("string").alias("k"), "y", "x")


def _rounded(df):
    return df.select("c_custkey", r6(F.col("y")).alias("y"), r6(F.col("x")).alias("x"))


def j01_fill_lookup(spark, d):
    return _rounded(lookups.fill_missing(_left(spark, d), _reference(spark, d).filter("k <> '3'"), "k", ["y", "x"]))


def j02_cascade(spark, d):
    ref = _reference(spark, d)
    parts = [(ref.filter("cast(k as int) < 8"), "k"), (ref.filter("cast(k as int) < 20"), "k")]
    return _rounded(lookups.cascade(_left(spark, d), parts, ["y", "x"]))


def j03_last_wins(spark, d):
    return _reference(spark, d).select("k", r6(F.col("y")).alias("y"), r6(F.col("x")).alias("x"))


def j13_overwrite_lookup(spark, d):
    left = _left(spark, d).withColumn("x", F.coalesce("x", F.lit(1.0)))
    return _rounded(lookups.overwrite_missing(left, _reference(spark, d).filter("k <> '3'"), "k", ["y", "x"]))


def j04_mean_branch(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("k"), F.lit("").alias("sub"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"), F.col("p_partkey").alias("row_no"))
    best = lookups.best_match(p.select("k", "sub").distinct(), p, ["k"], "sub", ["y", "x"], "row_no")
    return best.select("k", r6(F.col("y")).alias("y"), r6(F.col("x")).alias("x"))


def j04_fuzzy_best(spark, d):
    """Each brand's part types matched to the names of all its parts."""
    p = t(spark, d, "part").select(F.col("p_brand").alias("k"), "p_type", "p_name", F.col("p_retailprice").alias("y"), F.col("p_partkey").alias("row_no"))
    best = lookups.best_match(p.withColumnRenamed("p_type", "sub"), p.withColumnRenamed("p_name", "sub"), ["k"], "sub", ["y"], "row_no")
    return best.select("k", "sub", "y")


def _points(spark, d):
    return customer_points(spark, d).select(F.col("c_custkey").alias("id"), "y", "x")


def _places(spark, d):
    s = supplier_points(spark, d)
    n = s.groupBy(F.col("s_nationkey").alias("nk")).agg(S.power_weight(F.count_distinct("s_suppkey")).alias("weight"))
    met = s.join(n, F.col("s_nationkey") == F.col("nk"))
    return met.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("name"), "y", "x", "weight")


def j05_nearest(spark, d):
    found = spatial.nearest_distance(_points(spark, d), _places(spark, d).select("key", "y", "x"))
    return found.select("id", "key", r6(F.col("km")).alias("km"))


def j06_nearest_degree(spark, d):
    found = spatial.nearest_distance(_points(spark, d), _places(spark, d).select("key", "y", "x"), metric="degree")
    return found.select("id", "key", r6(F.col("km")).alias("km"))


def j07_radius_score(spark, d):
    return spatial.radius_score(_points(spark, d), _places(spark, d), 2.0).select("id", r6(F.col("score")).alias("score"))


def j08_radius_count(spark, d):
    return spatial.radius_count(_points(spark, d), _places(spark, d), 0.0201).select("id", "n")


def j10_group_mean_fill(spark, d):
    rows = _with_gaps(spark, d)
    return _rounded(lookups.group_mean_fill(rows, rows, "c_nationkey", ["y", "x"]))


def _halves(spark, d):
    o = t(spark, d, "orders").withColumn("ym", F.expr(YM))
    return o.filter("ym <= 199912"), o.filter("ym > 199912")


def j11_semi_anti(spark, d):
    early, late = _halves(spark, d)
    semi = late.join(early, "o_custkey", "left_semi").agg(F.count("*").alias("n_seen"))
    anti = late.join(early, "o_custkey", "left_anti").agg(F.count("*").alias("n_unseen"))
    return semi.crossJoin(anti)  # one row each


def j12_align(spark, d):
    o = t(spark, d, "orders")
    rows = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("_org_idx"), "o_orderstatus")
    y = o.select(F.col("o_orderkey").alias("_org_idx"), F.col("o_totalprice").alias("target"))
    return lookups.aligned(rows, y).select(F.col("_org_idx").alias("org_idx"), "o_orderstatus", "target")


def s09_lookup_source(spark, d):
    answers = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("address"), "n_name").filter("address <> '3'")
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("address"))
    return looked_up(rows, answers, "address", ["n_name"]).select("c_custkey", "n_name")


def _place(said):
    """Stands for a service: the address's number gives a place, and 3 has none."""
    return None if said == "3" else (37.0 + int(said) / 100, f"place {said}")


def s09_asked_source(spark, d):
    """Customers with what a service answers for their nation's number, each number asked once."""
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("address"))
    found = asked(rows, "address", _place, f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}", "y double, place string", per_second=1000.0)
    return rows.join(found, "address", "left").select("c_custkey", "found", r6(F.col("y")).alias("y"), "place")


REF = f"(select cast(s_nationkey as varchar) k, arg_max(y, s_suppkey) y, arg_max(x, s_suppkey) x from {SUPPLIER_SQL} where s_suppkey%4<>0 group by 1)"
LEFT = f"(select c_custkey, cast(c_nationkey as varchar) k, y, x from {GAPS})"
FILL = "round(case when (l.y is null or l.x is null) and r.k is not null then r.{0} else l.{0} end,6) as {0}"
RAW = "case when (l.y is null or l.x is null) and r.k is not null then r.{0} else l.{0} end as {0}"
LAT0 = f"(select avg(y) a from {CUSTOMER_SQL})"
HAV = "round(2*6371.0*atan2(sqrt(h), sqrt(1-h)),6)"
HAV_H = "pow(sin((radians(s.y)-radians(c.y))/2),2)+cos(radians(c.y))*cos(radians(s.y))*pow(sin(radians(s.x-c.x)/2),2) as h"
DEG2 = "((c.y-s.y)*(c.y-s.y)+(c.x-s.x)*(c.x-s.x))"
KM2 = "(pow(radians(c.y-s.y)*6371.0,2)+pow(radians(c.x-s.x)*cos(radians(l.a))*6371.0,2))"
NEAR = "with p as (select c.c_custkey id, s.s_suppkey k, {d2} d2, {h} from {c} c, {s} s, {l} l), m as (select id, k, h, row_number() over (partition by id order by d2, k) n from p) select id, k as key, {hav} as km from m where n=1"
SPLIT = f"with o as (select *, {YM} ym from orders)"

QUERIES = {
    "j01_fill_lookup": (j01_fill_lookup, f"select c_custkey, {FILL.format('y')}, {FILL.format('x')} from {LEFT} l left join (select * from {REF} where k<>'3') r on l.k=r.k"),
    "j02_cascade": (j02_cascade, f"with a as (select c_custkey, l.k, {RAW.format('y')}, {RAW.format('x')} from {LEFT} l left join (select * from {REF} where cast(k as int)<8) r on l.k=r.k) select c_custkey, {FILL.format('y')}, {FILL.format('x')} from a l left join (select * from {REF} where cast(k as int)<20) r on l.k=r.k"),
    "j03_last_wins": (j03_last_wins, f"select k, round(y,6) as y, round(x,6) as x from {REF}"),
    "j13_overwrite_lookup": (j13_overwrite_lookup, f"with l as (select c_custkey, k, y, coalesce(x,1.0) x from {LEFT}) select c_custkey, round(case when l.y is null or l.x is null then r.y else l.y end,6) as y, round(case when l.y is null or l.x is null then r.x else l.x end,6) as x from l left join (select * from {REF} where k<>'3') r on l.k=r.k"),
    "j04_mean_branch": (j04_mean_branch, "select p_brand as k, round(avg(p_retailprice),6) as y, round(avg(p_size),6) as x from part group by 1"),
    "j04_fuzzy_best": (j04_fuzzy_best, None),
    "j05_nearest": (j05_nearest, NEAR.format(d2=KM2, h=HAV_H, c=CUSTOMER_SQL, s=SUPPLIER_SQL, l=LAT0, hav=HAV)),
    "j06_nearest_degree": (j06_nearest_degree, NEAR.format(d2=DEG2, h=HAV_H, c=CUSTOMER_SQL, s=SUPPLIER_SQL, l=LAT0, hav=HAV)),
    "j07_radius_score": (j07_radius_score, f"""with n as (select s_nationkey nk, pow(count(distinct s_suppkey),0.7) w from supplier group by 1),
        p as (select distinct c.c_custkey id, s.s_nationkey nk from {CUSTOMER_SQL} c, {SUPPLIER_SQL} s, {LAT0} l where {KM2} <= 4.0), f as (select id, sum(w) s from p join n using (nk) group by 1)
        select c_custkey as id, round(coalesce(s,0.0),6) as score from customer left join f on c_custkey=id"""),
    "j08_radius_count": (j08_radius_count, f"with p as (select c.c_custkey id, count(*) n from {CUSTOMER_SQL} c, {SUPPLIER_SQL} s where {DEG2} <= 0.0201::double*0.0201::double group by 1) select c_custkey as id, cast(coalesce(n,0) as bigint) as n from customer left join p on c_custkey=id"),
    "j10_group_mean_fill": (j10_group_mean_fill, f"select c_custkey, round(coalesce(y, avg(y) over (partition by c_nationkey)),6) as y, round(coalesce(x, avg(x) over (partition by c_nationkey)),6) as x from {GAPS}"),
    "j11_semi_anti": (j11_semi_anti, f"{SPLIT} select count(*) filter (seen) as n_seen, count(*) filter (not seen) as n_unseen from (select o_custkey in (select o_custkey from o where ym<=199912) seen from o where ym>199912)"),
    "j12_align": (j12_align, "select o_orderkey as org_idx, o_orderstatus, o_totalprice as target from orders where o_orderstatus<>'P'"),
    "s09_asked_source": (s09_asked_source, "select c_custkey, c_nationkey<>3 as found, case when c_nationkey<>3 then round(37.0::double+c_nationkey/100,6) end as y, case when c_nationkey<>3 then 'place '||c_nationkey end as place from customer"),
    "s09_lookup_source": (s09_lookup_source, "select c_custkey, n_name from customer left join (select * from nation where n_nationkey<>3) on c_nationkey=n_nationkey"),
}
