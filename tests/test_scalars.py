from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("address", "by_pattern", "by_token"),
    [
        ("서울특별시 강남구 역삼동", ("강남구", "역삼동"), ("강남구", "역삼동")),
        ("서울특별시 강동구 천호동", ("강동구", "강동"), ("강동구", "천호동")),
        ("서울특별시 성동구 성수동1가", ("성동구", "성동"), ("성동구", "성수동1가")),
        ("서울특별시 중구 을지로1가", ("중구", None), ("중구", "을지로1가")),
    ],
)
def test_districts(spark, address, by_pattern, by_token):
    c = F.lit(address)
    assert (one(spark, S.first_match(c, r"(\S+구)")), one(spark, S.first_match(c, r"(\S+동)"))) == by_pattern
    assert (one(spark, S.token(c, 1)), one(spark, S.token(c, 2))) == by_token


def test_road_parts(spark):
    rows = spark.createDataFrame([("  테헤란로  123 ",), (None,), ("테헤란로",)], "r string")
    found = [tuple(x) for x in rows.select(*S.split_once(F.col("r"))).collect()]
    assert found == [("테헤란로  123", "테헤란로", "123"), ("", "", ""), ("테헤란로", "테헤란로", "")]


def test_unicode_blanks_and_tokens(spark):
    assert one(spark, S.strip(F.lit("　 a b\t"))) == "a b"
    assert one(spark, S.filled(F.lit("  "))) == "__NA__"
    assert one(spark, S.keep_or(F.lit("의무 "), ["의무"])) == "의무"
    assert one(spark, S.keep_or(F.lit("기타"), ["의무"])) == "OTHERS"
    assert one(spark, S.squeezed(F.lit(" a   b "))) == "a b"
    assert one(spark, S.without_tokens(F.lit("강남구 역삼동 1"), "동")) == "강남구 1"
    assert one(spark, S.text_key(F.lit("a"), F.lit(None).cast("string"))) == "a nan"
    assert one(spark, S.joined_key(F.lit("a"), F.lit(None).cast("string"))) == "a"


@pytest.mark.parametrize(("text", "number"), [("1,234", None), (" 12 ", 12.0), ("1e3", 1000.0), ("-", None), ("", None), ("1_000", None), ("0x10", None), ("NaN", None), ("12d", None), ("-3.5", -3.5)])
def test_to_number(spark, text, number):
    assert one(spark, S.to_number(F.lit(text))) == number


def test_sums_shares_and_bins(spark):
    rows = spark.createDataFrame([(60.0, 10.0, 20.0, 30.0, 40.0), (60.1, 10.0, 20.0, 30.0, 40.0), (85.5, 10.0, 20.0, 30.0, 40.0), (200.0, 10.0, 20.0, 30.0, 40.0), (70.0, 10.0, None, 30.0, None), (70.0, None, None, None, None)], "a double, b double, c double, d double, e double")
    n = [F.col(x) for x in "bcde"]
    total = S.sum_of_known(n)
    share = S.ratio(S.by_range(F.col("a"), list(zip((60, 85, 135), n)), n[3]), total)
    assert [(r[0], r[1]) for r in rows.select(share, total).collect()] == [(0.1, 100.0), (0.2, 100.0), (0.3, 100.0), (0.4, 100.0), (None, 40.0), (None, None)]
    bins = spark.createDataFrame([(0.0,), (40.0,), (40.5,), (-1.0,), (None,)], "v double").select(S.right_closed(F.col("v"), [0, 40, 60], ["first", "second"]))
    assert [r[0] for r in bins.collect()] == ["nan", "first", "second", "nan", "nan"]
    assert one(spark, S.ratio(F.lit(50.0), F.lit(0.0))) is None


def test_dates(spark):
    y, m, q = S.year_month_quarter(F.lit(202304))
    assert tuple(spark.range(1).select(y, m, q).first()) == (2023, 4, 2)
    with pytest.raises(Exception, match="not 6 digits"):
        spark.range(1).select(*S.year_month_quarter(F.lit(20234))).collect()
    assert [one(spark, S.positive_gap(F.lit(a), F.lit(b))) for a, b in ((2020, 2022), (2022, 2020))] == [0, 2]
    assert one(spark, S.positive_gap(F.lit(2020), F.lit(None).cast("int"))) is None


def test_rounding_weights_and_distance(spark):
    assert [one(spark, S.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, S.power_weight(F.lit(3))) == 3**0.7
    km = one(spark, S.haversine(F.lit(37.0), F.lit(127.0), F.lit(38.0), F.lit(127.0)))
    assert math.isclose(km, 6371.0 * math.pi / 180, rel_tol=1e-9)
    assert math.isclose(km, one(spark, S.haversine_by_sine(F.lit(37.0), F.lit(127.0), F.lit(38.0), F.lit(127.0))), rel_tol=1e-9)


def test_names():
    assert S.snake_case("HppGuDongBlock") == "hpp_gu_dong_block"
    assert S.parameter_tag({"maxIter": 400, "stepSize": 0.05}, {"maxIter": "n", "stepSize": "lr"}) == "_n400_lr005"
