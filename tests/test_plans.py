"""The housing plan end to end on a made-up table, sinks, and the stream."""

from __future__ import annotations

import json
import random
from glob import glob

import pytest
from pyspark.sql import functions as F

from quern.operators import learn
from quern.plans import blocks as B
from quern.plans import housing
from quern.plans.runner import Runner
from quern.sources.files import Places, cache_key, project_root, run_id, write_predictions
from quern.streaming.scoring import rows_of, transformed_to


def made_up(folder):
    random.seed(5)
    raw = list(housing.NAMES) + ["시군구", "도로명", "아파트명", "층", "건축년도", "계약년월", "좌표X", "좌표Y", "거래유형", "세대전기계약방법", "청소비관리형태", "건축면적", "주차대수"]

    def row(i, ym):
        gu, dong = random.choice([("강남구", "역삼동"), ("강동구", "천호동"), ("중구", "을지로1가")])
        v = {c: str(random.randint(1, 50)) for c in raw}
        y, x = 37.5 + random.random() / 20, 127 + random.random() / 20
        v |= {"시군구": f"서울특별시 {gu} {dong}", "도로명": f"길{i % 4} {i % 3}", "아파트명": f"apt{i % 5}", "층": str(i % 20), "건축년도": str(1990 + i % 30), "계약년월": str(ym), "거래유형": random.choice(["-", "중개거래"])}
        v |= {"좌표X": "" if i % 3 == 0 else str(x), "좌표Y": "" if i % 3 == 0 else str(y), "전용면적(㎡)": str(40 + i % 100), "기타/의무/임대/임의=1/2/3/4": random.choice(["의무", "", "기타"])}
        return v

    def write(path, columns, rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        quoted = lambda xs: ",".join('"' + str(x) + '"' if x != "" else "" for x in xs) + "\n"
        path.write_text(quoted(columns) + "".join(quoted(r[c] for c in columns) for r in rows))

    yms = [202301, 202302, 202303, 202304, 202306]
    train = [row(i, yms[i % 5]) | {"target": str(10000 + 100 * (i % 100))} for i in range(200)]
    write(folder / "data/raw/train.csv", [*raw, "target"], train)
    write(folder / "data/raw/test.csv", raw, [row(i, 202307) for i in range(30)])
    apt = [{"주소(시군구)": "강남구", "주소(읍면동)": "역삼동", "주소(도로명)": f"길{i}", "주소(도로상세주소)": str(i), "좌표Y": 37.51 + i / 100, "좌표X": 127.01} for i in range(3)]
    write(folder / "data/ext/k-apt.csv", list(apt[0]), apt)
    write(folder / "data/ext/coord.csv", ["매핑키", "좌표Y", "좌표X"], [{"매핑키": "중구 길1 1", "좌표Y": 37.55, "좌표X": 127.02}])
    stations = [{"역사명": f"s{i}", "호선": str(i % 2), "위도": 37.5 + i / 100, "경도": 127 + i / 100} for i in range(5)]
    write(folder / "data/ext/subway_feature.csv", list(stations[0]), stations)
    stops = [{"정류소명": f"b{i}", "정류소번호": i, "Y좌표": 37.5 + i / 200, "X좌표": 127 + i / 200} for i in range(10)]
    write(folder / "data/ext/bus_feature.csv", list(stops[0]), stops)


POLICY = {"kind": "time_holdout", "ym_col": "계약년월", "train_until": 202303, "valid_from": 202304, "valid_until": 202306}


@pytest.fixture(scope="module")
def places(tmp_path_factory):
    folder = tmp_path_factory.mktemp("housing")
    made_up(folder)
    return Places(str(folder))


def test_housing_to_files(spark, places, tmp_path):
    builder = housing.builder(spark, places)
    bundle = builder.build("rf", split_policy=POLICY)
    assert bundle.train.columns == ["_org_idx", *housing.NUMERIC, *housing.CATEGORICAL, "target"]
    assert (bundle.train.count(), bundle.valid.count(), bundle.test.count()) == (120, 80, 30)
    assert bundle.train.filter(F.col("좌표X").isNull()).count() < 40
    small = {"rf": {"numTrees": 3, "maxDepth": 3}, "gbt": {"maxIter": 3, "maxDepth": 3}}
    done = Runner(builder, small).run_ensemble({"gbt": 7, "rf": 3}, POLICY, out=str(tmp_path))
    text = open(glob(f"{done.path}/predictions/*.csv")[0]).read().split()
    assert text[0] == "target" and len(text) == 31 and all(t.isdigit() for t in text[1:])
    meta = json.load(open(f"{done.path}/meta.json"))
    assert meta["valid_rmse"] > 0 and len(meta["features"]["numeric"]) == 30 and len(meta["features"]["categorical"]) == 11


def test_command_line(spark, places, tmp_path, capsys):
    from quern.plans import cli

    done = cli.main(["--root", places.root, "--model", "rf", "--params", '{"rf": {"numTrees": 2, "maxDepth": 2}}', "--out", str(tmp_path)])
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["path"] == done.path and said["valid_rmse"] > 0 and glob(f"{done.path}/predictions/*.csv")


def test_cache_of_tables_and_features(spark):
    from quern.plans.builder import DatasetBuilder

    loads = []
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "n int, v string, target double")

    def load():
        loads.append("raw")
        return df, df.drop("target")

    def ext():
        loads.append("ext")
        return {}

    def pipeline(_):
        loads.append("pipeline")
        return B.Pipeline([B.FixedCategories(["v"])])

    b = DatasetBuilder(load, ext, pipeline, {}, ["n", "v"], ["v"], order="n")
    for use_cache in (True, True, False):
        assert b.build("gbt", use_cache).train.count() == 2
    assert loads == ["raw", "ext", "pipeline"] * 2


def test_small_blocks_and_summaries(spark, tmp_path):
    from quern.operators import stats
    from quern.sources.files import looked_up, write_filled

    df = spark.createDataFrame([("road", "1", 1, None), ("way", "2", 2, 3.0)], "a string, b string, n int, x double")
    assert B.JoinedRoad(("a", "b"), "road").transform(df).select("road").first()[0] == "road 1"
    known = B.FixedCategories(["a"]).fit(df.limit(1))
    assert [r["a"] for r in known.transform(df).orderBy("n").collect()] == ["road", None]
    assert stats.by_dtype(df, ["n"]) == {"time": ["n"], "numeric": ["x"], "other": ["a", "b"]}
    assert [d.columns for d in stats.without_null_columns(df, df)] == [["a", "b", "n"]] * 2
    write_filled(df, str(tmp_path / "filled"), "csv")
    assert spark.read.csv(str(tmp_path / "filled"), header=True).count() == 2
    answers = spark.createDataFrame([("1", "z"), ("1", "y")], "b string, said string")
    assert [r["said"] for r in looked_up(df, answers, "b", ["said"]).orderBy("n").collect()] == ["y", None]


def test_windowed_counts(spark, tmp_path):
    from quern.streaming.scoring import windowed_counts

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as at, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'")
    rows.write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(rows_of(spark, str(tmp_path / "in"), rows), "at", "k")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]


def test_state_ignores_later_rows(spark):
    train = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, v string")
    block = B.Frequencies({"v": "f"})
    one = sorted(map(tuple, B.Pipeline([block]).fit_transform(train).collect()))
    later = B.Pipeline([block]).transform(spark.createDataFrame([(9, "z"), (8, "a")], "i int, v string"))
    assert sorted(map(tuple, later.collect())) == [(8, "a", 2 / 3), (9, "z", 0.0)]
    assert one == sorted(map(tuple, B.Pipeline([block]).transform(train).collect()))
    with pytest.raises(KeyError):
        B.Pipeline([B.Membership("w", "f", ["x"])]).transform(train)


def test_stream_takes_the_batch_plan(spark, tmp_path):
    rows = spark.createDataFrame([(1, " x "), (2, "-"), (3, None)], "i int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    pipe = B.Pipeline([B.ValuesToNull({"v": ["-"]}), B.CleanCategories(["v"])])
    want = sorted(map(tuple, pipe.fit_transform(rows).collect()))
    query = transformed_to(rows_of(spark, str(tmp_path / "in"), rows), pipe, str(tmp_path / "out"), str(tmp_path / "at"))
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("i", "v").collect())) == want


def test_sinks_and_names(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(2, 1.5), (1, 2.5)], "_org_idx int, prediction double")
    write_predictions(df, str(tmp_path / "even"))
    write_predictions(df, str(tmp_path / "cut"), truncate=True)
    read = lambda p: open(glob(f"{tmp_path}/{p}/*.csv")[0]).read().split()
    assert read("even") == ["target", "2", "2"] and read("cut") == ["target", "2", "1"]
    assert run_id("p", "m", 0) == "p_m_19700101_000000Z"
    df.write.parquet(str(tmp_path / "t"))
    a = cache_key(spark.read.parquet(str(tmp_path / "t")), {})
    df.write.mode("append").parquet(str(tmp_path / "t"))
    assert a != cache_key(spark.read.parquet(str(tmp_path / "t")), {})
    monkeypatch.setenv("QUERN_ROOT", str(tmp_path))
    assert project_root() == tmp_path.resolve()
    assert learn.best_by(spark.createDataFrame([("a", 2.0), ("b", float("nan")), ("c", 1.0)], "model string, error double")).first()["model"] == "c"
