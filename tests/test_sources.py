"""Types of text columns, a source with a limit, and tables published once."""

from __future__ import annotations

import threading
import time
from glob import glob

import pytest

from quern.sources import files
from quern.sources.asking import answers, asked


def test_kinds_of_columns(spark):
    rows = [("1", "1", "True", "x", None, "1", " 7 ", "99999999999999999999", "NaN", "1e3", "true"), ("-2", "2.5", "False", "1", None, None, "+8", "1", "2", "inf", None), (None, None, None, None, None, "True", "9", "2", "3", ".5", "x")]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(11)) + "")
    want = ["long", "double", "boolean", "string", "double", "string", "long", "double", "string", "double", "string"]
    assert list(files.kinds(df).values()) == want
    done = files.typed(df.repartition(3))
    assert [kind for _, kind in done.dtypes] == [{"long": "bigint"}.get(w, w) for w in want]
    assert sorted((r["c0"], r["c1"], r["c6"]) for r in done.filter("c0 is not null").collect()) == [(-2, 2.5, 8), (1, 1.0, 7)]
    assert set(files.kinds(df.limit(0)).values()) == {"double"} and files.kinds(spark.range(3)) == {}
    odd = spark.createDataFrame([("1", "2")], "`a.b` string, `c d` string")
    assert files.typed(odd).dtypes == [("a.b", "bigint"), ("c d", "bigint")]


def test_types_of_a_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,0.5,x\n,NA,\n3,2,y\n")
    done = files.typed(files.read_csv(spark, str(tmp_path / "x.csv")))
    assert done.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert [tuple(r) for r in done.collect()] == [(1, 0.5, "x"), (None, None, None), (3, 2.0, "y")]


def counting(folder, lose=None, fail=()):
    """A client that notes each address it is asked for; at `lose` its task dies once, `fail` addresses never answer."""

    def client(said):
        with open(f"{folder}/{said}.asked", "a") as f:
            f.write("x")
        if said in fail:
            raise TimeoutError(said)
        if said == lose:
            with open(f"{folder}/lost", "a") as f:
                f.write("x")
            if len(open(f"{folder}/lost").read()) == 1:
                raise RuntimeError("the task is lost")
        return None if said.endswith("3") else (float(said), f"at {said}")

    return client


def test_no_address_is_asked_twice(spark, tmp_path):
    place, notes = f"file://{tmp_path}/place", tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(str(k % 30),) for k in range(90)] + [(None,)], "address string")
    asking = dict(place=place, fields="y double, name string", per_second=1000.0, tasks=2)
    with pytest.raises(Exception, match="lost"):
        asked(df, "address", counting(notes, lose="7"), **asking)
    before = {f: len(open(f).read()) for f in glob(f"{notes}/*.asked")}
    found = {r["address"]: (r["found"], r["y"], r["name"]) for r in asked(df, "address", counting(notes, lose="7"), **asking).collect()}
    assert found == {str(k): (False, None, None) if k % 10 == 3 else (True, float(k), f"at {k}") for k in range(30)}
    times = {f: len(open(f).read()) for f in glob(f"{notes}/*.asked")}
    assert len(before) > 1 and {n for f, n in times.items() if not f.endswith("/7.asked")} == {1}
    assert asked(df, "address", None, **asking).count() == 30  # nothing is left to ask
    assert not glob(f"{tmp_path}/place/journal")


def test_failures_are_tried_again_and_the_limit_holds(spark, tmp_path):
    place, notes = f"file://{tmp_path}/place", tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(str(k),) for k in range(8)], "address string")
    began = time.time()
    found = asked(df, "address", counting(notes, fail=("5",)), place, "y double, name string", per_second=8.0, tries=2, tasks=2)
    assert sorted(r["address"] for r in found.collect()) == list("0123467") and time.time() - began > 0.75
    assert open(f"{notes}/5.asked").read() == "xx"
    again = asked(df, "address", counting(notes), place, "y double, name string")
    assert again.count() == 8 and open(f"{notes}/1.asked").read() == "x"
    assert answers(spark, f"{place}/other", "address", "y double").count() == 0


def test_writers_at_one_time_publish_one_table(spark, tmp_path, monkeypatch):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    places = files.Places(f"file://{tmp_path}")
    df, found, gate = spark.read.parquet(str(tmp_path / "in")), [], threading.Barrier(3)
    key = files.cache_key

    def together(*a):
        out = key(*a)
        gate.wait(60)
        return out

    monkeypatch.setattr(files, "cache_key", together)
    threads = [threading.Thread(target=lambda: found.append(files.stored(df, places, "t").count())) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    assert found == [50] * 3 and len(glob(f"{tmp_path}/data/cache/t-*")) == 1
    monkeypatch.setattr(files, "cache_key", key)
    assert files.stored(df, places, "t").count() == 50
