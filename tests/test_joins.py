from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.operators import encode, learn, lookups, spatial
from quern.plans.builder import renamed
from quern.sources.files import Scratch, scratch


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fill_and_last_wins(spark):
    ref = spark.createDataFrame([("k", 1.0, 2.0, 1), ("k", 3.0, 4.0, 2), ("", 9.0, 9.0, 3), ("m", None, 1.0, 4)], "k string, y double, x double, n int")
    best = lookups.last_wins(ref, "k", ["y", "x"], "n")
    assert rows(best) == [("k", 3.0, 4.0)]
    left = spark.createDataFrame([(1, "k", None, 7.0), (2, "k", 5.0, 6.0), (3, "z", None, 7.0), (4, None, None, None)], "i int, k string, y double, x double")
    assert rows(lookups.fill_missing(left, best, "k", ["y", "x"])) == [(1, "k", 3.0, 4.0), (2, "k", 5.0, 6.0), (3, "z", None, 7.0), (4, None, None, None)]
    assert rows(lookups.overwrite_missing(left, best, "k", ["y", "x"]))[2] == (3, "z", None, None)


def test_best_match(spark):
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25
    c = spark.createDataFrame([("g", "12-34", 1.0, 1), ("g", "12-3", 2.0, 2), ("g", "12-3", 3.0, 3), ("h", "", 4.0, 4)], "k string, sub string, y double, row_no int")
    t = spark.createDataFrame([("g", "12-3", None, 0), ("g", "", None, 0), ("z", "1", None, 0)], "k string, sub string, y double, row_no int")
    assert rows(lookups.fill_by_best_match(t, c, ["k"], "sub", ["y"], "row_no")) == [("g", "", 2.0, 0), ("g", "12-3", 2.0, 0), ("z", "1", None, 0)]


def test_best_match_reads_padded_and_missing_texts(spark):
    """Keys and details are stripped on both sides; a missing detail is compared as the text nan; candidates need values."""
    c = spark.createDataFrame([(" g ", "banana", 1.0, 1), ("g", " na", 2.0, 2), ("g", "nan", None, 3), (None, "x", 5.0, 4)], "k string, sub string, y double, row_no int")
    t = spark.createDataFrame([("g", None, None, 0), ("g ", " banane", None, 1), ("g", " ", None, 2), (None, "y", None, 3)], "k string, sub string, y double, row_no int")
    assert rows(lookups.fill_by_best_match(t, c, ["k"], "sub", ["y"], "row_no").select("row_no", "y")) == [(0, 2.0), (1, 1.0), (2, 1.5), (3, 5.0)]


def test_best_match_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 7)))
    c = [(str(i % 3), word(), float(i), i) for i in range(60)]
    t = [(str(i % 4), word(), None, i) for i in range(40)]
    schema = "k string, sub string, y double, row_no int"
    found = lookups.best_match(spark.createDataFrame(t, schema), spark.createDataFrame(c, schema), ["k"], "sub", ["y"], "row_no")
    want = {}
    for k, sub, _, _ in t:
        if own := [(SequenceMatcher(None, sub, s).ratio(), -n, y) for kk, s, y, n in c if kk == k]:
            want[k, sub] = max(own)[2]
    assert {(x["k"], x["sub"]): x["y"] for x in found.collect()} == want


def test_best_match_of_a_hot_key_compares_few(spark):
    """Addresses with one another's typing errors under one key: equal to brute force, few of all pairs looked into."""
    r = random.Random(12)
    base = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(6, 11))) + f" {r.randrange(900)}" for _ in range(350)]

    def typed(s):
        i = r.randrange(len(s))
        return s[:i] + r.choice(["", "x", s[i] * 2, "\U0001f600"]) + s[i + 1 :]

    c = [("hot", s, float(i), i) for i, s in enumerate([*base, *base[:40], ""])] + [("hot", None, 1.0, 999)]
    t = [("hot", typed(r.choice(base)), None, i) for i in range(80)] + [("hot", base[3], None, 90), ("hot", "q", None, 91), ("hot", "\u00fc\u00e4", None, 92)]
    schema = "k string, sub string, y double, row_no int"
    targets, candidates = spark.createDataFrame(t, schema), spark.createDataFrame(c, schema)
    found = lookups.best_match(targets, candidates, ["k"], "sub", ["y"], "row_no")
    want = {sub: max((SequenceMatcher(None, sub, s).ratio(), -n, y) for _, s, y, n in c if s is not None)[2] for _, sub, _, _ in t}
    assert {x["sub"]: x["y"] for x in found.collect()} == want
    with scratch(spark) as tables:
        texts = candidates.dropna().select("k", F.col("sub").alias("candidate sub")).distinct()
        n = lookups.to_compare(tables.keep(targets.select("k", "sub").distinct()), tables.keep(texts), ["k"], "sub", tables).count()
    assert n < 0.05 * len(want) * 351


def test_quantiles_and_numbers_need_no_single_task(spark):
    from quern.operators import stats

    r = random.Random(7)
    data = [(float(r.randint(0, 40)), r.random() if i % 5 else None, None) for i in range(501)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    found = {(x["column"], x["share"]): x["value"] for x in stats.quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    want = {}
    for k, name in enumerate("ab"):
        v = sorted(x[k] for x in data if x[k] is not None)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = q * (len(v) - 1)
            want[name, q] = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert encode.medians(df.limit(0), ["a"]) == {"a": None}
    many = spark.range(1000).selectExpr("3 * id % 1000 as v")
    assert rows(stats.numbered(many.repartition(5), "v", "n")) == sorted([(i, i) for i in range(1000)], key=str)


def test_patience_and_trials():
    assert learn.best_round([5, 4, 3, 3.5, 3.2, 2.9], 2) == 3 and learn.best_round([5, 4, 3, 3.5, 2.9], 2) == 5 and learn.best_round([1.0], 50) == 1
    space = {"a": [1, 2, 3], "b": ["x"]}
    trials = learn.sampled(space)
    assert len(trials) == 100 and trials == learn.sampled(space) and {t["a"] for t in trials} == {1, 2, 3} and {t["b"] for t in trials} == {"x"}


def test_alignment_errors(spark):
    x = spark.createDataFrame([(1, "a"), (1, "b")], "_org_idx int, v string")
    y = spark.createDataFrame([(1, 5.0)], "_org_idx int, target double")
    with pytest.raises(ValueError, match="repeats"):
        lookups.aligned(x, y)
    with pytest.raises(KeyError):
        lookups.aligned(spark.createDataFrame([(2, "a")], "_org_idx int, v string"), y)
    with pytest.raises(KeyError, match="nothing"):
        renamed(x, {"nothing": "n"})


def test_spatial_joins_equal_brute_force(spark):
    random.seed(3)
    p = [(i, 37 + random.random() / 5, 127 + random.random() / 5) for i in range(120)] + [(500, 39.0, 129.0)]
    q = [(i, str(i % 7), 37 + random.random() / 5, 127 + random.random() / 5, float(i % 3)) for i in range(40)]
    points = spark.createDataFrame([*p, (999, None, None)], "id long, y double, x double")
    places = spark.createDataFrame(q, "key long, name string, y double, x double, weight double")
    left = points.dropna().toDF("id", "py", "px")
    right = places.select("key", places.y.alias("qy"), places.x.alias("qx"))
    want = sorted((i, min(((y - v) ** 2 + (x - w) ** 2, k) for k, _, v, w, _ in q)[1]) for i, y, x in p)
    assert sorted((r["id"], r["key"]) for r in spatial.nearest(left, right).collect()) == want
    assert spatial.nearest(left, right.limit(0)).count() == 0
    n = {i: sum((y - v) ** 2 + (x - w) ** 2 <= 0.05**2 for _, _, v, w, _ in q) for i, y, x in p} | {999: 0}
    assert dict(map(tuple, spatial.radius_count(points, places, 0.05).collect())) == n
    scores = dict(map(tuple, spatial.radius_score(points, places, 3.0).collect()))
    assert scores[500] == 0.0 and scores[999] is None and max(v for v in scores.values() if v is not None) > 0


def town(n: int, seed: int) -> list[tuple]:
    """Places of a dense town of 0.1 degrees, some at one another's place."""
    r = random.Random(seed)
    spots = [(37 + r.random() / 10, 127 + r.random() / 10) for _ in range(n - n // 10)]
    return [(k, *(spots[k] if k < len(spots) else spots[k % 50])) for k in range(n)]


def test_nearest_on_uneven_places_makes_few_pairs(spark):
    """One far place, and points in the town, around it and far away: no more than a few leaves of pairs for each point."""
    r = random.Random(5)
    q = town(3000, 1)
    near = [(i, 36.9 + r.random() * 0.3, 126.9 + r.random() * 0.3) for i in range(150)]
    away = [(150 + i, 37 + r.uniform(-40, 40), 127 + r.uniform(-40, 40)) for i in range(60)]

    def pairs(p, places):
        left, right = spark.createDataFrame(p, "id long, py double, px double"), spark.createDataFrame(places, "key long, qy double, qx double")
        with scratch(spark) as tables:
            met = spatial.likely_pairs(left, spatial.Tree.built(right, tables), tables).collect()
        want = sorted((i, *min(((y - v) * (y - v) + (x - w) * (x - w), k) for k, v, w in places)) for i, y, x in p)
        assert sorted((x["id"], x["d2"], x["key"]) for x in spatial.nearest(left, right).collect()) == want
        return len(met)

    even = pairs(near, q)
    assert even < 150 * 4 * spatial.LEAF
    assert pairs(near, [*q, (9000, -60.0, -170.0)]) < 1.5 * even
    assert pairs(away, [*q, (9000, -60.0, -170.0)]) < 60 * 6 * spatial.LEAF
    assert pairs(near, [(k, 37.05, 127.05) for k in range(5, 2000)]) == 150  # one spot


def test_radius_over_dense_cells_meets_the_border_alone(spark):
    r = random.Random(6)
    q = town(6000, 2)
    p = [(i, 37 + r.random() / 10, 127 + r.random() / 10) for i in range(40)] + [(99, 50.0, 10.0)]
    points, places = spark.createDataFrame(p, "id long, y double, x double"), spark.createDataFrame(q, "key long, y double, x double")
    radius = 0.04
    want = {i: sum((y - v) ** 2 + (x - w) ** 2 <= radius**2 for _, v, w in q) for i, y, x in p}
    assert dict(map(tuple, spatial.radius_count(points, places, radius).collect())) == want
    left, right = points.toDF("id", "py", "px"), places.toDF("key", "qy", "qx")
    with scratch(spark) as tables:
        tree = spatial.Tree.built(right, tables)
        inside, border = spatial.covered(left, tree, radius, tables)
        met, cells = spatial._met(border, tree).count(), inside.count()
    assert sum(want.values()) > 50_000 and met + cells < 0.35 * sum(want.values())


def test_radius_score_by_names(spark):
    r = random.Random(7)
    q = [(k, f"n{r.randrange(30)}" if k % 9 else None, y, x, float(k % 4)) for k, y, x in town(800, 3)] + [(5000, "nowhere", None, 127.0, 9.0)]
    p = [(i, 37 + r.random() / 10, 127 + r.random() / 10) for i in range(50)] + [(60, None, 1.0)]
    points = spark.createDataFrame(p, "id long, y double, x double")
    places = spark.createDataFrame(q, "key long, name string, y double, x double, weight double")
    weight = {}
    for _, name, _, _, w in q:
        if name is not None:
            weight[name] = max(weight.get(name, 0.0), w)
    rad = math.pi / 180 * 6371.0
    lat0 = 37.05
    near = lambda y, x, v, w: ((y - v) * rad) ** 2 + ((x - w) * rad * math.cos(math.radians(lat0))) ** 2 <= 2.5**2
    want = {i: None if y is None else sum(weight[n] for n in {n for _, n, v, w, _ in q if n is not None and v is not None and near(y, x, v, w)}) for i, y, x in p}
    got = dict(map(tuple, spatial.radius_score(points, places, 2.5, lat0).collect()))
    assert got == want
    assert {s for _, s in map(tuple, spatial.radius_score(points, places.limit(0), 2.5, lat0).collect())} == {0.0, None}


def test_encoders_learn_from_training_alone(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "_org_idx int, v string")
    assert rows(encode.first_seen_codes(train, "v")) == [("a", 1), ("b", 0), ("c", 2)]
    assert rows(encode.sorted_codes(train, "v")) == [("a", 0), ("b", 1), ("c", 2)]
    gaps = spark.createDataFrame([("a",), ("a",), (None,), (" ",)], "v string")
    assert rows(encode.frequencies(gaps, "v")) == [("__NA__", 0.5), ("a", 0.5)]
    months = spark.createDataFrame([(202303,), (202304,), (202306,), (202307,), (None,)], "ym int")
    early, late = encode.time_holdout(months, {"ym_col": "ym"})
    assert (rows(early), rows(late)) == ([(202303,)], [(202304,), (202306,)])
    with pytest.raises(NotImplementedError):
        encode.time_holdout(months, {"kind": "rolling_window"})


def test_blend_and_dispatch(spark):
    mix = learn.blend({"a": F.lit(10.0), "b": F.lit(20.0)}, {"a": 7, "b": 3})
    assert abs(spark.range(1).select(mix).first()[0] - 13) < 1e-12
    with pytest.raises(ValueError):
        learn.blend({"a": F.lit(1.0)}, {"a": 0})
    with pytest.raises(ValueError, match="unknown model"):
        learn.estimator("nothing")


@pytest.fixture
def kept(monkeypatch):
    """Counts the rows of all tables that Scratch.keep writes."""
    plain, seen = Scratch.keep, []

    def keep(self, df, *rest):
        out = plain(self, df, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    return seen


def test_points_at_one_place_go_down_the_tree_once(spark, kept):
    r = random.Random(12)
    at = [(r.random(), r.random()) for _ in range(5)]
    points = spark.createDataFrame([(i, *at[i % 5]) for i in range(4000)] + [(9000, None, 0.5)], "id long, y double, x double")
    spots = [(k, f"name {k % 3}", r.random(), r.random(), 1.0 + k % 3) for k in range(40)]
    places = spark.createDataFrame(spots, "key long, name string, y double, x double, weight double")
    near = lambda y, x: [s for s in spots if (s[2] - y) ** 2 + (s[3] - x) ** 2 <= 0.09]
    count = {r["id"]: r["n"] for r in spatial.radius_count(points, places, 0.3).collect()}
    assert count == {i: len(near(*at[i % 5])) for i in range(4000)} | {9000: 0}
    score = {r["id"]: r["score"] for r in spatial.radius_score(points, places, 40.0, 0.5).collect()}
    assert len(score) == 4001 and score[9000] is None and len({score[i] for i in range(0, 4000, 5)}) == 1
    found = {r["id"]: r["key"] for r in spatial.nearest_distance(points, places, metric="degree").collect()}
    assert found == {i: min(spots, key=lambda s: ((s[2] - at[i % 5][0]) ** 2 + (s[3] - at[i % 5][1]) ** 2, s[0]))[0] for i in range(4000)}
    assert max(kept) < 1000


def test_candidates_with_equal_texts_are_one(spark, monkeypatch):
    """The last join, which a hot text would swell, reads one row of each text and not the candidates."""
    plain, seen = lookups.settled, []
    monkeypatch.setattr(lookups, "settled", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    rows = [("k", "abcd" if i % 2 else "abxy", float(i), i) for i in range(3000)]
    candidates = spark.createDataFrame(rows, "k string, sub string, y double, row_no long")
    targets = spark.createDataFrame([("k", "abce"), ("k", "xxxy"), ("k", "")], "k string, sub string")
    found = {r["sub"]: r["y"] for r in lookups.best_match(targets, candidates, ["k"], "sub", ["y"], "row_no").collect()}
    assert found == {"abce": 1.0, "xxxy": 0.0, "": 1499.5}
    assert len(seen) == 1 and "head" in seen[0] and "row_no" not in seen[0]
