"""Leaf-wise boosting against a plain version, early stopping, resumption, trials, ordered statistics."""

from __future__ import annotations

import hashlib
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting, encode, learn
from quern.queries import learning

S = boosting.Settings(rounds=4, rate=0.3, leaves=9, least_rows=3, bins=12, features=0.7, rows=0.9, l1=0.2, l2=0.5, patience=2)
FEATURES = ["a", "b", "c"]


def numbers(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, r.random(), float(r.randrange(5)), None if i % 7 == 0 else r.gauss(0, 1)) for i in range(n)]
    return [(i, a, b, c, 10 * (a > 0.4) + 3 * b * (a > 0.7) + (c or 2.0) + r.gauss(0, 0.1)) for i, a, b, c in rows]


@pytest.fixture(scope="module")
def data(spark):
    schema = "_org_idx long, a double, b double, c double, target double"
    return [spark.createDataFrame(numbers(n, seed), schema) for n, seed in ((400, 1), (150, 2))]


def plain_tree(bins, slope, s, scale, allowed):
    """Best-first growth by loops over rows: {leaf's rows as a frozenset: value}."""
    worth = lambda g, n: max(abs(g / scale) - s.l1, 0) ** 2 / (n + s.l2)

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in range(256) if allowed[f] else ():
                left = [i for i in rows if bins[i, f] <= b]
                n, m = len(left), len(rows) - len(left)
                if min(n, m) >= s.least_rows:
                    g, h = sum(slope[i] for i in left), sum(slope[i] for i in rows)
                    gain = worth(g, n) + worth(h - g, m) - worth(h, n + m)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, left, [i for i in rows if bins[i, f] > b])
        return found

    leaves = [(list(range(len(bins))), best(range(len(bins))))]
    while len(leaves) < s.leaves and any(b for _, b in leaves):
        at = max(range(len(leaves)), key=lambda k: leaves[k][1][0] if leaves[k][1] else -1)
        _, (_, left, right) = leaves.pop(at)
        leaves += [(left, best(left)), (right, best(right))]
    value = lambda rows: -s.rate * np.sign(g := sum(slope[i] for i in rows) / scale) * max(abs(g) - s.l1, 0) / (len(rows) + s.l2)
    return {frozenset(rows): value(rows) for rows, _ in leaves}


def test_a_tree_equals_a_plain_one(spark, data):
    train = data[0].limit(120)
    s = replace(S, rows=1.0, features=1.0, bins=6)
    model = boosting.prepared(train, FEATURES, settings=s)
    rows = boosting.table(train, model).cache()
    held = rows.collect()
    bins = np.array([list(r["bins"]) for r in held])
    slope = [int(np.rint((model.base - r["y"]) * model.scale)) for r in held]
    tree = boosting.grown(rows, [], 0, model)
    want = plain_tree(bins, slope, s, model.scale, [True] * 3)
    leaf = tree.leaf_of(bins.astype(np.uint8))
    got = {frozenset(np.flatnonzero(leaf == k).tolist()): tree.value[k] for k in set(leaf)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(got) <= s.leaves and 0 in bins  # missing values


def test_passes_read_blocks_of_rows(spark, data, monkeypatch):
    """What a pass hands to Python is a row for each block, dealt evenly, and has all rows; blocks are cut by rows alone."""
    monkeypatch.setattr(boosting, "BLOCK", 32)
    model = boosting.prepared(data[0], FEATURES, settings=S)
    rows = boosting.table(data[0].coalesce(1), model)
    held = boosting.packed(rows)
    assert held.count() == -(-400 // 32) and held.rdd.getNumPartitions() > 1 and boosting.packed(held) is held
    found = [x for r in held.collect() for x in zip(np.frombuffer(r["draw"], np.int64), np.frombuffer(r["y"]), np.frombuffer(r["bins"], np.uint8).reshape(3, -1).T.tolist())]
    assert sorted((d, y, bytes(b)) for d, y, b in found) == sorted((r["draw"], r["y"], bytes(r["bins"])) for r in rows.collect())


def test_rows_of_the_queries_are_not_dealt_by_few_values(spark):
    """Segments and priorities have five values: a join dealt by them has five tasks at most, whatever the orders."""
    seen = []
    plain = learning.settled
    try:
        learning.settled = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
        learning._rows(spark, "/root/testdata/sf0.001")
    finally:
        learning.settled = plain
    assert len(seen) == 3 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in seen)


def test_rounds_stop_after_the_best_and_go_on_from_a_saved_model(spark, data):
    train, valid = data
    s = replace(S, rounds=60, patience=3, rate=0.8)
    saved = []
    model = boosting.prepared(train, FEATURES, settings=s)
    rows, held = boosting.table(train, model), boosting.table(valid, model)
    whole = boosting.boosted(rows, model, held, lambda m: saved.append(m.dumped()))
    assert len(whole.trees) == whole.best + 3 < 60 and whole.errors[whole.best - 1] == min(whole.errors)
    first = replace(boosting.Boosted.loaded(whole.dumped()), trees=whole.trees[:2], errors=whole.errors[:2], best=2)
    again = boosting.boosted(rows.repartition(3), first, held)
    assert [t.value for t in again.trees] == [t.value for t in whole.trees] and again.best == whole.best
    assert boosting.Boosted.loaded(saved[-1]) == whole
    done = learn.predict(whole, valid, FEATURES).agg(learn.rmse(F.col("target"), F.col("prediction"))).first()[0]
    assert abs(done - min(whole.errors)) < 1e-9
    mean = valid.agg(F.stddev_pop("target")).first()[0]
    assert done < 0.4 * mean
    assert abs(sum(r["percent"] for r in learn.importance(whole, FEATURES).collect()) - 100) < 1e-9
    refitted = learn.refit(train, valid, FEATURES, whole, "lgbm", {"rate": 0.8, "leaves": 4, "least_rows": 3})
    assert len(refitted.trees) == whole.best


def test_trials_are_equal_alone_and_side_by_side_and_are_not_run_again(spark, data, tmp_path, monkeypatch):
    train, valid = data
    drawn = learn.sampled({"leaves": [2, 5], "rate": [0.3, 0.9], "rows": [0.8, 1.0]}, 4)
    s = replace(S, rounds=2)
    alone = boosting.trials(train, valid, FEATURES, drawn, s, at_once=1).collect()
    both = boosting.trials(train, valid, FEATURES, drawn, s, place=f"file://{tmp_path}/trials", at_once=3).collect()
    assert alone == both and len(both) == 4
    monkeypatch.setattr(boosting, "boosted", None)
    assert boosting.trials(train, valid, FEATURES, drawn, s, place=f"file://{tmp_path}/trials").collect() == both


def test_ordered_statistics_see_no_later_row(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "hot", "x", None]), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, c string, y double")
    prior = sum(y for _, _, y in rows) / len(rows)
    place = {i: hashlib.md5(f"7:{i}".encode()).hexdigest() for i, _, _ in rows}
    want = {}
    for i, c, _ in rows:
        before = [y for j, d, y in rows if d == c and place[j] < place[i]]
        want[i] = (sum(before) + 2 * prior) / (len(before) + 2)
    found = encode.ordered_statistics(df, "k", "c", "y", "s", weight=2.0, seed=7)
    assert found.columns == ["k", "c", "y", "s"] and all(abs(x["s"] - want[x["k"]]) < 1e-9 for x in found.collect())
    later = {x["value"]: x["to"] for x in encode.target_statistics(df, "c", "y", 2.0).collect()}
    own = [y for _, c, y in rows if c is None]
    assert abs(later[None] - (sum(own) + 2 * prior) / (len(own) + 2)) < 1e-9


def test_bounds_of_the_queries_fail_for_a_bad_model(spark):
    """What the model queries return differs from their SQL where predictions are the mean, or shuffled."""
    _, _, unseen = learning._rows(spark, "/root/testdata/sf0.001")
    mean = unseen.agg(F.avg("target")).first()[0]
    for bad in (F.lit(mean), F.log1p(F.expm1("target") + 61)):
        done = learning.judged(unseen.withColumn("prediction", bad))
        assert done.filter("target <> prediction").count() > 0.2 * done.count()
    assert not learning._half_of_mean(unseen, unseen.withColumn("prediction", F.lit(mean))).first()["good"]
