"""Joins along time against plain restatements, with a key that holds most rows and spans many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import time_joins

FACTS = "id int, k string, at int, version_at int, x int"


@pytest.fixture(params=[2, 7])
def ranges(spark, request):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def data(seed, n_facts=400, n_versions=150):
    dice = random.Random(seed)
    key = lambda: dice.choice(["hot", "hot", "hot", "a", "b", "c", None])
    facts = [(i, key(), dice.choice([None, *range(60)]), None, 0) for i in range(n_facts)]
    versions = [(key(), dice.choice([None, *range(0, 60, 3)]), i % 7, f"v{i}") for i in range(n_versions)]
    return facts + facts[:5], versions


@pytest.mark.parametrize("seed", [1, 2])
def test_last_version_at_each_fact(spark, ranges, seed):
    facts, versions = data(seed)
    versions = [v for v in versions if seed == 1 or v[0] != "hot" or v[1] in (0, 3)]  # a hot key whose version lies many ranges back
    left = spark.createDataFrame(facts, FACTS)
    right = spark.createDataFrame(versions, "k string, t int, x int, name string")
    best = {}
    for r in time_joins.as_of_join(left, right, ["k"], "at", "t", ["x", "name"], prefix="v_").collect():
        best.setdefault(r["id"], []).append(r["v_name"])
    for i, k, at, _, _ in facts[:400]:
        known = [v for v in versions if k is not None and at is not None and v[0] == k and v[1] is not None and v[1] <= at]
        want = max(known, key=lambda v: (v[1], v[2], v[3]))[3] if known else None
        assert best[i] == [want] * (2 if i < 5 else 1)
    chosen = {r["id"]: r["v_name"] for r in time_joins.as_of_join(left, right, ["k"], "at", "t", ["x", "name"], "v_", eligible=F.col("x") > 2).collect()}
    for i, names in best.items():
        row = next((v for v in versions if v[3] == names[0]), None)
        assert chosen[i] == (names[0] if row and row[2] > 2 else None)


def test_versions_alone_facts_alone_and_clashing_names(spark):
    left, right = spark.createDataFrame(data(3)[0], FACTS), spark.createDataFrame(data(3)[1], "k string, at int, x int, name string")
    with pytest.raises(ValueError, match="version_at"):
        time_joins.as_of_join(left, right, ["k"], "at", "at")
    assert time_joins.as_of_join(left.limit(0), right, ["k"], "at", "at", prefix="v_").count() == 0
    assert time_joins.as_of_join(left, right.limit(0), ["k"], "at", "at", prefix="v_").where("v_name is null").count() == 405


@pytest.mark.parametrize("open_end", ["never_outside", "outside"])
def test_windows_open_at_each_fact(spark, ranges, open_end):
    facts, _ = data(4)
    dice = random.Random(5)
    windows = []
    for _ in range(200):
        start = dice.choice([None, *range(50)])
        windows.append((dice.choice(["hot", "hot", "a", "b", None]), start, dice.choice([None, (start or 0) + dice.randint(-2, 20)])))
    found = time_joins.window_coverage(spark.createDataFrame(facts, FACTS), spark.createDataFrame(windows, "k string, s int, e int"), "k", "k", "at", "s", "e", open_end).collect()
    assert len(found) == len(facts)
    for r in found:
        if r["k"] is None or r["at"] is None:
            assert r["windows"] is None and r["covering"] is None
            continue
        own = [w for w in windows if w[0] == r["k"] and w[1] is not None]
        assert r["windows"] == len(own)
        assert r["covering"] == sum(w[1] <= r["at"] and (r["at"] <= w[2] if w[2] is not None else open_end == "never_outside") for w in own)
    outside = time_joins.outside_all_windows(spark.createDataFrame(facts, FACTS), spark.createDataFrame(windows, "k string, s int, e int"), "k", "k", "at", "s", "e", open_end)
    assert outside.count() == sum(bool(r["windows"]) and r["covering"] == 0 for r in found)


def test_no_windows(spark):
    facts = spark.createDataFrame([(1, "a", 5, 0, 0)], FACTS)
    none = spark.createDataFrame([], "k string, s int, e int")
    assert [(r["windows"], r["covering"]) for r in time_joins.window_coverage(facts, none, "k", "k", "at", "s", "e").collect()] == [(0, 0)]
