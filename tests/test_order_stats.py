"""Exact order statistics: radix selection and numpy agree, whatever the skew."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import order_stats as o


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(7)
    data = {"hot": list(rng.normal(100, 1, 30_000)) + [99.5] * 9_000, "ties": [5.0] * 6_000 + [6.0] * 6_001, "wide": list(rng.lognormal(0, 4, 8_000)), "one": [3.0], "pair": [1.0, 2.0]}
    rows = [(g, float(v)) for g, values in data.items() for v in values]
    return data, spark.createDataFrame(rows, "g string, v double").repartition(8)


def test_quantiles_equal_numpy(skewed):
    data, df = skewed
    wanted = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0, "low": 0.0}
    found = {r["g"]: r for r in o.quantiles(df, ["g"], "v", wanted).collect()}
    for group, values in data.items():
        assert found[group]["n"] == len(values)
        for name, q in wanted.items():
            assert math.isclose(found[group][name], float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-12), (group, name)


def test_keys_sort_like_doubles(spark):
    dice = np.random.default_rng(8)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2), 8.0, np.nextafter(8.0, 0)]
    values += dice.integers(-2 ** 63, 2 ** 63 - 1, 20_000, dtype=np.int64).view(np.float64).tolist() + [2.0 ** e for e in range(-1074, 1024, 7)] + [-np.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 9)]
    values = [float(v) for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", o.sort_key(F.col("v")).alias("k"))
    bits = np.array(values).view(np.int64)
    want = {v: int(b) if b >= 0 else -int(b & 0x7FFFFFFFFFFFFFFF) for v, b in zip(values, bits)}
    assert all(r["k"] == want[r["v"]] for r in df.collect())


def test_rounds_look_at_few_rows(skewed):
    """The first round leaves one count per wanted rank; values that share their leading bits take another one."""
    _, df = skewed
    rows = df.select("g", F.col("v").alias("_v"), o.sort_key(F.col("v")).alias("_key"))
    ranks = [o.Rank("mid", 0.5, o._low(0.5))]
    first, done = o._round(rows, None, ["g"], ranks, None, o.SHIFTS[0])
    assert not done and first.where("g = 'hot'").count() <= 2
    second, _ = o._round(rows, first, ["g"], ranks, o.SHIFTS[0], o.SHIFTS[1])
    assert second.where("g = 'hot'").count() <= 3 and second.agg(F.max("_c")).first()[0] < 10_000


def test_two_clusters_around_the_median(spark):
    values = [1.0 + i * 1e-13 for i in range(3_001)] + [1.0 + 1e-3 + i * 1e-13 for i in range(3_000)] + [-1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("g", F.lit(None).cast("string"))
    found = o.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.4999, "c": 0.9, "d": 0.0}).first()
    assert [found[c] for c in "abcd"] == [pytest.approx(float(np.quantile(values, q)), rel=1e-15) for q in (0.5, 0.4999, 0.9, 0.0)]


def test_middle_three_and_leave_one_out(spark):
    for values in ([1.0, 5.0, 9.0, 20.0], [1.0, 2.0, 2.0, 7.0, 9.0], [4.0, 4.0, 4.0, 4.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]):
        df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
        three = o.middle_three(df, ["g"], "v")
        joined = df.join(three, "g").select("v", o.leave_one_out_median(F.col("n"), F.col("below"), F.col("mid"), F.col("above"), F.col("v")).alias("m"))
        for row in joined.collect():
            peers = list(values)
            peers.remove(row["v"])
            assert row["m"] == statistics.median(peers)


def test_nulls_and_nan_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in o.median(df, ["g"], "v").collect()] == [("a", 2, 2.0)]
