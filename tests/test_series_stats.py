"""Boundary behaviour of the series detectors, under few and many ranges, against brute force."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import running
from plumbline.operators import series_stats as s

MONDAY = dt.date(2024, 1, 1)


def daily(spark, values, series="a", start=MONDAY):
    rows = [(series, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, key date, value double").withColumn("ord", F.col("key"))


@pytest.fixture(params=["2", "7"])
def plan(request, spark):
    """A series in few ranges and in many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def noisy(n, seed, shifts=()):
    rng = random.Random(seed)
    return [100 + sum(h for at, h in shifts if i >= at) + rng.gauss(0, 3) + (i % 7) * 2 for i in range(n)]


# --- z-scores ---------------------------------------------------------------------


def many(spark, named):
    """Several series in one frame, so one run covers them all."""
    frames = [daily(spark, values, name) for name, values in named.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_zscore_status(spark, plan, rows):
    named = {"seven": [1, 2, 3, 4, 5, 6, 7], "equal": [5] * 9, "eight": [1, 2, 3, 4, 5, 6, 7, 8], "spike": [1, 2, 3, 4, 5, 6, 7, 100],
             "gaps": [1, 2, 3, None, float("nan"), 4, 5, 6, 7, 100], "nothing": [None, None]}
    found = s.robust_zscores(many(spark, named), ["id"])
    assert rows(found.verdict, "id", "status", "n", "flagged") == [
        ("eight", "clean", 8, 0), ("equal", "inconclusive", 9, 0), ("gaps", "flagged", 8, 1), ("nothing", "inconclusive", 0, 0), ("seven", "inconclusive", 7, 0), ("spike", "flagged", 8, 1)]


def test_zscore_threshold_is_strict(spark, plan):
    values = [1, 2, 3, 4, 5, 6, 7, 8]
    z = (8 - 4.5) / (2 * 1.4826)
    assert s.robust_zscores(daily(spark, values), ["id"], threshold=z).verdict.first()["status"] == "clean"
    assert s.robust_zscores(daily(spark, values), ["id"], threshold=z - 1e-9).verdict.first()["flagged"] == 2


def test_center_needs_three_points(spark, plan, rows):
    df = daily(spark, [1, 2]).unionByName(daily(spark, [None], "b")).unionByName(daily(spark, [1, 2, 4], "c"))
    assert rows(s.robust_center(df, ["id"])) == [("a", 2, None, None, None), ("b", 0, None, None, None), ("c", 3, 2.0, 1.0, 1.4826)]


def test_whole_frame_is_one_group(spark, plan):
    assert s.robust_center(daily(spark, [1, 2, 4]), []).first()["median"] == 2.0


# --- weekday band ------------------------------------------------------------------


def weekday_brute(points, threshold=3.5):
    cells = defaultdict(list)
    for day, v in points:
        if v is not None:
            cells[day.weekday()].append(v)
    out = []
    for day, v in points:
        if v is None or len(cells[day.weekday()]) < 4:
            continue
        peers = list(cells[day.weekday()])
        peers.remove(v)
        m = statistics.median(peers)
        spread = statistics.median([abs(p - m) for p in peers]) * 1.4826
        z = (v - m) / (spread if spread > 0 else max(1.0, abs(m) * 0.02))
        if abs(z) > threshold:
            out.append((day, round(m, 9), round(z, 9)))
    return sorted(out)


def test_weekday_band_equals_brute_force(spark, plan):
    named = {}
    for seed, n in [(1, 60), (2, 35), (3, 29), (4, 100), (5, 5)]:
        rng = random.Random(seed)
        named[str(seed)] = [rng.choice([10, 10, 10, 12, 15, None, rng.uniform(0, 60)]) for _ in range(n)]
    found = s.weekday_band(many(spark, named), ["id"]).flags.collect()
    for name, values in named.items():
        got = sorted((r["key"], round(r["weekday_median"], 9), round(r["score"], 9)) for r in found if r["id"] == name)
        assert got == weekday_brute([(MONDAY + dt.timedelta(days=i), v) for i, v in enumerate(values)])


def test_weekday_spike_and_untestable_days(spark, plan):
    values = [10 + (i % 3) for i in range(36)]  # 5 weeks and one more Monday
    values[16] = 90
    found = {r["id"]: r for r in s.weekday_band(many(spark, {"long": values, "short": values[:22], "tiny": values[:14]}), ["id"]).verdict.collect()}
    assert (found["long"]["status"], found["long"]["flagged"], found["long"]["untestable_points"]) == ("flagged", 1, 0)
    assert (found["short"]["n"], found["short"]["untestable_points"], len(found["short"]["untestable_days"])) == (22, 18, 18)
    assert found["tiny"]["status"] == "inconclusive"


def test_identical_peers_use_the_scale_floor(spark, plan):
    values = [100] * 35
    values[7] = 101  # a Monday: floor is max(1, 2 % of 100) = 2, so z = 0.5
    assert s.weekday_band(daily(spark, values), ["id"]).flags.count() == 0
    values[7] = 108
    flag = s.weekday_band(daily(spark, values), ["id"]).flags.first()
    assert (flag["weekday"], flag["score"]) == ("Monday", 4.0)


# --- ratios ------------------------------------------------------------------------


def ratio_frame(spark, pairs):
    return spark.createDataFrame([(i, float(n) if n is not None else None, float(d) if d is not None else None) for i, (n, d) in enumerate(pairs)], "key int, num double, den double")


def test_ratio_guard_and_bound(spark, plan, rows):
    pairs = [(10, 0), (10, None), (None, 50), (29, 29), (30, 30), (45, 30)]
    found = s.ratio_stability(ratio_frame(spark, pairs), [], "key", "num", "den", upper_bound=1.0)
    v = found.verdict.first()
    assert (v["status"], v["n"], v["low_volume"], v["band_tested"]) == ("flagged", 2, 4, False)
    assert rows(found.flags, "key", "reason") == [(5, "bound")]  # exactly at the bound is not above it


def test_ratio_band_skips_keys_already_flagged(spark, plan, rows):
    base = [(50 + i % 3, 100) for i in range(20)]
    df = ratio_frame(spark, base).unionByName(spark.createDataFrame([(100, 90.0, 100.0), (100, 5.0, 100.0), (101, 1.0, 100.0), (101, 2.0, 100.0)], "key int, num double, den double"))
    found = s.ratio_stability(df, [], "key", "num", "den", upper_bound=0.8)
    assert rows(found.flags, "key", "numerator", "reason") == [(100, 90.0, "bound"), (101, 1.0, "band")]


def test_ratio_without_testable_points_is_inconclusive(spark, plan):
    assert s.ratio_stability(ratio_frame(spark, [(1, 2)]), [], "key", "num", "den").verdict.first()["status"] == "inconclusive"


# --- change points --------------------------------------------------------------------


def segments_brute(values, min_segment, sigma, depth):
    diffs = [abs(b - a) for a, b in zip(values, values[1:])]
    scale = statistics.median(diffs) * 1.4826 / math.sqrt(2) or max(1.0, abs(statistics.median(values)) * 0.02)
    out, todo = [], [(0, len(values), 0)]

    def ssd(part):
        mean = sum(part) / len(part)
        return sum((x - mean) ** 2 for x in part)

    while todo:
        a, b, level = todo.pop()
        if level >= depth or b - a < 2 * min_segment:
            continue
        cut = min(range(a + min_segment, b - min_segment + 1), key=lambda c: (round(ssd(values[a:c]) + ssd(values[c:b]), 6), c))
        left, right = statistics.median(values[a:cut]), statistics.median(values[cut:b])
        if abs(right - left) / scale >= sigma and ssd(values[a:cut]) + ssd(values[cut:b]) < ssd(values[a:b]):
            out.append((MONDAY + dt.timedelta(days=cut), round(left, 6), round(right, 6)))
            todo += [(a, cut, level + 1), (cut, b, level + 1)]
    return sorted(out)


def test_changepoints_equal_brute_force(spark, plan):
    cases = {"one": (40, [(20, 60)]), "two": (60, [(15, 50), (40, -70)]), "four": (90, [(10, 40), (30, 40), (50, -90), (70, 60)]), "none": (30, [])}
    named = {name: noisy(n, n, shifts) for name, (n, shifts) in cases.items()}
    named |= {"step": [1.0] * 7 + [50.0] * 7, "short": [1.0] * 7 + [50.0] * 6}
    found = s.changepoints(many(spark, named), ["id"])
    flags, verdicts = found.flags.collect(), {r["id"]: r for r in found.verdict.collect()}
    for name, values in named.items():
        got = sorted((r["key"], round(r["before_median"], 6), round(r["after_median"], 6)) for r in flags if r["id"] == name)
        assert got == segments_brute(values, 7, 2.0, 3), name
        assert verdicts[name]["shifts"] == len(got)
        assert verdicts[name]["status"] == ("inconclusive" if len(values) < 14 else "flagged" if got else "clean")
        if cases.get(name, (0, []))[1]:
            assert MONDAY + dt.timedelta(days=cases[name][1][0][0]) in [g[0] for g in got]


# --- mixes, totals, joins -----------------------------------------------------------------


def test_psi_floor_and_one_sided_labels(spark):
    df = spark.createDataFrame([("x", "old", 50.0), ("x", "new", 50.0), ("y", "old", 50.0), ("z", "new", 50.0), ("x", "old", None)], "label string, period string, value double")
    v = s.psi(df, [], "label", "period", "value", "old", "new").verdict.first()
    expected = 2 * (0.5 - 1e-4) * math.log(0.5 / 1e-4)
    assert math.isclose(v["psi"], expected, rel_tol=1e-9) and v["status"] == "flagged" and v["new_or_missing"] == 2
    same = s.psi(df.where("label = 'x'"), [], "label", "period", "value", "old", "new").verdict.first()
    assert (same["psi"], same["status"]) == (0.0, "clean")


def test_additivity_tolerance_and_null_members(spark):
    parts = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "member string, value double")
    total = spark.createDataFrame([(3.5,)], "total double")
    row = s.additivity(parts, total, []).first()
    assert (row["status"], row["parts"], row["remainder"]) == ("clean", 3, 0.5)
    assert s.additivity(parts, spark.createDataFrame([(3.51,)], "total double"), []).first()["status"] == "flagged"


def test_fan_out_counts_without_joining(spark):
    base = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, None), (4, 30)], "id int, k int")
    path = spark.createDataFrame([(10,), (10,), (20,), (40,)], "k int")
    row = s.fan_out(base, path, ["k"], ["k"], ["id"]).first()
    assert (row["base_rows"], row["joined_rows"], row["unmatched_rows"], row["distinct_keys"], row["duplicate_rows"], row["status"]) == (5, 5, 2, 4, 1, "flagged")
    assert s.fan_out(base, path, ["k"], ["k"], ["id"], as_assertion=True).first()["status"] == "failed"
    clean = s.fan_out(base.where("id = 3"), path, ["k"], ["k"]).first()
    assert (clean["status"], clean["multiplier"]) == ("clean", 1.0)


def test_profile_counts_what_is_not_a_number(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,), ("4",), ("10",)], "v string")
    row = s.profile(df, [], "v").first()
    assert (row["count"], row["invalid_numeric"], row["null_count"], row["p25"], row["p50"], row["max"]) == (4, 1, 1, 1.75, 3.0, 10.0)


def test_mean_of_ratios_skips_zero_denominators(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (None, 4.0), (2.0, None)], "n double, d double")
    row = s.ratio_of_totals_vs_mean(df, [], "n", "d").first()
    assert (row["ratio_of_totals"], row["mean_of_member_ratios"], row["members"]) == (1.0, 0.5, 1)


def test_running_sums_chunked_equal_window(spark, plan):
    df = spark.createDataFrame([("a", i * i, float(i)) for i in range(53)] + [("b", 1, 2.0)], "g string, o int, v double").repartition(6)
    out = running.running_sums(df, ["g"], "o", {"t": F.col("v")}, {"p": "v"}).collect()
    for r in out:
        if r["g"] == "a":
            i = int(r["v"])
            assert r["t"] == i * (i + 1) / 2 and r["p"] == (None if i == 0 else i - 1.0)
