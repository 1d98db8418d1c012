"""A true link whose estimate is low reaches the exact confirmation on both paths."""

import numpy as np

from plumbline.llm import near_dedup


def test_low_estimate_of_a_true_link_is_no_reason_to_drop_it(spark):
    # two sets of 90 hashes with exactly 80 in common (0.8), estimated at 0.705
    hashes = np.random.default_rng(2796).integers(0, 1 << 63, 100, dtype=np.uint64)
    x, y = near_dedup.sketch(hashes[:90]), near_dedup.sketch(hashes[10:])
    size = np.array([90.0])
    assert near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), size, size)[0] < 0.71
    rows = [(0, 90, bytes(near_dedup.REGISTERS)), (1, 90, x.tobytes()), (2, 90, y.tobytes())]
    nodes = spark.createDataFrame(rows, "node bigint, n bigint, registers binary")
    pair = spark.createDataFrame([(1, 2)], "x bigint, y bigint")
    assert [tuple(r) for r in near_dedup._likely(pair, nodes, near_dedup.Rules()).collect()] == [(1, 2)]
    members = nodes.selectExpr("7L AS key", "0 AS band", "node", "node AS component", "0L AS pivot", "0L AS home", "CAST(NULL AS bigint) AS shared")
    assert [tuple(r) for r in near_dedup._across(members, nodes, near_dedup.Rules()).collect()] == [(1, 2)]
    t = 0.8
    assert near_dedup._floor(80) <= t - 6 * (t * (1 - t) / near_dedup.REGISTERS) ** 0.5
