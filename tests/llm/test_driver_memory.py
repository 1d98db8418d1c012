"""What the training-data operators hold in the driver's Python."""

import tracemalloc

from plumbline.llm import line_dedup
from plumbline.llm.graph import maybe_in


def _peak(make):
    make()  # imports and caches are not counted
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_bit_sets_and_rarity_stay_small(spark):
    words = spark.range(400_000).selectExpr("concat('w', id) AS text")
    _, peak = _peak(lambda: line_dedup.rarity(words))
    assert peak < 24 << 20
    test, peak = _peak(lambda: maybe_in(spark.range(400_000), "id", 1 << 22))
    assert peak < 24 << 20
    assert spark.range(400_000).where(test("id")).count() == 400_000
    assert spark.range(10_000_000, 10_100_000).where(test("id")).count() < 20_000
    assert spark.range(10).where(maybe_in(spark.range(0), "id")("id")).count() == 0
