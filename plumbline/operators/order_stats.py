"""Exact order statistics per group by radix selection, without putting a group into one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer, and a
window over the group sorts all of it in one task. Both break when one group holds a third of
a large table. Here every value becomes a 64-bit key that sorts like it. A round counts the rows of each group per leading
bits of the key (combined where the rows are), so the counts say which leading bits hold a wanted rank; the next
round looks only at rows with those bits and takes the bits that follow. It ends when every wanted rank's rows share one value, after
three rounds at the latest. A round returns at most 2^22 counts per group and rank, whatever the values are distributed like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.session import stored

SHIFTS = (42, 21, 0)  # bits of the key that a round leaves out


class Rank(NamedTuple):
    """A wanted rank: within two places of ``q * (n - 1)``, zero-based, as a function of n."""

    name: str
    q: float
    position: Callable[[Column], Column]


def sort_key(value: Column) -> Column:
    """A long that sorts like the double: exponent and mantissa of its size, mirrored for negative values. Both zeros are 0."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    # a logarithm next to a power of two may be rounded across it
    exponent = guess + F.when(size < power, -1).when(size >= power * 2, 1).otherwise(0)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("bigint")
    tiny = (size * float(2.0 ** 537) * float(2.0 ** 537)).cast("bigint")
    key = F.when(size < 2.0 ** -1022, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(value < 0, -key).otherwise(key)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join with null-safe keys; Spark broadcasts the right side when its stored size allows."""
    named = right.withColumnsRenamed({c: f"_k_{c}" for c in columns})
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_k_{c}"]) for c in columns])
    return left.join(named, condition).drop(*[f"_k_{c}" for c in columns])


def _round(rows: DataFrame, held: DataFrame | None, groups: list[str], ranks: Sequence[Rank], last: int | None, shift: int) -> tuple[DataFrame, bool]:
    """Counts per bits beyond ``shift`` where a wanted rank lies: ``_n`` of the group, rows ``_from`` before, ``_c`` inside, their value if it is one."""
    bits = F.shiftright("_key", shift).alias("_bits")
    if held is None:
        seen, inside = rows.select(*groups, bits, "_v"), list(groups)
        offset, total = F.lit(0).cast("bigint"), F.sum("_c").over(Window.partitionBy(*groups))
    else:
        inside = [*groups, "_above"]
        near = rows.select("*", F.shiftright("_key", last).alias("_above"))
        seen = _same(near, held.select(*groups, F.col("_bits").alias("_above"), F.col("_n"), F.col("_from").alias("_base")), inside).select(*inside, bits, "_v", "_n", "_base")
        offset, total = F.col("_base"), F.col("_n")
    keep = [] if held is None else [F.max(c).alias(c) for c in ("_n", "_base")]
    counts = seen.groupBy(*inside, "_bits").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *keep)
    before = Window.partitionBy(*inside).orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*groups, "_bits", "_c", "_low", "_high", total.alias("_n"), (offset + F.coalesce(F.sum("_c").over(before), F.lit(0))).alias("_from"))
    wanted = reduce(lambda a, b: a | b, [(r.position(F.col("_n")) >= F.col("_from")) & (r.position(F.col("_n")) < F.col("_from") + F.col("_c")) for r in ranks])
    # the smallest value always comes along, so that a group whose ranks all lie outside 0..n-1 keeps its size
    watch = Observation()
    found = stored(placed.where(wanted | (F.col("_from") == 0)).observe(watch, F.count_if(F.col("_low") != F.col("_high")).alias("open")))
    return found, watch.get["open"] == 0


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[Rank]) -> DataFrame:
    """Per group: ``n`` (non-null values) and the exact value at every requested rank."""
    groups = list(by)
    number = F.col(value).cast("double")
    rows = df.select(*groups, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_key", sort_key(F.col("_v")))
    held, last = None, None
    for shift in SHIFTS:
        held, done = _round(rows, held, groups, ranks, last, shift)
        last = shift
        if done:
            break
    n = F.col("_n")
    hits = [F.max(F.when((r.position(n) >= F.col("_from")) & (r.position(n) < F.col("_from") + F.col("_c")), F.col("_high"))).alias(r.name) for r in ranks]
    return held.groupBy(*groups).agg(F.max("_n").alias("n"), *hits)


def _low(q: float) -> Callable[[Column], Column]:
    return lambda n: F.floor((n - 1) * F.lit(q))


def _high(q: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil((n - 1) * F.lit(q))


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Inclusive linear-interpolation quantiles (rank ``(n-1)*q``); columns ``n`` and each name."""
    ranks = []
    for name, q in wanted.items():
        ranks += [Rank(f"_lo_{name}", q, _low(q)), Rank(f"_hi_{name}", q, _high(q))]
    found = order_statistics(df, by, value, ranks)
    n = F.col("n")
    columns = []
    for name, q in wanted.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q))
        columns.append((low + (high - low) * share).alias(name))
    return found.select(*by, "n", *columns)


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median: the middle value, or the mean of the two middle values."""
    found = order_statistics(df, by, value, [Rank("_lo", 0.5, _low(0.5)), Rank("_hi", 0.5, _high(0.5))])
    return found.select(*by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def middle_three(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The values at ranks m-1, m and m+1 with m = n div 2: all a leave-one-out median needs."""
    def at(shift: int) -> Callable[[Column], Column]:
        return lambda n: F.floor(n / 2) + shift
    wanted = [Rank("below", 0.5, at(-1)), Rank("mid", 0.5, at(0)), Rank("above", 0.5, at(1))]
    return order_statistics(df, by, value, wanted)


def leave_one_out_median(n: Column, below: Column, mid: Column, above: Column, own: Column) -> Column:
    """Median of a group without one member of value ``own``, from its three middle values."""
    odd = (
        F.when(own < mid, (mid + above) / 2)
        .when(own > mid, (below + mid) / 2)
        .otherwise((below + above) / 2)
    )
    return F.when(n % 2 == 1, odd).otherwise(F.when(own < mid, mid).otherwise(below))
