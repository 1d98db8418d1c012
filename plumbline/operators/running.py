"""Running sums and previous values over an ordered series, split into chunks of the order.

A plain window puts a whole series into one task. Here the rows are sorted into ranges of (series, order): ranges
hold about equally many rows whatever the distribution of the order key, and a long series spans many of them. The chunk
totals are accumulated (at most one row per series and range), and every chunk then runs its own window from its
starting offset. The ranges are materialised once, so that totals and rows see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.relational import attach, shuffled
from plumbline.session import stored


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column], previous: dict[str, str] | None = None, tie: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals (``sums``: name -> expression) and previous-row values.

    ``previous`` maps a new column to the column whose value on the preceding row it takes.
    ``tie`` breaks ties of the order column.
    """
    previous = previous or {}
    by = list(by)
    rows = df.withColumns({f"_s_{n}": e for n, e in sums.items()})
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = stored(rows.repartitionByRange(ranges, *by, order, *tie).withColumn("_chunk", F.spark_partition_id()))
    sequence = F.struct(order, *tie)
    totals = chunked.groupBy(*by, "_chunk").agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.struct(F.col(c).alias("v")), sequence).alias(f"_z_{n}") for n, c in previous.items()],
    )
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.lag(f"_z_{n}").over(chunks).alias(f"_p_{n}") for n in previous],
    )
    # short series have almost as many offsets as rows
    placed = attach(chunked, shuffled(offsets), [*by, "_chunk"], "inner")
    inside = Window.partitionBy(*by, "_chunk").orderBy(order, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    added = {n: F.col(f"_b_{n}") + F.sum(f"_s_{n}").over(upto) for n in sums}
    added |= {
        n: F.when(F.row_number().over(inside) == 1, F.col(f"_p_{n}.v")).otherwise(F.lag(c).over(inside))
        for n, c in previous.items()
    }
    return placed.withColumns(added).select(*df.columns, *sums, *previous)
