"""Helpers for pair results: bounded pre-filters and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, shared_folder

FLAGS = 1 << 18


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage like a checkpoint, in the space of compressed columns."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table_of(spark: SparkSession, octets: np.ndarray) -> Column:
    """A table of bytes as one value. As a literal its digits would stand in every description of a plan that Spark's driver makes and keeps."""
    return spark.createDataFrame(pa.table({"octets": pa.array([octets.tobytes()], pa.binary())})).scalar()


def maybe_in(keys: DataFrame, column: str, flags: int = FLAGS) -> Callable[[Column | str], Column]:
    """A bit set over hashes of the keys: a filter with false positives only, at most ``flags`` bits however many keys there are."""
    seen = keys.select(F.pmod(F.xxhash64(column), F.lit(flags)).cast("int").alias("f"))
    octets = seen.groupBy(F.shiftright("f", 3).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("f").bitwiseAND(F.lit(7)))).alias("bits"))
    held = octets.toArrow()  # at most flags / 8 rows of two numbers, as columns: as Python rows they would take a hundred times the room
    bits = np.zeros(flags // 8, np.uint8)
    bits[held["at"].to_numpy()] = held["bits"].to_numpy()
    octet = table_of(keys.sparkSession, bits)

    def test(key: Column | str) -> Column:
        f = F.pmod(F.xxhash64(key), F.lit(flags)).cast("int")
        byte = F.ascii(F.decode(F.substring(octet, F.shiftright(f, 3) + 1, F.lit(1)), "ISO-8859-1"))
        return F.getbit(byte, f.bitwiseAND(F.lit(7))) == 1

    return test


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (x, y): the smallest node that it can reach.

    Labels take the smallest label next door, then jump to the label of their label, until nothing changes.
    Every round is checkpointed; hubs are reduced in the map-side combine.
    """
    both = cut_lineage(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        offered = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("offer"))
        taken = labels.join(offered, labels["node"] == offered["x"]).select("node", F.col("component").alias("old"), F.least("component", "offer").alias("c"))
        above = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        jumped = cut_lineage(taken.join(above, taken["c"] == above["n2"]).select("node", "old", F.least("c", "c2").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("old != component").isEmpty():
            return labels
