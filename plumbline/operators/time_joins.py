"""Joins along time: the version in force at each fact, and the windows open at each event.

Both put facts and the other side into one ordered line per key. The line is cut into ranges of (key, time) that are equally full
whatever the keys are, so a key with a third of all rows spans many of them, and no pair of a fact and another row is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.relational import all_of, attach
from plumbline.operators.running import running_sums
from plumbline.session import stored


def as_of_join(
    facts: DataFrame, versions: DataFrame, key: Sequence[str], at: str, version_at: str, tie: Sequence[str] = (), prefix: str = "version_",
    eligible: Column | None = None,
) -> DataFrame:
    """``facts`` with the columns of the last version of their key at or before their time, renamed with ``prefix``.

    Of versions of one time the one with the greatest ``tie`` columns counts. A fact without a version in force, a null key part or a null time
    keeps nulls; versions with a null key part or time are never in force. ``eligible`` is a condition on the versions' own columns that is tested
    after the newest one is chosen: a fact whose version fails it has no version. Repeated facts stay.
    """
    key, tie = list(key), list(tie)
    held = [c for c in versions.columns if c not in key]
    named = {c: f"{prefix}{c}" for c in held}
    clash = set(named.values()) & set(facts.columns)
    if clash:
        raise ValueError(f"column(s) {sorted(clash)} would appear twice; choose another prefix")
    whole = all_of([F.col(f"`{c}`").isNotNull() for c in (*key, at)])
    keys = [f"_k{i}" for i in range(len(key))]
    content = F.struct(*[F.col(f"`{c}`") for c in held])
    judged = content if eligible is None else F.struct(content.alias("row"), F.coalesce(eligible, F.lit(False)).alias("counts"))
    ordered = F.struct(*[F.col(f"`{c}`") for c in tie]) if tie else F.lit(0)
    news = versions.where(all_of([F.col(f"`{c}`").isNotNull() for c in (*key, version_at)])).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(key, keys)], F.col(f"`{version_at}`").alias("_at"), F.lit(0).alias("_kind"), ordered.alias("_tie"), judged.alias("_v"))
    asks = facts.where(whole).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(key, keys)], F.col(f"`{at}`").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_f"))
    line = news.unionByName(asks, allowMissingColumns=True)
    order = ["_at", "_kind", "_tie"]
    ranges = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(line.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = cut.withColumn("_now", F.last("_v", ignorenulls=True).over(inside)).where("_f is not null")
    # only the first key of a range can go on from the range before: one row per range at most
    edge = cut.groupBy("_range").agg(
        F.min(F.struct(*keys)).alias("_first"), F.max(F.struct(*keys)).alias("_last"), F.max_by(F.struct("_v"), F.when(F.col("_v").isNotNull(), F.struct(*keys, *order))).alias("_newest"),
        F.max(F.when(F.col("_v").isNotNull(), F.struct(*keys))).alias("_of"))
    left = edge.where(F.col("_of") == F.col("_last")).select(F.col("_last").alias("_key"), "_range", F.col("_newest._v").alias("_left"))
    taken = edge.select(F.col("_first").alias("_key"), "_range", F.lit(True).alias("_asks"))
    earlier = Window.partitionBy("_key").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    carried = left.unionByName(taken, allowMissingColumns=True).withColumn("_carried", F.last("_left", ignorenulls=True).over(earlier)).where("_asks and _carried is not null")
    carried = carried.select(F.col("_range").alias("_to"), F.col("_key").alias("_whose"), "_carried")
    found = near.join(F.broadcast(carried), (F.col("_range") == F.col("_to")) & (F.struct(*keys) == F.col("_whose")), "left")
    version = F.coalesce("_now", "_carried")
    if eligible is not None:
        version = F.when(version["counts"], version["row"])
    found = found.select("_f", version.alias("_version"))
    out = found.select(*[F.col(f"_f.`{c}`").alias(c) for c in facts.columns], *[F.col(f"_version.`{c}`").alias(n) for c, n in named.items()])
    rest = facts.where(~whole).select("*", *[F.lit(None).cast(versions.schema[c].dataType).alias(n) for c, n in named.items()])
    return out.unionByName(rest)


def window_coverage(
    facts: DataFrame, windows: DataFrame, fact_key: str, window_key: str, at: str, start: str, end: str, open_end: str = "never_outside",
) -> DataFrame:
    """``facts`` with ``windows``, the dated windows of their key, and ``covering``, how many of them contain the fact's time.

    Windows may overlap, repeat and share a key in any number: starts, facts and ends pass by in order of time and a running count tells how many are
    open, both ends included. A missing end is open for good (``never_outside``) or contains nothing (``outside``); a window without a start
    is undated and not counted, one that ends before it starts contains nothing. A fact with a null key or time has null counts.
    """
    if open_end not in ("never_outside", "outside"):
        raise ValueError("open_end is never_outside or outside")
    kind = facts.schema[at].dataType
    dated = windows.where(F.col(start).isNotNull() & F.col(window_key).isNotNull()).select(F.col(window_key).alias("_key"), F.col(start).cast(kind).alias("_start"), F.col(end).cast(kind).alias("_end"))
    real = (F.col("_end") >= F.col("_start")) | (F.col("_end").isNull() & F.lit(open_end == "never_outside"))
    marks = dated.where(real).select("_key", F.explode(F.array(
        F.struct(F.col("_start").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).cast("bigint").alias("_step")),
        F.struct(F.col("_end").alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).cast("bigint").alias("_step")))).alias("m")).select("_key", "m.*").where("_at is not null")
    # marks of one kind, key and time pass together
    marks = marks.groupBy("_key", "_at", "_kind").agg(F.sum("_step").alias("_step"))
    whole = F.col(fact_key).isNotNull() & F.col(at).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    line = facts.where(whole).select(F.col(fact_key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_step"), row.alias("_f"))
    counted = running_sums(line.unionByName(marks, allowMissingColumns=True), ["_key"], "_at", {"covering": F.col("_step")}, tie=["_kind"]).where("_f is not null")
    totals = dated.groupBy("_key").agg(F.count(F.lit(1)).alias("windows"))
    zero = F.lit(0).cast("bigint")
    out = attach(counted, totals, ["_key"]).select(*[F.col(f"_f.`{c}`").alias(c) for c in facts.columns], F.coalesce("windows", zero).alias("windows"), "covering")
    none = F.lit(None).cast("bigint")
    return out.unionByName(facts.where(~whole).select("*", none.alias("windows"), none.alias("covering")))


def outside_all_windows(facts: DataFrame, windows: DataFrame, fact_key: str, window_key: str, at: str, start: str, end: str, open_end: str = "never_outside") -> DataFrame:
    """Facts whose key has dated windows, none of which contains their time."""
    return window_coverage(facts, windows, fact_key, window_key, at, start, end, open_end).where("windows > 0 and covering = 0")
