"""Comparison of two snapshots key by key, and explanation of the difference.

Every comparison tags the rows with their side and groups once by key: null keys match, a
repeated key cannot multiply rows, and hot keys are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.relational import any_of, check_columns


class Comparison(NamedTuple):
    """``verdict``: one row; ``changes``: one row per changed field; ``keys``: added and removed keys."""

    verdict: DataFrame
    changes: DataFrame
    keys: DataFrame


def _common_type(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type both sides are compared in: whole numbers and decimals meet in the larger scale, a fraction makes both doubles."""
    if old == new:
        return old
    if not (isinstance(old, T.NumericType) and isinstance(new, T.NumericType)):
        return T.StringType()
    if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in (old, new)):
        return T.DoubleType()
    return T.DecimalType(38, max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (old, new)))


def _paired(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: how often it occurs on each side, and each side's values (``_old_x``, ``_new_x``).

    Every value is its own aggregate, so numbers stay in a hash aggregation.
    """
    check_columns(before, *keys, *values)
    check_columns(after, *keys, *values)
    kinds = {v: _common_type(before.schema[v].dataType, after.schema[v].dataType) for v in values}

    def side(df: DataFrame, mine: str, other: str, tag: int) -> DataFrame:
        own = [F.col(v).cast(kinds[v]).alias(f"_{mine}_{v}") for v in values]
        return df.select(*keys, *own, *[F.lit(None).cast(kinds[v]).alias(f"_{other}_{v}") for v in values], F.lit(tag).alias("_s"))

    both = side(before, "old", "new", 0).unionByName(side(after, "new", "old", 1))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_s") == 0).alias("_olds"), F.count_if(F.col("_s") == 1).alias("_news"),
        *[F.max(f"_old_{v}").alias(f"_old_{v}") for v in values], *[F.max(f"_new_{v}").alias(f"_new_{v}") for v in values])


def _delta(old, new, kind):
    """Exact difference where 38 digits hold it (whole numbers, decimals in their own scale, doubles below 1e19), else in doubles."""
    if isinstance(kind, T.DecimalType):
        exact = f"decimal(38,{kind.scale})"
        return new.cast(exact) - old.cast(exact)
    if isinstance(kind, T.IntegralType):
        return new.cast("decimal(38,0)") - old.cast("decimal(38,0)")
    number = [c.cast("string").try_cast("decimal(38,18)") for c in (new, old)]
    small = (F.abs(new.try_cast("double")) < 1e19) & (F.abs(old.try_cast("double")) < 1e19)
    return F.when(small, number[0] - number[1])


def keyed_compare(
    before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: str | float = "0.005",
    complete: bool = True,
) -> Comparison:
    """Added, removed and changed keys. Exact decimal deltas, strict ``abs(delta) > tolerance``.

    Incomplete input or a repeated key makes the verdict inconclusive; a non-numeric or non-finite
    value is an error.
    """
    if float(tolerance) < 0:
        raise ValueError("tolerance cannot be negative")
    paired = _paired(before, after, keys, values)
    shared = paired.where("_olds > 0 and _news > 0")
    limit = F.lit(str(tolerance)).cast("decimal(38,18)")
    kinds = {v: _common_type(before.schema[v].dataType, after.schema[v].dataType) for v in values}
    fields = []
    for v in values:
        old, new = F.col(f"_old_{v}"), F.col(f"_new_{v}")
        exact, wide = _delta(old, new, kinds[v]), new.cast("double") - old.cast("double")
        moved = F.coalesce(F.abs(exact) > limit, F.abs(wide) > float(tolerance))
        changed = F.when(old.isNull() | new.isNull(), ~old.eqNullSafe(new)).otherwise(moved)
        delta = F.coalesce(exact.cast("double"), wide)
        fields.append(F.when(changed, F.struct(
            F.lit(v).alias("field"), old.cast("string").alias("before"), new.cast("string").alias("after"),
            delta.alias("delta"))))
    found = shared.withColumn("_c", F.filter(F.array(*fields), lambda c: c.isNotNull()))
    changes = found.select(*keys, F.explode("_c").alias("c")).select(*keys, "c.*")
    side = F.when(F.col("_olds") == 0, "added").when(F.col("_news") == 0, "removed")
    only = paired.withColumn("change", side).where("change is not null").select(*keys, "change")
    counts = paired.withColumn("_c", F.when((F.col("_olds") > 0) & (F.col("_news") > 0),
                                            F.size(F.filter(F.array(*fields), lambda c: c.isNotNull())))).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"), F.count_if(F.col("_olds") == 0).alias("added"),
        F.count_if(F.col("_news") == 0).alias("removed"),
        F.count_if((F.col("_olds") > 1) | (F.col("_news") > 1)).alias("duplicate_keys"))
    status = (F.when(F.lit(not complete), "inconclusive").when(F.col("duplicate_keys") > 0, "inconclusive")
              .when(F.col("changes") + F.col("added") + F.col("removed") > 0, "different").otherwise("equal"))
    reason = F.when(F.lit(not complete), "One or both inputs are incomplete").when(F.col("duplicate_keys") > 0, "Duplicate comparison keys")
    verdict = counts.select(status.alias("status"), reason.alias("reason"), "changes", "added", "removed", "duplicate_keys",
                            F.lit(str(tolerance)).alias("tolerance"))
    return Comparison(verdict, changes, only)


def restatement_split(old: DataFrame, new: DataFrame, keys: Sequence[str], amount: str, period: str | None = None) -> DataFrame:
    """Late arrivals, deletions, updates and unchanged rows of the same period, with their amounts."""
    values = [amount] + ([period] if period else [])
    paired = _paired(old, new, keys, values)
    before = F.coalesce(F.col(f"_old_{amount}"), F.lit(0)).cast("decimal(38,6)")
    after = F.coalesce(F.col(f"_new_{amount}"), F.lit(0)).cast("decimal(38,6)")
    kind = (F.when(F.col("_olds") == 0, "late_arrival").when(F.col("_news") == 0, "deletion")
            .when(any_of([~F.col(f"_old_{v}").eqNullSafe(F.col(f"_new_{v}")) for v in values]), "update").otherwise("unchanged"))
    groups = [kind.alias("kind")]
    if period:
        groups.insert(0, F.coalesce(F.col(f"_new_{period}"), F.col(f"_old_{period}")).alias("period"))
    return paired.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(before).cast("double").alias("before_amount"),
        F.sum(after).cast("double").alias("after_amount"), (F.sum(after) - F.sum(before)).cast("double").alias("delta"))


def mature_overlap(
    old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], date: str, cutoff, tolerance: str | float = "0.005"
) -> Comparison:
    """Keyed comparison restricted to dates both snapshots had time to complete."""
    ripe = F.col(date).cast("date") <= F.lit(cutoff).cast("date")
    return keyed_compare(old.where(ripe), new.where(ripe), keys, values, tolerance)


def contribution(before: DataFrame, after: DataFrame, reason: Sequence[str], amount: str, explained: Sequence[str] | None = None) -> DataFrame:
    """Delta per disjoint reason plus the unexplained remainder (reasons not listed as explained)."""
    both = before.select(*reason, (-F.col(amount)).alias("_v")).unionByName(after.select(*reason, F.col(amount).alias("_v")))
    deltas = both.groupBy(*reason).agg(F.sum("_v").alias("_d"))
    if explained is None:
        return deltas.select(F.concat_ws("|", *reason).alias("reason"), F.col("_d").cast("double").alias("delta"))
    label = F.concat_ws("|", *reason)
    name = F.when(label.isin(*explained), label).otherwise("unexplained")
    return deltas.groupBy(name.alias("reason")).agg(F.sum("_d").cast("double").alias("delta"))
