"""What changed since a reviewed baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.scalars import lookup


def classify_changes(claims: DataFrame, verdicts: DataFrame, strict: bool = True) -> DataFrame:
    """Attach each claim's classification; unknown ids and values, and a second verdict for a claim, are refused.

    ``claims``: id, …; ``verdicts``: id, change_classification, note. With ``strict`` an unknown entry
    fails the job; otherwise it is returned with its ``problem``.
    """
    value = F.lower(F.trim(F.coalesce("change_classification", F.lit(""))))
    given = verdicts.select("id", value.alias("change_classification"), F.nullif(F.trim("note"), F.lit("")).alias("change_note"), F.lit(True).alias("_given"))
    given = given.groupBy("id").agg(*[F.max(c).alias(c) for c in ("change_classification", "change_note", "_given")], F.count(F.lit(1)).alias("_verdicts"))
    joined = claims.withColumn("_known", F.lit(True)).join(given, "id", "full")
    problem = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown claim "), F.col("id").cast("string"))).when(
        F.col("_given") & ~F.col("change_classification").isin(*fixed.CLASSIFICATIONS),
        F.concat(F.lit("unknown change_classification "), F.col("change_classification"))).when(
        F.col("_verdicts") > 1, F.concat(F.lit("several verdicts for claim "), F.col("id").cast("string")))
    if strict:
        checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("change_classification"))
        return joined.withColumn("change_classification", checked).select(*claims.columns, "change_classification", "change_note")
    return joined.withColumn("problem", problem).select(*claims.columns, "change_classification", "change_note", "problem")


def suggested_class(baseline: Column, now: Column) -> Column:
    """Suggestion from the two statuses; the recorded verdict always wins."""
    return (F.when((baseline == "passed") & (now == "passed"), "preserved").when((baseline == "passed") & (now == "failed"), "new regression")
            .when((baseline == "failed") & (now == "passed"), "defect fixed").when((baseline == "failed") & (now == "failed"), "still open")
            .otherwise("inconclusive"))


def suggest_classes(baseline: DataFrame, now: DataFrame) -> DataFrame:
    joined = baseline.select("id", F.col("status").alias("baseline_status")).join(now.select("id", F.col("status").alias("now_status")), "id", "full")
    return joined.withColumn("change_classification", suggested_class(F.col("baseline_status"), F.col("now_status")))


def classification_counts(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Claims per classification; the known vocabulary keeps its order in ``position``."""
    value = F.nullif(F.lower(F.trim("change_classification")), F.lit(""))
    rank = {c: i for i, c in enumerate(fixed.CLASSIFICATIONS)}
    counts = claims.select(*by, value.alias("change_classification")).where("change_classification is not null")
    counts = counts.groupBy(*by, "change_classification").agg(F.count(F.lit(1)).alias("claims"))
    return counts.withColumn("position", lookup(F.col("change_classification"), rank, len(rank)))


def worst_classification(claims: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most serious classification per group."""
    rank = {c: i for i, c in enumerate(fixed.CLASSIFICATION_SEVERITY)}
    value = F.nullif(F.lower(F.trim("change_classification")), F.lit(""))
    ranked = claims.select(*by, value.alias("_v")).where("_v is not null")
    return ranked.groupBy(*by).agg(F.min_by("_v", F.struct(lookup(F.col("_v"), rank, len(rank)), F.col("_v"))).alias("worst"))


def regression_counts(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """New regressions, undecided claims and the headline they allow; null when nothing is classified."""
    value = F.nullif(F.lower(F.trim("change_classification")), F.lit(""))
    rows = claims.select(*by, value.alias("_v"))
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count("_v").alias("classified"), F.count_if(F.col("_v") == "new regression").alias("new_regressions"),
        F.count_if(F.col("_v").isNotNull() & ~F.col("_v").isin("preserved", "defect fixed")).alias("undecided"))
    headline = (F.when(F.col("classified") == 0, None)
                .when((F.col("new_regressions") == 0) & (F.col("undecided") == 0), "Nothing broke since the last approved version.")
                .when(F.col("new_regressions") == 0, "Nothing broke since the last approved version. Some changes still need your decision.")
                .when(F.col("new_regressions") == 1, "One thing broke since the last approved version.")
                .otherwise(F.concat(F.col("new_regressions").cast("string"), F.lit(" things broke since the last approved version."))))
    return out.withColumn("headline", headline)
