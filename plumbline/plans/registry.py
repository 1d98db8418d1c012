"""Probe plans: which method runs on which query, and how its outcome is recorded."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.scalars import lookup
from plumbline.operators import invariants, series_stats
from plumbline.session import cut_lineage
from plumbline.types import Detection


@dataclass(frozen=True)
class Probe:
    """One planned check. ``query`` is SQL text, or a function of the session that returns a frame."""

    id: str
    method: str
    query: str | Callable[[SparkSession], DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    question: str = ""
    severity: str = "review"


Outcome = Detection | DataFrame


def _series_method(operator: Callable[..., Detection]) -> Callable[..., Outcome]:
    def run(df: DataFrame, key_column: str, value_column: str, by: Sequence[str] = (), **params: Any) -> Outcome:
        return operator(series_stats.series(df, by, key_column, value_column), by, **params)
    return run


def _ratio(df, numerator, denominator, key_column, by=(), **params):
    return series_stats.ratio_stability(df, by, key_column, numerator, denominator, **params)


def _mix(df, label_column, value_column, period_column, baseline_period, current_period, by=(), **params):
    return series_stats.psi(df, by, label_column, period_column, value_column, baseline_period, current_period, **params)


def _mean_of_ratios(df, numerator, denominator, by=()):
    return series_stats.ratio_of_totals_vs_mean(df, by, numerator, denominator)


def _additivity(df, value_column, total, total_column, by=(), **params):
    frame = df.sparkSession.sql(total) if isinstance(total, str) else total
    return series_stats.additivity(df, frame, by, value_column, total_column, **params)


def _fan_out(df, path, base_key, path_key, business_key=None, **params):
    frame = df.sparkSession.sql(path) if isinstance(path, str) else path
    return series_stats.fan_out(df, frame, base_key, path_key, business_key, **params)


def _assert(df, column, value, operator="==", **params):
    return invariants.assert_value(df, column, operator, value, **params)


METHODS: dict[str, Callable[..., Outcome]] = {
    "stat.weekday_robust_band": _series_method(series_stats.weekday_band),
    "stat.robust_zscores": _series_method(series_stats.robust_zscores),
    "stat.changepoints": _series_method(series_stats.changepoints),
    "stat.ratio_stability": _ratio,
    "stat.population_stability": _mix,
    "stat.ratio_of_totals_vs_mean_of_ratios": _mean_of_ratios,
    "dax.additivity": _additivity,
    "dax.fan_out": _fan_out,
    "dax.assert": _assert,
}


def register_method(method: str, operator: Callable[..., Outcome]) -> None:
    """Extension point: make a method id runnable from a plan."""
    METHODS[method] = operator


def run_method(method: str, df: DataFrame, params: dict[str, Any] | None = None) -> Outcome:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {sorted(METHODS)}")
    return METHODS[method](df, **(params or {}))


def map_status(status: Column | str) -> Column:
    """Recorded status of an outcome; an assertion's own passed/failed is kept."""
    value = F.col(status) if isinstance(status, str) else status
    return F.when(value.isin("passed", "failed"), value).otherwise(lookup(value, fixed.METHOD_STATUS, "inconclusive"))


def interpretation_required(status: Column | str) -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin("review", "inconclusive")


def unfilled_placeholders_in(probe: Probe) -> list[str]:
    """Template holes left in the probe's own text."""
    import re
    text = (probe.query if isinstance(probe.query, str) else "") + " " + json.dumps(probe.params, default=str)
    return list(dict.fromkeys(re.findall(fixed.PLACEHOLDER, text)))


def _record(spark: SparkSession, probe: Probe, component: str, error: str) -> DataFrame:
    row = [(component, probe.id, probe.method, probe.question, probe.severity, "inconclusive", "inconclusive", error)]
    return spark.createDataFrame(row, "component string, probe string, method string, question string, severity string, outcome string, status string, error string")


def run_plan(spark: SparkSession, probes: Sequence[Probe], component: str = "") -> DataFrame:
    """Run every probe and return its verdict rows; one probe's failure never stops the others.

    Each probe is executed by its own action (a checkpoint of its verdict), because a single lazy
    union would let one runtime error fail the whole plan.
    """
    records = []
    for probe in probes:
        holes = unfilled_placeholders_in(probe)
        if holes:
            records.append(_record(spark, probe, component, "; ".join(f"template placeholder {h} not filled" for h in holes)))
            continue
        try:
            frame = spark.sql(probe.query) if isinstance(probe.query, str) else probe.query(spark)
            outcome = run_method(probe.method, frame, probe.params)
            verdict = outcome.verdict if isinstance(outcome, Detection) else outcome
            kept = [c for c in verdict.columns if c not in ("method", "status")]
            records.append(cut_lineage(verdict.select(
                F.lit(component).alias("component"), F.lit(probe.id).alias("probe"), F.lit(probe.method).alias("method"),
                F.lit(probe.question).alias("question"), F.lit(probe.severity).alias("severity"), F.col("status").alias("outcome"),
                map_status("status").alias("status"), F.lit(None).cast("string").alias("error"), *kept)))
        except Exception as problem:  # an execution error is not a failed check
            records.append(_record(spark, probe, component, str(problem).splitlines()[0][:1000]))
    if not records:
        raise ValueError("the plan holds no probe")
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumn("interpretation_required", interpretation_required("status"))


def journal(verdicts: DataFrame) -> DataFrame:
    """One summary row per verdict: identity, status, and its key figures as JSON."""
    identity = ["component", "probe", "method", "question", "severity", "status"]
    figures = [c for c in verdicts.columns if c not in identity]
    return verdicts.select(*identity, F.to_json(F.struct(*figures)).alias("summary"))


# methods that run although the published list has no entry for them
EXTRA_ENTRIES = (
    ("stat.robust_zscores", "Value far from the series median", "stat", "time", "medium", None, "Values sit within the robust band of their series."),
    ("lint.unresolved_measure", "Visual bound to a missing measure", "lint", "presentation", "medium", None, "Every bound measure exists in the model."),
)


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The detector catalog: 20 entries plus the two methods that run without one."""
    schema = "id string, title string, kind string, domain string, severity string, implemented_as string, claim string"
    return spark.createDataFrame([*fixed.CATALOG, *EXTRA_ENTRIES], schema)


def catalog_lookup(df: DataFrame, method: str) -> DataFrame:
    """Add ``catalog_title`` and ``catalog_claim`` of a method id; the first entry that is or implements it wins.

    The catalog is a fixed list of 22 entries, so it is a literal map inside the expression.
    """
    titles, claims = {}, {}
    for entry_id, title, _, _, _, implemented_as, claim in (*fixed.CATALOG, *EXTRA_ENTRIES):
        for name in filter(None, (entry_id, implemented_as)):
            titles.setdefault(name, title)
            claims.setdefault(name, claim)
    key = F.col(method)
    last_part = F.regexp_replace(F.regexp_replace(key, r"^.*\.", ""), "_", " ")
    return df.withColumns({
        "catalog_title": F.coalesce(lookup(key, titles), last_part),
        "catalog_claim": F.coalesce(lookup(key, claims), F.concat(F.lit("Detector "), key, F.lit(" expectation holds.")))})


def detector_select(components: DataFrame) -> DataFrame:
    """Minimum detectors for each component from its shapes. ``components``: component, shapes ARRAY<STRING>."""
    spark = components.sparkSession
    table = spark.createDataFrame([(shape, list(methods)) for shape, methods in fixed.DETECTORS_BY_SHAPE], "shape string, methods array<string>")
    pairs = components.select("component", F.explode(F.array_distinct("shapes")).alias("shape")).join(F.broadcast(table), "shape")
    return pairs.select("component", F.explode("methods").alias("method")).distinct()
