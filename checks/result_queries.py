"""Result tables. One claim per customer, judged from the customer's own orders and balance."""

from pyspark.sql import functions as F

from checks.base import DAILY, daily_revenue, query, rounded, table
from plumbline.operators import results as r
from plumbline.operators import series_stats
from plumbline.plans import registry

DETECTORS = ("dax.assert", "lint.raw_division", "stat.changepoints", "dax.custom_rule")


def _pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _base(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    c = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, n = F.col("c_custkey"), F.coalesce("orders", F.lit(0).cast("bigint"))
    status = F.when(n == 0, "inconclusive").when(F.col("c_acctbal") < 1000, "failed").when(k % 6 == 5, "inconclusive").otherwise("passed")
    detector = _pick(k % 4, DETECTORS)
    severity = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "high").when(F.col("c_mktsegment") == "BUILDING", "Low").when(F.col("c_mktsegment") == "FURNITURE", "medium").when(
        F.col("c_mktsegment") == "MACHINERY", "critical")
    return c.select(
        F.concat(F.lit("C"), k.cast("string")).alias("id"), k.alias("k"), n.alias("n"), status.alias("status"), detector.alias("detector"), severity.alias("severity"),
        F.concat(detector, F.lit(": Observed "), n.cast("string"), F.lit(" == expected 0: does not hold")).alias("observed"), F.col("c_nationkey").alias("component"),
        F.concat(F.lit("Balance of customer "), k.cast("string"), F.lit(" stays positive; checked monthly")).alias("expected"))


BASE = """o AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1),
cl AS (SELECT 'C' || c_custkey AS id, c_custkey AS k, COALESCE(n, 0) AS n, c_nationkey AS component,
  CASE WHEN n IS NULL THEN 'inconclusive' WHEN c_acctbal < 1000 THEN 'failed' WHEN c_custkey % 6 = 5 THEN 'inconclusive' ELSE 'passed' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'dax.assert' WHEN 1 THEN 'lint.raw_division' WHEN 2 THEN 'stat.changepoints' ELSE 'dax.custom_rule' END AS detector,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'high' WHEN 'BUILDING' THEN 'Low' WHEN 'FURNITURE' THEN 'medium' WHEN 'MACHINERY' THEN 'critical' END AS severity
  FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""
CATALOG_CLAIM = """CASE detector WHEN 'dax.assert' THEN 'The stated invariant holds in the imported population.' WHEN 'lint.raw_division' THEN 'Ratios return BLANK, not infinity or an error, on empty denominators.'
  WHEN 'stat.changepoints' THEN 'Level shifts in the series correspond to known business or tracking events.' ELSE 'Detector dax.custom_rule expectation holds.' END"""


@query("map_status", f"""WITH {BASE} SELECT id, CASE WHEN status IN ('passed', 'failed') THEN status WHEN status = 'inconclusive' THEN 'inconclusive' END AS status, status = 'inconclusive' AS interpretation_required FROM cl""")
def map_status(spark, sf):
    mapped = registry.map_status("status")
    return _base(spark, sf).select("id", mapped.alias("status"), registry.interpretation_required(mapped).alias("interpretation_required"))


@query("catalog_lookup", f"""WITH {BASE} SELECT id, CASE detector WHEN 'dax.assert' THEN 'Custom data rule' WHEN 'lint.raw_division' THEN 'Division without a zero guard' WHEN 'stat.changepoints' THEN 'Level shift in the series'
  ELSE 'custom rule' END AS catalog_title, {CATALOG_CLAIM} AS catalog_claim FROM cl""")
def catalog_lookup(spark, sf):
    return registry.catalog_lookup(_base(spark, sf), "detector").select("id", "catalog_title", "catalog_claim")


@query("to_claims", f"""WITH {BASE} SELECT 'PRB-' || id AS id, detector, {CATALOG_CLAIM} AS expected, detector || ': ' || status AS observed, status, 'engine' AS layer, COALESCE(severity, 'review') AS severity, status AS probe_status FROM cl""")
def to_claims(spark, sf):
    return r.to_claims(_base(spark, sf).select("id", F.col("detector").alias("method"), "status", "severity"), "id")


@query("lint_to_claims", """
WITH f AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'lint.raw_division' ELSE 'lint.stale_query_name' END AS method, CAST(l_orderkey AS VARCHAR) AS object, CAST(l_linenumber AS VARCHAR) AS fragment FROM lineitem GROUP BY ALL),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method ORDER BY object, fragment) AS rn FROM f)
SELECT CASE method WHEN 'lint.raw_division' THEN 'LINT-raw-division' ELSE 'LINT-stale-query-name' END AS id, COUNT(*) AS hits,
  STRING_AGG(object, '; ' ORDER BY rn) FILTER (WHERE rn <= 12) || CASE WHEN COUNT(*) > 12 THEN ' and ' || (COUNT(*) - 12) || ' more' ELSE '' END AS objects FROM t GROUP BY method""")
def lint_to_claims(spark, sf):
    method = F.when(F.col("l_linenumber") % 2 == 0, "lint.raw_division").otherwise("lint.stale_query_name")
    found = table(spark, sf, "lineitem").select(method.alias("method"), F.lit("low").alias("severity"), F.col("l_orderkey").cast("string").alias("object"), F.col("l_linenumber").cast("string").alias("fragment")).distinct()
    return r.lint_to_claims(found).select("id", "hits", "objects")


@query("failed_to_findings", f"""WITH {BASE} SELECT 'FD-' || id AS id, 'Balance of customer ' || k || ' stays positive; checked monthly' AS title, COALESCE(severity, 'medium') AS severity, id AS claim_ids,
  'Probe ' || detector || ' failed: ' || detector || ': Observed ' || n || ' == expected 0: does not hold' AS explanation,
  'The checked rule does not hold for these rows, and every figure built on them is off by as much.' AS impact, 'probes/' || id || '.json' AS evidence FROM cl WHERE status = 'failed'""")
def failed_to_findings(spark, sf):
    return rounded(r.failed_to_findings(_base(spark, sf)))


@query("outcome_text", f"""WITH {DAILY}, c AS (SELECT o_orderpriority, MEDIAN(revenue) AS m, COUNT(*) AS n FROM daily GROUP BY 1),
s AS (SELECT o_orderpriority, MEDIAN(ABS(revenue - m)) * 1.4826 AS sigma FROM daily JOIN c USING (o_orderpriority) GROUP BY 1),
f AS (SELECT o_orderpriority, day, (revenue - m) / sigma AS z FROM daily JOIN c USING (o_orderpriority) JOIN s USING (o_orderpriority) WHERE ABS((revenue - m) / sigma) > 3.5),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY day) AS rn FROM f),
g AS (SELECT o_orderpriority, COUNT(*) AS flags, STRING_AGG(CAST(day AS VARCHAR) || ' (' || FORMAT('{{:.2f}}', z) || ')', '; ' ORDER BY rn) FILTER (WHERE rn <= 8) AS items FROM r GROUP BY 1)
SELECT o_orderpriority, CASE WHEN flags > 0 THEN 'flagged' ELSE 'clean' END AS status,
  CASE WHEN flags > 0 THEN flags || ' flagged of ' || n || ' point(s): ' || items || '.' ELSE 'All ' || n || ' point(s) sit within the expected range.' END AS observed FROM c LEFT JOIN g USING (o_orderpriority)""")
def outcome_text(spark, sf):
    found = series_stats.robust_zscores(series_stats.series(daily_revenue(spark, sf), ["o_orderpriority"], "day", "revenue"), ["o_orderpriority"])
    return r.outcome_text(found.verdict, found.flags, ["o_orderpriority"]).select("o_orderpriority", "status", "observed")


@query("facts_check", f"""WITH {BASE} SELECT id, CASE WHEN k % 5 = 0 THEN 'differs' WHEN k % 5 = 1 THEN 'missing value' WHEN k % 5 = 2 THEN 'missing evidence' ELSE 'matches' END AS status FROM cl""")
def facts_check(spark, sf):
    """A fact written as 3.0 for an observed 3 differs; fields and documents can be missing; pointers reach into arrays."""
    b = _base(spark, sf)
    kind = F.col("k") % 5
    evidence = b.where("k % 5 != 2").select(F.col("id").alias("evidence"), F.to_json(F.struct("n", "status", F.array(F.struct(F.col("n").alias("n.o"))).alias("cells"))).alias("document"))
    value = F.when(kind == 0, F.concat(F.col("n").cast("string"), F.lit(".0"))).otherwise(F.col("n").cast("string"))
    facts = b.select("id", F.col("id").alias("evidence"), F.when(kind == 1, "absent").when(kind == 3, "cells/0/n.o").otherwise("/n").alias("field"), value.alias("value"))
    return r.facts_check(facts, evidence).select("id", "status")


def _findings(spark, sf):
    b = _base(spark, sf).where("k % 3 = 0")
    return b.select(F.concat(F.lit("F"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("Finding about "), F.col("id")).alias("title"),
                    F.when(F.col("k") % 2 == 0, "high").otherwise("blocker").alias("severity"), F.array("id").alias("claim_ids"), F.concat(F.lit("Observed "), F.col("n").cast("string"), F.lit(" > expected 1")).alias("explanation"))


def _components(spark, sf):
    return _base(spark, sf).select("component", F.concat(F.lit("Nation "), F.col("component").cast("string")).alias("name"), F.col("id").alias("claim_id"))


RANKED = f"""{BASE},
fi AS (SELECT 'F' || k AS id, id AS claim_id, 'Finding about ' || id AS title, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'blocker' END AS severity, n, status FROM cl WHERE k % 3 = 0),
rec AS (SELECT 'claim' AS kind, CASE WHEN c.status = 'failed' THEN 'defect' WHEN c.status = 'passed' THEN 'passed' WHEN detector LIKE 'lint.%' THEN 'lint' ELSE 'open' END AS grp, c.id,
    COALESCE(f.title, 'Balance of customer ' || k || ' stays positive') AS heading, CASE WHEN c.status = 'failed' THEN COALESCE(f.severity, c.severity) ELSE c.severity END AS severity, CAST(c.n AS DOUBLE) AS magnitude, 'Nation ' || component AS component_name
  FROM cl c LEFT JOIN fi f ON f.claim_id = c.id
  UNION ALL SELECT 'finding', 'defect', id, title, severity, CAST(n AS DOUBLE), NULL FROM fi WHERE status <> 'failed')"""


@query("rank_findings", f"""WITH {RANKED}
SELECT kind, grp AS "group", id, heading, severity, magnitude, component_name,
  CAST(CASE LOWER(severity) WHEN 'critical' THEN 0 WHEN 'blocker' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 5 END AS BIGINT) AS severity_rank FROM rec""")
def rank_findings(spark, sf):
    out = r.rank_findings(_base(spark, sf).withColumn("hits", F.lit(None).cast("bigint")), _findings(spark, sf), _components(spark, sf))
    return rounded(out.select("kind", "group", "id", "heading", "severity", "magnitude", "component_name", "severity_rank"))


@query("component_status", f"""WITH {BASE}, g AS (SELECT k // 2 AS component, COUNT(*) AS claims, BOOL_OR(status = 'failed') AS bad, BOOL_AND(status = 'passed') AS good FROM cl GROUP BY 1)
SELECT component, claims, CASE WHEN bad THEN 'problem' WHEN good THEN 'ok' ELSE 'decision' END AS key, CASE WHEN bad THEN 'Problem found' WHEN good THEN 'Looks right' ELSE 'Needs your decision' END AS label FROM g""")
def component_status(spark, sf):
    return r.component_status(_base(spark, sf).withColumn("component", F.floor(F.col("k") / 2)))


@query("status_summary", f"WITH {BASE} SELECT component::BIGINT AS component, status, COUNT(*) AS claims FROM cl GROUP BY 1, 2")
def status_summary(spark, sf):
    return rounded(r.status_summary(_base(spark, sf), ["component"]))


@query("constraint_violations", f"""WITH {BASE}
SELECT 'claim' AS kind, id, 'measured claim needs evidence' AS problem FROM cl WHERE status IN ('passed', 'failed') AND k % 10 = 0
UNION ALL SELECT 'claim', id, 'passed claim has unobserved required layers screen' FROM cl WHERE status = 'passed' AND k % 7 = 0
UNION ALL SELECT 'claim', id, 'missing source' FROM cl WHERE k % 11 = 0
UNION ALL SELECT 'finding', 'F' || k, 'references unknown claim X' || k FROM cl WHERE k % 3 = 0 AND k % 9 = 0
UNION ALL SELECT 'finding', 'F' || k, 'missing impact' FROM cl WHERE k % 3 = 0 AND k % 4 = 0
UNION ALL SELECT DISTINCT 'component', CAST(component AS VARCHAR), 'has no captured scenarios' FROM cl WHERE component % 5 = 0""")
def constraint_violations(spark, sf):
    b = _base(spark, sf)
    k = F.col("k")
    required = F.when(k % 7 == 0, F.array(F.lit("engine"), F.lit("screen"))).otherwise(F.array(F.lit("engine")))
    claims = b.select("id", "expected", F.when(k % 11 != 0, "orders").alias("source"), "status", F.lit("engine").alias("layer"), required.alias("required"), F.array(F.lit("engine")).alias("seen"),
                      F.when(k % 10 != 0, F.array("id")).alias("evidence"))
    findings = _findings(spark, sf).join(b.select(F.concat(F.lit("F"), k.cast("string")).alias("id"), "k"), "id")
    findings = findings.withColumns({"claim_ids": F.when(k % 9 == 0, F.array(F.concat(F.lit("X"), k.cast("string")))).otherwise(F.col("claim_ids")), "impact": F.when(k % 4 != 0, "wrong total")})
    components = b.groupBy("component").agg(F.array(F.min("id")).alias("claim_ids")).select(
        "component", F.concat(F.lit("Nation "), F.col("component").cast("string")).alias("name"), "claim_ids", F.when(F.col("component") % 5 == 0, 0).otherwise(2).cast("bigint").alias("scenarios"))
    return r.constraint_violations(claims, findings, components, ["engine", "screen"])


@query("orphan_evidence", f"""WITH {BASE}
SELECT 'run' || k AS run, CAST(0 AS BIGINT) AS owners, 'attached but no component records it' AS problem FROM cl WHERE k % 5 = 0 AND k % 2 = 0
UNION ALL SELECT 'run' || k, CAST(2 AS BIGINT), 'recorded by several components' FROM cl WHERE k % 5 = 1
UNION ALL SELECT 'run' || k, CAST(0 AS BIGINT), 'attached but no claim cites it' FROM cl WHERE k % 13 = 0""")
def orphan_evidence(spark, sf):
    b = _base(spark, sf)
    k = F.col("k")
    run = F.concat(F.lit("run"), k.cast("string"))
    runs = b.select(run.alias("run"), F.when(k % 2 == 0, "completed").otherwise("stopped").alias("status"))
    owners = b.where("k % 5 != 0").select(F.explode(F.when(k % 5 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("component"), run.alias("run"))
    claims = b.where("k % 13 != 0").select("id", F.array(F.concat(F.lit("evidence/detectors/"), run, F.lit("/lint.json"))).alias("evidence"))
    return r.orphan_evidence(runs, owners, b.select(run.alias("run")), claims)


@query("validate_decisions", f"""WITH {BASE}
SELECT k AS position, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END AS claim_id, 'unknown claim' AS problem FROM cl WHERE k % 17 = 0
UNION ALL SELECT k, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'accepted without a pass' FROM cl WHERE k % 3 = 0 AND (status <> 'passed' OR k % 17 = 0)
UNION ALL SELECT k, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'exception needs reason, scope and expiry' FROM cl WHERE k % 3 = 1 AND k % 2 = 0
UNION ALL SELECT k, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'unknown decision' FROM cl WHERE k % 3 = 2
UNION ALL SELECT k, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'reviewer is empty' FROM cl WHERE k % 19 = 0
UNION ALL SELECT k, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'fingerprint differs' FROM cl WHERE k % 23 = 0
UNION ALL SELECT k + 1000000000, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, CASE WHEN k % 17 = 0 THEN 'unknown claim' ELSE 'decided more than once' END FROM cl WHERE k % 29 = 0
UNION ALL SELECT k + 1000000000, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, CASE k % 3 WHEN 0 THEN 'accepted without a pass' WHEN 1 THEN 'exception needs reason, scope and expiry' ELSE 'unknown decision' END FROM cl
  WHERE k % 29 = 0 AND ((k % 3 = 0 AND (status <> 'passed' OR k % 17 = 0)) OR (k % 3 = 1 AND k % 2 = 0) OR k % 3 = 2)
UNION ALL SELECT k + 1000000000, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'reviewer is empty' FROM cl WHERE k % 29 = 0 AND k % 19 = 0
UNION ALL SELECT k + 1000000000, CASE WHEN k % 17 = 0 THEN 'X' || k ELSE id END, 'fingerprint differs' FROM cl WHERE k % 29 = 0 AND k % 23 = 0""")
def validate_decisions(spark, sf):
    b = _base(spark, sf)
    k = F.col("k")
    decisions = b.select(
        k.alias("position"), F.when(k % 17 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.col("id")).alias("claim_id"), _pick(k % 3, ("accepted", "exception", "maybe")).alias("decision"),
        F.when(k % 19 == 0, " ").otherwise("Kim").alias("reviewer"), F.lit("confirmed in the review meeting").alias("confirmation"), F.when(k % 23 == 0, "old").otherwise("abc").alias("fingerprint"),
        F.when(k % 2 == 1, "known gap").alias("reason"), F.lit("one page").alias("scope"), F.lit("2030-01-01").alias("expires_at"))
    again = decisions.where("position % 29 = 0").withColumn("position", F.col("position") + 1_000_000_000)
    return r.validate_decisions(decisions.unionByName(again), b.select("id", "status"), "abc")


@query("questions", f"""WITH {BASE}
SELECT k // 4 AS component, 0::BIGINT AS rank, id, 'issue' AS severity FROM cl WHERE k % 8 = 0
UNION ALL SELECT k // 4, 1, 'check-' || k, 'issue' FROM cl WHERE k % 10 = 0
UNION ALL SELECT k // 4, 2, id, CASE WHEN status = 'failed' THEN 'issue' ELSE 'open' END FROM cl WHERE k % 8 <> 0 AND status IN ('failed', 'inconclusive')
UNION ALL SELECT c, 3, 'none', 'ok' FROM (SELECT k // 4 AS c, COUNT(*) FILTER (WHERE k % 8 = 0 OR k % 10 = 0 OR status <> 'passed') AS n FROM cl GROUP BY 1) WHERE n = 0""")
def questions(spark, sf):
    b = _base(spark, sf).withColumn("component", F.floor(F.col("k") / 4))
    claims = b.withColumns({"change_classification": F.when(F.col("k") % 8 == 0, "new regression"), "question": F.lit(None).cast("string")})
    checks = b.select("component", F.concat(F.lit("check-"), F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 10 == 0, "fail").otherwise("pass").alias("status"), F.lit("A figure moved the wrong way.").alias("text"))
    return rounded(r.questions(claims, checks).select("component", "rank", "id", "severity"))


@query("case_rollup", f"""WITH {BASE}
SELECT component::BIGINT AS case_id, 'status' AS facet, status AS member, COUNT(*) AS count FROM cl GROUP BY 1, 3
UNION ALL SELECT component, 'layer', 'engine', COUNT(*) FROM cl GROUP BY 1
UNION ALL SELECT component, 'detector', detector, COUNT(*) FROM cl GROUP BY 1, 3
UNION ALL SELECT component, 'severity', CASE WHEN k % 2 = 0 THEN 'high' ELSE 'blocker' END, COUNT(*) FROM cl WHERE k % 3 = 0 GROUP BY 1, 3
UNION ALL SELECT component, 'scenarios', status, SUM(n)::BIGINT FROM cl GROUP BY 1, 3""")
def case_rollup(spark, sf):
    b = _base(spark, sf).withColumn("case_id", F.col("component").cast("bigint"))
    findings = b.where("k % 3 = 0").select("case_id", F.when(F.col("k") % 2 == 0, "high").otherwise("blocker").alias("severity"))
    components = b.select("case_id", F.col("status").alias("component"), F.col("n").alias("scenarios"))
    return r.case_rollup(b.withColumn("layer", F.lit("engine")), findings, components)


@query("facts_from_figures", f"""WITH {BASE}
SELECT component || '-base-' || CASE WHEN k % 2 = 0 THEN 'Orders_of_' || k ELSE 'table_Orders of/' || k END AS id, 'base: Orders of/' || k || CASE WHEN k % 2 = 0 THEN '' ELSE ' total' END AS label,
  CASE WHEN k % 2 = 0 THEN '/cards/Orders of~1' || k ELSE '/tables/Orders of/' || k END AS pointer, n AS value FROM cl""")
def facts_from_figures(spark, sf):
    b = _base(spark, sf)
    figures = b.select("component", F.lit("base").alias("label"), F.when(F.col("k") % 2 == 0, "card").otherwise("table").alias("kind"), F.concat(F.lit("Orders of/"), F.col("k").cast("string")).alias("key"), F.col("n").alias("value"))
    return r.facts_from_figures(figures)


@query("run_plan", """
SELECT 'none' AS probe, 'none' AS status FROM orders WHERE FALSE
UNION ALL SELECT 'negative-durations', CASE WHEN (SELECT COUNT(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) = 0 THEN 'passed' ELSE 'failed' END
UNION ALL SELECT 'order-fan-out', CASE WHEN (SELECT COUNT(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) = (SELECT COUNT(*) FROM orders) THEN 'passed' ELSE 'review' END
UNION ALL SELECT 'discount-ratio', 'inconclusive' UNION ALL SELECT 'broken-query', 'inconclusive' UNION ALL SELECT 'unfilled', 'inconclusive'""")
def run_plan(spark, sf):
    """A plan with passing, failing, broken and unfilled probes; each gives exactly one record."""
    for name in ("orders", "lineitem"):
        table(spark, sf, name).createOrReplaceTempView(f"plan_{name}")
    probes = [
        registry.Probe("negative-durations", "dax.assert", "SELECT count_if(l_shipdate < o_orderdate) AS n FROM plan_lineitem JOIN plan_orders ON l_orderkey = o_orderkey", {"column": "n", "value": 0}),
        registry.Probe("order-fan-out", "dax.fan_out", "SELECT o_orderkey FROM plan_orders", {"path": "SELECT l_orderkey FROM plan_lineitem", "base_key": ["o_orderkey"], "path_key": ["l_orderkey"]}),
        registry.Probe("discount-ratio", "stat.ratio_of_totals_vs_mean_of_ratios", "SELECT l_discount, l_quantity FROM plan_lineitem", {"numerator": "l_discount", "denominator": "l_quantity"}),
        registry.Probe("broken-query", "dax.assert", "SELECT missing_column FROM plan_orders", {"column": "n", "value": 0}),
        registry.Probe("unfilled", "dax.assert", "SELECT count(*) AS n FROM <fact>", {"column": "n", "value": 0}),
    ]
    return registry.run_plan(spark, probes, "orders").select("probe", "status")


@query("plan_journal", """
SELECT 'negative-durations' AS probe, CASE WHEN COUNT(*) = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(COUNT(*) AS DOUBLE) AS actual FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def plan_journal(spark, sf):
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    probe = registry.Probe("negative-durations", "dax.assert", lambda s: items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n")), {"column": "n", "value": 0})
    book = registry.journal(registry.run_plan(spark, [probe], "orders"))
    return book.select("probe", "status", F.get_json_object("summary", "$.actual").cast("double").alias("actual"))


@query("detector_select", """
WITH s AS (SELECT DISTINCT o_custkey AS component, CASE o_orderstatus WHEN 'F' THEN 'count_by_date' WHEN 'O' THEN 'members_with_total' ELSE 'timestamp_and_date_key' END AS shape FROM orders),
m AS (SELECT UNNEST(['count_by_date', 'count_by_date', 'count_by_date', 'count_by_date', 'members_with_total', 'members_with_total', 'timestamp_and_date_key']) AS shape,
  UNNEST(['stat.weekday_robust_band', 'stat.changepoints', 'dax.fan_out', 'dax.additivity', 'dax.additivity', 'stat.ratio_of_totals_vs_mean_of_ratios', 'dax.event_day_boundary']) AS method)
SELECT DISTINCT component, method FROM s JOIN m USING (shape)""")
def detector_select(spark, sf):
    shape = F.when(F.col("o_orderstatus") == "F", "count_by_date").when(F.col("o_orderstatus") == "O", "members_with_total").otherwise("timestamp_and_date_key")
    # one component holds at most the seven known shapes
    shapes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.collect_set(shape).alias("shapes"))
    return registry.detector_select(shapes)
