"""Snapshot comparison and regression classification on orders."""

from pyspark.sql import functions as F

from checks.base import money, query, rounded, table
from plumbline.operators import compare as c
from plumbline.operators import regress as r


def _snapshots(spark, sf):
    """Orders, and a later snapshot: some rows gone, some new, some amounts restated."""
    before = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), money("o_totalprice").alias("amount"),
                                               F.when(F.col("o_orderkey") % 13 != 0, money("o_totalprice") / 100).cast("decimal(18,4)").alias("fee"))
    k = F.col("o_orderkey")
    changed = F.when(k % 97 == 1, F.col("amount") + F.lit(10).cast("decimal(18,4)")).when(k % 97 == 2, F.col("amount") + F.lit("0.005").cast("decimal(18,4)")).otherwise(F.col("amount"))
    kept = before.where(k % 97 != 0).withColumns({"amount": changed.cast("decimal(18,4)"), "fee": F.when(k % 97 != 3, F.col("fee"))})
    late = before.where(k % 97 == 0).withColumn("o_orderkey", k + 100_000_000)
    return before, kept.unionByName(late)


SNAP = """b AS (SELECT o_orderkey AS k, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,4)) AS amount,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,4)) / 100, 4) AS DECIMAL(18,4)) END AS fee FROM orders),
a AS (SELECT k, st, day, CASE WHEN k % 97 = 1 THEN amount + 10 WHEN k % 97 = 2 THEN amount + 0.005 ELSE amount END AS amount, CASE WHEN k % 97 <> 3 THEN fee END AS fee FROM b WHERE k % 97 <> 0
    UNION ALL SELECT k + 100000000, st, day, amount, fee FROM b WHERE k % 97 = 0)"""


@query("keyed_compare_verdict", f"""WITH {SNAP},
j AS (SELECT b.k AS bk, a.k AS ak, b.amount AS ba, a.amount AS aa, b.fee AS bf, a.fee AS af FROM b FULL JOIN a ON a.k = b.k),
c AS (SELECT COUNT(*) FILTER (WHERE ABS(aa - ba) > 0.005) + COUNT(*) FILTER (WHERE bk IS NOT NULL AND ak IS NOT NULL AND ((bf IS NULL) <> (af IS NULL) OR ABS(af - bf) > 0.005)) AS changes,
  COUNT(*) FILTER (WHERE bk IS NULL) AS added, COUNT(*) FILTER (WHERE ak IS NULL) AS removed FROM j)
SELECT CASE WHEN changes + added + removed > 0 THEN 'different' ELSE 'equal' END AS status, changes, added, removed, CAST(0 AS BIGINT) AS duplicate_keys FROM c""")
def keyed_compare_verdict(spark, sf):
    before, after = _snapshots(spark, sf)
    return c.keyed_compare(before, after, ["o_orderkey"], ["amount", "fee"]).verdict.drop("reason", "tolerance")


@query("keyed_compare_changes", f"""WITH {SNAP}
SELECT b.k AS o_orderkey, 'amount' AS field, ROUND(CAST(a.amount - b.amount AS DOUBLE), 4) AS delta FROM a JOIN b USING (k) WHERE ABS(a.amount - b.amount) > 0.005
UNION ALL SELECT k, 'fee', ROUND(CAST(a.fee - b.fee AS DOUBLE), 4) FROM a JOIN b USING (k) WHERE (a.fee IS NULL) <> (b.fee IS NULL) OR ABS(a.fee - b.fee) > 0.005""")
def keyed_compare_changes(spark, sf):
    before, after = _snapshots(spark, sf)
    return rounded(c.keyed_compare(before, after, ["o_orderkey"], ["amount", "fee"]).changes.select("o_orderkey", "field", "delta"))


@query("keyed_compare_keys", f"""WITH {SNAP}
SELECT k AS o_orderkey, 'added' AS change FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'removed' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def keyed_compare_keys(spark, sf):
    before, after = _snapshots(spark, sf)
    return c.keyed_compare(before, after, ["o_orderkey"], ["amount", "fee"]).keys


@query("keyed_compare_duplicates", """
SELECT 'inconclusive' AS status, 'Duplicate comparison keys' AS reason, COUNT(*) AS duplicate_keys FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)""")
def keyed_compare_duplicates(spark, sf):
    """A key that is not unique makes the comparison inconclusive instead of multiplying rows."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money("l_quantity").alias("q"))
    return c.keyed_compare(items, items, ["l_orderkey", "l_linenumber"], ["q"]).verdict.select("status", "reason", "duplicate_keys")


@query("restatement_split", f"""WITH {SNAP},
j AS (SELECT COALESCE(a.st, b.st) AS period, CASE WHEN b.k IS NULL THEN 'late_arrival' WHEN a.k IS NULL THEN 'deletion' WHEN a.amount <> b.amount THEN 'update' ELSE 'unchanged' END AS kind,
  COALESCE(b.amount, 0) AS x, COALESCE(a.amount, 0) AS y FROM b FULL JOIN a ON a.k = b.k)
SELECT period, kind, COUNT(*) AS keys, ROUND(CAST(SUM(x) AS DOUBLE), 4) AS before_amount, ROUND(CAST(SUM(y) AS DOUBLE), 4) AS after_amount, ROUND(CAST(SUM(y) - SUM(x) AS DOUBLE), 4) AS delta FROM j GROUP BY 1, 2""")
def restatement_split(spark, sf):
    before, after = _snapshots(spark, sf)
    return rounded(c.restatement_split(before, after, ["o_orderkey"], "amount", "o_orderstatus"), 4)


@query("mature_overlap", f"""WITH {SNAP},
m AS (SELECT * FROM b WHERE day <= DATE '2000-12-31'), n AS (SELECT * FROM a WHERE day <= DATE '2000-12-31')
SELECT COUNT(*) FILTER (WHERE ABS(n.amount - m.amount) > 0.005) AS changes, COUNT(*) FILTER (WHERE m.k IS NULL) AS added, COUNT(*) FILTER (WHERE n.k IS NULL) AS removed FROM m FULL JOIN n ON m.k = n.k""")
def mature_overlap(spark, sf):
    before, after = _snapshots(spark, sf)
    return c.mature_overlap(before, after, ["o_orderkey"], ["amount"], "day", "2000-12-31").verdict.select("changes", "added", "removed")


@query("contribution", f"""WITH {SNAP},
d AS (SELECT st, SUM(v) AS v FROM (SELECT st, -amount AS v FROM b UNION ALL SELECT st, amount FROM a) GROUP BY 1)
SELECT CASE WHEN st IN ('F', 'O') THEN st ELSE 'unexplained' END AS reason, ROUND(CAST(SUM(v) AS DOUBLE), 4) AS delta FROM d GROUP BY 1""")
def contribution(spark, sf):
    before, after = _snapshots(spark, sf)
    return rounded(c.contribution(before, after, ["o_orderstatus"], "amount", explained=["F", "O"]))


def _claims(spark, sf):
    """One claim per customer: the account is not overdrawn, before and after the customer's orders."""
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    customers = table(spark, sf, "customer").join(spent, "c_custkey", "left")
    before = F.when(F.col("c_acctbal") >= 0, "passed").otherwise("failed")
    now = F.when(F.col("orders").isNull(), "inconclusive").when(F.col("c_acctbal") - F.col("orders") * 100 >= -500, "passed").otherwise("failed")
    return customers.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("component"), before.alias("before"), now.alias("status"))


CLAIMS = """o AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1),
cl AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS component, CASE WHEN c_acctbal >= 0 THEN 'passed' ELSE 'failed' END AS before,
   CASE WHEN n IS NULL THEN 'inconclusive' WHEN c_acctbal - n * 100 >= -500 THEN 'passed' ELSE 'failed' END AS status FROM customer LEFT JOIN o ON o_custkey = c_custkey),
cc AS (SELECT *, CASE WHEN before = 'passed' AND status = 'passed' THEN 'preserved' WHEN before = 'passed' AND status = 'failed' THEN 'new regression'
   WHEN before = 'failed' AND status = 'passed' THEN 'defect fixed' WHEN before = 'failed' AND status = 'failed' THEN 'still open' ELSE 'inconclusive' END AS cls FROM cl)"""


def _classified(spark, sf):
    claims = _claims(spark, sf)
    return claims.withColumn("change_classification", r.suggested_class(F.col("before"), F.col("status")))


@query("suggested_classes", f"WITH {CLAIMS} SELECT id, before AS baseline_status, status AS now_status, cls AS change_classification FROM cc")
def suggested_classes(spark, sf):
    claims = _claims(spark, sf)
    return r.suggest_classes(claims.select("id", F.col("before").alias("status")), claims.select("id", "status"))


@query("classify_changes", f"WITH {CLAIMS} SELECT id, status, cls AS change_classification, CASE WHEN cls = 'new regression' THEN component END AS change_note FROM cc")
def classify_changes(spark, sf):
    classified = _classified(spark, sf)
    verdicts = classified.select("id", F.initcap("change_classification").alias("change_classification"), F.when(F.col("change_classification") == "new regression", F.col("component")).alias("note"))
    return r.classify_changes(classified.select("id", "status"), verdicts)


@query("classification_counts", f"""WITH {CLAIMS} SELECT component, cls AS change_classification, COUNT(*) AS claims,
  CAST(CASE cls WHEN 'preserved' THEN 0 WHEN 'new regression' THEN 2 WHEN 'defect fixed' THEN 3 WHEN 'still open' THEN 4 ELSE 5 END AS BIGINT) AS position FROM cc GROUP BY 1, 2""")
def classification_counts(spark, sf):
    return rounded(r.classification_counts(_classified(spark, sf), ["component"]))


@query("worst_classification", f"""WITH {CLAIMS}, rk AS (SELECT substr(id, 1, 2) || component AS component, cls, CASE cls WHEN 'new regression' THEN 0 WHEN 'still open' THEN 1 WHEN 'inconclusive' THEN 3 WHEN 'defect fixed' THEN 4 ELSE 5 END AS rk FROM cc)
SELECT component, ARG_MIN(cls, rk) AS worst FROM rk GROUP BY 1""")
def worst_classification(spark, sf):
    fine = _classified(spark, sf).withColumn("component", F.concat(F.substring("id", 1, 2), "component"))
    return r.worst_classification(fine, ["component"])


@query("regression_counts", f"""WITH {CLAIMS}, g AS (SELECT component, COUNT(*) AS classified, COUNT(*) FILTER (WHERE cls = 'new regression') AS new_regressions,
  COUNT(*) FILTER (WHERE cls NOT IN ('preserved', 'defect fixed')) AS undecided FROM cc GROUP BY 1)
SELECT *, CASE WHEN new_regressions = 0 AND undecided = 0 THEN 'Nothing broke since the last approved version.'
  WHEN new_regressions = 0 THEN 'Nothing broke since the last approved version. Some changes still need your decision.'
  WHEN new_regressions = 1 THEN 'One thing broke since the last approved version.' ELSE new_regressions || ' things broke since the last approved version.' END AS headline FROM g""")
def regression_counts(spark, sf):
    return r.regression_counts(_classified(spark, sf), ["component"])
