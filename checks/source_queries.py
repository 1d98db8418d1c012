"""Sources: evidence queries, metadata and fingerprints over the supplied tables."""

import uuid

from pyspark.sql import functions as F

from checks.base import query, rounded, table
from plumbline.functions.scalars import sha256_hex
from plumbline.session import shared_folder
from plumbline.sources import evidence as e


@query("sql_evidence", "SELECT r_name, COUNT(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sql_evidence(spark, sf):
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"evidence_{name}")
    return e.sql_evidence(spark, "SELECT r_name, count(*) AS nations FROM evidence_nation JOIN evidence_region ON n_regionkey = r_regionkey GROUP BY r_name")[0]


@query("table_metadata", """
SELECT UNNEST([0, 1, 2, 3, 4, 5])::BIGINT AS position, UNNEST(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  UNNEST(['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string']) AS type, (SELECT COUNT(*) FROM orders) AS rows""")
def table_metadata(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("metadata_orders")
    return rounded(e.table_metadata(spark, "metadata_orders").select("position", "column", "type", "rows"))


@query("bounded_report", """
SELECT COUNT(*) AS "rows", (SELECT COUNT(*) FROM orders) <= 5000 AS complete FROM (SELECT 1 FROM orders LIMIT 5000)""")
def bounded_report(spark, sf):
    """A report keeps 5,000 rows and says whether that is everything."""
    part, complete = e.bounded(table(spark, sf, "orders"))
    return part.agg(F.count(F.lit(1)).alias("rows")).withColumn("complete", F.lit(complete))


@query("fingerprint_files")
def fingerprint_files(spark, sf):
    """sha256 of every file of the data folder (files are outside SQL's view)."""
    files = e.fingerprint(spark, sf)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("verify_fingerprint", """
SELECT CASE WHEN doc_id % 50 = 0 THEN 'doc-' || doc_id ELSE 'doc-' || doc_id END AS path, CASE WHEN doc_id % 50 = 0 THEN 'missing' WHEN doc_id % 50 = 1 THEN 'changed' ELSE 'added' END AS change FROM documents WHERE doc_id % 50 <= 2""")
def verify_fingerprint(spark, sf):
    """Documents as files: some gone, some changed, some new since sealing."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 50
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path")
    sealed = d.where(k != 2).select(path, sha256_hex("text").alias("sha256"))
    now = d.where(k != 0).select(path, sha256_hex(F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return e.verify_fingerprint(now, sealed).select("path", "change")


@query("text_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sha256_hex("text").alias("digest"))


@query("evidence_round_trip", """
SELECT o_orderstatus, COUNT(*) AS orders, ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS amount FROM orders GROUP BY 1""")
def evidence_round_trip(spark, sf):
    """A result set written once to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/evidence-{uuid.uuid4()}/orders"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,4)").alias("amount"))
    e.write_evidence(orders, folder)
    kept = e.read_table(spark, "parquet", path=folder)
    return rounded(kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").cast("double").alias("amount")), 2)


@query("scan_event_files", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS type, COUNT(*) AS events, (SELECT COUNT(*) FROM conversations WHERE turn % 7 = 6) AS malformed FROM conversations WHERE turn % 7 <> 6 GROUP BY 1, 2""")
def scan_event_files(spark, sf):
    """Conversations written as JSON-lines files, some lines cut short, and scanned again."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4()}"
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    table(spark, sf, "conversations").select(F.when(F.col("turn") % 7 == 6, F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(folder)
    events, counts = e.scan_events_jsonl(spark, folder, since_days=1)
    malformed = counts.agg(F.sum("malformed_lines")).scalar()
    return events.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("events")).withColumn("malformed", malformed)


@query("evidence_result_sets", """
SELECT n_regionkey, COUNT(*) AS nations, TRUE AS complete FROM nation GROUP BY 1""")
def evidence_result_sets(spark, sf):
    """Result sets saved as JSON documents, one per region, and read back with their completeness."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4()}"
    cells = F.struct("n_nationkey", "n_regionkey")
    table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(cells).alias("rows")).select(
        F.lit(True).alias("complete"), "rows", F.col("n_regionkey").alias("part")).write.partitionBy("part").json(folder)
    found, complete = e.read_evidence(spark, f"{folder}/*/*.json", "n_nationkey int, n_regionkey int")
    return found.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations")).select(F.col("n_regionkey").cast("bigint").alias("n_regionkey"), "nations", F.lit(complete).alias("complete"))


@query("scan_article_files", """
SELECT 'Nation ' || n_name AS title, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS date, 'About ' || n_name || '.' AS body FROM nation""")
def scan_article_files(spark, sf):
    """Articles written as one Markdown file each and scanned with their front matter."""
    folder = f"{shared_folder(spark)}/articles-{uuid.uuid4()}"
    day = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    text = F.concat(F.lit("---\ntitle: Nation "), F.col("n_name"), F.lit("\ndate: 2024-01-"), day, F.lit("\n---\nAbout "), F.col("n_name"), F.lit("."))
    table(spark, sf, "nation").select(text.alias("value"), "n_nationkey").repartition(25, "n_nationkey").sortWithinPartitions("n_nationkey").select(
        "value", "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return e.scan_articles(spark, f"{folder}/*/*.txt").select("title", "date", F.trim(F.regexp_replace("body", "\\s+$", "")).alias("body"))
