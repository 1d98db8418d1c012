"""File digests and published sets over files written from the supplied tables."""

import uuid

from pyspark.sql import functions as F

from checks.base import query, rounded, table
from plumbline.session import shared_folder
from plumbline.sources import published as p


def _customer_files(spark, sf):
    """One text file per 300 customer keys, in key order; the first keys share short files."""
    folder = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    key = F.col("c_custkey")
    part = F.when(key < 40, key % 4).otherwise(4 + F.floor(key / 300)).cast("int").alias("part")
    line = F.concat_ws("|", key.cast("string"), "c_name", "c_mktsegment")
    table(spark, sf, "customer").select(part, key.alias("key"), line.alias("value")).repartition(16, "part").sortWithinPartitions("part", "key").select(
        "part", "value").write.partitionBy("part").text(folder)
    return folder


@query("tree_fingerprint", """
WITH f AS (SELECT CASE WHEN c_custkey < 40 THEN c_custkey % 4 ELSE 4 + c_custkey // 300 END AS part,
    string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1),
r AS (SELECT part, body, i, sha256(substring(body, i * 1000 + 1, 1000)) AS digest FROM (SELECT part, body, UNNEST(range(0, (length(body) + 999) // 1000)) AS i FROM f))
SELECT CAST(part AS VARCHAR) AS part, length(ANY_VALUE(body)) AS length, sha256(sha256(string_agg(digest, '' ORDER BY i))) AS sha256 FROM r GROUP BY part""")
def tree_fingerprint(spark, sf):
    """Files below 4,000 bytes are read as rows, the others by ranges of 1,000 bytes."""
    files = p.tree_fingerprint(spark, _customer_files(spark, sf), range_bytes=1000, whole_bytes=4000)
    return files.select(F.regexp_extract("path", "part=([0-9]+)/", 1).alias("part"), "length", "sha256")


@query("published_orders", """
SELECT o_orderstatus, COUNT(*) AS orders, ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS amount FROM orders GROUP BY 1""")
def published_orders(spark, sf):
    """Orders published once and read back with every file held against its digest."""
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    p.publish(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,4)").alias("amount")), folder)
    kept = p.read_published(spark, folder)
    return rounded(kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").cast("double").alias("amount")), 2)
