"""Article search over a stored inverted index.

``build`` tokenises every article once and writes four tables into a folder: ``articles`` with a number for each;
``postings`` with one row per (term, article), its count in every field, the fields' lengths and the article's topics; ``frequencies`` with the
articles per (term, topic), a null topic standing for all; and ``totals``, which comes last and makes the index complete. Postings lie in
segments, each a file over some articles, sorted by term: writing one needs no shuffle of postings, and a reader of few terms skips
the pages of all others. A term of very many articles lies in all segments, never in one task.

A batch of queries is one join: terms of all queries with their frequencies, then with the postings, summed per
(query, article). Nothing is tokenised again but the queries and the bodies of the hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.operators.text import kept_words, snippet, tokens
from plumbline.session import stored

TABLES = ("articles", "postings", "frequencies", "totals")
SEGMENT = 8 << 20  # octets of text in a segment, about
PUSHED = 200  # distinct query terms up to which the scan of the postings is told the terms themselves


def build(docs: DataFrame, folder: str) -> None:
    """Write the index of ``docs`` (path, title, summary, topics ARRAY, tags ARRAY, body, date if there is one) to an unused folder.

    Paths identify articles: an article without one can't be named by a hit and is refused, and so are two of one path.
    Null fields are empty. An empty table makes an empty index.
    """
    spark = docs.sparkSession
    empty = F.array().cast("array<string>")
    date = F.col("date").cast("string") if "date" in docs.columns else F.lit(None).cast("string")
    docs.select(F.monotonically_increasing_id().alias("number"), "path", "title", date.alias("date"), F.array_distinct(F.coalesce("topics", empty)).alias("topics"),
                F.coalesce("tags", empty).alias("tags"), "summary", "body").write.parquet(f"{folder}/articles")
    articles = spark.read.parquet(f"{folder}/articles")
    wrong = articles.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("path is null or n > 1").limit(1).collect()
    if wrong:
        raise ValueError(f"an index needs one article per path; {wrong[0]['path']!r} has {wrong[0]['n']}")
    texts = {"title": F.col("title"), "summary": F.col("summary"), "labels": F.concat_ws(" ", "topics", "tags"), "body": F.col("body")}
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(text, F.lit("")).alias("text")) for name, text in texts.items()])
    # texts move once; counts and lengths are made where an article is. A segment has a given size: Spark would measure it by its compressed
    # texts, which take a hundredth of the room of their postings
    room = articles.agg(F.sum(sum((F.coalesce(F.octet_length(text), F.lit(0)) for text in texts.values()), F.lit(0).cast("bigint"))).alias("octets")).first()["octets"] or 0
    spread = articles.repartition(max(spark.sparkContext.defaultParallelism, -(-room // SEGMENT)), "number").select("number", "topics", F.explode(fields).alias("f")).select("number", "topics", "f.*")
    words = kept_words(spread, ["number", "topics", "field"], F.col("text"))
    counts = words.groupBy("number", "topics", "term").agg(*[F.count_if(F.col("field") == name).cast("int").alias(name) for name in texts])
    article = Window.partitionBy("number")
    sized = counts.withColumns({f"{name}_length": F.sum(name).over(article).cast("int") for name in texts})
    sized.sortWithinPartitions("term").write.parquet(f"{folder}/postings")
    everyone = F.array_union(F.array(F.lit(None).cast("string")), "topics")
    postings = spark.read.parquet(f"{folder}/postings")
    # articles with the same topics count together before they count for each topic
    alike = postings.groupBy("term", "topics").agg(F.count(F.lit(1)).alias("articles"))
    alike.select("term", F.explode(everyone).alias("topic"), "articles").groupBy("term", "topic").agg(F.sum("articles").alias("articles")).sortWithinPartitions("term").write.parquet(f"{folder}/frequencies")
    articles.select(F.explode(everyone).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("total")).coalesce(1).write.parquet(f"{folder}/totals")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5, width: int = 200) -> DataFrame:
    """(query_id, rank, path, title, date, topics, score, snippet): the ``k`` best articles of every query, ties to the smaller path.

    ``queries``: query_id, query and, if some search one topic only, topic (null or empty: all). The weight of a term counts the articles of the
    query's own topic. A query without a term of the index has no hits. Repeated query ids must ask the same question.
    """
    parts = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}
    topic = F.nullif(F.col("topic"), F.lit("")) if "topic" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", topic.alias("_topic"), F.array_distinct(tokens("query")).alias("terms")).distinct()
    terms = asked.select("query_id", "_topic", F.explode("terms").alias("term"))
    known = terms.join(parts["frequencies"], (terms["term"] == parts["frequencies"]["term"]) & F.col("_topic").eqNullSafe(F.col("topic"))).select(
        "query_id", "_topic", terms["term"].alias("_term"), "articles")
    known = known.join(parts["totals"], F.col("_topic").eqNullSafe(F.col("topic")))
    idf = F.ln((F.col("total") + 1).cast("double") / (F.col("articles") + 1)) + 1
    # a table whose size Spark knows: it travels to the postings as long as it is small
    weighed = stored(known.select("query_id", "_topic", "_term", idf.alias("idf")))
    part = F.lit(0.0)
    for name, weight in fixed.FIELD_WEIGHTS.items():
        tf, length = F.col(name).cast("double"), F.col(f"{name}_length").cast("double")
        part = part + F.when(tf > 0, float(weight) * F.col("idf") * (1 + F.ln(tf)) / F.sqrt(length)).otherwise(0.0)
    postings = parts["postings"]
    named = [r["term"] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(named) <= PUSHED:
        postings = postings.where(F.col("term").isin(named))
    met = postings.join(weighed, (F.col("term") == F.col("_term")) & (F.col("_topic").isNull() | F.array_contains("topics", F.col("_topic"))))
    scored = met.groupBy("query_id", "number").agg(F.round(F.sum(part), 4).alias("score")).where("score > 0")
    # whatever ties with the last one comes along until the paths decide
    near = scored.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")
    shown = parts["articles"].select("number", "path", "title", "date", "topics", "body")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    named_hits = stored(near).join(parts["articles"].select("number", "path"), "number")
    top = named_hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("path")
    hits = top.join(asked.select("query_id", "terms"), "query_id").join(shown, "number")
    hits = hits.select("query_id", "rank", "path", "title", "date", "topics", "score", "terms", "body")
    return hits.drop("terms", "body").join(snippet(hits, ["query_id", "path"], "body", F.col("terms"), width), ["query_id", "path"])
