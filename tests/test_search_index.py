"""The stored index against a plain restatement of the ranking."""

import math
import re
from collections import Counter

import pytest

from plumbline.functions import fixed_values as fixed
from plumbline.operators import search_index

ARTICLES = [
    ("a.md", "Missing orders", None, ["dbt"], ["late"], "orders arrive late and orders are counted twice", "2024-01-02"),
    ("b.md", "Orders counted twice", "about orders", ["dbt", "ga4"], [], "the join repeats rows " * 3 + "orders", "2024-01-01"),
    ("c.md", None, None, None, None, None, None),
    ("d.md", "Nothing here", "orders", ["ga4"], ["orders"], "", "2024-02-01"),
    ("e.md", "Nothing here", "orders", ["ga4"], ["orders"], "", "2024-02-01")]
SCHEMA = "path string, title string, summary string, topics array<string>, tags array<string>, body string, date string"


def words(text):
    out = []
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        if len(w) > 2 and w not in fixed.STOPWORDS:
            for suffix, least in (("ss", None), ("ing", 6), ("ed", 5), ("es", 5), ("s", 4)):
                if w.endswith(suffix) and (least is None or len(w) >= least):
                    w = w if least is None else w[:-len(suffix)]
                    break
            out.append(w)
    return out


def ranked(query, topic, k):
    chosen = [a for a in ARTICLES if not topic or topic in (a[3] or [])]
    fields = {a[0]: [(3, words(a[1])), (2, words(a[2])), (3, words(" ".join((a[3] or []) + (a[4] or [])))), (1, words(a[5]))] for a in chosen}
    idf = {t: math.log((len(chosen) + 1) / (1 + sum(any(t in f for _, f in fs) for fs in fields.values()))) + 1 for t in set(words(query))}
    scores = {p: sum(w * idf[t] * (1 + math.log(c[t])) / math.sqrt(len(f)) for w, f in fs for c in [Counter(f)] for t in idf if c[t]) for p, fs in fields.items()}
    return [(p, round(s, 4)) for p, s in sorted(scores.items(), key=lambda x: (-round(x[1], 4), x[0])) if s > 0][:k]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "one")
    search_index.build(spark.createDataFrame(ARTICLES, SCHEMA), path)
    return path


def test_a_batch_of_queries(spark, folder):
    asked = [(1, "late orders", None), (2, "orders", "ga4"), (3, "orders counted", "dbt"), (4, "the of", None), (5, "absent", None), (6, None, "dbt"), (7, "orders", ""), (8, "orders", "unknown")]
    found = search_index.search(spark, folder, spark.createDataFrame(asked, "query_id int, query string, topic string"), k=3).orderBy("query_id", "rank").collect()
    for number, query, topic in asked:
        assert [(r["path"], r["score"]) for r in found if r["query_id"] == number] == ranked(query, topic, 3), (number, query)
    first = next(r for r in found if r["query_id"] == 1)
    assert first["title"] == "Missing orders" and first["date"] == "2024-01-02" and first["topics"] == ["dbt"] and first["snippet"].startswith("orders arrive late")
    assert next(r for r in found if r["query_id"] == 2 and r["path"] == "d.md")["snippet"] == ""


def test_queries_without_topics_and_empty_tables(spark, folder, tmp_path):
    none = spark.createDataFrame([], "query_id int, query string")
    assert search_index.search(spark, folder, none).count() == 0
    search_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert search_index.search(spark, str(tmp_path / "empty"), spark.createDataFrame([(1, "orders")], "query_id int, query string")).count() == 0


def test_refuses_a_used_folder_and_unnamed_articles(spark, folder, tmp_path):
    with pytest.raises(Exception, match="(?i)exists"):
        search_index.build(spark.createDataFrame(ARTICLES, SCHEMA), folder)
    with pytest.raises(ValueError, match="one article per path"):
        search_index.build(spark.createDataFrame(ARTICLES + ARTICLES[:1], SCHEMA), str(tmp_path / "twice"))


def test_postings_lie_in_sorted_segments(spark, folder):
    index = spark.read.parquet(f"{folder}/postings")
    assert index.where("term = 'order'").selectExpr("sum(title + summary + labels + body) AS n").first()[0] == sum(words(" ".join(filter(None, [a[1], a[2], *(a[3] or []), *(a[4] or []), a[5]]))).count("order") for a in ARTICLES)
    for part in index.selectExpr("input_file_name() AS f", "term").toPandas().groupby("f"):
        assert part[1]["term"].is_monotonic_increasing


def test_a_segment_has_a_given_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "SEGMENT", 2_000)
    docs = spark.range(200).selectExpr("concat('p', id) AS path", "'t' AS title", "'s' AS summary", "array('a') AS topics", "array('b') AS tags", "repeat('word ', 20) AS body")
    search_index.build(docs, f"{tmp_path}/index")
    assert len(list((tmp_path / "index" / "postings").glob("part-*"))) >= 10
