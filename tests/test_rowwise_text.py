"""Snippets and keywords that are found within a row, against the same done over exploded words."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import text as t


def _texts():
    chance = random.Random(7)
    words = ["term", "Terms,", "other", "(others)", "x" * 30, "a", "É", "ſtrange", "Kelvin", "wording", "class", "-", "zz term", "\U0001f600"]
    return [None, "", " \n ", "term", "x" * 300, "x" * 300 + " term"] + [chance.choice([" ", "\n\t", "  "]).join(chance.choices(words, k=chance.randrange(1, 120))) for _ in range(150)]


@pytest.mark.parametrize("width", [0, 1, 20, 37, 200])
def test_walk_equals_windows(spark, width):
    rows = [(i, x, ["term", "kelvin", None] if i % 3 else None) for i, x in enumerate(_texts())]
    df = spark.createDataFrame(rows, "id int, text string, terms array<string>")
    for terms in (("term", "other", "word"), F.col("terms")):
        wanted = terms if not isinstance(terms, tuple) else F.array(*map(F.lit, terms))
        got = {r["id"]: r["snippet"] for r in t.snippet(df, ["id"], "text", terms, width).collect()}
        slow = t._shared_snippets(df.select("id", F.col("text").alias("_text"), wanted.alias("_terms")), ["id"], width)
        assert got == {r["id"]: r["snippet"] for r in slow.collect()}


def test_unshared_rows_go_through_no_window(spark):
    df = spark.createDataFrame([(i, f"term {i}") for i in range(50)], "id int, text string")
    plan = t.snippet(df, ["id"], "text", ["term"])
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown.split("Initial Plan")[0]


def test_snippets_of_shared_and_missing_keys(spark, rows):
    df = spark.createDataFrame([(1, "a term b"), (1, "a term b"), (None, "one term"), (2, "word")], "id int, text string")
    assert rows(t.snippet(df, ["id"], "text", ["term"], 100)) == [(1, "a term b"), (1, "a term b"), (2, "word"), (None, "one term")]


def test_keywords_of_a_row_equal_those_over_rows(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "id int, text string")
    for n in (1, 3, 20):
        slow = {}
        for r in t.keywords(df, ["id"], "text", n).orderBy("id", "rank").collect():
            slow.setdefault(r["id"], []).append(r["term"])
        assert {r["id"]: r["top"] for r in df.select("id", t.top_terms(F.col("text"), n).alias("top")).collect()} == {i: slow.get(i, []) for i, _ in enumerate(_texts())}


def test_article_index_counts_unshared_articles_in_their_row(spark):
    df = spark.createDataFrame([("a.md", "---\ntitle: A\ndate: 2024-01-02\n---\nalpha alpha beta"), ("b.md", "gamma"), ("b.md", "delta gamma"), (None, "omega")], "path string, text string")
    found = t.article_index(df)
    got = [(r["path"], r["keywords"], r["words"]) for r in found.collect()]
    assert got[0] == ("a.md", ["alpha", "beta"], 3) and sorted(got[1:], key=str) == sorted([("b.md", ["gamma", "delta"], 1), ("b.md", ["gamma", "delta"], 2), (None, [], 1)], key=str)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
