"""Rows told apart by id and text, thresholds below 0.8, and records that are no records."""

import datetime as dt

import brute
import pytest

from plumbline.llm import line_dedup, near_dedup, revisit

WORDS = [f"w{i}" for i in range(60)]
TEXT, NEAR, OTHER = " ".join(WORDS), " ".join(WORDS[:57]), " ".join(reversed(WORDS))


def test_one_text_of_each_group_stays(spark):
    rows = [(1, TEXT), (None, NEAR), (None, OTHER), (3, OTHER + " x"), (5, NEAR + " y"), (5, "something else entirely here"), (5, "something else entirely here"), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id int, text string, held string").repartition(3)
    left = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()), key=str)
    assert left == sorted([(1, TEXT), (3, OTHER + " x"), (5, "something else entirely here"), (5, "something else entirely here"), (7, ""), (None, None)], key=str)
    nobody = spark.createDataFrame([(None, TEXT), (None, NEAR), (8, OTHER), (8, OTHER + " x")], "doc_id int, text string")
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep_one(nobody).collect()) == ["8", "None"]


@pytest.mark.parametrize("threshold,num,den", [("0.5", 1, 2), ("0.7", 7, 10), ("0.8", 4, 5), ("0.9", 9, 10), ("1", 1, 1)])
def test_lines_at_any_threshold(spark, threshold, num, den):
    rows = [(1, "aa bb cc\naa bb"), (2, "aa bb cc dd\naa"), (3, "aa bb cc dd ee\nbb aa"), (4, "x y z\nx y z q\n" + " ".join(WORDS[:10])), (5, " ".join(WORDS[:9]) + "\n" + " ".join(WORDS[:8])), (6, "x z y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup.report(docs, threshold=threshold).collect()}
    assert got == brute.kept_lines(rows, num, den)


def test_a_very_long_line(spark):
    docs = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(100_000))), (2, " ".join(f"t{i}" for i in range(99_000)))], "doc_id bigint, text string")
    assert {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup.report(docs).collect()} == {1: [0], 2: []}


def test_bad_records_keep_the_others(spark):
    rows = [("a", "response", "http://x/", dt.datetime(2024, 1, 2), 200, [("ETag", "1")], "body"), ("b", "response", "http://x/", None, None, None, None)]
    schema = "record_id string, kind string, uri string, at timestamp, status int, headers array<struct<name:string,value:string>>, body string"
    written = revisit.write_records(spark.createDataFrame(rows, schema))
    assert written.where("record is not null").count() == 2
    good = written.collect()
    bad = [(good[0]["record"][:40],), (good[0]["record"].split("\r\n\r\n")[0] + "\r\n\r\n",), ("WARC/1.1\r\nWARC-Date: never\r\n\r\nno http",), ("",), (None,)]
    read = revisit.read_records(spark.createDataFrame([(r["record"],) for r in good] + bad, "record string")).collect()
    assert {r["record_id"]: (r["status"], r["at"]) for r in read if r["body"]}["a"] == (200, dt.datetime(2024, 1, 2))
    assert [(r["status"], r["at"]) for r in read if r["record_id"] == "b"] == [(None, None)]
    assert len(read) == 4
