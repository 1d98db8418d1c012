"""Line dedup of different texts without an id or under one id."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup
from tests.llm import brute
from tests.llm.test_text_operators import corpus


@pytest.mark.parametrize("seed", [5, 6])
def test_every_text_under_an_id_is_a_document(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.choice([None, 1, 2, i + 10]), t or "") for i, t in corpus(seed)}, key=str)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ordered = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    want = brute.kept_lines([(i, t) for i, (_, t) in enumerate(ordered)])
    for table in (docs, docs.orderBy(F.desc("text")), docs.union(docs)):
        times = 2 if table.count() > len(rows) else 1
        got = sorted(str((r["doc_id"], r["kept_lines"])) for r in line_dedup.report(table).collect())
        assert got == sorted(times * [str((k, want[i])) for i, (k, _) in enumerate(ordered)])
        left = sorted(str(tuple(r)) for r in line_dedup.dedup(table).collect())
        stay = [(k, "\n".join(x for j, x in enumerate(t.split("\n")) if j in want[i] or not x.strip())) for i, (k, t) in enumerate(ordered) if want[i] or not t.strip()]
        assert left == sorted(times * [str(r) for r in stay])
