"""Secrets of different texts without an id or under one id."""

from plumbline.llm import secrets
from tests.llm.test_text_operators import SECRETS, clashing, spans_of


def test_texts_under_one_id_keep_their_own_spans(spark):
    rows = [(k if k in (1, 8) else None if i % 2 else 70, t) for i, (k, t) in enumerate(SECRETS)] + [(None, "clean words at the place of others"), (70, "clean words at the place of others")]
    docs = clashing(spark, rows)
    single = {r["row"]: r["text"] for r in secrets.mask(docs.selectExpr("monotonically_increasing_id() AS doc_id", "text", "coalesce(text, '-') AS row")).collect()}
    for times, table in ((1, docs), (2, docs.union(docs))):
        got = sorted(str((r["doc_id"], [tuple(s) for s in r["spans"]])) for r in secrets.report(table).collect())
        assert got == sorted(times * [str((k, spans_of(t))) for k, t in rows])
        masked = sorted(str((r["doc_id"], r["text"])) for r in secrets.mask(table).collect())
        assert masked == sorted(times * [str((k, single["-" if t is None else t])) for k, t in rows])
