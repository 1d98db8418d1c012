"""Families of near copies, and what the plans of line dedup say of their tables of bytes."""

import random

from plumbline.llm import line_dedup


def test_copies_with_words_of_their_own_go_by_the_first_comparison(spark, monkeypatch):
    dice, base = random.Random(3), [f"word{i}" for i in range(60)]
    lines = []
    for i in range(60):
        words = list(base)
        for k, at in enumerate(dice.sample(range(60), 3)):
            words[at] = f"own{i}x{k}"
        lines.append(words)
    sent, confirmed = [], line_dedup._confirmed
    def counted(pairs, *others):
        sent.append(pairs.select("y").distinct().count())
        return confirmed(pairs, *others)
    monkeypatch.setattr(line_dedup, "_confirmed", counted)
    got = {r["doc_id"]: r["kept_lines"] for r in line_dedup.report(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id bigint, text string")).collect()}
    def like(a, b):
        return 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    assert got == {i: [] if any(like(x, line) for x in lines[:i]) else [0] for i, line in enumerate(lines)}
    assert sent[0] >= 30  # their three rarest words are their own, so that all of them met pair by pair in the join before


def test_descriptions_of_plans_stay_short(spark):
    """A table of half a million bytes as a literal made each of them two million characters long, and Spark's driver keeps them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    line_dedup.report(spark.createDataFrame([(1, "a b c d e f g\nx y"), (2, "a b c d e f h")], "doc_id bigint, text string")).collect()
    told = store.executionsList()
    sizes = [len(told.apply(i).physicalPlanDescription()) for i in range(before, told.size())]
    assert sizes and max(sizes) < 300_000
