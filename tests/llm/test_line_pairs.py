"""Lines that share many words without resembling each other are told apart before their texts are fetched."""

import random

from plumbline.llm import line_dedup


def test_few_pairs_are_verified(spark, monkeypatch):
    dice, vocabulary = random.Random(5), [f"word{i}" for i in range(60)]
    lines = [dice.sample(vocabulary, 45) for _ in range(80)]
    lines[40] = lines[7][:44] + ["other"]
    rows = [(i // 4, "\n".join(" ".join(x) for x in lines[i:i + 4])) for i in range(0, 80, 4)]
    sent, confirmed = [], line_dedup._confirmed
    def counted(pairs, *others):
        sent.append(pairs.count())
        return confirmed(pairs, *others)
    monkeypatch.setattr(line_dedup, "_confirmed", counted)
    got = {r["doc_id"]: r["kept_lines"] for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {}
    for i, line in enumerate(lines):
        like = any(5 * len(set(line) & set(x)) >= 4 * len(set(line) | set(x)) for x in lines[:i])
        want.setdefault(i // 4, []).extend([] if like else [i % 4])
    assert got == want and want[10] == [1, 2, 3]
    assert sum(sent) <= 60  # of 3,160
