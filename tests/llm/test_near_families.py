"""A family around the threshold: links are found in the tiles, and no pair of members travels with its texts."""

import random

from plumbline.llm import near_dedup
from tests.llm.brute import near_groups


def test_members_below_the_threshold_are_not_paired_with_the_family(spark, monkeypatch):
    dice = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(90):
        copy = list(base)
        for at in dice.sample(range(4, 112), dice.randint(2, 5)):
            copy[at] = f"n{i}x{at}"
        texts.append(" ".join(copy))
    texts += [t + " one more" for t in texts[60:70]]
    rows = list(enumerate(texts))
    sent, confirmed = [], near_dedup._confirm
    def counted(pairs, *others):
        sent.append(pairs.count())
        return confirmed(pairs, *others)
    monkeypatch.setattr(near_dedup, "_confirm", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), rules=near_dedup.Rules(4)).collect()}
    assert got == near_groups(rows, 4) and len({c for _, c in got.values()}) > 10
    assert sum(sent) <= 5 * len(rows)
