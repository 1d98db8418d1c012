"""Quality classifier, vector codes and hard negatives against plain restatements."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import hard_negatives, quality_fm, vector_codes


# --- quality classifier --------------------------------------------------------------------


def test_sum_of_squares_identity():
    dice = np.random.default_rng(3)
    n = quality_fm.width(["n"])
    machine = quality_fm.Machine(0.3, dice.normal(size=n), dice.normal(size=(n, quality_fm.RANK)), ("n",))
    docs = [quality_fm.features(t, [7.0]) for t in ("one two two", "", "A longer line.\nA longer line.")]
    for (slots, values), score in zip(docs, quality_fm.raw_scores(machine, *quality_fm._joined(docs))):
        plain = 0.3 + sum(machine.weights[s] * v for s, v in zip(slots, values))
        plain += sum((machine.factors[slots[i]] @ machine.factors[slots[j]]) * values[i] * values[j] for i in range(len(slots)) for j in range(i))
        assert score == pytest.approx(plain)


def documents(spark):
    dice = np.random.default_rng(4)
    words = ["river", "stone", "walk", "evening", "bread", "letter", "garden", "north", "quiet", "window"]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(dice.choice(words, 40)) + "." if good else " | ".join(dice.choice(words, 40).tolist())
        rows.append((i, text, float(len(text)), "fr"))
        labels.append((i, int(good)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string, n_chars double, lang string").repartition(3),
            spark.createDataFrame(labels, "doc_id bigint, quality int"))


def test_learns_and_scores_rows_it_has_not_seen(spark):
    docs, labels = documents(spark)
    machine = quality_fm.train(docs, labels.where("doc_id % 4 != 0"), ["n_chars"])
    held = quality_fm.score(docs.where("doc_id % 4 = 0"), machine).join(labels, "doc_id").collect()
    assert len(held) == 100 and all((r["score"] >= 0.5) == bool(r["quality"]) for r in held)
    again = quality_fm.train(docs.repartition(5), labels.where("doc_id % 4 != 0").repartition(4), ["n_chars"])
    assert np.array_equal(machine.factors, again.factors) and machine.bias == again.bias


def test_the_bound_on_examples(spark):
    docs, labels = documents(spark)
    few = quality_fm.train(docs, labels, rows=20)
    hot = docs.selectExpr("1 AS doc_id", "concat(text, doc_id) AS text")  # one id with many texts
    many = quality_fm.train(hot, labels, rows=20)
    assert few.factors.shape == many.factors.shape == (quality_fm.width([]), quality_fm.RANK)


def test_odd_documents_get_scores(spark):
    docs, labels = documents(spark)
    machine = quality_fm.train(docs, labels, ["n_chars"])
    rows = [(1, None, None, "x"), (2, "", float("nan"), "x"), (None, "word", float("inf"), "x"), (3, "word " * 300_000, 1.0, "x"), (4, "\n \t", -5.0, "x"), (4, "\n \t", -5.0, "x"), (5, "😀" + "a" * 100_000, 0.0, "x")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars double, score string")
    found = quality_fm.score(odd, machine).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "4", "4", "5", "None"] and all(0 <= r["score"] <= 1 for r in found)
    assert quality_fm.score(odd.limit(0), machine).count() == 0
    no_labels = spark.createDataFrame([(None, 1), (7, None)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_fm.score(odd, quality_fm.train(docs, no_labels, ["n_chars"])).collect()} == {0.5}
    contrary = spark.createDataFrame([(i, q) for i in range(50) for q in (0, 1)], "doc_id bigint, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_fm.score(odd, quality_fm.train(docs, contrary)).collect())


# --- vector codes --------------------------------------------------------------------------


def plain_codes(rows, s):
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    size = max(1, -(-max(len(v) for _, _, v in kept) // s.parts))
    x = [[int(np.floor(s.scale * float(c))) for c in v] + [0] * (size * s.parts - len(v)) for _, _, v in kept]
    parts = [[r[p * size:(p + 1) * size] for r in x] for p in range(s.parts)]
    books = [[list(e) for e in part[:s.entries]] for part in parts]

    def nearest(part, book):
        far = [[sum((a - b) ** 2 for a, b in zip(r, e)) for e in book] for r in part]
        return [min(range(len(book)), key=lambda e: (f[e], e)) for f in far], [min(f) for f in far]
    for _ in range(s.rounds):
        for part, book in zip(parts, books):
            codes, _ = nearest(part, book)
            for e in range(len(book)):
                mine = [r for r, c in zip(part, codes) if c == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [nearest(part, book) for part, book in zip(parts, books)]
    out = [(k[0], k[1], bytes(f[0][i] for f in found), sum(f[1][i] for f in found)) for i, k in enumerate(kept)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(spark, rows, s, kind="float"):
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, codes string").repartition(3)
    codes, books = vector_codes.compress(frame, settings=s)
    return sorted(((r["id"], r["label"], bytes(r["codes"]), r["error"]) for r in codes.collect()), key=str), books.digest(), codes


@pytest.mark.parametrize("settings", [vector_codes.Settings(), vector_codes.Settings(parts=3, entries=5, rounds=2, scale=7)])
def test_equal_plain_integer_means(spark, settings):
    dice = np.random.default_rng(6)
    middle = dice.normal(size=(6, 16))
    rows = [(i, (middle[i % 6] + dice.normal(size=16) * 0.2).astype(np.float32).tolist(), i % 3 if i % 11 else None) for i in range(900)]
    rows += [(i, rows[i % 40][1], 1) for i in range(900, 1200)]  # copies, so that distances tie
    rows += [(2, None, 0), (3, [1.0, float("nan")], 0), (4, [float("inf")], 0), (5, [None] * 16, 0), (7, [], None), (8, [0.5], 2), (None, [0.25] * 16, 2)] + rows[:3]
    want, digest = plain_codes(rows, settings)
    got, books, codes = coded(spark, rows, settings)
    assert got == sorted(want, key=str) and books == digest
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert all(r["label_error"] == sums[r["label"]] for r in vector_codes.label_errors(codes).collect())


def test_few_vectors_ties_and_none(spark):
    s = vector_codes.Settings()
    for rows in ([(9, [1.0, -1.0, 0.5], None)], [(i, [0.0] * 8, 1) for i in range(30)], [(1, [], None)]):
        want, digest = plain_codes(rows, s)
        got, books, _ = coded(spark, rows, s, "double")
        assert got == sorted(want, key=str) and books == digest
    got, _, codes = coded(spark, [(1, None, 2)], s)
    assert got == [] and vector_codes.label_errors(codes).count() == 0


def test_blocks_of_many_rows_and_values_without_a_code(spark):
    dice = np.random.default_rng(7)
    x = np.floor(dice.normal(size=(vector_codes.BLOCK + 700, 5)) * 300).astype(np.int64)
    book = x[:16].copy()
    codes, sums, counts = vector_codes.assign(x, vector_codes.grow(x, vector_codes.LEAF), book)
    want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=16)).all() and (sums == np.stack([x[want == e].sum(axis=0) for e in range(16)])).all()
    with pytest.raises(Exception, match="no code"):
        coded(spark, [(1, [1e9] * 8, 0)], vector_codes.Settings())


# --- hard negatives ------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, s):
    kept = {(i, lab, tuple(int(np.floor(s.scale * float(x))) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(k[2]) for k in kept), default=0)
    kept = sorted({(i, lab, v + (0,) * (width - len(v))) for i, lab, v in kept})
    out = []
    for a in kept:
        if not is_anchor(a[0]):
            continue
        others = sorted((-sum(x * y for x, y in zip(a[2], o[2])), o[0], o[1]) for o in kept if o[0] != a[0])
        for score, name, _ in [o for o in others if o[2] == a[1]][:s.positives]:
            fits = [o for o in others if o[2] != a[1] and s.low * -score <= 100 * -o[0] <= s.high * -score]
            out += [(a[0], name, rank + 1, o[1], -score, -o[0]) for rank, o in enumerate(fits[:s.negatives])]
    return sorted(out)


def mined(spark, rows, kind="float", every=10, settings=hard_negatives.Settings()):
    frame = spark.createDataFrame([(*r, 5, "n") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, rank int, name string").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(frame, frame["vec_id"] % every == 0, settings=settings).collect())


def test_equal_a_full_comparison(spark):
    dice = np.random.default_rng(9)
    middle = dice.normal(size=(8, 12))
    rows = [(i, (middle[i % 8] + dice.normal(size=12) * 0.4).astype(np.float32).tolist(), int(dice.integers(4)) if i % 13 else None) for i in range(1500)]
    hot = rows[5][1]
    rows += [(i, hot, i % 4) for i in range(1500, 2300)]  # one vector with a third of the rows: all its scores tie
    rows += [(1, None, 0), (2, [None] * 12, 1), (3, [float("nan")] * 12, 1), (None, hot, 1), (10, [0.0] * 12, 1), (20, [], 2), (30, [1.0], 3), (40, [-1.0] * 12, 0), (40, [1.0] * 12, 0)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, hard_negatives.Settings()) and len(got) > 1500
    assert mined(spark, rows + rows[:700]) == got  # repeated rows count once


def test_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    monkeypatch.setattr(hard_negatives, "STEP", 8)
    dice = np.random.default_rng(10)
    rows = [(i, dice.normal(size=4).tolist(), int(dice.integers(3))) for i in range(900)]
    s = hard_negatives.Settings(positives=3, negatives=4, scale=64, low=50, high=90)
    assert mined(spark, rows, "double", 7, s) == plain_negatives(rows, lambda i: i % 7 == 0, s)


def test_fewer_rows_than_asked_and_none(spark):
    for rows in ([(10, [1.0, 0.0], 1)], [(10, [1.0, 0.0], 1), (11, [1.0, 0.5], 1), (12, [0.9, 0.1], 2), (13, [0.0, 0.0], 2)], [(10, None, 1)], [(10, [], 1), (11, [], 2)]):
        assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0, hard_negatives.Settings())


def test_no_join_sends_a_table_through_the_driver(spark):
    """Packed anchors are far larger than the files they come from, by which Spark would broadcast them."""
    dice = np.random.default_rng(12)
    rows = [(i, dice.normal(size=6).tolist(), i % 3) for i in range(300)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0, hard_negatives.Settings())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_the_walk_stops_early():
    dice = np.random.default_rng(11)
    x = np.concatenate([dice.normal(size=(2000, 6)) * 20 + [500, 0, 0, 0, 0, 0], dice.normal(size=(2000, 6)) * 20 + [0, 500, 0, 0, 0, 0]]).round()
    units, length = hard_negatives._units(x)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(np.asarray(at)))
            return np.asarray(self)[at]
    block = {"x": x.view(Watched), "units": units, "length": length, "id": np.arange(4000), "label": np.arange(4000) % 2, "place": np.arange(4000)}
    asks = {"x": x[:8], "pivot": np.zeros(8, int), "floor": np.full(8, -np.inf), "low": np.full(8, -1 << 52), "high": np.full(8, 1 << 52), "label": np.zeros(8, int), "same": np.ones(8, bool), "id": np.arange(8)}
    best = hard_negatives.walk(asks, block, 5)
    score = x[:8] @ x.T
    for i in range(8):
        want = [o for o in np.lexsort((np.arange(4000), -score[i])) if o != i and o % 2 == 0][:5]
        assert [hard_negatives.ROOM - 1 - int(k % hard_negatives.ROOM) for k in best[i]] == want
    assert sum(seen) <= 2600  # the far half of the list is never scored
