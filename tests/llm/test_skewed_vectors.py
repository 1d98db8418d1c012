"""Nearest neighbours where a third of the rows are copies of one vector, over several full blocks."""

from collections import defaultdict

import numpy as np

from plumbline.llm import ann


def test_copies_of_one_vector_over_full_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(36_500, 64))
    copies = rng.permutation(36_500)[:12_166]
    x[copies] = x[copies[0]] + 0.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[copies] = x[copies[0]]
    assert len(np.unique(x, axis=0)) > 2.9 * ann.BLOCK
    beside = np.argsort(-(x @ x[copies[0]]), kind="stable")[12_166:12_186]  # the copies are nearest to these, or nearly so
    asked = {int(q) for q in (*copies[:30], *rng.permutation(36_500)[:30], *beside)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(table, table.where(table["vec_id"].isin(list(asked))), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    hot, hit, total = set(copies.tolist()), 0, 0
    for q in asked:
        found = [n for _, n in sorted(got[q])]
        score = (x * x[q]).sum(axis=1)
        want = [n for n in np.lexsort((np.arange(len(x)), -score)).tolist() if n != q][:20]
        if q in hot:
            assert found == want
        else:
            hit, total = hit + len(set(found) & set(want)), total + 20
    print(f"recall beside the copies {hit / total:.4f} of {total}")
    assert hit >= 0.9 * total


def test_repeated_rows_and_the_own_id(spark):
    rows = [(5, [1.0, 0.0])] * 30 + [(7, [1.0])] * 2 + [(9, [1.0, -0.0])] + [(5, [0.9, i / 1000]) for i in range(400)] + [(11, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.search(table, spark.createDataFrame([(5, [1.0, 0.0]), (9, [1.0, 0.0])], table.schema), k=20).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found if r["query_id"] == 5] == [7, 7, 9, 11]
    assert [r["vec_id"] for r in found if r["query_id"] == 9] == [5] * 20


def test_inverted_files_rank_by_footrule_distance():
    rng = np.random.default_rng(3)
    pivots, x = rng.normal(size=(40, 9)), rng.normal(size=(70, 8))
    order = ann.prefixes(x, pivots, 12, 6.0)
    near = x @ pivots[:, :-1].T + np.sqrt(36.0 - (x * x).sum(axis=1))[:, None] * pivots[:, -1]
    assert (order == np.argsort(-near, axis=1, kind="stable")[:, :12]).all()
    starts, posted, placed = ann.inverted(order, 40)
    files = {(p, int(posted[j]), int(placed[j])) for p in range(40) for j in range(starts[p], starts[p + 1])}
    assert files == {(int(p), v, place) for v, row in enumerate(order) for place, p in enumerate(row)}
    asked, whole = order[0], np.full((70, 40), 12)
    np.put_along_axis(whole, order, np.arange(12)[None, :], 1)
    shared = np.array([sum(12 - max(i, whole[v, p]) for i, p in enumerate(asked)) for v in range(70)])
    footrule = np.abs(whole - whole[0]).sum(axis=1)
    assert len(set((footrule + 2 * shared).tolist())) == 1


def test_recall_where_most_vectors_lie_to_one_side(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9_000, 64))
    x[:3_000] += 4 * rng.normal(size=64) / 8  # a third leans one way, none are equal
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(table, table.where("vec_id % 90 = 0"), k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in got:
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:20].tolist()))
    assert len(got) == 100 and hit >= 0.9 * 2_000
