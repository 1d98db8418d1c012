"""Near copies whose rows have no id, or share one."""

from plumbline.llm import near_dedup


def changed(words, places, sign):
    return [f"{sign}{i}" if i in places else w for i, w in enumerate(words)]


def test_links_through_rows_without_an_id(spark):
    out = []
    for f in "abc":  # the second text is like the first (0.84), the third like the second only
        one = [f"{f}{i}" for i in range(120)]
        two = changed(one, {20, 40}, f + "x")
        out.append([" ".join(t) for t in (one, two, changed(two, {60, 80}, f + "y"))])
    (a1, a2, a3), (b1, b2, b3), (c1, c2, _) = out
    rows = [(1, a1), (None, a2), (None, a2), (2, a3), (3, b1), (None, b2), (4, b3), (7, c1), (7, b2 + " tail"), (7, c2), (None, c2), (None, "one alone in here")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = [("1", "1", True), ("2", "1", False), ("3", "3", True), ("4", "3", False), ("7", "3", False), ("7", "7", True), ("7", "7", True),
            ("None", "1", False), ("None", "1", False), ("None", "3", False), ("None", "7", False), ("None", "None", True)]
    assert got == sorted(want)
