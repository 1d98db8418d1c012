"""Dictionary redaction against a plain restatement."""

import random
import re

from plumbline.operators import term_dictionary


def plain(text, terms):
    pieces = re.findall(r"\w+|(?s:\W)", text)
    low = [p.lower() for p in pieces]
    found = []
    for rank, term in enumerate(sorted(terms, key=lambda t: (-len(t), t))):
        parts = re.findall(r"\w+|(?s:\W)", term.lower())
        found += [(rank, i, len(parts), term) for i in range(len(low)) if parts and low[i:i + len(parts)] == parts]
    taken = []
    for m in sorted(found):
        if not any(m[1] < t[1] + t[2] and t[1] < m[1] + m[2] for t in taken):
            taken.append(m)
    out, at = "", 0
    for _, i, n, term in sorted(taken, key=lambda m: m[1]):
        out += "".join(pieces[at:i]) + terms[term]
        at = i + n
    hits = {}
    for m in taken:
        hits[m[3]] = hits.get(m[3], 0) + 1
    return out + "".join(pieces[at:]), hits, sorted({m[3] for m in found})


def test_many_terms_over_random_texts(spark):
    dice = random.Random(2)
    words = ["north", "river", "c", "plus", "Ünder", "a_b", "x1", "the", "deal"]
    terms = {" ".join(dice.choices(words, k=dice.randint(1, 3))): f"<{i}>" for i in range(150)} | {"c++": "[c]", "river-north": "$1 \\d", "(the)": "[p]", "ünder": "[u]", "": "[none]"}
    texts = ["".join(dice.choice(words + [w.upper() for w in words]) + dice.choice([" ", " ", " ", "\n", "-", "++ ", "  ", ", "]) for _ in range(40)) for _ in range(60)]
    texts += ["", "(the) c++ C++x rivers river-north.", "😀 the deal 😀", "deal " * 3_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(999, None, "k")], "id int, body string, term string").repartition(3)
    given = {t: r for t, r in terms.items()}
    real = {t: r for t, r in terms.items() if t}
    found = {r["id"]: r for r in term_dictionary.redact_dictionary(df, "body", given).collect()}
    alive = {r["id"]: r["surviving"] for r in term_dictionary.surviving_terms(df, "body", list(given)).collect()}
    for i, text in enumerate(texts):
        want, hits, present = plain(text, real)
        assert (found[i]["body"], found[i]["term_hits"], alive[i]) == (want, hits, present), text[:80]
    assert found[999]["body"] is None and found[999]["term_hits"] == {} and alive[999] == [] and found[0]["term"] == "k"


def test_the_plan_does_not_grow(spark):
    df = spark.createDataFrame([("x",)], "body string")
    def size(n):
        return len(term_dictionary.redact_dictionary(df, "body", {f"word{i} of {i}": "[w]" for i in range(n)})._jdf.queryExecution().analyzed().toString())
    assert abs(size(5_000) - size(5)) < 400
    assert term_dictionary.redact_dictionary(df, "body", {}).collect()[0]["body"] == "x"
    assert term_dictionary.surviving_terms(df.limit(0), "body", ["x"]).count() == 0
