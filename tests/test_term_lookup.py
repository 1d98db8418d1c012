"""Dictionary terms are looked up side by side instead of piece by piece in lambdas with the dictionary in every row."""

from plumbline.operators import term_dictionary


def test_no_row_holds_the_dictionary(spark):
    df = spark.range(700).selectExpr("id", "concat(if(id % 2 = 0, 'Old Foo of ', 'new '), id) AS body")
    out = term_dictionary.redact_dictionary(df, "body", {"foo": "[f]", "Foo": "[g]", "old foo": "[o]", "699": "[n]", "of": "[of]"})
    alive = term_dictionary.surviving_terms(df, "body", ["foo", "Foo", "old foo", "699"])
    for plan in (out, alive):
        assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["body"], r["term_hits"]) for r in out.collect()}
    assert got[4] == ("[o] [of] 4", {"of": 1, "old foo": 1}) and got[699] == ("new [n]", {"699": 1}) and got[5] == ("new 5", {}) and len(got) == 700
    left = {r["id"]: r["surviving"] for r in alive.collect()}
    assert left[4] == ["Foo", "foo", "old foo"] and left[699] == ["699"] and left[5] == []
    both = term_dictionary.redact_dictionary(spark.createDataFrame([("a foo",)], "body string"), "body", {"foo": "[f]", "Foo": "[g]"}).first()
    assert both["body"] == "a [f]" and both["term_hits"] == {"foo": 1}


def test_letters_that_change_the_pieces_in_lower_case(spark):
    """Places are those in lower case, also where the text has more or fewer pieces."""
    low, high = (f"regexp_extract_all({c}, '{term_dictionary.PIECE}', 0)".replace("\\", "\\\\") for c in ("lower(t)", "t"))
    each = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'b foo, bar') AS t")
    odd = each.where(f"size({low}) <> size({high})").selectExpr("id", "t", f"{low} AS low", f"{high} AS high").collect()
    assert odd
    found = {r["id"]: r["t"] for r in term_dictionary.redact_dictionary(each.where(f"size({low}) <> size({high})").union(spark.createDataFrame([(0, "x foo")], "id bigint, t string")).repartition(1), "t", {"foo": "[f]", "bar": "[b]"}).collect()}
    for r in odd:
        places = [*r["high"], *[""] * (len(r["low"]) - len(r["high"]))]
        want = "".join({"foo": "[f]", "bar": "[b]"}.get(r["low"][i] if i < len(r["low"]) else None, p) for i, p in enumerate(places))
        assert found[r["id"]] == want
    assert found[0] == "x [f]"
