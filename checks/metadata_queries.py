"""Metadata lint and lineage. The part table stands in for a metrics catalog: every 20 parts are one
model, every part is one measure (its formula follows from the part's size) and one bound visual.
"""

from pyspark.sql import functions as F

from checks.base import query, rounded, table
from plumbline.operators import metadata as m


def _k():
    return F.col("p_partkey")


def _shape():
    """The kind of formula a part's measure has."""
    return F.col("p_size") % 8


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("M"), F.floor(_k() / 20).cast("string")).alias("model"))


def _name(key, shape):
    return F.when(shape == 5, F.concat(F.lit("Last refresh "), key.cast("string"))).otherwise(F.concat(F.lit("Measure "), key.cast("string")))


def _measures(spark, sf):
    called = F.concat(F.lit("[Measure "), (_k() - 1).cast("string"), F.lit("]"))
    formula = (F.when(_shape() == 0, F.lit("TODAY() - [Base]")).when(_shape() == 1, F.lit("CALCULATE(SUM(fact_sales[amount]), ALL(dim_date))"))
               .when(_shape() == 2, F.concat(called, F.lit(" / [Base]"))).when(_shape() == 3, F.concat(F.lit("DIVIDE("), called, F.lit(", COUNTROWS(fact_sales))")))
               .when(_shape() == 4, F.lit("AVERAGE('fact_sales'[price])")).when(_shape() == 5, F.lit("MAX(dim_customer[joined])"))
               .when(_shape() == 6, F.concat(F.lit("SUM(fact_sales[amount]) + "), called)).otherwise(F.lit("COUNTROWS(dim_customer)")))
    return _part(spark, sf).select("model", F.lit("fact_sales").alias("table"), _name(_k(), _shape()).alias("measure"), formula.alias("expression"),
                                   F.when(F.col("p_size") % 3 == 0, "#,##0").otherwise("0.00%").alias("format"), "p_partkey")


def _models(spark, sf):
    return _part(spark, sf).select("model").distinct()


def _columns(spark, sf):
    def column(table_name, name, kind="data", expression=None):
        return F.struct(F.lit(table_name).alias("table"), F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.lit(expression).cast("string").alias("expression"))
    columns = F.array(column("fact_sales", "amount"), column("fact_sales", "price"), column("dim_customer", "joined"), column("dim_customer", "name"), column("dim_date", "day"),
                      column("dim_date", "is_current", "calculated", "MONTH(dim_date[day]) = MONTH(TODAY())"))
    return _models(spark, sf).select("model", F.explode(columns).alias("c")).select("model", "c.*")


def _relationships(spark, sf):
    def path(column, active):
        return F.struct(F.lit(column).alias("from_column"), F.lit(active).alias("active"))
    even = F.substring("model", F.lit(2), F.length("model")).cast("bigint") % 2 == 0
    paths = F.when(even, F.array(path("first_key", True), path("last_key", False))).otherwise(F.array(path("first_key", True)))
    return _models(spark, sf).select("model", F.explode(paths).alias("p")).select(
        "model", F.lit("fact_sales").alias("from_table"), "p.from_column", F.lit("dim_customer").alias("to_table"), F.lit("customer_key").alias("to_column"), "p.active")


def _tables(spark, sf):
    return _columns(spark, sf).select("model", "table").distinct()


def _bindings(spark, sf):
    bound = F.when(_k() % 5 == 0, F.concat(F.lit("Ghost "), _k().cast("string"))).otherwise(_name(_k(), _shape()))
    kind = F.get(F.array(F.lit("card"), F.lit("table"), F.lit("chart"), F.lit("text box")), (_k() % 4).cast("int"))
    return _part(spark, sf).where("p_partkey % 9 != 0").select(
        "model", F.concat(F.lit("P"), (_k() % 3).cast("string")).alias("page"), F.concat(F.lit("V"), _k().cast("string")).alias("visual"), kind.alias("type"), F.lit("Values").alias("role"),
        F.when(_k() % 6 == 0, "Updated on").otherwise("Sales").alias("title"), F.when(_k() % 7 == 0, "Old name").otherwise(F.concat(F.lit("fact_sales."), bound)).alias("query_name"),
        bound.alias("measure"), bound.alias("label"))


def _partitions(spark, sf):
    source = F.concat(F.lit('let S = Warehouse.Databases(p), D = S{[Name="proj",Kind="Database"]}, E = D{[Name="'), F.lower("model"), F.lit('",Kind="Schema"]}, T = E{[Name="'), F.col("table"), F.lit('",Kind="Table"]} in T'))
    query_text = F.when(F.col("table") == "dim_date", F.lit("CALENDAR(a, b)")).when(F.col("table") == "dim_customer", F.lit('let S = Value.NativeQuery(Warehouse.Contents(p), "select 1") in S')).otherwise(source)
    return _tables(spark, sf).select("model", "table", F.when(F.col("table") == "dim_date", "calculated").otherwise("m").alias("kind"), query_text.alias("query"))


PART = """pt AS (SELECT p_partkey AS k, p_size % 8 AS s, p_size AS size, 'M' || (p_partkey // 20) AS model, CASE WHEN p_size % 8 = 5 THEN 'Last refresh ' || p_partkey ELSE 'Measure ' || p_partkey END AS name,
   CASE WHEN p_size % 3 = 0 THEN '#,##0' ELSE '0.00%' END AS fmt FROM part),
md AS (SELECT DISTINCT model FROM pt),
edge AS (SELECT a.model, a.k, a.name, b.k AS to_k, b.name AS called FROM pt a JOIN pt b ON a.model = b.model AND b.k = a.k - 1 WHERE a.s IN (2, 3, 6) AND b.s <> 5),
direct AS (SELECT model, k, name, UNNEST(CASE s WHEN 1 THEN ['fact_sales', 'dim_date'] WHEN 3 THEN ['fact_sales'] WHEN 4 THEN ['fact_sales'] WHEN 5 THEN ['dim_customer'] WHEN 6 THEN ['fact_sales'] WHEN 7 THEN ['dim_customer'] ELSE [] END) AS tab FROM pt),
reach AS (WITH RECURSIVE step AS (SELECT model, name, k, name AS reached, k AS rk, 0 AS lvl FROM pt UNION ALL SELECT l.model, l.name, l.k, e.called, e.to_k, l.lvl + 1 FROM step l JOIN edge e ON e.k = l.rk) SELECT * FROM step),
closure AS (SELECT r.model, r.name, d.tab, MIN(r.lvl) AS lvl FROM reach r JOIN direct d ON d.k = r.rk GROUP BY 1, 2, 3),
bd AS (SELECT *, 'P' || (k % 3) AS page, 'V' || k AS visual, CASE k % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' ELSE 'text box' END AS type, CASE WHEN k % 5 = 0 THEN 'Ghost ' || k ELSE name END AS bound,
   CASE WHEN k % 6 = 0 THEN 'Updated on' ELSE 'Sales' END AS title FROM pt WHERE k % 9 <> 0)"""
LINT = """lint AS (
  SELECT model, 'lint.volatile_time_in_column' AS method, 'high' AS severity, 'dim_date[is_current]' AS object FROM md
  UNION ALL SELECT model, 'lint.volatile_time_in_measure', 'medium', 'fact_sales[' || name || ']' FROM pt WHERE s = 0
  UNION ALL SELECT model, 'lint.date_context_removed', 'medium', 'fact_sales[' || name || ']' FROM pt WHERE s = 1
  UNION ALL SELECT model, 'lint.raw_division', 'low', 'fact_sales[' || name || ']' FROM pt WHERE s = 2
  UNION ALL SELECT model, 'lint.freshness_label_on_business_date', 'medium', 'fact_sales[' || name || ']' FROM pt WHERE s = 5
  UNION ALL SELECT model, 'lint.format_hides_precision', 'low', 'fact_sales[' || name || ']' FROM pt WHERE s IN (3, 4) AND fmt = '#,##0'
  UNION ALL SELECT model, 'lint.multiple_relationship_paths', 'medium', 'fact_sales -> dim_customer' FROM md WHERE CAST(substr(model, 2) AS INT) % 2 = 0)"""


@query("lint_model", f"WITH {PART}, {LINT} SELECT * FROM lint")
def lint_model(spark, sf):
    return m.lint_model(_columns(spark, sf), _measures(spark, sf), _relationships(spark, sf)).select("model", "method", "severity", "object")


def _lint_query(name, method, build):
    @query(name, f"WITH {PART}, {LINT} SELECT model, object FROM lint WHERE method = '{method}'")
    def run(spark, sf):
        return build(spark, sf).select("model", "object")


_lint_query("lint_volatile_column", "lint.volatile_time_in_column", lambda s, d: m.lint_volatile_columns(_columns(s, d)))
_lint_query("lint_volatile_measure", "lint.volatile_time_in_measure", lambda s, d: m.lint_volatile_measures(_measures(s, d)))
_lint_query("lint_date_context", "lint.date_context_removed", lambda s, d: m.lint_date_context(_measures(s, d)))
_lint_query("lint_raw_division", "lint.raw_division", lambda s, d: m.lint_raw_division(_measures(s, d)))
_lint_query("lint_freshness_measure", "lint.freshness_label_on_business_date", lambda s, d: m.lint_freshness_measures(_measures(s, d)))
_lint_query("lint_integer_format", "lint.format_hides_precision", lambda s, d: m.lint_integer_formats(_measures(s, d)))


@query("lint_relationship_paths", f"WITH {PART}, {LINT} SELECT model, object, 'first_key -> customer_key; last_key -> customer_key (inactive)' AS fragment FROM lint WHERE method = 'lint.multiple_relationship_paths'")
def lint_relationship_paths(spark, sf):
    return m.lint_relationship_paths(_relationships(spark, sf)).select("model", "object", "fragment")


@query("lint_fragments", f"""WITH {PART}
SELECT model, 'fact_sales[' || name || ']' AS object, CASE WHEN s = 1 THEN 'ALL(dim_date)' WHEN s = 2 THEN '[Measure ' || (k - 1) || '] / [Base]' WHEN s = 3 THEN 'format "#,##0" on DIVIDE(...' ELSE 'format "#,##0" on AVERAGE(...' END AS fragment
FROM pt WHERE s IN (1, 2) OR (s IN (3, 4) AND fmt = '#,##0')""")
def lint_fragments(spark, sf):
    x = _measures(spark, sf)
    return m.lint_date_context(x).unionByName(m.lint_raw_division(x)).unionByName(m.lint_integer_formats(x)).select("model", "object", "fragment")


@query("lint_stale_name", f"WITH {PART} SELECT model, page || '/' || visual AS object, 'projection \"Old name\" -> measure \"' || bound || '\"' AS fragment FROM bd WHERE k % 7 = 0")
def lint_stale_name(spark, sf):
    return m.lint_stale_names(_bindings(spark, sf)).select("model", "object", "fragment")


@query("lint_unresolved_measure", f"WITH {PART} SELECT model, page || '/' || visual AS object, bound AS fragment FROM bd WHERE k % 5 = 0")
def lint_unresolved_measure(spark, sf):
    return m.lint_unresolved(_bindings(spark, sf), _measures(spark, sf)).select("model", "object", "fragment")


@query("lint_freshness_title", f"WITH {PART} SELECT model, page || '/' || visual AS object FROM bd WHERE k % 6 = 0 AND k % 5 <> 0")
def lint_freshness_title(spark, sf):
    return m.lint_freshness_titles(_bindings(spark, sf), _measures(spark, sf)).select("model", "object")


@query("lint_summary", f"""WITH {PART}, {LINT} SELECT method, COUNT(*) AS hits FROM lint GROUP BY 1
UNION ALL SELECT 'lint.stale_query_name', COUNT(*) FROM bd WHERE k % 7 = 0 UNION ALL SELECT 'lint.unresolved_measure', COUNT(*) FROM bd WHERE k % 5 = 0""")
def lint_summary(spark, sf):
    """Each finding given twice counts once."""
    a = m.lint_model(_columns(spark, sf), _measures(spark, sf), _relationships(spark, sf))
    b = m.lint_stale_names(_bindings(spark, sf)).unionByName(m.lint_unresolved(_bindings(spark, sf), _measures(spark, sf)))
    return m.lint_summary(a.unionByName(b).unionByName(a))


def _texts(spark, sf):
    text = (F.when(_k() % 4 == 0, F.lit('EVALUATE ROW("x", SUM(fact_sales[amount])) ORDER BY [x]')).when(_k() % 4 == 1, F.lit('EVALUATE ROW("x", SUM(fact_sale[amount]), "f", <fact>)'))
            .when(_k() % 4 == 2, F.lit("EVALUATE FILTER(fact_sales, 'fact_sales'[amout] > 0 && [amount] > 1)"))
            .otherwise(F.concat(F.lit('DEFINE MEASURE fact_sales[Local] = 1 EVALUATE ADDCOLUMNS(dim_customer, "y", [Measure '), _k().cast("string"), F.lit('] + [Local], "d", <date_key>, "e", <date_key>)'))))
    return _part(spark, sf).select("model", _k().cast("string").alias("query_id"), text.alias("text"))


@query("check_references", f"""WITH {PART}
SELECT model, CAST(k AS VARCHAR) AS query_id, 'table' AS kind, 'fact_sale' AS name FROM pt WHERE k % 4 = 1 UNION ALL SELECT model, CAST(k AS VARCHAR), 'column', 'amout' FROM pt WHERE k % 4 = 2
UNION ALL SELECT model, CAST(k AS VARCHAR), 'measure', 'Measure ' || k FROM pt WHERE k % 4 = 3 AND s = 5
UNION ALL SELECT model, CAST(k AS VARCHAR), 'table', 'BY' FROM pt WHERE k % 4 = 0""")
def check_references(spark, sf):
    return m.check_references(_texts(spark, sf), _columns(spark, sf), _measures(spark, sf)).select("model", "query_id", "kind", "name")


@query("closest_name", f"""WITH {PART}
SELECT model, kind, name, CASE name WHEN 'fact_sale' THEN 'fact_sales' WHEN 'amout' THEN 'amount' END AS closest FROM (SELECT DISTINCT model, 'table' AS kind, 'BY' AS name FROM pt WHERE k % 4 = 0 UNION ALL SELECT DISTINCT model, 'table' AS kind, 'fact_sale' AS name FROM pt WHERE k % 4 = 1 UNION ALL SELECT DISTINCT model, 'column', 'amout' FROM pt WHERE k % 4 = 2)""")
def closest_name(spark, sf):
    out = m.check_references(_texts(spark, sf), _columns(spark, sf), _measures(spark, sf))
    return out.where("kind != 'measure'").select("model", "kind", "name", "closest").distinct()


#: Longest common block of two texts, the earliest in the first and then in the second: length k, negated places i and j.
BLOCK = """list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(b) + 1), lambda j:
  {'k': len(list_filter(range(1, least(len(a) - i, len(b) - j) + 2), lambda n: a[i:i + n - 1] = b[j:j + n - 1])), 'i': -i, 'j': -j}))))"""
#: Similarity of the texts x and y of ``pairs`` by longest matching blocks.
RATIOS = f"""seg AS (SELECT x, y, x AS a, y AS b, CAST(0 AS BIGINT) AS k FROM pairs UNION ALL SELECT x, y, s.a, s.b, s.k FROM (
  SELECT x, y, UNNEST([{{'a': a[:-m.i - 1], 'b': b[:-m.j - 1], 'k': m.k}}, {{'a': a[-m.i + m.k:], 'b': b[-m.j + m.k:], 'k': 0}}]) AS s FROM (SELECT x, y, a, b, {BLOCK} AS m FROM seg WHERE a <> '' AND b <> '') WHERE m.k > 0)),
ratio AS (SELECT x, y, 2.0 * SUM(k) / (len(x) + len(y)) AS r FROM seg GROUP BY x, y)"""


@query("closest_measure", f"""WITH RECURSIVE {PART}, asked AS (SELECT DISTINCT model, 'Measure ' || k AS name FROM pt WHERE k % 4 = 3 AND s = 5),
pairs AS (SELECT DISTINCT lower(p.name) AS x, lower(a.name) AS y FROM asked a JOIN pt p USING (model)), {RATIOS}
SELECT a.model, a.name, ARG_MAX(p.name, (r, x)) AS closest FROM asked a LEFT JOIN (pt p JOIN ratio ON x = lower(p.name) AND r >= 0.6) ON p.model = a.model AND y = lower(a.name) GROUP BY 1, 2""")
def closest_measure(spark, sf):
    """Unknown measures against all measures of their model, by longest matching blocks."""
    out = m.check_references(_texts(spark, sf), _columns(spark, sf), _measures(spark, sf))
    return out.where("kind = 'measure'").select("model", "name", "closest").distinct()


@query("error_suggestions", f"""WITH RECURSIVE {PART}, told AS (SELECT model, CAST(k AS VARCHAR) AS error_id, UNNEST(['Measur ' || (k // 20) || CASE WHEN k % 2 = 0 THEN '7' ELSE '12' END, 'dim_custmer', 'amout']) AS name FROM pt),
known AS (SELECT model, name FROM pt UNION ALL SELECT model, UNNEST(['fact_sales', 'dim_customer', 'dim_date', 'amount', 'price', 'joined', 'name', 'day', 'is_current']) FROM md),
pairs AS (SELECT DISTINCT lower(k.name) AS x, lower(t.name) AS y FROM told t JOIN known k USING (model)), {RATIOS},
best AS (SELECT model, y, STRING_AGG(name, ', ' ORDER BY r DESC, x DESC) AS names FROM (SELECT k.model, k.name, x, y, r FROM (SELECT DISTINCT model, lower(name) AS y FROM told) JOIN ratio USING (y) JOIN known k USING (model)
  WHERE x = lower(k.name) AND r >= 0.6 QUALIFY ROW_NUMBER() OVER (PARTITION BY k.model, y ORDER BY r DESC, x DESC) <= 3) GROUP BY 1, 2)
SELECT t.model, error_id, t.name, 'Engine mentioned ''' || t.name || '''; closest model names: ' || names AS note FROM told t JOIN best b ON b.model = t.model AND b.y = lower(t.name)
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.model = t.model AND lower(k.name) = lower(t.name))""")
def error_suggestions(spark, sf):
    """Engine errors that quote a mistyped measure, table and column each, and one real name."""
    ending = F.when(_k() % 2 == 0, "7").otherwise("12")
    message = F.concat(F.lit("Column 'amout' in \"dim_custmer\" or measure 'Measur "), F.floor(_k() / 20).cast("string"), ending, F.lit("' cannot be found; see 'fact_sales'."))
    errors = _part(spark, sf).select("model", _k().cast("string").alias("error_id"), message.alias("message"))
    return m.suggest_from_error(errors, _columns(spark, sf), _measures(spark, sf)).select("model", "error_id", "name", "note")


@query("unfilled_placeholders", f"WITH {PART} SELECT CAST(k AS VARCHAR) AS query_id, CASE WHEN k % 4 = 1 THEN '<fact>' ELSE '<date_key>' END AS placeholders FROM pt WHERE k % 4 IN (1, 3)")
def unfilled_placeholders(spark, sf):
    return rounded(m.unfilled_placeholders(_texts(spark, sf), "text").where("size(placeholders) > 0").select("query_id", "placeholders"))


@query("expression_references", f"WITH {PART} SELECT model, name AS measure, 'table' AS kind, tab AS name FROM direct UNION ALL SELECT model, name, 'measure', called FROM edge")
def expression_references(spark, sf):
    return m.expression_references(_measures(spark, sf), _tables(spark, sf))


@query("called_measures", f"WITH {PART} SELECT model, name AS measure, reached, CAST(MIN(lvl) AS BIGINT) AS level FROM reach GROUP BY 1, 2, 3")
def called_measures(spark, sf):
    x = _measures(spark, sf)
    return rounded(m.called_measures(m.expression_measures(x), x))


@query("measure_closure", f'WITH {PART} SELECT model, name AS measure, tab AS "table", CAST(lvl AS BIGINT) AS level FROM closure WHERE lvl <= 4')
def measure_closure(spark, sf):
    return rounded(m.measure_closure(_measures(spark, sf), _tables(spark, sf), depth=4))


CHAIN = """pt AS (SELECT p_partkey AS k, p_partkey // 20 AS g, 'M' || (p_partkey // 20) AS model, 'Measure ' || p_partkey AS name FROM part),
edge AS (SELECT a.model, a.name, b.name AS called FROM pt a JOIN pt b ON a.g = b.g AND (b.k = a.k - 1 OR (a.g % 2 = 0 AND a.k % 20 = 0 AND b.k % 20 = 19))),
step AS (SELECT model, name, name AS reached, 0 AS lvl FROM pt UNION ALL SELECT s.model, s.name, e.called, lvl + 1 FROM step s JOIN edge e ON e.model = s.model AND e.name = s.reached WHERE lvl < 20),
reach AS (SELECT model, name, reached, MIN(lvl) AS lvl FROM step GROUP BY 1, 2, 3)"""


def _chained(spark, sf):
    """Measures that each call the one before; in every other model the first calls the last, so that all twenty are a cycle."""
    g = F.floor(_k() / 20)
    last = F.concat(F.lit("[Measure "), (_k() + 19).cast("string"), F.lit("]"))
    first = F.when(g % 2 == 0, F.concat(last, F.lit(" + COUNTROWS(dim_date)"))).otherwise("COUNTROWS(dim_date)")
    formula = F.when(_k() % 20 == 0, first).otherwise(F.concat(F.lit("[Measure "), (_k() - 1).cast("string"), F.lit("] + 1")))
    return _part(spark, sf).select("model", F.concat(F.lit("Measure "), _k().cast("string")).alias("measure"), formula.alias("expression"))


@query("closure_long_chains", f"""WITH RECURSIVE {CHAIN} SELECT model, name AS measure, 'dim_date' AS "table", CAST(lvl AS BIGINT) AS level FROM reach WHERE CAST(substr(reached, 9) AS BIGINT) % 20 = 0""")
def closure_long_chains(spark, sf):
    """Tables behind up to nineteen calls."""
    return rounded(m.measure_closure(_chained(spark, sf), _tables(spark, sf)))


def _flags_sql(depth):
    return f"""WITH RECURSIVE {CHAIN}, near AS (SELECT * FROM reach WHERE lvl <= {depth}), onward AS (SELECT DISTINCT r.model, r.name, e.called FROM near r JOIN edge e ON e.model = r.model AND e.name = r.reached)
SELECT n.model, n.name AS measure, COUNT(*) - 1 AS reached, CAST(MAX(lvl) AS BIGINT) AS levels, COALESCE(BOOL_OR(around), FALSE) AS cyclic, COALESCE(BOOL_OR(missing), FALSE) AS cut FROM near n
LEFT JOIN (SELECT o.model, o.name, BOOL_OR(o.called = o.name) AS around, BOOL_OR(x.reached IS NULL) AS missing FROM onward o LEFT JOIN near x ON x.model = o.model AND x.name = o.name AND x.reached = o.called GROUP BY 1, 2) f USING (model, name) GROUP BY 1, 2"""


@query("closure_flags", _flags_sql(20))
def closure_flags(spark, sf):
    x = _chained(spark, sf)
    edges = m.expression_measures(x)
    return rounded(m.reach_flags(m.called_measures(edges, x), edges))


@query("closure_flags_cut", _flags_sql(4))
def closure_flags_cut(spark, sf):
    """The same calls followed four times only: whatever that leaves out is flagged."""
    x = _chained(spark, sf)
    edges = m.expression_measures(x)
    return rounded(m.reach_flags(m.called_measures(edges, x, depth=4), edges))


@query("measures_used", f"""WITH {PART}, u AS (SELECT model, bound, COUNT(*) AS uses, STRING_AGG(page || '/' || visual, '; ' ORDER BY page || '/' || visual) AS used_by FROM bd GROUP BY 1, 2)
SELECT COALESCE(p.model, u.model) AS model, COALESCE(name, bound) AS measure, u.uses IS NOT NULL AS used, p.name IS NOT NULL AS captured, COALESCE(uses, 0) AS uses, COALESCE(used_by, '') AS used_by
FROM pt p FULL JOIN u ON p.model = u.model AND p.name = u.bound""")
def measures_used(spark, sf):
    return m.measures_used(_bindings(spark, sf), _measures(spark, sf))


SOURCES = """src AS (SELECT model, UNNEST(['fact_sales', 'dim_customer', 'dim_date']) AS tab, UNNEST(['Warehouse, table ' || lower(model) || '.fact_sales', 'Value, a native query', 'calculated inside the model']) AS source FROM md)"""


@query("table_sources", f'WITH {PART}, {SOURCES} SELECT model, tab AS "table", source, CAST(1 AS BIGINT) AS partitions FROM src')
def table_sources(spark, sf):
    return m.table_sources(_partitions(spark, sf))


@query("tables_for_measures", f"""WITH {PART}, {SOURCES}
SELECT c.model, c.tab AS "table", COUNT(*) AS measures, MAX(source) AS source, CAST(CASE WHEN c.tab LIKE 'fact%' THEN 0 ELSE 1 END AS BIGINT) AS rank
FROM closure c JOIN src USING (model, tab) WHERE EXISTS (SELECT 1 FROM bd WHERE bd.model = c.model AND bd.bound = c.name) GROUP BY 1, 2""")
def tables_for_measures(spark, sf):
    x = _measures(spark, sf)
    used = m.measures_used(_bindings(spark, sf), x)
    return rounded(m.tables_for_measures(m.measure_closure(x, _tables(spark, sf)), used, m.table_sources(_partitions(spark, sf))))


@query("expression_chips", f"""WITH {PART}, own AS (SELECT k AS rk, CASE s WHEN 0 THEN 'reads the clock' WHEN 1 THEN 'removes filters' ELSE 'divides without a guard' END AS chip FROM pt WHERE s IN (0, 1, 2, 3))
SELECT model, name AS measure, chip, ARG_MIN(reached, lvl) AS found_in, CAST(MIN(lvl) AS BIGINT) AS level FROM reach JOIN own USING (rk) GROUP BY 1, 2, 3""")
def expression_chips(spark, sf):
    return rounded(m.expression_chips(_measures(spark, sf)))


@query("number_chains", f"""WITH {PART}, {SOURCES}
SELECT b.model, b.page, b.visual, CASE WHEN type = 'card' THEN 'on a card' ELSE 'as a table total' END AS how, b.bound AS measure, c.tab AS "table", source
FROM bd b LEFT JOIN closure c ON c.model = b.model AND c.name = b.bound LEFT JOIN src s ON s.model = c.model AND s.tab = c.tab WHERE type IN ('card', 'table')""")
def number_chains(spark, sf):
    x = _measures(spark, sf)
    out = m.number_chains(_bindings(spark, sf), x, m.measure_closure(x, _tables(spark, sf)), m.table_sources(_partitions(spark, sf)))
    return out.drop("expression")


@query("coverage_gaps", f"""WITH {PART}
SELECT model, 'visual without fields' AS gap, 'P' || (k % 3) || '/V' || k AS object FROM pt WHERE k % 9 = 0 AND k % 4 <> 3
UNION ALL SELECT DISTINCT model, 'page never captured', 'P2' FROM pt WHERE k % 3 = 2
UNION ALL SELECT DISTINCT model, 'measure without definition', bound FROM bd WHERE k % 5 = 0""")
def coverage_gaps(spark, sf):
    kind = F.get(F.array(F.lit("card"), F.lit("table"), F.lit("chart"), F.lit("text box")), (_k() % 4).cast("int"))
    visuals = _part(spark, sf).select("model", F.concat(F.lit("P"), (_k() % 3).cast("string")).alias("page"), F.concat(F.lit("V"), _k().cast("string")).alias("visual"), kind.alias("type"))
    captured = visuals.select("model", F.lower("page").alias("page")).where("page != 'p2'").distinct()
    return m.coverage_gaps(visuals, _bindings(spark, sf), _measures(spark, sf), captured)


def _reports(spark, sf):
    """One report definition per model, its visuals grouped by page (a model has at most 20 visuals)."""
    b = _bindings(spark, sf)

    def literal(column):
        return F.concat(F.lit("'"), column, F.lit("'"))
    title = F.struct(F.array(F.struct(F.struct(F.struct(F.struct(F.struct(literal(F.col("title")).alias("Value")).alias("Literal")).alias("expr")).alias("text")).alias("properties"))).alias("title"))
    select = F.array(F.struct(F.col("query_name").alias("Name"), F.struct(F.col("measure").alias("Property")).alias("Measure")))
    single = F.struct(F.col("type").alias("visualType"), F.create_map(F.col("role"), F.array(F.struct(F.col("query_name").alias("queryRef")))).alias("projections"),
                      F.struct(select.alias("Select")).alias("prototypeQuery"), title.alias("vcObjects"))
    config = F.to_json(F.struct(F.col("visual").alias("name"), (F.substring("visual", F.lit(2), F.length("visual")).cast("bigint") % 2 == 0).alias("isHidden"), single.alias("singleVisual")))
    values = F.transform(F.sequence(F.lit(1), F.substring("visual", F.lit(2), F.length("visual")).cast("int") % 11 + 1), lambda i: F.array(F.struct(F.struct(literal(i.cast("string")).alias("Value")).alias("Literal"))))
    where = F.array(F.struct(F.struct(F.struct(values.alias("Values")).alias("In")).alias("Condition")))
    column = F.struct(F.struct(F.struct(F.struct(F.lit("dim_customer").alias("Entity")).alias("SourceRef")).alias("Expression"), F.lit("name").alias("Property")).alias("Column"))
    filters = F.to_json(F.array(F.struct(F.lit("Categorical").alias("type"), column.alias("expression"), F.struct(where.alias("Where")).alias("filter"))))
    pages = b.groupBy("model", "page").agg(F.collect_list(F.struct(config.alias("config"), filters.alias("filters"))).alias("visualContainers"))
    sections = pages.groupBy("model").agg(F.collect_list(F.struct(F.concat(F.lit("id"), F.col("page")).alias("name"), F.col("page").alias("displayName"), F.lit("[]").alias("filters"), "visualContainers")).alias("sections"))
    report = F.to_json(F.array(F.struct(F.lit("Advanced").alias("type"), column.alias("expression"))))
    return sections.select("model", F.to_json(F.struct(report.alias("filters"), "sections")).alias("document"))


@query("flatten_report", f"WITH {PART} SELECT model, 'id' || page AS page_id, page, visual, type, k % 2 = 0 AS hidden, title, CAST(1 AS BIGINT) AS fields FROM bd")
def flatten_report(spark, sf):
    flat = m.flatten_report(_reports(spark, sf))
    return flat.select("model", "page_id", "page", "visual", "type", "hidden", "title", F.size("projections").cast("bigint").alias("fields"))


@query("visual_bindings", f"WITH {PART} SELECT model, page, visual, 'Values' AS role, CASE WHEN k % 7 = 0 THEN 'Old name' ELSE 'fact_sales.' || bound END AS query_name, bound AS measure FROM bd")
def visual_bindings(spark, sf):
    return m.visual_bindings(m.flatten_report(_reports(spark, sf))).select("model", "page", "visual", "role", "query_name", "measure")


@query("filter_restrictions", f"""WITH {PART}
SELECT model, 'visual' AS level, page, visual, 'dim_customer[name]' AS field, 'Categorical' AS kind, 'restricted' AS state, CAST(k % 11 + 1 AS BIGINT) AS listed, ARRAY_TO_STRING(GENERATE_SERIES(1, k % 11 + 1), ';') AS "values" FROM bd
UNION ALL SELECT DISTINCT model, 'report', '', '', 'dim_customer[name]', 'Advanced', 'offered', CAST(0 AS BIGINT), '' FROM bd""")
def filter_restrictions(spark, sf):
    return rounded(m.filter_restrictions(m.flatten_report(_reports(spark, sf))))


@query("flatten_visual_documents", f"WITH {PART} SELECT model, page, visual, type, title, bound AS measure FROM bd")
def flatten_visual_documents(spark, sf):
    """The same visuals stored one document each."""
    b = _bindings(spark, sf)
    field = F.struct(F.struct(F.col("measure").alias("Property")).alias("Measure"))
    state = F.create_map(F.col("role"), F.struct(F.array(F.struct(F.col("query_name").alias("queryRef"), field.alias("field"))).alias("projections")))
    title = F.array(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("title").alias("Value")).alias("Literal")).alias("expr")).alias("text")).alias("properties")))
    visual = F.struct(F.col("type").alias("visualType"), F.struct(state.alias("queryState")).alias("query"), F.struct(title.alias("title")).alias("visualContainerObjects"))
    documents = b.select("model", F.col("page").alias("page_id"), "page", F.to_json(F.struct(F.col("visual").alias("name"), visual.alias("visual"))).alias("document"))
    return m.visual_bindings(m.flatten_visuals(documents)).select("model", "page", "visual", "type", "title", "measure")


@query("model_catalog", f"""WITH {PART}
SELECT model, 'table' AS object, 'T' || (k % 2) AS "table", 'T' || (k % 2) AS name, NULL AS target FROM pt WHERE k % 20 < 2
UNION ALL SELECT model, 'column', CASE WHEN k % 3 = 2 THEN 'unresolved:2' ELSE 'T' || (k % 3) END, 'c' || k, NULL FROM pt
UNION ALL SELECT model, 'measure', CASE WHEN k % 3 = 2 THEN 'unresolved:2' ELSE 'T' || (k % 3) END, name, NULL FROM pt
UNION ALL SELECT model, 'partition', CASE WHEN k % 3 = 2 THEN 'unresolved:2' ELSE 'T' || (k % 3) END, 'p' || k, NULL FROM pt
UNION ALL SELECT model, 'relationship', CASE WHEN k % 3 = 2 THEN 'unresolved:2' ELSE 'T' || (k % 3) END, CASE WHEN k % 3 = 2 THEN 'unresolved:2' ELSE 'T' || (k % 3) END || '[c' || k || ']', 'unresolved:-1' FROM pt""")
def model_catalog(spark, sf):
    """Ids 0 and 1 resolve to tables; id 2 does not exist."""
    p = _part(spark, sf)
    tables = p.where("p_partkey % 20 < 2").select("model", (_k() % 2).alias("id"), F.concat(F.lit("T"), (_k() % 2).cast("string")).alias("name"))
    columns = p.select("model", _k().alias("id"), (_k() % 3).alias("table_id"), F.when(_k() % 2 == 0, F.concat(F.lit("c"), _k().cast("string"))).alias("explicit_name"), F.concat(F.lit("c"), _k().cast("string")).alias("inferred_name"))
    measures = p.select("model", (_k() % 3).alias("table_id"), _name(_k(), _shape()).alias("name"))
    partitions = p.select("model", (_k() % 3).alias("table_id"), F.concat(F.lit("p"), _k().cast("string")).alias("name"))
    rels = p.select("model", _k().alias("id"), _k().alias("from_column_id"), F.lit(-1).cast("bigint").alias("to_column_id"), F.lit(True).alias("active"))
    return m.model_catalog(tables, columns, measures, rels, partitions)
