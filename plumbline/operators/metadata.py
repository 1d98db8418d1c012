"""Lint and lineage over metric metadata held in tables.

Frames carry a ``model`` column, so any number of models or reports is scanned in one job:

* ``columns``        model, table, column, kind (``calculated`` or other), expression
* ``measures``       model, table, measure, expression, format
* ``relationships``  model, from_table, from_column, to_table, to_column, active
* ``partitions``     model, table, kind (``calculated`` or other), query
* ``bindings``       model, page, visual, type, role, title, query_name, measure, label
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.relational import shuffled
from plumbline.functions.scalars import lookup
from plumbline.operators.names import similar_names
from plumbline.session import stored

FINDING = ["model", "method", "severity", "object", "kind", "fragment"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _finding(df: DataFrame, bad: Column, method: str, severity: str, obj: Column, kind: str, fragment: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(
        "model", F.lit(method).alias("method"), F.lit(severity).alias("severity"), obj.alias("object"), F.lit(kind).alias("kind"), fragment.alias("fragment"))


def _field(name: str) -> Column:
    return F.concat(F.coalesce("table", F.lit("?")), F.lit("["), F.coalesce(name, F.lit("")), F.lit("]"))


def _expression() -> Column:
    return F.trim("expression")


def lint_volatile_columns(columns: DataFrame) -> DataFrame:
    bad = (F.col("kind") == "calculated") & F.col("expression").rlike(fixed.VOLATILE)
    return _finding(columns, bad, "lint.volatile_time_in_column", "high", _field("column"), "calculated_column", _expression())


def lint_volatile_measures(measures: DataFrame) -> DataFrame:
    return _finding(measures, F.col("expression").rlike(fixed.VOLATILE), "lint.volatile_time_in_measure", "medium", _field("measure"), "measure", _expression())


def lint_date_context(measures: DataFrame) -> DataFrame:
    fragment = F.regexp_extract("expression", fixed.DATE_CONTEXT_REMOVAL, 0)
    return _finding(measures, F.col("expression").rlike(fixed.DATE_CONTEXT_REMOVAL), "lint.date_context_removed", "medium", _field("measure"), "measure", fragment)


def lint_raw_division(measures: DataFrame) -> DataFrame:
    bad = F.col("expression").rlike(fixed.RAW_DIVISION) & ~F.contains(F.upper("expression"), F.lit("DIVIDE"))
    return _finding(measures, bad, "lint.raw_division", "low", _field("measure"), "measure", _expression())


def lint_freshness_measures(measures: DataFrame) -> DataFrame:
    bad = F.col("measure").rlike(fixed.FRESHNESS_WORDS) & ~F.coalesce("expression", F.lit("")).rlike(fixed.FRESHNESS_SOURCE)
    return _finding(measures, bad, "lint.freshness_label_on_business_date", "medium", _field("measure"), "measure", F.coalesce(_expression(), F.lit("")))


def lint_integer_formats(measures: DataFrame) -> DataFrame:
    bad = F.col("expression").rlike(fixed.STATISTIC) & F.col("format").rlike(fixed.INTEGER_FORMAT)
    fragment = F.concat(F.lit('format "'), F.col("format"), F.lit('" on '), F.regexp_extract("expression", fixed.STATISTIC, 0), F.lit("..."))
    return _finding(measures, bad, "lint.format_hides_precision", "low", _field("measure"), "measure", fragment)


def lint_relationship_paths(relationships: DataFrame) -> DataFrame:
    """Several relationships between the same two tables, all of them listed in name order (as many as the two tables have columns)."""
    pair = ["model", "from_table", "to_table"]
    rows = relationships.where("from_table is not null and to_table is not null")
    counts = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")
    path = F.concat(F.col("from_column"), F.lit(" -> "), F.col("to_column"), F.when(F.col("active"), "").otherwise(" (inactive)"))
    listed = rows.groupBy(*pair).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_column", "to_column", path.alias("p")))), lambda x: x["p"]), "; ").alias("fragment"))
    found = counts.join(listed, pair)
    obj = F.concat(F.col("from_table"), F.lit(" -> "), F.col("to_table"))
    return _finding(found, F.lit(True), "lint.multiple_relationship_paths", "medium", obj, "relationship", F.col("fragment"))


def lint_model(columns: DataFrame, measures: DataFrame, relationships: DataFrame) -> DataFrame:
    return _union([lint_volatile_columns(columns), lint_volatile_measures(measures), lint_date_context(measures), lint_raw_division(measures),
                   lint_freshness_measures(measures), lint_integer_formats(measures), lint_relationship_paths(relationships)])


def _where_used() -> Column:
    return F.concat_ws("/", "page", "visual")


def lint_stale_names(bindings: DataFrame) -> DataFrame:
    bad = ((F.col("measure") != "") & (F.col("query_name") != "") & ~F.contains("query_name", "measure")
           & (F.substring_index("query_name", ".", -1) != F.col("measure")))
    fragment = F.concat(F.lit('projection "'), F.col("query_name"), F.lit('" -> measure "'), F.col("measure"), F.lit('"'))
    return _finding(bindings, bad, "lint.stale_query_name", "low", _where_used(), "visual", fragment)


def lint_unresolved(bindings: DataFrame, measures: DataFrame) -> DataFrame:
    lost = bindings.where("measure != ''").join(measures.select("model", "measure"), ["model", "measure"], "left_anti")
    return _finding(lost, F.lit(True), "lint.unresolved_measure", "medium", _where_used(), "visual", F.col("measure"))


def lint_freshness_titles(bindings: DataFrame, measures: DataFrame) -> DataFrame:
    titled = bindings.where(F.col("title").rlike(fixed.FRESHNESS_WORDS)).join(measures.select("model", "measure", "expression"), ["model", "measure"])
    bad = ~F.coalesce("expression", F.lit("")).rlike(fixed.FRESHNESS_SOURCE)
    fragment = F.concat(F.lit('title "'), F.col("title"), F.lit('" bound to '), F.col("measure"), F.lit(" = "), F.coalesce(_expression(), F.lit("")))
    return _finding(titled, bad, "lint.freshness_label_on_business_date", "medium", _where_used(), "visual", fragment)


def lint_report(bindings: DataFrame, measures: DataFrame) -> DataFrame:
    return _union([lint_stale_names(bindings), lint_unresolved(bindings, measures), lint_freshness_titles(bindings, measures)])


def lint_dedupe(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["model", "method", "object", "fragment"])


def lint_summary(findings: DataFrame) -> DataFrame:
    return lint_dedupe(findings).groupBy("method").agg(F.count(F.lit(1)).alias("hits"))


# --- references ------------------------------------------------------------------------


def unfilled_placeholders(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("placeholders", F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(fixed.PLACEHOLDER), F.lit(0))))


def check_references(queries: DataFrame, columns: DataFrame, measures: DataFrame) -> DataFrame:
    """References of stored query text that the model does not have, with the closest real name.

    ``queries``: model, query_id, text. A bare ``[X]`` is accepted when it is a measure, a measure or
    alias the query defines itself, or a column of a table the query already names. A model without captured
    columns says nothing about its queries, which are then left out.
    """
    text = F.col("text")
    queries = queries.join(shuffled(columns.select("model").distinct()), "model", "left_semi")
    local = F.concat(F.regexp_extract_all(text, F.lit(fixed.DEFINED_MEASURE), F.lit(1)), F.regexp_extract_all(text, F.lit(fixed.ALIAS), F.lit(1)))
    scan = F.regexp_replace(text, fixed.DEFINED_MEASURE, " ")
    q = queries.select("model", "query_id", F.transform(local, lambda x: F.lower(F.trim(x))).alias("_local"), scan.alias("_scan"))
    q = q.withColumn("_qualified", F.regexp_extract_all("_scan", F.lit(fixed.QUALIFIED_REFERENCE), F.lit(0))).withColumn(
        "_rest", F.regexp_replace("_scan", fixed.QUALIFIED_REFERENCE, " "))
    refs = q.select("model", "query_id", "_local", F.explode(F.array_distinct("_qualified")).alias("_ref"))
    quoted, bare = F.regexp_extract("_ref", fixed.QUALIFIED_REFERENCE, 1), F.regexp_extract("_ref", fixed.QUALIFIED_REFERENCE, 2)
    refs = refs.select("model", "query_id", "_local", F.trim(F.when(quoted != "", quoted).otherwise(bare)).alias("table"),
                       F.trim(F.regexp_extract("_ref", fixed.QUALIFIED_REFERENCE, 3)).alias("name"))
    refs = refs.withColumns({"_t": F.lower("table"), "_x": F.lower("name")})
    tables = columns.groupBy("model", F.lower("table").alias("_t")).agg(F.min("table").alias("_table"))
    cols = columns.select("model", F.lower("table").alias("_t"), F.lower("column").alias("_x")).distinct().withColumn("_is_column", F.lit(True))
    names = measures.select("model", F.lower("measure").alias("_x")).distinct().withColumn("_is_measure", F.lit(True))
    refs = stored(refs.join(shuffled(tables), ["model", "_t"], "left").join(shuffled(cols), ["model", "_t", "_x"], "left").join(shuffled(names), ["model", "_x"], "left"))
    is_local = F.array_contains("_local", F.col("_x"))
    kind = F.when(F.col("_table").isNull(), "table").when(F.col("_is_column").isNull() & F.col("_is_measure").isNull() & ~is_local, "column")
    qualified = refs.withColumn("kind", kind).where("kind is not null").select(
        "model", "query_id", "kind", F.when(F.col("kind") == "table", F.col("table")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("kind") == "column", F.col("_t")).alias("_t"))
    visible = refs.where("_table is not null").select("model", "query_id", "_t").distinct().join(shuffled(cols), ["model", "_t"]).select(
        "model", "query_id", "_x").distinct().withColumn("_visible", F.lit(True))
    plain = q.select("model", "query_id", "_local", F.explode(F.array_distinct(F.regexp_extract_all("_rest", F.lit(fixed.BRACKETED), F.lit(1)))).alias("name"))
    plain = plain.withColumn("name", F.trim("name")).withColumn("_x", F.lower("name"))
    plain = plain.join(shuffled(names), ["model", "_x"], "left").join(shuffled(visible), ["model", "query_id", "_x"], "left")
    unknown = plain.where("_is_measure is null and _visible is null and not array_contains(_local, _x)").select(
        "model", "query_id", F.lit("measure").alias("kind"), "name", F.lit(None).cast("string").alias("_t"))
    problems = stored(qualified.unionByName(unknown).distinct())
    table_names = columns.select("model", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("_t"), F.col("table").alias("candidate"))
    column_names = columns.select("model", F.lit("column").alias("kind"), F.lower("table").alias("_t"), F.col("column").alias("candidate"))
    measure_names = measures.select("model", F.lit("measure").alias("kind"), F.lit(None).cast("string").alias("_t"), F.col("measure").alias("candidate"))
    candidates = table_names.unionByName(column_names).unionByName(measure_names)
    # a measure may also be meant as a column of a table that its query names
    columns_too = problems.where("kind = 'measure'").select("model", "query_id", "name").join(shuffled(refs.where("_table is not null").select("model", "query_id", "_t").distinct()), ["model", "query_id"])
    own = problems.select("model", "query_id", "name", "kind", "_t", F.col("kind").alias("_shown"))
    places = own.unionByName(columns_too.select("model", "query_id", "name", F.lit("column").alias("kind"), "_t", F.lit("measure").alias("_shown")))
    found = similar_names(places.select("model", "kind", "_t", "name"), candidates, ["model", "kind", "_t"], "name").withColumnsRenamed(
        {"model": "_m", "kind": "_k", "_t": "_tt", "name": "_n"})
    met = places.join(shuffled(found), (F.col("model") == F.col("_m")) & (F.col("kind") == F.col("_k")) & F.col("_t").eqNullSafe(F.col("_tt")) & (F.lower("name") == F.col("_n")), "left")
    return met.groupBy("model", "query_id", F.col("_shown").alias("kind"), "name").agg(F.max_by("closest", F.struct("ratio", F.lower("closest").alias("_c"))).alias("closest"))


def closest_name(names: DataFrame, candidates: DataFrame, scope: list[str], name: str, cutoff: float = 0.6) -> DataFrame:
    """Best match of each name within its own scope (one model, one table), or null. A null scope value matches a null one."""
    found = similar_names(names, candidates, scope, name, 1, cutoff).drop("rank", "ratio")
    other = found.withColumnsRenamed({c: f"_f_{c}" for c in (*scope, name)})
    condition = reduce(lambda a, b: a & b, [names[s].eqNullSafe(other[f"_f_{s}"]) for s in scope], F.lower(names[name]) == other[f"_f_{name}"])
    return names.join(shuffled(other), condition, "left").select(*names.columns, "closest")


def suggest_from_error(errors: DataFrame, columns: DataFrame, measures: DataFrame, top: int = 3) -> DataFrame:
    """Closest real names for the identifiers that an engine's error text quotes and its model lacks.

    ``errors``: model, error_id, message. One row per unknown identifier with a similar name: the ``names`` in order and the note that
    shows them. A model without captured columns says nothing about its errors.
    """
    quoted = F.regexp_extract_all("message", F.lit(fixed.ERROR_IDENTIFIER), F.lit(0))
    told = errors.join(shuffled(columns.select("model").distinct()), "model", "left_semi").select("model", "error_id", F.explode(F.array_distinct(quoted)).alias("_q"))
    told = told.withColumn("name", F.trim(F.substring("_q", F.lit(2), F.length("_q") - 2))).where("name != ''").drop("_q").distinct()
    known = columns.select("model", F.col("table").alias("candidate")).unionByName(columns.select("model", F.col("column").alias("candidate"))).unionByName(
        measures.select("model", F.col("measure").alias("candidate")))
    low = known.select("model", F.lower("candidate").alias("_low")).distinct()
    unknown = stored(told.withColumn("_low", F.lower("name")).join(shuffled(low), ["model", "_low"], "left_anti"))
    found = similar_names(unknown.select("model", F.col("_low").alias("name")), known, ["model"], "name", top, row_numbers=True)
    lists = found.groupBy("model", F.col("name").alias("_low")).agg(F.sort_array(F.collect_list(F.struct("rank", "closest"))).alias("_l"))
    shown = unknown.join(shuffled(lists), ["model", "_low"]).withColumn("names", F.transform("_l", lambda x: x["closest"]))
    note = F.concat(F.lit("Engine mentioned '"), F.col("name"), F.lit("'; closest model names: "), F.array_join("names", ", "))
    return shown.select("model", "error_id", "name", "names", note.alias("note"))


def _words(expression: Column) -> Column:
    quoted = F.regexp_extract_all(expression, F.lit(r"'([^']+)'"), F.lit(1))
    return F.array_distinct(F.concat(quoted, *[F.regexp_extract_all(expression, F.lit(p), F.lit(0)) for p in (r"[\p{L}_][\p{L}\p{N}_]*", r"[\p{L}_][\p{L}\p{N}_]*(?:-[\p{L}\p{N}_]+)+")]))


def expression_tables(measures: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of the model that an expression names: words of the expression meet table names in an equi-join."""
    words = measures.select("model", "measure", F.explode(_words(F.coalesce("expression", F.lit("")))).alias("table"))
    return words.join(tables.select("model", "table").distinct(), ["model", "table"]).select("model", "measure", "table")


def expression_measures(measures: DataFrame) -> DataFrame:
    """Measures of the model an expression calls: a bracketed name that no table qualifies."""
    text = F.coalesce("expression", F.lit(""))
    qualified = r"'[^']+'\s*\[[^\]\[]+\]|(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_ -]*?\s*\[[^\]\[]+\]"
    free = F.regexp_replace(text, qualified, " ")
    called = F.array_distinct(F.transform(F.regexp_extract_all(free, F.lit(r"(?<!\])\[([^\]\[]+)\]"), F.lit(1)), lambda m: F.lower(F.trim(m))))
    calls = measures.select("model", "measure", F.explode(called).alias("_m"))
    known = measures.select("model", F.lower(F.trim("measure")).alias("_m"), F.col("measure").alias("called")).dropDuplicates(["model", "_m"])
    return calls.join(known, ["model", "_m"]).select("model", "measure", "called").distinct()


def expression_references(measures: DataFrame, tables: DataFrame) -> DataFrame:
    """Both kinds of references: model, measure, kind (table or measure), name."""
    a = expression_tables(measures, tables).select("model", "measure", F.lit("table").alias("kind"), F.col("table").alias("name"))
    return a.unionByName(expression_measures(measures).select("model", "measure", F.lit("measure").alias("kind"), F.col("called").alias("name"))).distinct()


def called_measures(edges: DataFrame, measures: DataFrame, depth: int | None = None) -> DataFrame:
    """Measures reached from each measure, with the smallest number of calls (0 = itself).

    Every round follows the calls of the pairs that the round before found first, until none is new; so a cycle ends, a much-called
    measure cannot multiply rows, and a round costs what it adds. ``depth`` bounds the calls; ``reach_flags`` tells where that left something out.
    """
    # every round reads the call pairs again, so they are worked out once
    pairs = stored(edges.select(F.col("model").alias("_model"), F.col("measure").alias("_from"), F.col("called").alias("_to")).distinct())
    fresh = stored(measures.select("model", "measure", F.col("measure").alias("reached"), F.lit(0).alias("level")).distinct())
    known = fresh
    level = 0
    while depth is None or level < depth:
        level += 1
        hop = fresh.join(pairs, (F.col("model") == F.col("_model")) & (F.col("reached") == F.col("_from"))).select("model", "measure", F.col("_to").alias("reached")).distinct()
        watch = Observation()
        fresh = stored(hop.join(known.select("model", "measure", "reached"), ["model", "measure", "reached"], "left_anti").withColumn("level", F.lit(level)).observe(watch, F.count(F.lit(1)).alias("rows")))
        if watch.get["rows"] == 0:
            break
        known = known.unionByName(fresh)
    return known


def reach_flags(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """Per measure of ``called_measures``: the number of measures it reaches, the longest way, ``cyclic`` if it reaches itself again,
    ``cut`` if something it reaches calls a measure that the depth left out."""
    calls = edges.select(F.col("model").alias("_model"), F.col("measure").alias("_from"), F.col("called").alias("_to")).distinct()
    onward = reach.join(calls, (F.col("model") == F.col("_model")) & (F.col("reached") == F.col("_from"))).select("model", "measure", F.col("_to").alias("reached")).distinct()
    missing = onward.join(reach, ["model", "measure", "reached"], "left_anti").select("model", "measure").distinct().withColumn("cut", F.lit(True))
    around = onward.where("reached = measure").select("model", "measure").withColumn("cyclic", F.lit(True))
    sizes = reach.groupBy("model", "measure").agg((F.count(F.lit(1)) - 1).alias("reached"), F.max("level").alias("levels"))
    joined = sizes.join(around, ["model", "measure"], "left").join(missing, ["model", "measure"], "left")
    return joined.select("model", "measure", "reached", "levels", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("cut", F.lit(False)).alias("cut"))


def measure_closure(measures: DataFrame, tables: DataFrame, depth: int | None = None) -> DataFrame:
    """Tables each measure reads, through the measures it calls: model, measure, table, level."""
    reach = called_measures(expression_measures(measures), measures, depth)
    direct = expression_tables(measures, tables).withColumnRenamed("measure", "reached")
    return reach.join(direct, ["model", "reached"]).groupBy("model", "measure", "table").agg(F.min("level").alias("level"))


def measure_places(bindings: DataFrame) -> DataFrame:
    """Every place that binds a measure, one row each: model, measure, place."""
    bound = bindings.where("measure is not null and measure != ''")
    return bound.select("model", F.trim("measure").alias("measure"), _where_used().alias("place")).distinct()


def measures_used(bindings: DataFrame, measures: DataFrame, shown: int = 12) -> DataFrame:
    """Every bound or defined measure: captured or not, used or not, and where.

    ``used_by`` shows the first ``shown`` places in name order with the number of the rest; ``measure_places`` has all as rows.
    """
    key = F.lower(F.trim("measure"))
    bound = bindings.where("measure is not null and measure != ''").withColumn("_m", key)
    counts = bound.groupBy("model", "_m").agg(F.count(F.lit(1)).alias("uses"), F.min(F.trim("measure")).alias("_name"))
    places = bound.select("model", "_m", _where_used().alias("_p")).distinct()
    order = Window.partitionBy("model", "_m").orderBy("_p")
    lists = places.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown).groupBy("model", "_m").agg(
        F.array_join(F.array_sort(F.collect_list("_p")), "; ").alias("used_by"))
    total = places.groupBy("model", "_m").agg(F.count(F.lit(1)).alias("_places"))
    rest = F.when(F.col("_places") > shown, F.format_string(" and %d more", F.col("_places") - shown)).otherwise("")
    used = counts.join(lists, ["model", "_m"]).join(total, ["model", "_m"]).withColumn("used_by", F.concat("used_by", rest))
    known = measures.select("model", key.alias("_m"), F.col("measure").alias("_defined"), "expression").dropDuplicates(["model", "_m"])
    both = known.join(used, ["model", "_m"], "full")
    return both.select(
        "model", F.coalesce("_defined", "_name").alias("measure"), F.col("uses").isNotNull().alias("used"), F.col("_defined").isNotNull().alias("captured"),
        F.coalesce("uses", F.lit(0).cast("bigint")).alias("uses"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def table_sources(partitions: DataFrame) -> DataFrame:
    """Where each table's partition reads from, as far as its query text says so."""
    text = F.trim(F.coalesce("query", F.lit("")))

    def step(kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(fixed.SOURCE_STEP % kind), F.lit(1))
        return F.try_element_at(hits, F.lit(-1))

    raw = F.nullif(F.regexp_extract(text, fixed.SOURCE_CONNECTOR, 1), F.lit(""))
    connector = F.coalesce(lookup(raw, fixed.CONNECTOR_WORDS), raw)
    table, schema, database = F.coalesce(step("Table"), step("View")), step("Schema"), step("Database")
    relation = F.concat_ws(".", F.when(schema.isNull(), database), schema, table)
    source = (F.when(text == "", "not captured").when(F.col("kind") == "calculated", "calculated inside the model")
              .when(table.isNotNull(), F.concat_ws(", ", connector, F.concat(F.lit("table "), relation)))
              .when(text.rlike(fixed.NATIVE_QUERY), F.concat_ws(", ", connector, F.lit("a native query")))
              .when(connector.isNotNull(), F.concat(connector, F.lit(" (the query does not name a single table)")))
              .otherwise(F.trim(F.regexp_extract(text, r"^\s*([^\r\n]+)", 1))))
    rows = partitions.withColumn("source", source)
    return rows.groupBy("model", "table", "source").agg(F.count(F.lit(1)).alias("partitions"))


def _sources_of(sources: DataFrame) -> DataFrame:
    """All sources of a table in one text, in name order (a table has as many as its partitions name)."""
    return sources.groupBy("model", "table").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("source"))


def tables_for_measures(closure: DataFrame, used: DataFrame, sources: DataFrame) -> DataFrame:
    """Tables behind the used measures with their source; facts first, then dimensions."""
    wanted = used.where("used").select("model", "measure")
    counts = closure.join(wanted, ["model", "measure"], "left_semi").groupBy("model", "table").agg(F.count(F.lit(1)).alias("measures"))
    known = _sources_of(sources)
    prefix = F.lower(F.substring_index("table", "_", 1))
    out = counts.join(known, ["model", "table"], "left").withColumn("source", F.coalesce("source", F.lit("not captured")))
    return out.withColumn("rank", F.when(prefix == "fact", 0).when(prefix == "dim", 1).otherwise(2))


def without_comments(expression: Column) -> Column:
    """Expression text without comments and with empty string literals, so that neither is read as a formula."""
    blank = F.regexp_replace(F.regexp_replace(expression, r"(?s)/\*.*?\*/", " "), r"(?m)(//|--).*$", " ")
    return F.regexp_replace(blank, '"[^"]*"', '""')


def short_divisions(text: Column) -> Column:
    """Number of guarded divisions called with fewer than three arguments, at any depth of brackets.

    Innermost brackets are judged and replaced by a plain word, one layer a step, at most as many as there are opening brackets.
    """
    def layer(acc: Column, _: Column) -> Column:
        inner = F.regexp_extract_all(acc["rest"], F.lit(r"(?i)\bDIVIDE\s*\(([^()]*)\)"), F.lit(1))
        few = F.size(F.filter(inner, lambda a: F.length(a) - F.length(F.replace(a, F.lit(","), F.lit(""))) < 2))
        return F.struct(F.regexp_replace(acc["rest"], r"[\p{L}_.]*\s*\([^()]*\)", "x").alias("rest"), (acc["n"] + few).alias("n"))
    layers = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    return F.when(layers > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(layers, F.lit(1))), F.struct(text.alias("rest"), F.lit(0).alias("n")), layer, lambda acc: acc["n"])).otherwise(0)


def expression_chips(measures: DataFrame, depth: int | None = None) -> DataFrame:
    """Clock, filter removal, and division without a guard or without its third argument, in a measure or in a measure it calls (level 0 = its own)."""
    own = measures.select("model", F.col("measure").alias("reached"), without_comments(F.coalesce("expression", F.lit(""))).alias("_e")).select("model", "reached", F.explode(F.filter(F.array(
        F.when(F.col("_e").rlike(fixed.VOLATILE), F.lit("reads the clock")), F.when(F.col("_e").rlike(fixed.FILTER_REMOVAL), F.lit("removes filters")),
        F.when(F.col("_e").rlike(fixed.RAW_DIVISION) | (short_divisions(F.col("_e")) > 0), F.lit("divides without a guard"))), lambda c: c.isNotNull())).alias("chip"))
    reach = called_measures(expression_measures(measures), measures, depth)
    return reach.join(own, ["model", "reached"]).groupBy("model", "measure", "chip").agg(
        F.min_by("reached", F.struct("level", "reached")).alias("found_in"), F.min("level").alias("level"))


def number_chains(bindings: DataFrame, measures: DataFrame, closure: DataFrame, sources: DataFrame) -> DataFrame:
    """Figure on a card or a table total -> measure -> table -> source; unknown steps stay null."""
    headline, total = F.col("type").isin("card", "multi-row card", "KPI", "gauge"), F.col("type").isin("table", "matrix")
    shown = bindings.where((headline | (total & F.col("role").isin("Values", "Value", "Data", "Y", "Y2"))) & (F.col("measure") != ""))
    figures = shown.select("model", "page", "visual", "measure", F.when(headline, "on a card").otherwise("as a table total").alias("how"))
    known = measures.select("model", "measure", F.col("expression")).dropDuplicates(["model", "measure"])
    chain = figures.join(known, ["model", "measure"], "left").join(closure.select("model", "measure", "table"), ["model", "measure"], "left")
    where = _sources_of(sources)
    return chain.join(where, ["model", "table"], "left").select("model", "page", "visual", "how", "measure", "expression", "table", "source")


def coverage_gaps(visuals: DataFrame, bindings: DataFrame, measures: DataFrame, captured_pages: DataFrame) -> DataFrame:
    """Visuals that bind no field, pages never captured, and bound measures without a definition.

    ``visuals``: model, page, visual, type; ``captured_pages``: model, page.
    """
    drawn = visuals.where(~F.col("type").isin("text box", "image", "shape", "button", "group of visuals"))
    empty = drawn.join(bindings.select("model", "page", "visual").distinct(), ["model", "page", "visual"], "left_anti").select(
        "model", F.lit("visual without fields").alias("gap"), F.concat_ws("/", "page", "visual").alias("object"))
    seen = captured_pages.select("model", F.lower(F.trim("page")).alias("_p")).distinct()
    pages = visuals.select("model", "page", F.lower(F.trim("page")).alias("_p")).distinct().join(seen, ["model", "_p"], "left_anti").select(
        "model", F.lit("page never captured").alias("gap"), F.col("page").alias("object"))
    lost = bindings.where("measure != ''").select("model", F.trim("measure").alias("measure"), F.lower(F.trim("measure")).alias("_m")).distinct().join(
        measures.where("expression is not null and expression != ''").select("model", F.lower(F.trim("measure")).alias("_m")), ["model", "_m"], "left_anti").select(
        "model", F.lit("measure without definition").alias("gap"), F.col("measure").alias("object"))
    return _union([empty, pages, lost])


# --- report definitions and catalogs --------------------------------------------------------

_CONFIG = (
    "name string, isHidden boolean, singleVisual struct<visualType string, projections map<string, array<struct<queryRef string>>>, "
    "prototypeQuery struct<Select: array<struct<Name string, Measure: struct<Property string>, `Column`: struct<Property string>>>>, "
    "vcObjects struct<title: array<struct<properties: struct<text: struct<expr: struct<Literal: struct<Value string>>>>>>>>"
)
_REPORT = ("filters string, sections array<struct<name string, displayName string, filters string, "
           "visualContainers array<struct<config string, filters string>>>>")


def _type_word(name: Column | str) -> Column:
    """What a reader calls a visual type; a type without such a word keeps its name."""
    kind = F.col(name) if isinstance(name, str) else name
    return F.coalesce(lookup(kind, fixed.VISUAL_TYPES), kind)


def flatten_report(reports: DataFrame) -> DataFrame:
    """Report definitions (``model``, ``document`` JSON) as one row per visual.

    Columns: model, page_id, page, visual, type, hidden, title, projections (role, query_name,
    measure, column) and the filter texts of report, page and visual.
    """
    r = reports.select("model", F.from_json("document", _REPORT).alias("r"))
    pages = r.select("model", F.col("r.filters").alias("report_filters"), F.explode("r.sections").alias("s"))
    visuals = pages.select("model", "report_filters", F.col("s.name").alias("page_id"), F.col("s.displayName").alias("page"), F.col("s.filters").alias("page_filters"),
                           F.explode("s.visualContainers").alias("v"))
    c = visuals.withColumn("c", F.from_json("v.config", _CONFIG))
    title = F.try_element_at("c.singleVisual.vcObjects.title", F.lit(1))["properties"]["text"]["expr"]["Literal"]["Value"]
    selected = F.coalesce("c.singleVisual.prototypeQuery.Select", F.array().cast(
        "array<struct<Name:string,Measure:struct<Property:string>,Column:struct<Property:string>>>"))
    roles = F.flatten(F.transform(F.map_entries("c.singleVisual.projections"), lambda e: F.transform(
        e["value"], lambda p: F.struct(e["key"].alias("role"), p["queryRef"].alias("query_name")))))
    c = c.withColumn("_sel", selected)

    def resolved(p: Column) -> Column:
        hit = F.get(F.filter("_sel", lambda s: s["Name"] == p["query_name"]), F.lit(0))
        return F.struct(p["role"].alias("role"), p["query_name"].alias("query_name"), hit["Measure"]["Property"].alias("measure"), hit["Column"]["Property"].alias("column"))

    empty = F.array().cast("array<struct<role:string,query_name:string>>")
    return c.select(
        "model", "page_id", "page", F.col("c.name").alias("visual"), _type_word("c.singleVisual.visualType").alias("type"), F.coalesce("c.isHidden", F.lit(False)).alias("hidden"),
        F.regexp_replace(title, r"^'+|'+$", "").alias("title"), F.transform(F.coalesce(roles, empty), resolved).alias("projections"),
        "report_filters", "page_filters", F.col("v.filters").alias("visual_filters"))


def flatten_visuals(visuals: DataFrame) -> DataFrame:
    """The folder layout, one JSON document per visual: ``model, page_id, page, document`` (and page/report filters as text)."""
    schema = ("name string, isHidden boolean, filterConfig string, visual struct<visualType string, "
              "query: struct<queryState: map<string, struct<projections: array<struct<queryRef string, nativeQueryRef string, "
              "field: struct<Measure: struct<Property string>, `Column`: struct<Property string>>>>>>>, "
              "visualContainerObjects: struct<title: array<struct<properties: struct<text: struct<expr: struct<Literal: struct<Value string>>>>>>>>")
    c = visuals.withColumn("c", F.from_json("document", schema))
    title = F.try_element_at("c.visual.visualContainerObjects.title", F.lit(1))["properties"]["text"]["expr"]["Literal"]["Value"]
    roles = F.flatten(F.transform(F.map_entries("c.visual.query.queryState"), lambda e: F.transform(e["value"]["projections"], lambda p: F.struct(
        e["key"].alias("role"), F.coalesce(p["queryRef"], p["nativeQueryRef"]).alias("query_name"),
        p["field"]["Measure"]["Property"].alias("measure"), p["field"]["Column"]["Property"].alias("column")))))
    empty = F.array().cast("array<struct<role:string,query_name:string,measure:string,column:string>>")

    def optional(name: str) -> Column:
        return F.col(name) if name in visuals.columns else F.lit(None).cast("string").alias(name)

    return c.select(
        "model", "page_id", "page", F.col("c.name").alias("visual"), _type_word(F.coalesce("c.visual.visualType", F.lit("group"))).alias("type"),
        F.coalesce("c.isHidden", F.lit(False)).alias("hidden"), F.regexp_replace(title, r"^'+|'+$", "").alias("title"), F.coalesce(roles, empty).alias("projections"),
        optional("report_filters"), optional("page_filters"), F.col("c.filterConfig").alias("visual_filters"))


def visual_bindings(flat: DataFrame) -> DataFrame:
    """One row per bound field of the flattened visuals."""
    rows = flat.select("model", "page", "visual", "type", "title", F.explode("projections").alias("p"))
    return rows.select("model", "page", "visual", "type", "p.role", "title", "p.query_name", "p.measure", F.coalesce("p.column", "p.measure").alias("label"))


def filter_restrictions(flat: DataFrame) -> DataFrame:
    """Every report, page and visual filter: field, number of listed values and the values."""
    report = flat.select("model", F.lit("report").alias("level"), F.lit("").alias("page"), F.lit("").alias("visual"), F.col("report_filters").alias("text")).distinct()
    page = flat.select("model", F.lit("page").alias("level"), "page", F.lit("").alias("visual"), F.col("page_filters").alias("text")).distinct()
    visual = flat.select("model", F.lit("visual").alias("level"), "page", "visual", F.col("visual_filters").alias("text"))
    entry = "array<struct<displayName string, type string, field string, expression string, filter struct<Where string>>>"
    text = F.col("text")
    listed = F.when(text.startswith("["), F.from_json(text, entry)).otherwise(F.from_json(text, f"filters {entry}")["filters"])
    rows = report.unionByName(page).unionByName(visual).where(F.coalesce(text, F.lit("")) != "").select("model", "level", "page", "visual", F.explode(listed).alias("f"))
    target = F.coalesce("f.field", "f.expression", F.lit(""))
    entity, prop = F.nullif(F.regexp_extract(target, r'"Entity"\s*:\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(target, r'"Property"\s*:\s*"([^"]*)"', 1), F.lit(""))
    name = F.coalesce(prop, "f.displayName")
    field = F.when(entity.isNotNull() & name.isNotNull(), F.concat(entity, F.lit("["), name, F.lit("]"))).otherwise(F.coalesce(name, F.lit("a field")))
    where = F.coalesce("f.filter.Where", F.lit(""))
    values = F.transform(F.regexp_extract_all(where, F.lit(r'"Literal"\s*:\s*\{\s*"Value"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda v: F.regexp_replace(F.trim(v), r"^'+|'+$", ""))
    state = F.when(F.size("values") > 0, "restricted").when(where.isin("", "[]"), "offered").otherwise("condition")
    rows = rows.withColumns({"field": field, "kind": F.coalesce("f.type", F.lit("filter")), "values": values})
    return rows.withColumn("state", state).select("model", "level", "page", "visual", "field", "kind", "state", F.size("values").cast("bigint").alias("listed"), "values")


def model_catalog(tables: DataFrame, columns: DataFrame, measures: DataFrame, relationships: DataFrame, partitions: DataFrame) -> DataFrame:
    """Metadata rowsets with numeric ids resolved into names; an unknown id reads ``unresolved:<id>``.

    Inputs carry ``model`` and: tables id, name; columns id, table_id, explicit_name, inferred_name;
    measures table_id, name; relationships id, from_column_id, to_column_id, active; partitions table_id, name.
    Returns model, object (table, column, measure, relationship, partition), table, name, target.
    """
    t = tables.select("model", F.col("id").alias("table_id"), F.col("name").alias("_table"))

    def table_of() -> Column:
        return F.coalesce("_table", F.concat(F.lit("unresolved:"), F.coalesce(F.col("table_id").cast("string"), F.lit("None"))))

    name_of = F.coalesce("explicit_name", "inferred_name")
    none = F.lit(None).cast("string")
    named = columns.join(t, ["model", "table_id"], "left").select("model", F.col("id").alias("_cid"), table_of().alias("table"), name_of.alias("name"))
    out = [tables.select("model", F.lit("table").alias("object"), F.col("name").alias("table"), "name", none.alias("target")),
           named.select("model", F.lit("column").alias("object"), "table", "name", none.alias("target"))]
    for kind, frame in (("measure", measures), ("partition", partitions)):
        out.append(frame.join(t, ["model", "table_id"], "left").select("model", F.lit(kind).alias("object"), table_of().alias("table"), "name", none.alias("target")))

    def end(prefix: str) -> DataFrame:
        return named.select("model", F.col("_cid").alias(f"{prefix}_column_id"), F.col("table").alias(f"_{prefix}_t"), F.concat("table", F.lit("["), F.coalesce("name", F.lit("")), F.lit("]")).alias(f"_{prefix}_c"))

    rel = relationships.join(end("from"), ["model", "from_column_id"], "left").join(end("to"), ["model", "to_column_id"], "left")
    out.append(rel.select("model", F.lit("relationship").alias("object"), F.coalesce("_from_t", F.lit("unresolved:None")).alias("table"),
                          F.coalesce("_from_c", F.concat(F.lit("unresolved:"), F.col("from_column_id").cast("string"))).alias("name"),
                          F.coalesce("_to_c", F.concat(F.lit("unresolved:"), F.col("to_column_id").cast("string"))).alias("target")))
    return _union(out)
