"""Result tables: claims, findings, ranking, record checks and reviewer decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.relational import any_of
from plumbline.functions.scalars import (
    first_clause, first_sentence, lookup, pointer_path, strip_prefix, technical_token, typed_equal)
from plumbline.plans.registry import catalog_lookup



def to_claims(verdicts: DataFrame, probe: str = "probe") -> DataFrame:
    """One claim per verdict: id ``PRB-<probe>``, mapped status, expectation text from the catalog."""
    named = catalog_lookup(verdicts, "method")
    status = F.when(F.col("status").isin("passed", "failed"), F.col("status")).otherwise("inconclusive")
    question = F.col("question") if "question" in verdicts.columns else F.lit(None).cast("string")
    observed = F.col("observed") if "observed" in verdicts.columns else F.col("status")
    severity = F.coalesce(F.col("severity"), F.lit("review")) if "severity" in verdicts.columns else F.lit("review")
    asked = F.nullif(F.trim(F.coalesce(question, F.lit(""))), F.lit(""))
    return named.select(
        F.concat(F.lit("PRB-"), F.col(probe).cast("string")).alias("id"), F.col("method").alias("detector"),
        F.coalesce(asked, F.col("catalog_claim")).alias("expected"), F.concat_ws(": ", "method", observed).alias("observed"),
        status.alias("status"), F.lit("engine").alias("layer"), severity.alias("severity"), F.col("status").alias("probe_status"))


def _lint_id() -> Column:
    return F.concat(F.lit("LINT-"), F.regexp_replace(F.regexp_replace("method", r"^[^.]*\.", ""), "_", "-"))


def lint_objects(findings: DataFrame) -> DataFrame:
    """Every object behind a lint claim, one row each: claim id, object, fragment."""
    return findings.select(_lint_id().alias("id"), "object", "fragment")


def lint_to_claims(findings: DataFrame, shown: int = 12) -> DataFrame:
    """One claim per lint method with its hit count, why it matters, and the first objects in name order with the number of the rest.

    ``lint_objects`` has all of them as rows.
    """
    order = Window.partitionBy("method").orderBy("object", "fragment")
    listed = findings.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    objects = listed.groupBy("method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "object"))), lambda x: x["object"]), "; ").alias("objects"))
    counts = findings.groupBy("method").agg(F.count(F.lit(1)).alias("hits"), F.min("severity").alias("severity"))
    claims = catalog_lookup(counts.join(objects, "method"), "method")
    rest = F.when(F.col("hits") > shown, F.format_string(" and %d more", F.col("hits") - shown)).otherwise("")
    objects = F.concat("objects", rest)
    return claims.withColumn("objects", objects).select(
        _lint_id().alias("id"), F.col("method").alias("detector"), F.col("catalog_claim").alias("expected"),
        F.concat(F.col("hits").cast("string"), F.lit(" object(s). Hits: "), F.col("objects")).alias("observed"),
        F.lit("inconclusive").alias("status"), F.lit("cross-layer").alias("layer"), "severity", "hits", "objects")


def failed_to_findings(claims: DataFrame) -> DataFrame:
    """One finding per failed probe claim, with the evidence its claim cites; claims without that column cite the file of their probe's record."""
    failed = claims.where("status = 'failed'")
    return failed.select(
        F.concat(F.lit("FD-"), F.col("id")).alias("id"), F.coalesce(F.nullif(F.trim("expected"), F.lit("")), F.regexp_replace("id", "^PRB-", "")).alias("title"), F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.array("id").alias("claim_ids"), F.concat(F.lit("Probe "), F.col("detector"), F.lit(" failed: "), F.col("observed")).alias("explanation"),
        F.lit("The checked rule does not hold for these rows, and every figure built on them is off by as much.").alias("impact"),
        (F.col("evidence") if "evidence" in claims.columns else F.array(F.concat(F.lit("probes/"), F.regexp_replace("id", "^PRB-", ""), F.lit(".json")))).alias("evidence"))


def outcome_text(verdicts: DataFrame, flags: DataFrame, by: Sequence[str], shown: int = 8) -> DataFrame:
    """One sentence per verdict: how many points are flagged and the first of them in key order.

    ``verdicts``: by…, method, status, n; ``flags``: by…, key, score.
    """
    order = Window.partitionBy(*by).orderBy(F.col("key").cast("string"), "score")
    listed = flags.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    item = F.concat(F.col("key").cast("string"), F.lit(" ("), F.format_number(F.bround("score", 2), 2), F.lit(")"))
    lists = listed.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("t")))), lambda x: x["t"]), "; ").alias("_items"))
    totals = flags.groupBy(*by).agg(F.count(F.lit(1)).alias("_flags"))
    joined = verdicts.join(totals, list(by), "left").join(lists, list(by), "left")
    count = F.coalesce("_flags", F.lit(0).cast("bigint"))
    text = (F.when(F.col("status") == "inconclusive", F.format_string("Not testable over %d point(s).", F.col("n")))
            .when(count == 0, F.format_string("All %d point(s) sit within the expected range.", F.col("n")))
            .otherwise(F.concat(F.format_string("%d flagged of %d point(s): ", count, F.col("n")), F.col("_items"), F.lit("."))))
    return joined.select(*by, "method", "status", text.alias("observed"))


def facts_check(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A stored fact must equal the value its evidence holds, JSON type included.

    ``facts``: id, evidence, field (a JSON pointer; the leading slash may be left out), value (JSON text);
    ``evidence``: evidence, document (JSON text).
    """
    joined = facts.join(evidence.withColumn("_there", F.lit(True)), "evidence", "left")
    actual = F.to_json(F.try_variant_get(F.try_parse_json("document"), pointer_path("field"), "variant"))
    status = (F.when(F.col("_there").isNull(), "missing evidence").when(F.col("actual").isNull(), "missing value")
              .when(typed_equal("actual", "value"), "matches").otherwise("differs"))
    return joined.withColumn("actual", actual).select("id", "evidence", "field", "value", "actual", status.alias("status"))


def magnitude(observed: Column, hits: Column) -> Column:
    """Size of a problem: the hit count, else the observed number of an ``Observed X op expected Y`` text."""
    seen = F.regexp_extract(F.trim(F.coalesce(observed, F.lit(""))), fixed.OBSERVED_COMPARISON, 1)
    number = F.regexp_replace(F.regexp_extract(seen, fixed.NUMBER_IN_TEXT, 0), ",", "").try_cast("double")
    return F.coalesce(F.abs(hits.cast("double")), F.abs(number), F.lit(0.0))


def rank_findings(claims: DataFrame, findings: DataFrame, components: DataFrame) -> DataFrame:
    """All records worst first: group, severity, magnitude (defects only), component, id.

    ``claims``: id, detector, expected, observed, status, severity, hits; ``findings``: id, title,
    severity, claim_ids, explanation; ``components``: component, name, claim_id. A finding about a
    failed claim is merged into it; any other finding is a record of its own.
    """
    links = findings.select("id", "title", "severity", F.posexplode_outer("claim_ids").alias("_p", "claim_id"))
    related = links.where("claim_id is not null").groupBy("claim_id").agg(
        F.min_by(F.struct(F.col("title"), F.col("severity")), F.col("id")).alias("_f"), F.count(F.lit(1)).alias("findings"))
    owner = components.groupBy("claim_id").agg(F.min(F.struct("name", "component")).alias("_o"))
    c = claims.join(related, claims["id"] == related["claim_id"], "left").drop("claim_id")
    c = c.join(owner, c["id"] == owner["claim_id"], "left").drop("claim_id")
    group = (F.when(F.col("status") == "failed", "defect").when(F.col("status") == "passed", "passed")
             .when((F.col("status") == "inconclusive") & F.coalesce(F.startswith("detector", F.lit("lint.")), F.lit(False)), "lint").otherwise("open"))
    severity = F.when(F.col("status") == "failed", F.coalesce("_f.severity", "severity")).otherwise(F.col("severity"))
    observed = strip_prefix("observed", F.coalesce("detector", F.lit("")))
    hits = F.col("hits") if "hits" in claims.columns else F.lit(None).cast("bigint")
    records = c.select(
        F.lit("claim").alias("kind"), group.alias("group"), "id", F.coalesce("_f.title", first_clause("expected")).alias("heading"), "status",
        severity.alias("severity"), observed.alias("observed"), magnitude(observed, hits).alias("magnitude"),
        F.col("_o.component").alias("component"), F.col("_o.name").alias("component_name"))
    failed = claims.where("status = 'failed'").select(F.col("id").alias("claim_id"))
    merged = links.join(failed, "claim_id", "left_semi").select("id").distinct()
    alone = findings.join(merged, "id", "left_anti").select(
        F.lit("finding").alias("kind"), F.lit("defect").alias("group"), "id", F.col("title").alias("heading"), F.lit("failed").alias("status"),
        "severity", F.col("explanation").alias("observed"), magnitude(F.col("explanation"), F.lit(None)).alias("magnitude"),
        F.lit(None).cast(dict(components.dtypes)["component"]).alias("component"), F.lit(None).cast("string").alias("component_name"))
    both = records.unionByName(alone)
    rank = F.coalesce(lookup(F.lower(F.trim(F.coalesce("severity", F.lit("")))), fixed.SEVERITY_RANK), F.lit(fixed.UNRATED))
    both = both.withColumns({"group_rank": lookup(F.col("group"), fixed.GROUP_RANK), "severity_rank": rank})
    return both.orderBy("group_rank", "severity_rank", F.when(F.col("group") == "defect", -F.col("magnitude")).otherwise(0.0),
                        F.coalesce("component_name", F.lit("~")), "id")


def component_status(claims: DataFrame, by: Sequence[str] = ("component",)) -> DataFrame:
    """problem / ok / decision from a component's own claims; a component without claims needs a decision."""
    out = claims.groupBy(*by).agg(
        F.count("status").alias("claims"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("_bad"),
        F.coalesce(F.bool_and(F.coalesce(F.col("status") == "passed", F.lit(False))), F.lit(False)).alias("_good"))
    key = F.when(F.col("_bad"), "problem").when(F.col("_good") & (F.col("claims") > 0), "ok").otherwise("decision")
    return out.select(*by, "claims", key.alias("key"), lookup(key, fixed.COMPONENT_LABELS).alias("label"))


def status_summary(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("claims"))


def constraint_violations(claims: DataFrame, findings: DataFrame, components: DataFrame, layers: Sequence[str] | None = None) -> DataFrame:
    """Every broken rule of the record set, one row each: kind, id, problem.

    ``claims``: id, expected, source, status, layer, required, seen, evidence; ``findings``: id,
    title, severity, claim_ids, impact; ``components``: component, name, claim_ids, scenarios BIGINT.
    """
    def broken(df: DataFrame, kind: str, key: str, rules: list[tuple[Column, Column | str]]) -> DataFrame:
        """All rules of a table in one pass over it."""
        told = F.array(*[F.when(bad, F.lit(text) if isinstance(text, str) else text) for bad, text in rules])
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.explode(F.filter(told, lambda p: p.isNotNull())).alias("problem"))

    def missing(*names: str) -> list[tuple[Column, Column | str]]:
        return [(F.col(n).isNull() | (F.trim(n) == ""), f"missing {n}") for n in names]

    bare = F.col("status").isin("passed", "failed") & (F.coalesce(F.size("evidence"), F.lit(0)) == 0)
    unseen = F.array_except("required", F.coalesce("seen", F.array().cast("array<string>")))
    of_claim = missing("expected", "source", "status", "layer") + [(~F.col("status").isin(*fixed.CLAIM_STATUSES), "invalid status")]
    if layers:
        of_claim.append((~F.col("layer").isin(*layers), "unknown layer"))
    of_claim += [(bare, "measured claim needs evidence"), (
        (F.col("status") == "passed") & (F.size(unseen) > 0), F.concat(F.lit("passed claim has unobserved required layers "), F.array_join(F.array_sort(unseen), ",")))]
    of_component = missing("name") + [(F.coalesce("scenarios", F.lit(0)) == 0, "has no captured scenarios")]
    ids = claims.groupBy("id").agg(F.count(F.lit(1)).alias("_c"))
    references = findings.select(F.lit("finding").alias("kind"), F.col("id").cast("string").alias("id"), F.explode("claim_ids").alias("claim_id")).unionByName(
        components.select(F.lit("component").alias("kind"), F.col("component").cast("string").alias("id"), F.explode("claim_ids").alias("claim_id")))
    known = ids.select(F.col("id").alias("claim_id"))
    dangling = references.join(known, "claim_id", "left_anti").select("kind", "id", F.concat(F.lit("references unknown claim "), F.col("claim_id")).alias("problem"))
    result = broken(claims, "claim", "id", of_claim).unionByName(broken(ids.where("_c > 1 or id is null"), "claim", "id", [(F.lit(True), "claim ids must be unique and present")]))
    for more in (broken(findings, "finding", "id", missing("title", "severity", "impact")), broken(components, "component", "component", of_component), dangling):
        result = result.unionByName(more)
    return result


def orphan_evidence(runs: DataFrame, components: DataFrame, detectors: DataFrame, claims: DataFrame) -> DataFrame:
    """Completed runs not owned by exactly one component, and detector outputs no claim cites.

    ``runs``: run, status; ``components``: component, run; ``detectors``: run; ``claims``: id, evidence ARRAY.
    """
    owners = components.where("run is not null").groupBy("run").agg(F.count(F.lit(1)).alias("owners"))
    judged = runs.join(owners, "run", "left").withColumn("owners", F.coalesce("owners", F.lit(0).cast("bigint")))
    problem = F.when((F.col("owners") == 0) & (F.col("status") == "completed"), "attached but no component records it").when(
        F.col("owners") > 1, "recorded by several components")
    bad_runs = judged.withColumn("problem", problem).where("problem is not null").select("run", "owners", "problem")
    cited = claims.select(F.explode("evidence").alias("_e")).select(F.regexp_extract("_e", r"evidence/detectors/([^/]+)/", 1).alias("run")).distinct()
    uncited = detectors.select("run").join(cited, "run", "left_anti").select("run", F.lit(0).cast("bigint").alias("owners"), F.lit("attached but no claim cites it").alias("problem"))
    return bad_runs.unionByName(uncited)


def validate_decisions(decisions: DataFrame, claims: DataFrame, fingerprint: str) -> DataFrame:
    """All complaints about reviewer decisions at once: position, claim_id, problem.

    ``decisions``: position, claim_id, decision, reviewer, confirmation, fingerprint, reason, scope, expires_at.
    """
    status = claims.select(F.col("id").alias("claim_id"), F.col("status").alias("_status"), F.lit(True).alias("_known"))
    first = decisions.groupBy("claim_id").agg(F.min("position").alias("_first"))
    d = decisions.join(status, "claim_id", "left").join(first, "claim_id", "left")

    def empty(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    known = F.coalesce("_known", F.lit(False))
    valid = F.coalesce(F.col("decision").isin(*fixed.REVIEW_DECISIONS), F.lit(False))
    which = (F.when(~valid, "unknown decision")
             .when((F.col("decision") == "accepted") & (F.coalesce("_status", F.lit("")) != "passed"), "accepted without a pass")
             .when((F.col("decision") == "exception") & any_of([empty("reason"), empty("scope"), empty("expires_at")]), "exception needs reason, scope and expiry"))
    problems = F.array(
        F.when(~known, "unknown claim").when(F.col("position") > F.col("_first"), "decided more than once"), which,
        F.when(empty("reviewer"), "reviewer is empty"), F.when(empty("confirmation"), "confirmation is missing"),
        F.when(F.coalesce("fingerprint", F.lit("")) != fingerprint, "fingerprint differs"))
    return d.select("position", "claim_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def questions(claims: DataFrame, checks: DataFrame, by: Sequence[str] = ("component",)) -> DataFrame:
    """Decisions asked of a reader in order: new regressions, computed failures, open claims.

    ``claims``: by…, id, detector, expected, observed, status, change_classification, question;
    ``checks``: by…, id, status, text. Technical wording is replaced by a neutral sentence.
    """
    named = catalog_lookup(claims, "detector")
    classed = F.lower(F.trim(F.coalesce("change_classification", F.lit(""))))
    expected, seen = F.regexp_replace(F.trim(F.coalesce("expected", F.lit(""))), r"\.+$", ""), first_sentence("observed")
    plain = (expected != "") & (seen != "") & technical_token(expected).isNull() & technical_token(seen).isNull()
    subject = F.when(F.col("detector").isNotNull(), F.concat(F.lit('the "'), F.col("catalog_title"), F.lit('" check'))).otherwise(
        F.concat(F.lit("one expectation ("), F.col("id"), F.lit(")")))
    lost = F.when(plain, F.concat(F.lit("Since the baseline, "), expected, F.lit(" no longer holds: "), seen, F.lit(". Is this an intended change?"))).otherwise(
        F.concat(F.lit("Since the baseline, "), subject, F.lit(" no longer holds; see the technical note. Is this an intended change?")))
    raw = F.trim(F.coalesce(F.nullif(F.trim("question"), F.lit("")), F.col("expected"), F.lit("")))
    outcome = F.when(F.col("status") == "failed", " found a problem").otherwise(" could not be settled automatically")
    neutral = F.concat(subject, outcome, F.lit("; see the technical note. Does the figure look right to you?"))
    asked = F.concat(F.when(F.col("status") == "failed", "Defect: ").otherwise(""), F.when((raw != "") & technical_token(raw).isNull(), raw).otherwise(neutral))
    regressed = classed == "new regression"
    kind = F.when(regressed, 0).when(F.col("status").isin("failed", "inconclusive"), 2)
    from_claims = named.withColumn("rank", kind).where("rank is not null").select(
        *by, "rank", "id", F.when(regressed, lost).otherwise(asked).alias("text"),
        F.when(regressed | (F.col("status") == "failed"), "issue").otherwise("open").alias("severity"))
    from_checks = checks.where("status = 'fail'").select(*by, F.lit(1).alias("rank"), "id", "text", F.lit("issue").alias("severity"))
    asked_rows = from_claims.unionByName(from_checks)
    quiet = claims.select(*by).unionByName(checks.select(*by)).distinct().join(asked_rows.select(*by).distinct(), list(by), "left_anti")
    fallback = quiet.select(*by, F.lit(3).alias("rank"), F.lit("none").alias("id"), F.lit(
        "Nothing looked inconsistent. Do these figures match what you expect for these dates and filters?").alias("text"), F.lit("ok").alias("severity"))
    return asked_rows.unionByName(fallback)


def case_rollup(claims: DataFrame, findings: DataFrame, components: DataFrame) -> DataFrame:
    """Per case: claims by status, layer and detector, findings by severity, scenarios per component."""
    def count(df: DataFrame, facet: str, column: str, weight: Column) -> DataFrame:
        return df.groupBy("case_id", F.lit(facet).alias("facet"), F.col(column).cast("string").alias("member")).agg(weight.cast("bigint").alias("count"))
    one = F.count(F.lit(1))
    out = count(claims, "status", "status", one).unionByName(count(claims, "layer", "layer", one)).unionByName(count(claims, "detector", "detector", one))
    out = out.unionByName(count(findings, "severity", "severity", one))
    return out.unionByName(count(components, "scenarios", "component", F.sum("scenarios")))


def facts_from_figures(figures: DataFrame) -> DataFrame:
    """One addressable fact per captured figure: id, label, pointer with escaped key, value.

    ``figures``: component, label, kind (card or table), key, value.
    """
    card = F.col("kind") == "card"
    clean = F.regexp_replace("key", r"[^A-Za-z0-9]+", "_")
    escaped = F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return figures.select(
        F.concat_ws("-", F.col("component").cast("string"), "label", F.when(card, clean).otherwise(F.concat(F.lit("table_"), F.col("key")))).alias("id"),
        F.concat(F.col("label"), F.lit(": "), F.when(card, F.col("key")).otherwise(F.concat("key", F.lit(" total")))).alias("label"),
        F.when(card, F.concat(F.lit("/cards/"), escaped)).otherwise(F.concat(F.lit("/tables/"), F.col("key"))).alias("pointer"), "value")
