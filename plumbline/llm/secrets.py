"""Secret scanning through a trigram inverted index.

Each rule's pattern is reduced to a Boolean query over the three-character strings that every match must
contain. The index posts every document under the trigrams that some rule asks for; intersecting the postings
gives the documents that can match a rule at all, and only those are verified with the pattern itself. A rule
without mandatory trigrams (a run of hexadecimal digits) scans every document.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.words import texts


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` code points, else the match is dropped (it still consumes its text)."""

    kind: str
    pattern: str
    group: int
    least: int


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further public token formats that this scanner adds to the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 27),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + MORE
EXACT = 64  # literal variants followed at once while a pattern is walked


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-cased trigrams a match must hold; None when nothing is mandatory.

    Walks the parsed pattern and keeps the exact strings the part walked so far can be. Where a part has too
    many variants, the strings so far are turned into trigrams and the walk starts over behind it.
    """
    wanted: list[list[frozenset[str]]] = []

    def settle(strings: set[str]) -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            wanted.append([a for a in sets if not any(b < a for b in sets)])

    def walk(nodes, strings: set[str]) -> set[str]:
        for kind, value in nodes:
            parts = exact(kind, value)
            if parts is not None and len(strings) * len(parts) <= EXACT:
                strings = {a + b for a, b in product(strings, parts)}
                continue
            settle(strings)
            strings = {""}
            if kind is op.SUBPATTERN:
                strings = walk(value[3], strings)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                settle(walk(value[2], {""}))
        return strings

    def exact(kind, value) -> set[str] | None:
        if kind is op.LITERAL:
            return {chr(value).lower()}
        if kind is op.IN and all(k is op.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind is op.SUBPATTERN:
            return series(value[3])
        if kind is op.BRANCH:
            branches = [series(b) for b in value[1]]
            return None if None in branches else set().union(*branches)
        if kind is op.MAX_REPEAT and value[1] == 1:
            inner = series(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return None

    def series(nodes) -> set[str] | None:
        found = {""}
        for kind, value in nodes:
            parts = exact(kind, value)
            if parts is None or len(found) * len(parts) > EXACT:
                return None
            found = {a + b for a, b in product(found, parts)}
        return found

    settle(walk(_parser.parse(pattern), {""}))
    # every collected condition is mandatory; the one with the fewest, longest alternatives is the most selective
    return min(wanted, key=lambda sets: (len(sets), -min(map(len, sets))), default=None)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id, mark) for the trigrams that rules ask for, over whole texts."""
    low = docs.select("doc_id", "mark", F.lower("text").alias("low"))
    present = F.filter(F.lit(trigrams), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", "mark", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, mark, kind) of every document whose postings satisfy a rule's query; rules here have trigrams."""
    asked = [(r.kind, i, t, len(alternative)) for r in rules for i, alternative in enumerate(trigram_query(r.pattern)) for t in sorted(alternative)]
    clauses = docs.sparkSession.createDataFrame(asked, "kind string, clause int, trigram string, needed int")
    index = postings(docs, sorted({a[2] for a in asked}))
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "mark", "kind", "clause").agg(
        F.count_distinct("trigram").alias("met"), F.first("needed").alias("needed"))
    return met.where("met = needed").select("doc_id", "mark", "kind").distinct()


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``doc_id`` and ``mark``, the hash of the text; a null key equals a null key."""
    other = right.withColumnsRenamed({"doc_id": "_other", "mark": "_mark"})
    return left.join(other, left["doc_id"].eqNullSafe(other["_other"]) & (left["mark"] == other["_mark"]), how).drop("_other", "_mark")


def _matches(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row per match: its number, its length, its tested length and the text length before it."""
    found = rows.where(F.col("text").rlike(rule.pattern)).select(
        "doc_id", "mark", F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("tested"), F.split("text", rule.pattern).alias("gaps"))
    each = F.transform("hits", lambda h, i: F.struct(
        i.alias("i"), F.length(h).alias("size"), F.length(F.get("tested", i)).alias("tested"), F.length(F.get("gaps", i)).alias("gap")))
    return found.select("doc_id", "mark", F.lit(rule.kind).alias("kind"), F.inline(each))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, mark, kind, start, end) of every secret, leftmost and non-overlapping per kind, in code points, end exclusive.

    ``mark`` is the hash of the row's text, so different texts under one key, or without a key, keep their own spans. Null and empty texts hold nothing; a null key is a key like any other. A repeated row is reported once,
    equal texts under different keys are all reported. Further columns of ``docs`` are not read.
    """
    docs = texts(docs, key, text).withColumn("mark", F.xxhash64("text"))
    plain = [r for r in rules if trigram_query(r.pattern) is None]
    indexed = tuple(r for r in rules if r not in plain)
    found = [_matches(docs, r) for r in plain]
    if indexed:
        maybe = candidates(docs, indexed).groupBy("doc_id", "mark").agg(F.collect_set("kind").alias("kinds"))
        verify = _same(docs, maybe)
        found += [_matches(verify.where(F.array_contains("kinds", r.kind)), r) for r in indexed]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    upto = Window.partitionBy("doc_id", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)])
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = every.distinct().select("doc_id", "mark", "kind", "tested", (end - F.col("size")).alias("start"), end.alias("end"))
    return placed.where(F.col("tested") >= least[F.col("kind")]).select("doc_id", "mark", "kind", "start", "end")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: its spans in order, as ``spans`` array<struct<start, rank, end, kind>> (empty for none)."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    found = scan(docs, key, text, rules).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(
        F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return _same(texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("mark")), found, "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one mark. Other columns stay."""
    found = scan(docs, key, text, rules).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    string = F.col(f"`{text}`").cast("string")
    held = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.coalesce(string, F.lit(""))).alias("mark"), string.alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body, start = F.col("body"), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        sign = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, sign).alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    masked = F.when(F.col("spans").isNull(), F.col(f"row.`{text}`")).otherwise(done)
    return _same(held, found, "left").select(*[masked.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
