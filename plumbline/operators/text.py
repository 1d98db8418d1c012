"""Redaction, keyword extraction, article search and session digests over text columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.relational import attach
from plumbline.functions.scalars import technical_token, term_pattern
from plumbline.operators.running import running_sums
from plumbline.session import cut_lineage, stored

# --- redaction -------------------------------------------------------------------


#: Runs of word characters, and every other character on its own.
PIECE = r"(?U)\w+|(?s)\W"


def ordered_terms(terms: Sequence[str]) -> list[str]:
    return sorted(terms, key=lambda t: (-len(t), t))


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def redact_terms(df: DataFrame, text: str, replacements: dict[str, str], counts: str = "term_hits") -> DataFrame:
    """Replace configured terms, longest first, and count the replacements per term in a map column."""
    body, hits = F.col(text), []
    for term in ordered_terms(list(replacements)):
        pattern = term_pattern(term)
        hits += [F.lit(term), F.regexp_count(body, F.lit(pattern))]
        body = F.regexp_replace(body, pattern, _literal(replacements[term]))
    return df.withColumns({text: body, counts: F.create_map(*hits) if hits else F.create_map().cast("map<string,int>")})


def url_pattern(allowed_hosts: Sequence[str] = fixed.ALLOWED_URL_HOSTS, allowed_prefixes: Sequence[str] = ()) -> str:
    """URL pattern that skips allow-listed hosts (and full host/path prefixes)."""
    hosts = "|".join(h.replace(".", r"\.") for h in allowed_hosts)
    skip = [r"(?:[^/\s@]*@)?(?:" + hosts + r")(?::\d+)?(?=[/?#\s)\]}>\"'`]|$)"] if hosts else []
    skip += [p.replace(".", r"\.") for p in allowed_prefixes]
    guard = "(?!" + "|".join(skip) + ")" if skip else ""
    return fixed.URL.replace("https?://", "https?://" + ("(?i:" + guard + ")" if guard else ""))


def pii_steps(allowed_hosts: Sequence[str] = fixed.ALLOWED_URL_HOSTS, allowed_prefixes: Sequence[str] = ()) -> list[tuple[str, str, str, str]]:
    """Kind, pattern, token and a cheap necessary condition of a match, in the order they are applied."""
    return [
        ("email", fixed.EMAIL, "[email]", "@"), ("id", fixed.GUID, "[id]", "[0-9a-fA-F]{8}-"), ("url", url_pattern(allowed_hosts, allowed_prefixes), "[url]", "://"),
        ("path", fixed.WINDOWS_USER_PATH, "[path]", "Users"), ("path", fixed.POSIX_USER_PATH, "[path]", "/(?:home|Users)/"), ("ip", fixed.IPV4, "[ip]", r"\p{Nd}\.\p{Nd}"),
        ("phone", fixed.PHONE, "[phone]", r"\p{Nd}{3}[ .\-]\p{Nd}{4}")]


def redact_pii(df: DataFrame, text: str, allowed_hosts: Sequence[str] = fixed.ALLOWED_URL_HOSTS, allowed_prefixes: Sequence[str] = (),
               counts: str = "pii_hits") -> DataFrame:
    """Replace e-mail, id, URL, user path, IPv4 and phone by tokens, with a struct of counts per kind.

    Each step works on the output of the one before, in its own projection. A text without the
    character or digits a pattern needs skips that pattern.
    """
    out, totals = df, {}
    for i, (kind, pattern, token, needs) in enumerate(pii_steps(allowed_hosts, allowed_prefixes)):
        body = F.col(text)
        possible = F.contains(body, F.lit(needs)) if needs in ("@", "://", "Users") else body.rlike(needs)
        out = out.withColumn("_may", F.coalesce(possible, F.lit(False)))
        out = out.withColumns({f"_h{i}": F.when(F.col("_may"), F.regexp_count(body, F.lit(pattern))).otherwise(F.when(body.isNotNull(), 0)),
                               text: F.when(F.col("_may"), F.regexp_replace(body, pattern, _literal(token))).otherwise(body)})
        totals.setdefault(kind, []).append(f"_h{i}")
    total = [sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias(kind) for kind, cols in totals.items()]
    return out.withColumn(counts, F.struct(*total)).drop("_may", *[c for cols in totals.values() for c in cols])


def residual_scan(df: DataFrame, keys: Sequence[str], text: str, terms: Sequence[str] = (), allow: Sequence[str] = ()) -> DataFrame:
    """What still looks identifying, per line: names, money, large numbers and surviving terms."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), fixed.LINE_BREAK)).alias("_p", "_line"))
    lines = lines.where("_line != ''").withColumn("line", (F.col("_p") + 1).cast("bigint"))
    line = F.col("_line")
    usual = sorted({*fixed.COMMON_CAPITALISED, *[a.lower() for a in allow]})
    allowed = F.array(*[F.lit(a.lower()) for a in allow]) if allow else F.array().cast("array<string>")

    def unusual(word: Column) -> Column:
        shouting = (F.upper(word) == word) & word.rlike("[A-Z]") & (F.length(word) >= 3)
        return ~F.lower(word).isin(*usual) & ~shouting

    names = F.filter(F.regexp_extract_all(line, F.lit(fixed.CAPITALISED), F.lit(0)), lambda m: ~F.array_contains(allowed, F.lower(m))
                     & (F.size(F.filter(F.split(m, "[ -]"), unusual)) >= 2))
    money = F.regexp_extract_all(line, F.lit(fixed.CURRENCY), F.lit(0))
    free = F.regexp_replace(line, r"(?i)(port\s*)(?:(?U)\b\d{1,3}(?:,\d{3})+\b|\b\d{5,}\b)", "$1")
    numbers = F.filter(F.regexp_extract_all(free, F.lit(fixed.BIG_NUMBER), F.lit(0)), lambda m: (F.length(F.replace(m, F.lit(","), F.lit(""))) >= 5)
                       & ~F.array_contains(allowed, F.lower(m)) & ~F.exists(F.col("_money"), lambda c: F.contains(c, m)))
    found = F.array(*[F.when(line.rlike(term_pattern(t)), F.lit(t)) for t in terms]) if terms else F.array().cast("array<string>")
    lines = lines.withColumn("_money", money)

    def tagged(kind: str, hits: Column) -> Column:
        return F.transform(F.filter(hits, lambda h: h.isNotNull()), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("text")))

    hits = F.concat(tagged("name", names), tagged("currency", F.col("_money")), tagged("number", numbers), tagged("replace_term", found))
    return lines.select(*keys, "line", F.explode(hits).alias("h")).select(*keys, "line", "h.kind", "h.text")


def publish_gate(docs: DataFrame, text: str, report_status: str, terms: Sequence[str] = (), accept_residual: bool = False) -> DataFrame:
    """Why a document may not be published: no redaction report, report in review, or a surviving term."""
    body = F.col(text)
    alive = [F.when(body.rlike(term_pattern(t)), F.lit(t)) for t in sorted(terms)]
    left = F.array_join(F.filter(F.array(*alive), lambda t: t.isNotNull()), ", ") if terms else F.lit("")
    review = F.lit(not accept_residual) & (F.col(report_status) == "review")
    problem = (F.when(F.col(report_status).isNull(), "no redaction report").when(review, "redaction report needs review")
               .when(left != "", F.concat(F.lit("terms still present: "), left)))
    return docs.withColumns({"problem": problem, "publishable": problem.isNull()})


# --- tokens and search -----------------------------------------------------------------


def stem(token: Column) -> Column:
    out = token
    for suffix, minimum in reversed(fixed.STEM_SUFFIXES):
        fits = token.endswith(suffix) & (F.length(token) >= minimum) & ~token.endswith("ss")
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def tokens(text: Column | str) -> Column:
    """Lower-case alphanumeric tokens longer than two characters, without stop words, lightly stemmed."""
    body = F.lower((F.col(text) if isinstance(text, str) else text).cast("string"))
    kept = F.filter(F.regexp_extract_all(body, F.lit(r"[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(*fixed.STOPWORDS))
    return F.transform(kept, stem)


def tokenise(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tokens(text))


def kept_words(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """One row per kept token (column ``term``). Exploding first keeps the per-token work in generated code."""
    raw = df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text.cast("string")), F.lit(r"[a-z0-9]{3,}"), F.lit(0))).alias("term"))
    return raw.where(~F.col("term").isin(*fixed.STOPWORDS)).withColumn("term", stem(F.col("term")))


def keywords(df: DataFrame, key: Sequence[str], text: str, n: int = 20) -> DataFrame:
    """Distinctive terms per document: term frequency with a mild boost for longer terms."""
    counts = kept_words(df, key, F.col(text)).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    score = F.col("tf") * (1 + F.ln(F.length("term").cast("double")))
    order = Window.partitionBy(*key).orderBy(score.desc(), "term")
    return counts.withColumns({"score": score, "rank": F.row_number().over(order)}).where(F.col("rank") <= n)


def top_terms(text: Column, n: int = 20) -> Column:
    """The terms that ``keywords`` gives for a text of its own, best first; empty for a null text."""
    def counted(terms: Column) -> Column:
        starts = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(terms, x["i"] - 1) != x["term"]))
        return F.get(F.transform(F.array(starts), lambda found: F.transform(found, lambda x, j: F.struct(
            x["term"], (F.coalesce(F.get(found, j + 1)["i"], F.size(terms)) - x["i"]).alias("tf")))), F.lit(0))
    counts = F.get(F.transform(F.array(F.sort_array(tokens(text))), counted), F.lit(0))
    ranked = F.sort_array(F.transform(counts, lambda c: F.struct((-(c["tf"] * (1 + F.ln(F.length(c["term"]).cast("double"))))).alias("low"), c["term"].alias("term"))))
    return F.transform(F.slice(F.coalesce(ranked, F.array().cast("array<struct<low:double,term:string>>")), 1, n), lambda x: x["term"])


def query_terms(spark, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]))


def tfidf_search(docs: DataFrame, query: str, topic: str | None = None, k: int = 5) -> DataFrame:
    """Articles ranked for a query over weighted fields; the k best, score descending then path.

    ``docs``: path, title, summary, topics ARRAY, tags ARRAY, body. The tokens of a field are counted
    where they are read: only its length and its count per query term leave the map side.
    """
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    empty = F.array().cast("array<string>")
    candidates = docs if topic is None else docs.where(F.array_contains("topics", topic))
    if not terms:
        return candidates.limit(0).select("path", F.lit(0.0).alias("score"))
    labels = F.concat_ws(" ", F.coalesce("topics", empty), F.coalesce("tags", empty))
    texts = {"title": F.col("title"), "summary": F.col("summary"), "labels": labels, "body": F.col("body")}
    fields = F.array(*[F.struct(F.lit(float(fixed.FIELD_WEIGHTS[name])).alias("weight"), F.lit(name).alias("field"), F.coalesce(texts[name], F.lit("")).alias("text")) for name in texts])
    spread = candidates.select("path", F.explode(fields).alias("f")).select("path", "f.*")
    found = [f"_t{i}" for i in range(len(terms))]
    counted = kept_words(spread, ["path", "field", "weight"], F.col("text")).groupBy("path", "field", "weight").agg(
        F.count(F.lit(1)).alias("length"), *[F.count_if(F.col("term") == term).alias(c) for c, term in zip(found, terms)])
    hits = cut_lineage(counted.where(F.greatest(*[F.col(c) for c in found], F.lit(0)) > 0))
    # one number per query term comes to the driver
    spreads = hits.groupBy("path").agg(*[F.max(c).alias(c) for c in found]).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in found]).first()
    total = candidates.count()
    score = F.lit(0.0)
    for c in found:
        idf = math.log((total + 1) / (1 + (spreads[c] or 0))) + 1
        score = score + F.when(F.col(c) > 0, F.col("weight") * idf * (1 + F.ln(F.col(c).cast("double"))) / F.sqrt(F.col("length").cast("double"))).otherwise(0.0)
    scored = hits.groupBy("path").agg(F.round(F.sum(score), 4).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "path").limit(k)


def snippet(df: DataFrame, key: Sequence[str], text: str, terms: Sequence[str] | Column, width: int = 200) -> DataFrame:
    """The window of at most ``width`` characters that carries the most query terms; the first one wins.

    ``terms`` are fixed, or an array column with the terms of each row. A row is cut where it is read, in one walk over its words.
    Rows that share their key are read as one text, word by word in turn; only they go through windows.
    """
    again = _repeated(df, key)
    wanted = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    told = attach(df.withColumn("_terms", wanted).select(*key, F.col(text).alias("_text"), "_terms"), again, key)
    own = told.where("_c is null").select(*key, _normal("_text").alias("_body"), "_terms")
    return own.select(*key, _window_of(F.col("_body"), F.col("_terms"), width).alias("snippet")).unionByName(
        _shared_snippets(told.where("_c is not null").drop("_c"), key, width))


def _repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keys of several rows with their number (``_c``), as a table: while they are few, no text moves to meet them."""
    return stored(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"))


def _normal(text: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))


def _window_of(body: Column, terms: Column, width: int) -> Column:
    """The snippet of a text whose words stand one blank apart.

    The best window begins at the first word from which the last hit of the fullest one is still within reach, so the walk keeps the
    starts of the hits within reach of the latest one, the most that there were at once (``most``), and where that reach began (``at``).
    """
    bare = F.split(F.regexp_replace(F.lower(body), "[^a-z0-9 ]", ""), " ")
    marked = F.zip_with(F.split(body, " "), bare, lambda word, b: F.struct(
        (F.length(word) + 1).cast("bigint").alias("step"), F.coalesce(F.array_contains(terms, stem(b)), F.lit(False)).alias("hit")))

    def state(here: Column, near: Column, most: Column, at: Column) -> Column:
        return F.struct(here.alias("here"), near.alias("near"), most.alias("most"), at.alias("at"))

    def walk(s: Column, word: Column) -> Column:
        after = s["here"] + word["step"]
        near = F.filter(F.concat(s["near"], F.array(s["here"])), lambda x: x >= after - width)
        fuller = F.size(near) > s["most"]
        met = state(after, near, F.greatest(F.size(near), s["most"]), F.when(fuller, F.greatest(after - width, F.lit(0).cast("bigint"))).otherwise(s["at"]))
        return F.when(word["hit"], met).otherwise(state(after, s["near"], s["most"], s["at"]))
    zero = F.lit(0).cast("bigint")
    at = F.aggregate(marked, state(zero, F.array().cast("array<bigint>"), F.lit(0), zero), walk, lambda s: s["at"])

    def cut(at: Column) -> Column:
        start = F.when(at == 0, zero).otherwise(at - 1 + F.instr(F.substr(body, at), " "))
        return F.get(F.transform(F.array(start), rest), F.lit(0))

    def rest(start: Column) -> Column:
        seen = F.substr(body, start + 1, F.lit(max(width, 0)))
        whole = F.length(body) - start < width
        piece = F.when(whole, seen).otherwise(F.regexp_extract(seen, "(?s)^(.*) ", 1))
        return F.concat(F.when(start > 0, "… ").otherwise(""), piece, F.when(whole, "").otherwise(" …"))
    return F.when(body == "", "").otherwise(F.get(F.transform(F.array(at), cut), F.lit(0)))


def _shared_snippets(df: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    """Snippets of rows (key, _text, _terms) that share their key. A range frame over the offsets of their words gives each start its window."""
    body = _normal("_text")
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))
    rows = df.select(*key, "_terms", F.posexplode(F.concat(words, F.array(F.lit(None).cast("string")))).alias("at", "word"))
    bare = stem(F.regexp_replace(F.lower("word"), "[^a-z0-9]", ""))
    hit = F.coalesce(F.array_contains("_terms", bare), F.lit(False)).cast("int")
    inside = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("hit", hit).withColumns({
        "start": F.coalesce(F.sum(F.length("word") + 1).over(inside), F.lit(0).cast("bigint")), "hits_before": F.coalesce(F.sum("hit").over(inside), F.lit(0).cast("bigint"))})
    reach = Window.partitionBy(*key).orderBy("start").rangeBetween(0, width)
    windows = placed.withColumns({"end": F.max("at").over(reach), "hits": F.max("hits_before").over(reach) - F.col("hits_before")}).where("word is not null")
    best = windows.groupBy(*key).agg(F.max_by(F.struct("at", "end"), F.struct("hits", (-F.col("at")).alias("first"))).alias("b"))
    out = attach(df.select(*key, words.alias("_w")), best, key)
    piece = F.array_join(F.slice("_w", F.col("b.at") + 1, F.col("b.end") - F.col("b.at")), " ")
    lead = F.when(F.col("b.at") > 0, "… ").otherwise("")
    tail = F.when(F.col("b.end") < F.size("_w"), " …").otherwise("")
    return out.select(*key, F.when(F.col("b").isNull(), "").otherwise(F.concat(lead, piece, tail)).alias("snippet"))


def search(docs: DataFrame, query: str, topic: str | None = None, k: int = 5) -> DataFrame:
    """Ranked hits with title, date and topics, as far as the articles have them, and their snippets."""
    top = tfidf_search(docs, query, topic, k)
    bodies = docs.join(F.broadcast(top), "path")  # k rows
    cut = snippet(bodies, ["path"], "body", query_terms(docs.sparkSession, query))
    shown = [c for c in ("title", "date", "topics") if c in docs.columns]
    return bodies.select("path", *shown, "score").join(cut, "path").orderBy(F.desc("score"), "path")


# --- articles ----------------------------------------------------------------------------


def _unquote(value: Column) -> Column:
    text = F.trim(value)
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    inner = F.replace(F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(quoted, inner).otherwise(text)


def front_matter(df: DataFrame, text: str) -> DataFrame:
    """Header fields and body: title, date, topics, tags, summary, ``meta`` (all scalar fields) and ``body``."""
    shape = r"(?s)^---(.*?)\n---(.*)$"
    body = F.col(text)
    headed = body.rlike(shape)
    rows = df.withColumn("_head", F.when(headed, F.regexp_extract(body, shape, 1)).otherwise("")).withColumn(
        "body", F.when(headed, F.regexp_replace(F.regexp_extract(body, shape, 2), r"^\n+", "")).otherwise(body))
    rows = rows.withColumn("_lines", F.filter(F.split("_head", fixed.LINE_BREAK), lambda line: F.contains(line, F.lit(":"))))

    def key_of(line: Column) -> Column:
        return F.trim(F.substring_index(line, ":", 1))

    def value_of(line: Column) -> Column:
        return F.trim(F.substr(line, F.instr(line, ":") + 1))

    def raw(name: str) -> Column:
        """The last line of a key wins."""
        return value_of(F.try_element_at(F.filter("_lines", lambda line: key_of(line) == name), F.lit(-1)))

    def scalar(name: str) -> Column:
        return _unquote(raw(name))

    def listed(name: str) -> Column:
        inner = F.regexp_extract(raw(name), r"(?s)^\[(.*)\]$", 1)
        parts = F.filter(F.regexp_extract_all(inner, F.lit(r'"(?:[^"\\]|\\.)*"|[^,\[\]]+'), F.lit(0)), lambda p: F.trim(p) != "")
        return F.coalesce(F.transform(parts, _unquote), F.array().cast("array<string>"))

    later = F.filter("_lines", lambda line, i: ~F.exists(F.slice("_lines", i + 2, F.size("_lines")), lambda x: key_of(x) == key_of(line)))
    meta = F.map_from_entries(F.transform(later, lambda line: F.struct(key_of(line).alias("key"), _unquote(value_of(line)).alias("value"))))
    return rows.select(*df.columns, scalar("title").alias("title"), F.coalesce(scalar("date"), F.lit("")).alias("date"), listed("topics").alias("topics"),
                       listed("tags").alias("tags"), F.coalesce(scalar("summary"), F.lit("")).alias("summary"), meta.alias("meta"), "body")


def article_index(docs: DataFrame, key: str = "path", text: str = "text", n: int = 20) -> DataFrame:
    """Index rows: header fields, top keywords and word count, newest first.

    Terms are counted within the row of an article. Articles that share a key share their keywords, which are counted over all of them.
    """
    parsed = attach(front_matter(docs.select(key, text), text), _repeated(docs, [key]), [key])
    shared = keywords(parsed.where("_c is not null"), [key], "body", n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_shared"))
    own = F.when(F.col("_c").isNull() & F.col(key).isNotNull(), top_terms(F.col("body"), n))
    words = F.regexp_count("body", F.lit(r"(?U)\S+")).cast("bigint")
    out = parsed.select(key, F.coalesce("title", F.regexp_extract(key, r"([^/]*?)(?:\.md)?$", 1)).alias("title"), "date", "topics", "tags", "summary", words.alias("words"), own.alias("_own"))
    out = out.join(shared, key, "left").withColumn("keywords", F.coalesce("_own", "_shared", F.array().cast("array<string>"))).drop("_own", "_shared")
    # a sort reads its input twice, once to find its ranges: of these rows, not of the texts
    return stored(out).orderBy(F.desc("date"), F.desc(key))


def topic_counts(index: DataFrame, vocabulary: DataFrame, strict: bool = True) -> DataFrame:
    """Articles per topic of the vocabulary, zero included; an unknown topic is refused.

    ``vocabulary``: topic. With ``strict`` off unknown topics come back with ``known`` false.
    """
    used = index.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("articles"))
    joined = vocabulary.select("topic", F.lit(True).alias("_known")).join(used, "topic", "full")
    known = F.coalesce("_known", F.lit(False))
    count = F.coalesce("articles", F.lit(0).cast("bigint"))
    if strict:
        count = F.when(known, count).otherwise(F.raise_error(F.concat(F.lit("unknown topic "), F.col("topic"))).cast("bigint"))
        return joined.select("topic", count.alias("articles"))
    return joined.select("topic", known.alias("known"), count.alias("articles"))


# --- sessions ----------------------------------------------------------------------------


def block_text(content: Column | str) -> Column:
    """Text of a message body: a JSON string, or the text blocks of a JSON list joined by newlines."""
    body = F.col(content) if isinstance(content, str) else content
    plain = F.from_json(F.concat(F.lit('{"s":'), body, F.lit("}")), "s string")["s"]
    blocks = F.from_json(body, "array<struct<type string, text string>>")
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "")), lambda b: b["text"])
    return F.trim(F.when(body.startswith('"'), plain).when(body.startswith("["), F.array_join(parts, "\n")).otherwise(""))


def session_digest(events: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session: first and last time, events, prompts, answers, commands, skills and errors.

    ``events``: by…, type, timestamp, content (JSON text of the message content).
    """
    blocks = F.from_json("content", "array<struct<type string, name string, is_error boolean, input struct<command string>>>")
    listed = F.when(F.startswith("content", F.lit("[")), blocks)
    rows = events.withColumns({"_text": block_text("content"), "_blocks": F.coalesce(listed, F.array().cast(
        "array<struct<type string, name string, is_error boolean, input struct<command string>>>"))})

    def using(name: str) -> Column:
        return F.size(F.filter("_blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == name)))

    commands = F.size(F.filter("_blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == "Bash") & (b["input"]["command"] != "")))
    errors = F.size(F.filter("_blocks", lambda b: (b["type"] == "tool_result") & b["is_error"]))
    said = F.coalesce(F.col("_text"), F.lit("")) != ""
    return rows.groupBy(*by).agg(
        F.min(F.nullif("timestamp", F.lit(""))).alias("started_at"), F.max(F.nullif("timestamp", F.lit(""))).alias("ended_at"), F.count(F.lit(1)).alias("events"),
        F.count_if((F.col("type") == "user") & said).alias("prompts"), F.count_if((F.col("type") == "assistant") & said).alias("answers"),
        F.sum(commands).alias("commands"), F.sum(using("Skill")).alias("skills"), F.sum(errors).alias("errors"),
        F.sum(F.when(said, F.length("_text")).otherwise(0)).alias("chars"))


def event_types(events: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    return events.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("events"))


def char_budget(items: DataFrame, by: Sequence[str], section: str, position: str, text: str, sections: Sequence[str], max_chars: int) -> DataFrame:
    """Items kept within a character budget, spent section by section in the given order.

    A section stops at its first item that no longer fits; the next section goes on with what is
    left. Running lengths are computed once; each section then needs only its own maximum.
    """
    # only keys and lengths are summed and materialised; the texts are joined once at the end
    sized = items.where(F.col(section).isin(*sections)).select(*by, section, position, F.length(text).cast("bigint").alias("_len"))
    measured = cut_lineage(running_sums(sized, [*by, section], position, {"_upto": F.col("_len")}))
    spent = measured.select(*by).distinct().withColumn("_spent", F.lit(0).cast("bigint"))
    kept = None
    for name in sections:
        here = attach(measured.where(F.col(section) == name), spent, by, "inner").where(F.col("_upto") <= max_chars - F.col("_spent"))
        part = here.select(*by, section, position)
        kept = part if kept is None else kept.unionByName(part)
        used = here.groupBy(*by).agg(F.max("_upto").alias("_used"))
        spent = cut_lineage(attach(spent, used, by).select(*by, (F.col("_spent") + F.coalesce("_used", F.lit(0).cast("bigint"))).alias("_spent")))
    return attach(items, kept.withColumn("_kept", F.lit(True)), [*by, section, position], "inner").drop("_kept")


def budget_summary(items: DataFrame, kept: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Per session: items and characters kept, items left out, and whether anything was cut (``truncated``)."""
    def sized(df: DataFrame, n: str, chars: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias(chars))
    zero = F.lit(0).cast("bigint")
    both = attach(sized(items, "_items", "_all"), sized(kept, "kept", "chars"), by)
    out = both.select(*by, F.coalesce("kept", zero).alias("kept"), F.coalesce("chars", zero).alias("chars"), (F.col("_items") - F.coalesce("kept", zero)).alias("dropped"))
    return out.withColumn("truncated", F.col("dropped") > 0)


def technical(df: DataFrame, text: str) -> DataFrame:
    """Add the earliest technical token of each sentence (null when it reads plainly)."""
    return df.withColumn("token", technical_token(text))
