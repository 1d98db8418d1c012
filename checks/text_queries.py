"""Text jobs over whole documents, conversations and pages."""

import uuid

from pyspark.sql import functions as F

from checks.base import query, rounded, table
from plumbline.functions import fixed_values as fixed
from plumbline.functions import scalars as sc
from plumbline.operators import search_index, term_dictionary
from plumbline.operators import text as t
from plumbline.session import shared_folder
from plumbline.sources.evidence import parse_events, read_texts

TERMS = {"that": "[w1]", "hein": "[w2]", "of the": "[w3]", "the": "[w4]", "la": "[w5]"}


def _docs(spark, sf):
    return read_texts(spark, f"{sf}/documents.parquet", "doc_id", "text", "lang", "source", partitions=spark.sparkContext.defaultParallelism)



def _terms_sql(body):
    """Whole-word replacement; applied twice because a match also consumes its neighbour character."""
    for term in t.ordered_terms(list(TERMS)):
        for _ in range(2):
            body = f"regexp_replace({body}, '(?i)(^|[^\\pL\\pN_]){term}($|[^\\pL\\pN_])', '\\1{TERMS[term]}\\2', 'g')"
    return body


@query("redact_terms", f"SELECT doc_id, md5({_terms_sql('text')}) AS digest FROM documents")
def redact_terms(spark, sf):
    return t.redact_terms(_docs(spark, sf), "text", TERMS).select("doc_id", F.md5("text").alias("digest"))


SYLLABLES = [a + b for a in "aeiours" for b in "dhlnrstw"] + ["th", "en", "ing", "ion", "ung", "que", "ment", "eau"]
#: About four thousand words of two syllables, and pairs of words; no term of one piece is part of another.
DICTIONARY = {a + b: "[w]" for a in SYLLABLES for b in SYLLABLES if a + b not in ("the", "of", *SYLLABLES)} | {f"{a} the": "[t]" for a in SYLLABLES} | {f"of {a}": "[o]" for a in SYLLABLES}
PIECES = rf"""dictionary AS MATERIALIZED (SELECT UNNEST({[t for t in DICTIONARY if " " not in t]}) AS term), p0 AS (SELECT doc_id, UNNEST(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|(?s:.)')) AS piece, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|(?s:.)'), 1) AS i FROM documents),
p1 AS (SELECT *, lower(piece) AS x, LEAD(lower(piece)) OVER w AS x1, LEAD(lower(piece), 2) OVER w AS x2, LEAD(lower(piece), 3) OVER w AS x3, LEAD(lower(piece), 4) OVER w AS x4 FROM p0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p2 AS (SELECT *, COALESCE(x IN {tuple(SYLLABLES)} AND x1 = ' ' AND x2 = 'the', FALSE) AS t, COALESCE(x = 'of' AND x1 = ' ' AND x2 IN {tuple(SYLLABLES)}, FALSE) AS o, COALESCE(x3 = ' ' AND x4 = 'the', FALSE) AS later FROM p1),
p3 AS (SELECT *, t OR (o AND NOT later) AS multi FROM p2),
p4 AS MATERIALIZED (SELECT p3.*, COALESCE(LAG(multi) OVER w, FALSE) OR COALESCE(LAG(multi, 2) OVER w, FALSE) AS inside, term IS NOT NULL AS single FROM p3 LEFT JOIN dictionary ON x = term WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p5 AS (SELECT *, CASE WHEN inside THEN '' WHEN multi AND t THEN '[t]' WHEN multi THEN '[o]' WHEN single THEN '[w]' ELSE piece END AS out FROM p4)"""


@query("redact_dictionary", f"""WITH {PIECES} SELECT d.doc_id, md5(COALESCE(string_agg(out, '' ORDER BY i), '')) AS digest, COUNT(*) FILTER (NOT inside AND (multi OR single)) AS hits
FROM documents d LEFT JOIN p5 USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""")
def redact_dictionary(spark, sf):
    """About four thousand terms in one pass."""
    out = term_dictionary.redact_dictionary(_docs(spark, sf), "text", DICTIONARY)
    total = F.aggregate(F.map_values("term_hits"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return out.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), total.alias("hits"))


@query("surviving_terms", f"""WITH {PIECES}, s AS (SELECT doc_id, x AS term FROM p4 WHERE single UNION SELECT doc_id, x || ' the' FROM p2 WHERE t UNION SELECT doc_id, 'of ' || x2 FROM p2 WHERE o)
SELECT d.doc_id, COALESCE(string_agg(term, ';' ORDER BY term), '') AS surviving FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1""")
def surviving_terms(spark, sf):
    return rounded(term_dictionary.surviving_terms(_docs(spark, sf), "text", list(DICTIONARY)).select("doc_id", "surviving"))


PHONE = r"(^|[^\w.\-])((?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4})($|[^\d\-])"


def _pii_sql(body):
    steps = [(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email]"),
             (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[id]"),
             (r"\bhttps?://[^\s)\]}>\"''`]+", "[url]"),
             (r"[A-Za-z]:[\\/]+Users[\\/]+[^\\/\s\"''`<>|]+(?:[\\/]+[^\s\"''`<>|]*)*", "[path]"),
             (r"/(?:home|Users)/[^/\s\"''`<>|]+(?:/[^\s\"''`<>|]*)*", "[path]"),
             (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]")]
    for pattern, token in steps:
        body = f"regexp_replace({body}, '{pattern}', '{token}', 'g')"
    return f"regexp_replace({body}, '{PHONE}', '\\1[phone]\\3', 'g')"


@query("redact_pii", f"SELECT doc_id, md5({_pii_sql('text')}) AS digest FROM documents")
def redact_pii(spark, sf):
    return t.redact_pii(_docs(spark, sf), "text").select("doc_id", F.md5("text").alias("digest"))


@query("redact_pii_counts", r"""
WITH a AS (SELECT source, text, regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g') AS b FROM documents)
SELECT source, SUM(len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')))::BIGINT AS email, SUM(len(regexp_extract_all(b, '\b(?:\d{1,3}\.){3}\d{1,3}\b')))::BIGINT AS ip FROM a GROUP BY 1""")
def redact_pii_counts(spark, sf):
    hits = t.redact_pii(_docs(spark, sf), "text")
    return hits.groupBy("source").agg(F.sum("pii_hits.email").alias("email"), F.sum("pii_hits.ip").alias("ip"))


@query("redact_page_urls", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(url || ' ' || html, '\bhttps?://[^\s)\]}>\"''`]+', '[url]', 'g'), '/(?:home|Users)/[^/\s\"''`<>|]+(?:/[^\s\"''`<>|]*)*', '[path]', 'g')) AS digest FROM pages""")
def redact_page_urls(spark, sf):
    pages = read_texts(spark, f"{sf}/pages.parquet", "page_id", "url", "html", partitions=spark.sparkContext.defaultParallelism).select("page_id", F.concat_ws(" ", "url", "html").alias("body"))
    body = F.regexp_replace(F.regexp_replace("body", t.url_pattern(), "[url]"), fixed.POSIX_USER_PATH, "[path]")
    return pages.select("page_id", F.md5(body).alias("digest"))


def _residual_sql():
    usual = "[" + ", ".join(f"'{w}'" for w in sorted(set(fixed.COMMON_CAPITALISED))) + "]"
    return f"""
WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
x AS (SELECT doc_id, line, regexp_replace(raw, '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]', '_', 'g') AS s FROM l),
n AS (SELECT doc_id, 'name' AS kind, UNNEST(list_filter(regexp_extract_all(s, '\\b[A-Z][A-Za-z0-9]+(?:[ \\-][A-Z][A-Za-z0-9]+)+\\b'),
   lambda m: len(list_filter(regexp_split_to_array(m, '[ -]'), lambda w: NOT list_contains({usual}, lower(w)) AND NOT (upper(w) = w AND len(w) >= 3))) >= 2)) AS hit FROM x),
c AS (SELECT doc_id, line, s, regexp_extract_all(s, '[$€£¥]\\s?\\d[\\d,]*(?:\\.\\d+)?|\\b\\d[\\d,]*(?:\\.\\d+)?\\s?(?:USD|EUR|GBP|CAD|AUD|ILS|CHF)\\b') AS money FROM x),
b AS (SELECT doc_id, 'number' AS kind, UNNEST(list_filter(regexp_extract_all(s, '\\b\\d{{1,3}}(?:,\\d{{3}})+\\b|\\b\\d{{5,}}\\b'),
   lambda m: len(replace(m, ',', '')) >= 5 AND len(list_filter(money, lambda q: contains(q, m))) = 0)) AS hit FROM c)
SELECT doc_id, kind, COUNT(*) AS hits, MIN(hit) AS first_hit FROM (SELECT * FROM n UNION ALL SELECT * FROM b UNION ALL SELECT doc_id, 'currency', UNNEST(money) FROM c) GROUP BY 1, 2"""


@query("residual_scan", _residual_sql())
def residual_scan(spark, sf):
    found = t.residual_scan(_docs(spark, sf), ["doc_id"], "text")
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("hits"), F.min("text").alias("first_hit"))


@query("publish_gate", r"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN lang = 'fr' THEN 'review' ELSE 'clean' END AS st, regexp_matches(text, '(?i)(^|[^\pL\pN_])hein($|[^\pL\pN_])') AS a, regexp_matches(text, '(?i)(^|[^\pL\pN_])of the($|[^\pL\pN_])') AS b FROM documents)
SELECT doc_id, CASE WHEN st IS NULL THEN 'no redaction report' WHEN st = 'review' THEN 'redaction report needs review' WHEN a AND b THEN 'terms still present: hein, of the' WHEN a THEN 'terms still present: hein' WHEN b THEN 'terms still present: of the' END AS problem FROM x""")
def publish_gate(spark, sf):
    status = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("lang") == "fr", "review").otherwise("clean")
    return t.publish_gate(_docs(spark, sf).withColumn("status", status), "text", "status", ["hein", "of the"]).select("doc_id", "problem")


STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"


def _tokens_sql(body):
    kept = f"list_filter(regexp_extract_all(lower({body}), '[a-z0-9]+'), lambda w: len(w) > 2 AND NOT list_contains({STOP}, w))"
    return f"""list_transform({kept}, lambda w: CASE WHEN w LIKE '%ss' THEN w WHEN w LIKE '%ing' AND len(w) >= 6 THEN w[:-4] WHEN w LIKE '%ed' AND len(w) >= 5 THEN w[:-3]
  WHEN w LIKE '%es' AND len(w) >= 5 THEN w[:-3] WHEN w LIKE '%s' AND len(w) >= 4 THEN w[:-2] ELSE w END)"""


@query("tokenise", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS k FROM documents)")
def tokenise(spark, sf):
    return t.tokenise(_docs(spark, sf), "text").select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("keywords", f"""WITH k AS (SELECT doc_id, UNNEST({_tokens_sql('text')}) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS tf FROM k GROUP BY 1, 2)
SELECT doc_id, term, tf, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY tf * (1 + ln(len(term))) DESC, term) AS rank FROM c QUALIFY rank <= 20""")
def keywords(spark, sf):
    return rounded(t.keywords(_docs(spark, sf), ["doc_id"], "text").select("doc_id", "term", "tf", "rank"))


QUERY = "worthless onering hested of nicht ueberall theron ndwhst ouier that heinan"


def _articles(spark, sf):
    """Documents as articles: title, date, topics and tags in a header, the text as body."""
    k = F.col("doc_id")
    head = F.concat(F.lit('---\ntitle: "Note '), k.cast("string"), F.lit(' on \\"'), F.col("source"), F.lit('\\""\ndate: "2024-01-'), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit('"\ntopics: ["'),
                    F.get(F.array(F.lit("ga4"), F.lit("dbt"), F.lit("bigquery")), (k % 3).cast("int")), F.lit('", "attribution"]\ntags: ['), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\nsummary: about "), F.col("lang"),
                    F.lit("\nanonymized: true\n---\n\n"))
    return _docs(spark, sf).select(F.concat(F.lit("articles/doc-"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(head, F.col("text")).alias("text"))


ART = r"""art AS (SELECT doc_id, 'articles/doc-' || doc_id || '.md' AS path, 'Note ' || doc_id || ' on "' || source || '"' AS title, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date,
  CASE doc_id % 3 WHEN 0 THEN 'ga4' WHEN 1 THEN 'dbt' ELSE 'bigquery' END AS topic, lang, source, ltrim(text, chr(10)) AS body FROM documents)"""


@query("front_matter", f"WITH {ART} SELECT path, title, date, topic || ';attribution' AS topics, lang || ';' || source AS tags, 'about ' || lang AS summary, md5(body) AS digest FROM art")
def front_matter(spark, sf):
    parsed = t.front_matter(_articles(spark, sf), "text")
    return rounded(parsed.select("path", "title", "date", "topics", "tags", "summary", F.md5("body").alias("digest")))


@query("article_index", f"""WITH {ART}, k AS (SELECT path, UNNEST({_tokens_sql('body')}) AS term FROM art), c AS (SELECT path, term, COUNT(*) AS tf FROM k GROUP BY 1, 2),
r AS (SELECT path, term, ROW_NUMBER() OVER (PARTITION BY path ORDER BY tf * (1 + ln(len(term))) DESC, term) AS rank FROM c QUALIFY rank <= 20), g AS (SELECT path, STRING_AGG(term, ';' ORDER BY rank) AS keywords FROM r GROUP BY 1)
SELECT path, title, date, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS words, COALESCE(keywords, '') AS keywords FROM art LEFT JOIN g USING (path)""")
def article_index(spark, sf):
    return rounded(t.article_index(_articles(spark, sf)).select("path", "title", "date", "words", "keywords"))


@query("topic_counts", f"""WITH {ART}, v AS (SELECT UNNEST({list(fixed.TOPICS)}) AS topic) SELECT v.topic, CASE WHEN v.topic = 'attribution' THEN (SELECT COUNT(*) FROM art) ELSE (SELECT COUNT(*) FROM art WHERE art.topic = v.topic) END AS articles FROM v""")
def topic_counts(spark, sf):
    vocabulary = spark.createDataFrame([(x,) for x in fixed.TOPICS], "topic string")
    return t.topic_counts(t.front_matter(_articles(spark, sf), "text"), vocabulary)


SEARCH = f"""{ART}, q AS (SELECT DISTINCT UNNEST({_tokens_sql("'" + QUERY + "'")}) AS term),
cand AS (SELECT * FROM art WHERE topic IN ('ga4', 'dbt', 'bigquery')),
f AS (SELECT path, 'title' AS field, 3.0::DOUBLE AS w, {_tokens_sql('title')} AS k FROM cand UNION ALL SELECT path, 'summary', 2.0, {_tokens_sql("'about ' || lang")} FROM cand
  UNION ALL SELECT path, 'labels', 3.0, {_tokens_sql("topic || ' attribution ' || lang || ' ' || source")} FROM cand UNION ALL SELECT path, 'body', 1.0, {_tokens_sql('body')} FROM cand),
e AS (SELECT path, field, w, GREATEST(len(k), 1) AS len, UNNEST(k) AS term FROM f), h AS (SELECT path, field, w, len, term, COUNT(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, ln((CAST((SELECT COUNT(*) FROM cand) AS DOUBLE) + 1) / (1 + COUNT(DISTINCT path))) + 1 AS idf FROM h GROUP BY 1),
s AS (SELECT path, ROUND(SUM(w * idf * (1 + ln(tf)) / sqrt(len)), 4) AS score FROM h JOIN d USING (term) GROUP BY 1)"""


@query("tfidf_search", f"WITH {SEARCH} SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 5")
def tfidf_search(spark, sf):
    return t.tfidf_search(t.front_matter(_articles(spark, sf), "text"), QUERY, topic="attribution").select("path", "score")


SNIP_TERMS = ("that", "nicht", "elle", "los")


@query("snippet", f"""WITH w0 AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')) AS b FROM documents),
w AS (SELECT doc_id, string_split(b, ' ') AS ws FROM w0 WHERE b <> ''),
u AS (SELECT doc_id, ws, UNNEST(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
st AS (SELECT doc_id, i, word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS bare FROM u),
sm AS (SELECT doc_id, i, word, CASE WHEN bare LIKE '%ss' THEN bare WHEN bare LIKE '%ing' AND len(bare) >= 6 THEN bare[:-4] WHEN bare LIKE '%ed' AND len(bare) >= 5 THEN bare[:-3] WHEN bare LIKE '%es' AND len(bare) >= 5 THEN bare[:-3]
  WHEN bare LIKE '%s' AND len(bare) >= 4 THEN bare[:-2] ELSE bare END AS stem FROM st),
p AS (SELECT *, SUM(len(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS stop, SUM(CASE WHEN stem IN {SNIP_TERMS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM sm),
pp AS (SELECT *, stop - len(word) - 1 AS start, h - CASE WHEN stem IN {SNIP_TERMS} THEN 1 ELSE 0 END AS hb FROM p),
c AS (SELECT a.doc_id, a.i, COALESCE(COUNT(b.i), 0) AS n, COALESCE(MAX(b.h), a.hb) - a.hb AS hits FROM pp a LEFT JOIN pp b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 101 AND b.stop <= a.start + 200 GROUP BY a.doc_id, a.i, a.hb),
best AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) = 1)
SELECT doc_id, CASE WHEN i > 0 THEN '… ' ELSE '' END || array_to_string(ws[i + 1 : i + n], ' ') || CASE WHEN i + n < len(ws) THEN ' …' ELSE '' END AS snippet FROM best JOIN w USING (doc_id)
UNION ALL SELECT doc_id, '' FROM w0 WHERE b = ''""")
def snippet(spark, sf):
    return t.snippet(_docs(spark, sf), ["doc_id"], "text", SNIP_TERMS)


TOPIC = "CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ga4' WHEN 2 THEN 'dbt' ELSE 'attribution' END"


@query("search_hits", f"""WITH {ART}, b AS (SELECT item_id AS query_id, {TOPIC} AS topic, {_tokens_sql('text')} AS k FROM benchmark), q AS (SELECT DISTINCT query_id, topic, UNNEST(k) AS term FROM b),
f AS (SELECT path, 3.0::DOUBLE AS w, {_tokens_sql('title')} AS k FROM art UNION ALL SELECT path, 2.0, {_tokens_sql("'about ' || lang")} FROM art
  UNION ALL SELECT path, 3.0, {_tokens_sql("topic || ' attribution ' || lang || ' ' || source")} FROM art UNION ALL SELECT path, 1.0, {_tokens_sql('body')} FROM art),
e AS (SELECT path, w, len(k) AS len, UNNEST(k) AS term FROM f), h AS (SELECT path, w, len, term, COUNT(*) AS tf FROM e GROUP BY ALL),
m AS (SELECT query_id, q.topic, term, path, w, len, tf FROM q JOIN h USING (term) JOIN art USING (path) WHERE q.topic IS NULL OR q.topic = 'attribution' OR q.topic = art.topic),
d AS (SELECT query_id, term, ln((CAST(any_value(n) AS DOUBLE) + 1) / (1 + COUNT(DISTINCT path))) + 1 AS idf
  FROM m JOIN (SELECT query_id AS qid, (SELECT COUNT(*) FROM art WHERE b.topic IS NULL OR b.topic = 'attribution' OR b.topic = art.topic) AS n FROM b) ON query_id = qid GROUP BY 1, 2),
s AS (SELECT query_id, path, ROUND(SUM(w * idf * (1 + ln(tf)) / sqrt(len)), 4) AS score FROM m JOIN d USING (query_id, term) GROUP BY 1, 2),
t AS (SELECT query_id, path, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 5),
w AS (SELECT query_id, path, string_split(trim(regexp_replace(body, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')), ' ') AS ws FROM t JOIN art USING (path)),
u AS (SELECT query_id, path, UNNEST(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w), x AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS bare FROM u),
y AS (SELECT *, CASE WHEN bare LIKE '%ss' THEN bare WHEN bare LIKE '%ing' AND len(bare) >= 6 THEN bare[:-4] WHEN bare LIKE '%ed' AND len(bare) >= 5 THEN bare[:-3] WHEN bare LIKE '%es' AND len(bare) >= 5 THEN bare[:-3]
  WHEN bare LIKE '%s' AND len(bare) >= 4 THEN bare[:-2] ELSE bare END AS stem FROM x),
z AS (SELECT y.query_id, path, i, word, CASE WHEN q.term IS NULL THEN 0 ELSE 1 END AS hit FROM y LEFT JOIN q ON q.query_id = y.query_id AND q.term = y.stem),
p AS (SELECT *, SUM(len(word) + 1) OVER (PARTITION BY query_id, path ORDER BY i) AS stop, SUM(hit) OVER (PARTITION BY query_id, path ORDER BY i) AS hs FROM z),
c AS (SELECT a.query_id, a.path, a.i, COALESCE(COUNT(o.i), 0) AS n, COALESCE(MAX(o.hs), a.hs - a.hit) - (a.hs - a.hit) AS hits FROM p a LEFT JOIN p o ON a.query_id = o.query_id AND a.path = o.path AND o.i >= a.i AND o.i < a.i + 101
  AND o.stop <= a.stop - len(a.word) - 1 + 200 GROUP BY a.query_id, a.path, a.i, a.hs, a.hit),
g AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, path ORDER BY hits DESC, i) = 1)
SELECT query_id, rank, path, title, date, topic || ';attribution' AS topics, score,
  CASE WHEN i > 0 THEN '… ' ELSE '' END || array_to_string(ws[i + 1 : i + n], ' ') || CASE WHEN i + n < len(ws) THEN ' …' ELSE '' END AS snippet
FROM t JOIN art USING (path) JOIN g USING (query_id, path) JOIN w USING (query_id, path)""")
def search_hits(spark, sf):
    """Every benchmark text is a query, a quarter of them over all articles and the others within a topic."""
    folder = f"{shared_folder(spark)}/search-index-{uuid.uuid4().hex}"
    search_index.build(t.front_matter(_articles(spark, sf), "text"), folder)
    k = F.col("item_id") % 4
    topic = F.when(k == 1, "ga4").when(k == 2, "dbt").when(k == 3, "attribution")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), topic.alias("topic"), F.col("text").alias("query"))
    return rounded(search_index.search(spark, folder, queries))


def _log(spark, sf):
    """Conversations as event lines; every tenth turn is a broken line."""
    c = table(spark, sf, "conversations")
    stamp = F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"))
    block = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.col("role").alias("type"), stamp.alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message")))
    line = F.when(((F.col("conv_id") + F.col("turn")) % 10) == 9, F.substring(block, 1, 30)).otherwise(block)
    return c.select("conv_id", "turn", line.alias("value"))


@query("event_scan", "SELECT conv_id, COUNT(*) FILTER (WHERE (conv_id + turn) % 10 <> 9) AS events, COUNT(*) FILTER (WHERE (conv_id + turn) % 10 = 9) AS malformed_lines FROM conversations GROUP BY 1")
def event_scan(spark, sf):
    return parse_events(_log(spark, sf), by=["conv_id"])[1]


@query("session_digest", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, MIN('2024-01-01T00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0')) AS started_at, MAX('2024-01-01T00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0')) AS ended_at, COUNT(*) AS events,
  COUNT(*) FILTER (WHERE role = 'user' AND trim(text) <> '') AS prompts, COUNT(*) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS answers, CAST(SUM(len(trim(text))) AS BIGINT) AS chars FROM conversations WHERE (conv_id + turn) % 10 <> 9 GROUP BY 1""")
def session_digest(spark, sf):
    events, _ = parse_events(_log(spark, sf), by=["conv_id"])
    return t.session_digest(events).select("session_id", "started_at", "ended_at", "events", "prompts", "answers", "chars")


@query("event_types", "SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS type, COUNT(*) AS events FROM conversations WHERE (conv_id + turn) % 10 <> 9 GROUP BY 1, 2")
def event_types(spark, sf):
    return t.event_types(parse_events(_log(spark, sf), by=["conv_id"])[0])


@query("char_budget", """
WITH i AS (SELECT conv_id, turn, role, SUM(len(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS upto FROM conversations),
k1 AS (SELECT * FROM i WHERE role = 'user' AND upto <= 2500), r1 AS (SELECT conv_id, MAX(upto) AS used FROM k1 GROUP BY 1),
k2 AS (SELECT i.* FROM i LEFT JOIN r1 USING (conv_id) WHERE role = 'assistant' AND upto <= 2500 - COALESCE(used, 0)), r2 AS (SELECT conv_id, SUM(used) AS used FROM (SELECT * FROM r1 UNION ALL SELECT conv_id, MAX(upto) FROM k2 GROUP BY 1) GROUP BY 1),
k3 AS (SELECT i.* FROM i LEFT JOIN r2 USING (conv_id) WHERE role = 'system' AND upto <= 2500 - COALESCE(used, 0))
SELECT conv_id, turn, role FROM k1 UNION ALL SELECT conv_id, turn, role FROM k2 UNION ALL SELECT conv_id, turn, role FROM k3""")
def char_budget(spark, sf):
    c = table(spark, sf, "conversations")
    return t.char_budget(c, ["conv_id"], "role", "turn", "text", ["user", "assistant", "system"], 2500).select("conv_id", "turn", "role")


@query("budget_summary", """
WITH i AS (SELECT conv_id, turn, role, len(text) AS size, SUM(len(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS upto FROM conversations),
k1 AS (SELECT * FROM i WHERE role = 'user' AND upto <= 2500), r1 AS (SELECT conv_id, MAX(upto) AS used FROM k1 GROUP BY 1),
k2 AS (SELECT i.* FROM i LEFT JOIN r1 USING (conv_id) WHERE role = 'assistant' AND upto <= 2500 - COALESCE(used, 0)), k AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2),
s AS (SELECT conv_id, COUNT(*) AS kept, SUM(size) AS chars FROM k GROUP BY 1)
SELECT conv_id, COALESCE(kept, 0) AS kept, CAST(COALESCE(chars, 0) AS BIGINT) AS chars, n - COALESCE(kept, 0) AS dropped, n > COALESCE(kept, 0) AS truncated
FROM (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY 1) LEFT JOIN s USING (conv_id)""")
def budget_summary(spark, sf):
    c = table(spark, sf, "conversations")
    return t.budget_summary(c, t.char_budget(c, ["conv_id"], "role", "turn", "text", ["user", "assistant"], 2500), ["conv_id"], "text")


SENTENCES = ("Is the {} total right?", "COUNTROWS ( {} ) should match", "Compare 'Sales'[{}] with [Base]", "The fact_orders table holds {}", "See evidence/{}.json for details", "The receipt for {} is missing")


@query("technical_token", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'COUNTROWS' WHEN 2 THEN '''Sales''[' || p_name || ']' WHEN 3 THEN 'fact_orders' WHEN 4 THEN 'evidence/' || split_part(p_name, ' ', 1) || CASE WHEN p_name LIKE '% %' THEN '' ELSE '.json' END ELSE 'receipt' END AS token FROM part""")
def technical_token(spark, sf):
    p = table(spark, sf, "part")
    choices = [F.concat(F.lit(s.split("{}")[0]), F.col("p_name"), F.lit(s.split("{}")[1])) for s in SENTENCES]
    rows = p.select("p_partkey", F.get(F.array(*choices), (F.col("p_partkey") % 6).cast("int")).alias("sentence"))
    return t.technical(rows, "sentence").select("p_partkey", "token")


@query("screen_text", r"""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 1 THEN v WHEN 2 THEN -CAST(k AS DOUBLE) END AS parsed, CAST(k AS DOUBLE) AS total,
  rtrim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-') AS slug, rtrim(regexp_replace(p, '[^A-Za-z0-9_-]+', '-', 'g'), '-') AS anchor, format('{:,}', k) AS shown, 'Order ' || k || ' was placed' AS sentence,
  CASE WHEN k % 2 = 0 THEN 'Order lines total' ELSE 'Total orders' END AS figure, dayname(d) AS weekday, CASE WHEN k <= 12 THEN ['no','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve'][k + 1] ELSE format('{:,}', k) END AS spelled FROM o""")
def screen_text(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = k.cast("string")
    number = (F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number(k, 0))).when(k % 4 == 1, F.format_number("o_totalprice", 2)).when(k % 4 == 2, F.concat(F.lit("-"), text, F.lit("%"))).otherwise(F.concat(F.lit("$"), text, F.lit("K"))))
    grid = F.concat(F.lit("Item\n1\nTotal\n"), F.format_number(k, 0), F.lit("\n"))
    key = F.when(k % 2 == 0, "order_lines_table").otherwise("total-orders")
    return o.select(
        "o_orderkey", sc.parse_number(number).alias("parsed"), sc.total_value(grid).alias("total"), sc.slug("o_orderpriority").alias("slug"), sc.anchor_slug("o_orderpriority").alias("anchor"), sc.format_number(k).alias("shown"),
        sc.first_sentence(F.concat(F.lit("Order "), text, F.lit(" was placed. Then it shipped."))).alias("sentence"), sc.figure_name(F.lit("table"), key).alias("figure"), sc.weekday_name(F.to_date("o_orderdate")).alias("weekday"), sc.spell(k).alias("spelled"))


@query("date_ranges", r"""
WITH w AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 40 AS b, CAST(l_shipdate AS DATE) AS c, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN a = c AND b = e THEN 'same' WHEN c >= a AND e <= b THEN 'narrowed' WHEN c <= a AND e >= b THEN 'widened' ELSE 'moved' END AS relation,
  CASE WHEN c = e THEN strftime(c, '%B %-d') WHEN year(c) = year(e) AND month(c) = month(e) THEN strftime(c, '%B %-d') || '–' || day(e) WHEN year(c) = year(e) THEN strftime(c, '%B %-d') || ' – ' || strftime(e, '%B %-d')
  ELSE strftime(c, '%B %-d, %Y') || ' – ' || strftime(e, '%B %-d, %Y') END AS phrase FROM w""")
def date_ranges(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = sc.screen_date(F.date_format("l_shipdate", "M/d/yyyy"))
    x = x.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 40).alias("b"), shipped.alias("c"),
                 F.date_add(shipped, F.col("l_quantity").cast("int")).alias("e"))
    return x.select("l_orderkey", "l_linenumber", sc.range_relation("a", "b", "c", "e").alias("relation"), sc.date_range_text("c", "e").alias("phrase"))


@query("json_pointers", """
SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, CASE WHEN CAST(json_extract(props, '$.k') AS VARCHAR) IS NOT NULL THEN 'BIGINT' END AS tag, CAST(event_id AS VARCHAR) AS nested FROM events""")
def json_pointers(spark, sf):
    e = table(spark, sf, "events")
    nested = F.concat(F.lit('{"a/b": [{"x~y": '), F.col("event_id").cast("string"), F.lit("}]}"))
    value = sc.pointer_value("props", "/k")
    return e.select("event_id", value.alias("value"), sc.type_tag(value).alias("tag"), sc.pointer_value(nested, "/a~1b/0/x~0y").alias("nested"))
