"""Registered queries of the operators in this folder, with their SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, chat, hard_negatives, line_dedup, near_dedup, packing, quality, quality_fm, revisit, secrets, token_files, vector_codes
from plumbline.llm.tokens import vocabulary
from plumbline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
tri AS (SELECT r, doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
    FROM (SELECT doc_id, w, row_number() OVER () AS r, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
good AS (SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(x, '[.!?\x{2026}\x{3002}]([''")\]\x{bb}\x{201d}\x{2019}]*)([\x20\x09-\x0D]|$)')
    AND NOT 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 30 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
    AND NOT 100 * len(regexp_extract_all(x, '[|\x{bb}\x{203a}\x{2022}\x{b7}]')) > 25 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
    AND NOT (regexp_matches(x, '(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|(uses|accept( all)?) cookies|(enable|requires) javascript|subscribe to our|sign up for|click here|licensed under|copyright \(c\)|powered by)')
      AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 40)) AS g FROM d),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(d.l) - len(list_distinct(d.l)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    100 * length(array_to_string(g, '')) >= 50 * length(array_to_string(d.l, '')) AS enough
  FROM d JOIN good USING (doc_id) LEFT JOIN cov ON cov.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND enough AS kept FROM c"""


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op7_sql() -> str:
    def one(rank: int, r: secrets.Rule) -> str:
        p = "'" + r.pattern.replace("'", "''") + "'"
        return (f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, regexp_extract_all(text, {p}, 0) AS hits, "
                f"regexp_extract_all(text, {p}, {r.group}) AS tested, regexp_split_to_array(text, {p}) AS gaps FROM d")
    scans = " UNION ALL ".join(one(i, r) for i, r in enumerate(secrets.RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({scans}),
m AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(tested) AS val, unnest(gaps[1:len(hits)]) AS gap FROM s),
p AS (SELECT doc_id, kind, rank, length(val) >= least AS ok, length(hit) AS size,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
k AS (SELECT doc_id, kind, rank, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span FROM p WHERE ok),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


@query("op7_secret_scan", _op7_sql())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.report(table(spark, sf, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.report(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", F.array_join(F.col("kept_lines").cast("array<string>"), ",").alias("kept_lines"))


@query("op1_near_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf, "documents"), rules=near_dedup.Rules(words=4))


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query("op2_token_files")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, folder)


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    return bpe.encode(table(spark, sf, "documents"), path, digests=True)


@query("op6_revisits")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as WARC records and back, every revisit resolved."""
    records = revisit.read_records(revisit.write_records(revisit.captures_of(table(spark, sf, "pages"))))
    found = revisit.resolve(records)
    said = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.select("record_id", "uri", "state", "source_id", F.size("headers").cast("bigint").alias("n_headers"), said.alias("headers"), "payload_digest")


@query("op8_permutation_index")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op10_chat_format")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.read_turns(chat.format_turns(turns)))


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a machine fitted on labels outside the held-out fold; the only metadata is the stated length."""
    docs = table(spark, sf, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    machine = quality_fm.train(docs, table(spark, sf, "labels").where(fold != 1), ["n_chars"])
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return quality_fm.score(docs, machine).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _op12_sql(s: vector_codes.Settings = vector_codes.Settings()) -> str:
    """Rounds of integer k-means one after another, every part against every entry."""
    steps = [f"""
w AS (SELECT CAST(ceil(max(len(embedding)) / {s.parts}.0) AS BIGINT) AS size FROM embeddings WHERE embedding IS NOT NULL),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_resize(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {s.scale}) AS BIGINT)), (SELECT size * {s.parts} FROM w), CAST(0 AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, v[p * size + 1:(p + 1) * size] AS x FROM kept, w, (SELECT unnest(range({s.parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {s.entries})"""]
    near = "list_sum(list_transform(list_zip(x, c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    for i in range(s.rounds + 1):
        steps.append(f"""
took{i} AS MATERIALIZED (SELECT r, p, x, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT r, part.p, x, e, {near} AS d FROM part JOIN book{i} USING (p)) GROUP BY r, p, x)""")
        if i < s.rounds:
            steps.append(f"""
mean{i} AS MATERIALIZED (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY pos) AS c FROM (SELECT p, e, pos, CAST(sum(y) AS BIGINT) AS t, count(*) AS n
    FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS pos FROM took{i}) GROUP BY p, e, pos) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return "WITH" + ",".join(steps) + f""",
codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM took{s.rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{s.rounds}) AS codebooks_sha256 FROM kept JOIN codes USING (r)"""


@query("op12_vector_codes", _op12_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf, "embeddings"))
    return vector_codes.label_errors(codes).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_sum(list_transform(list_zip(a.x, o.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
WINDOW k AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER k <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    vectors = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
