"""Sessions rebuilt from logs of the supplied conversations."""

from pyspark.sql import functions as F

from checks.base import query, table
from plumbline.operators import sessions


def _tool_log(spark, sf):
    """Every assistant turn runs a command, every third uses a skill; results come as events of their own: ok, failed or none."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("conv_id") + F.col("turn")
    call = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    prefix = F.when(k % 5 == 0, "/check:run ").otherwise("")
    def block(**parts):
        none = F.lit(None).cast("string")
        return F.struct(*[parts.get(n, none).alias(n) for n in ("type", "text", "name", "id", "tool_use_id", "content")],
                        parts.get("is_error", F.lit(None).cast("boolean")).alias("is_error"),
                        F.struct(*[parts.get(n, none).alias(n) for n in ("command", "skill", "args")]).alias("input"))
    text = block(type=F.lit("text"), text=F.col("text"))
    bash = block(type=F.lit("tool_use"), name=F.lit("Bash"), id=call, command=F.concat(F.lit("run "), F.col("text")))
    skill = block(type=F.lit("tool_use"), name=F.lit("Skill"), skill=F.lit("review"), args=F.col("turn").cast("string"))
    answer = block(type=F.lit("tool_result"), tool_use_id=call, content=F.concat(F.lit("out "), F.col("text")), is_error=k % 4 == 1)
    spoken = c.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("turn").cast("bigint") * 2).alias("event"), F.col("role").alias("type"),
        F.when(F.col("role") == "assistant", F.to_json(F.when(k % 3 == 0, F.array(text, bash, skill)).otherwise(F.array(text, bash))))
        .otherwise(F.element_at(F.split(F.to_json(F.struct(F.concat(prefix, "text").alias("s"))), r'^\{"s":', 2), 2)).alias("content"))
    spoken = spoken.withColumn("content", F.when(F.startswith("content", F.lit('"')), F.regexp_replace("content", r"\}$", "")).otherwise(F.col("content")))
    results = c.where((F.col("role") == "assistant") & (k % 4 != 2)).select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("turn").cast("bigint") * 2 + 1).alias("event"), F.lit("user").alias("type"), F.to_json(F.array(answer)).alias("content"))
    return spoken.unionByName(results)


_ITEMS = r"""
c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, conv_id + turn AS k, role, COALESCE(text, '') AS raw FROM conversations),
s AS (SELECT session_id, turn, k, role, raw, trim(CASE WHEN role <> 'assistant' AND k % 5 = 0 THEN '/check:run ' || raw ELSE raw END, E' \t\n\x0b\x0c\r') AS said FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM s WHERE role = 'assistant' AND said <> ''),
items AS (
  SELECT session_id, 'prompts' AS section, turn * 2 AS event, 0 AS part, left(said, 2000) AS text, NULL AS outcome, NULL AS result FROM s WHERE role = 'user' AND said <> ''
  UNION ALL SELECT session_id, 'skills', turn * 2, 1, left(regexp_extract(said, '^[^\n\r\x0B\f]*'), 300), NULL, NULL FROM s WHERE role = 'user' AND starts_with(said, '/')
  UNION ALL SELECT session_id, 'answers', turn * 2, 0, CASE WHEN back <= 3 THEN left(said, 4000) ELSE left(regexp_extract(said, '^[^\n\r\x0B\f]*'), 300) END, NULL, NULL FROM a
  UNION ALL SELECT session_id, 'skills', turn * 2, 1, left(regexp_extract(said, '^[^\n\r\x0B\f]*'), 300), NULL, NULL FROM a WHERE starts_with(said, '/')
  UNION ALL SELECT session_id, 'commands', turn * 2, CASE WHEN said = '' THEN 0 WHEN starts_with(said, '/') THEN 2 ELSE 1 END, left('run ' || raw, 200),
    CASE k % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'unanswered' ELSE 'ok' END, CASE WHEN k % 4 <> 2 THEN left('out ' || raw, 300) END FROM s WHERE role = 'assistant'
  UNION ALL SELECT session_id, 'skills', turn * 2, CASE WHEN said = '' THEN 1 WHEN starts_with(said, '/') THEN 3 ELSE 2 END, 'review ' || turn, NULL, NULL FROM s WHERE role = 'assistant' AND k % 3 = 0
  UNION ALL SELECT session_id, 'errors', turn * 2 + 1, 0, left('out ' || raw, 300), NULL, NULL FROM s WHERE role = 'assistant' AND k % 4 = 1)"""


def _budget_sql(most):
    """Sections one after another, each up to its first item that no longer fits."""
    steps, spent = [], "0"
    for i, name in enumerate(sessions.SECTIONS):
        before = " UNION ALL ".join(f"SELECT session_id, used FROM u{j}" for j in range(i)) or "SELECT '' AS session_id, 0 AS used WHERE FALSE"
        steps.append(f"""
k{i} AS (SELECT u.* FROM upto u LEFT JOIN (SELECT session_id, SUM(used) AS used FROM ({before}) GROUP BY 1) b USING (session_id) WHERE section = '{name}' AND upto <= {most} - COALESCE(used, 0)),
u{i} AS (SELECT session_id, MAX(upto) AS used FROM k{i} GROUP BY 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(sessions.SECTIONS)))
    return f"""WITH {_ITEMS}, upto AS (SELECT *, SUM(len(text)) OVER (PARTITION BY session_id, section ORDER BY event, part) AS upto FROM items), {",".join(steps)}
SELECT session_id, section, CAST(event AS BIGINT) AS event, CAST(part AS BIGINT) AS part, text FROM ({every})"""


def _items(spark, sf):
    return sessions.session_items(_tool_log(spark, sf), order=["event"])


@query("session_items", f"WITH {_ITEMS} SELECT session_id, section, CAST(event AS BIGINT) AS event, CAST(part AS BIGINT) AS part, text, outcome, result FROM items")
def session_items(spark, sf):
    return _items(spark, sf).select("session_id", "section", "at.event", F.col("at.part").cast("bigint").alias("part"), "text", "outcome", "result")


@query("session_sections", _budget_sql(1500))
def session_sections(spark, sf):
    kept, _ = sessions.session_sections(_items(spark, sf), max_chars=1500)
    return kept.select("session_id", "section", "at.event", F.col("at.part").cast("bigint").alias("part"), "text")
