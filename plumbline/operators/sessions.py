"""What happened in a logged session: its prompts, answers, commands with their outcome, skills and errors as ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.relational import attach
from plumbline.operators.text import budget_summary, char_budget

BLANK = " \t\n\x0b\x0c\r"
LINE = r"^[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*"
#: Sections in the order in which a budget is spent on them.
SECTIONS = ("prompts", "skills", "errors", "answers", "commands")
BLOCK = "array<struct<type string, text string, name string, id string, tool_use_id string, is_error boolean, content string, input struct<command string, skill string, args string>>>"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def first_line(text: Column, most: int = 300) -> Column:
    return F.substring(F.regexp_extract(text, LINE, 0), 1, most)


def said(content: Column, blocks: Column) -> Column:
    """Text of a message: a JSON string, or its text blocks one per line; empty for anything else."""
    plain = F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "s string")["s"]
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (_stripped(b["text"]) != "")), lambda b: b["text"])
    return F.coalesce(_stripped(F.when(content.startswith('"'), plain).otherwise(F.array_join(texts, "\n"))), F.lit(""))


def _item(section: str, text: Column, tool: Column | None = None, failed: Column | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"), text.alias("text"), (F.lit(None) if tool is None else tool).cast("string").alias("tool"),
        (F.lit(None) if failed is None else failed).cast("boolean").alias("failed"))


def _pieces(prefix: str) -> Column:
    """All items of one event: its text first, then its blocks in order."""
    text, speaker = F.col("_text"), F.col("type")
    spoken = F.array(
        F.when((speaker == "user") & (text != ""), _item("prompts", F.substring(text, 1, 2000))),
        F.when((speaker == "assistant") & (text != ""), _item("answers", text)),
        F.when(speaker.isin("user", "assistant") & text.startswith(prefix), _item("skills", first_line(text))))

    def acts(b: Column) -> Column:
        used, result = b["type"] == "tool_use", b["type"] == "tool_result"
        skill = _stripped(F.concat_ws(" ", F.coalesce(b["input"]["skill"], F.lit("")), F.coalesce(b["input"]["args"], F.lit(""))))
        failed = F.coalesce(b["is_error"], F.lit(False))
        answer = F.substring(F.coalesce(b["content"], F.lit("")), 1, 300)
        return F.array(
            F.when(used & (b["name"] == "Bash") & (b["input"]["command"] != ""), _item("commands", F.substring(b["input"]["command"], 1, 200), b["id"])),
            F.when(used & (b["name"] == "Skill"), _item("skills", skill)),
            F.when(result & failed, _item("errors", answer, b["tool_use_id"], failed)),
            F.when(result, _item("results", answer, b["tool_use_id"], failed)))
    return F.filter(F.concat(spoken, F.flatten(F.transform("_blocks", acts))), lambda x: x.isNotNull())


def session_items(events: DataFrame, by: Sequence[str] = ("session_id",), order: Sequence[str] = ("block", "position"), command_prefix: str = "/") -> DataFrame:
    """Rows by…, section, at, text, tool, outcome, result of every session, ``at`` in the order of the events and of the blocks inside one.

    ``events``: by…, order…, type, content (JSON text of the message content). Sections: ``prompts`` (2,000 characters each), ``answers`` (4,000 for a
    session's last three, else the first line), ``commands`` (200), ``skills`` (tools used by name and texts that start with ``command_prefix``),
    ``errors`` (300). A command's outcome is that of the first result that names its call: ``ok``, ``failed``, or ``unanswered`` where none does or
    the call has no id; ``result`` is how that result starts. Messages without text, blocks of other kinds and content that is no JSON give no row. Results are
    matched per session and call, and only the last three answers are ranked, so a session of any length is spread over tasks.
    """
    by = list(by)
    blocks = F.coalesce(F.when(F.startswith("content", F.lit("[")), F.from_json("content", BLOCK)), F.array().cast(BLOCK))
    read = events.select(*by, F.struct(*order).alias("_event"), "type", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"), blocks.alias("_blocks"))
    read = read.withColumn("_text", said(F.col("content"), F.filter("_blocks", lambda b: b.isNotNull())))
    each = read.select(*by, "_event", F.posexplode(_pieces(command_prefix)).alias("_part", "_item")).select(
        *by, F.struct("_event.*", F.col("_part").alias("part")).alias("at"), "_item.*")

    first = F.min(F.struct("at", "failed", "text")).alias("_first")
    results = each.where("section = 'results' AND tool IS NOT NULL").groupBy(*by, "tool").agg(first)
    commands = attach(each.where("section = 'commands'"), results, [*by, "tool"])
    outcome = F.when(F.col("_first").isNull(), "unanswered").when(F.col("_first.failed"), "failed").otherwise("ok")
    ran = commands.select(*by, "section", "at", "text", "tool", outcome.alias("outcome"), F.col("_first.text").alias("result"))

    answers = each.where("section = 'answers'")
    newest = Window.partitionBy(*by).orderBy(F.desc("at"))
    last = answers.select(*by, "at").withColumn("_back", F.row_number().over(newest)).where("_back <= 3")
    told = attach(answers, last, [*by, "at"]).withColumn("text", F.when(F.col("_back").isNotNull(), F.substring("text", 1, 4000)).otherwise(first_line(F.col("text"))))

    nothing = F.lit(None).cast("string")
    def plain(df: DataFrame) -> DataFrame:
        return df.select(*by, "section", "at", "text", "tool", nothing.alias("outcome"), nothing.alias("result"))
    return plain(each.where("section IN ('prompts', 'skills', 'errors')")).unionByName(plain(told)).unionByName(ran)


def session_sections(items: DataFrame, by: Sequence[str] = ("session_id",), max_chars: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """Items of every session within a budget of characters, and what was kept, left out and whether that cut anything."""
    kept = char_budget(items, by, "section", "at", "text", SECTIONS, max_chars)
    return kept, budget_summary(items, kept, by, "text")
