"""Words, lines and input columns shared by the text operators (SQL expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
TRIM = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; an empty array for none."""
    bare = F.btrim(text, F.lit(TRIM))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIM)) != ""


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of a frame, a null text as the empty one; other columns stay behind."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
