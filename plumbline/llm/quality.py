"""Line-first cleaning: rules judge single lines, failing lines go, and a document that loses too much goes with them.

Everything is one narrow projection over the text: no shuffle, no Python. A document's repeated three-word
windows are found by sorting hashes of its own windows, and only in documents that have any.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import has_word, lines, texts, words

SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|(uses|accept( all)?) cookies|"
    r"(enable|requires) javascript|subscribe to our|sign up for|click here|licensed under|copyright \(c\)|powered by)")


class Limits(NamedTuple):
    """Production thresholds of the rules."""

    min_words: int = 50
    repeat_percent: int = 50
    symbols_per_hundred_words: int = 30
    separators_per_hundred_words: int = 25
    min_kept_percent: int = 50


def repeated_words(windows: Column, ordered: Column) -> Column:
    """Number of words inside a three-word window that occurs at least twice."""
    def repeated(x: Column, i: Column) -> Column:
        return (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
    at = F.transform(F.filter(ordered, lambda x, i: F.coalesce(repeated(x, i), F.lit(False))), lambda x: x["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered).cast("bigint")


def line_fails(line: Column, limits: Limits = Limits()) -> Column:
    """True for a line with a word that breaks a punctuation, navigation or boilerplate rule.

    Punctuation: no sentence ends anywhere in the line, or symbols crowd the words. Navigation: separators
    crowd the words. Boilerplate: a fixed phrase, in a line of at most 40 words so that prose which quotes
    one stays.
    """
    count = F.size(words(line))
    def per_hundred(pattern: str) -> Column:
        return F.lit(100) * F.regexp_count(line, F.lit(pattern))
    no_sentence = ~line.rlike(r"[.!?…。](['\")\]»”’]*)([\x20\x09-\x0D]|$)")
    return has_word(line) & (
        no_sentence
        | (per_hundred(SYMBOLS) > limits.symbols_per_hundred_words * count)
        | (per_hundred("[|»›•·]") > limits.separators_per_hundred_words * count)
        | (line.rlike(BOILERPLATE) & (count <= 40)))


def _judged(rows: DataFrame, carry: list[str], limits: Limits) -> DataFrame:
    rows = rows.select(*carry, "text", words(F.col("text")).alias("w"), lines(F.col("text")).alias("all_lines"))
    w = F.col("w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    rows = rows.select(
        "*", F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter("all_lines", has_word).alias("full_lines"), F.filter("all_lines", lambda x: ~line_fails(x, limits)).alias("good_lines"))
    rows = rows.select(
        "*", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), None).otherwise(
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    counts = rows.select(
        *carry, F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("windows"), F.col("ordered")).alias("n_repeat_words"), F.array_join("good_lines", "\n").alias("cleaned"),
        F.length(F.array_join(F.filter("good_lines", has_word), "")).cast("bigint").alias("kept_line_chars"),
        F.length(F.array_join("full_lines", "")).cast("bigint").alias("line_chars"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    enough = 100 * F.col("kept_line_chars") >= limits.min_kept_percent * F.col("line_chars")
    return counts.select("*", failed.alias("base_failed"), (~failed & enough).alias("kept"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: the counts, ``base_failed``, ``kept`` and the ``cleaned`` text.

    A null or empty text has no words, so it fails the base rule and is not kept. Repeated rows give
    repeated results, a null key stays null, further columns of ``docs`` are not read. ``cleaned`` has the
    lines that pass, with lines without a word left where they were. Window hashes are 64 bits wide.
    """
    return _judged(texts(docs, key, text), ["doc_id"], limits)


def clean(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The kept rows with their cleaned text; all other columns as they came, whatever their names."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # a column that is not deterministic keeps the filter above the projections; pushed down, it would repeat them
    judged = _judged(rows, ["row"], limits).withColumn("stays", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    kept = judged.where("stays")
    return kept.select(*[F.col("cleaned").alias(c) if c == text else F.col(f"row.`{c}`") for c in names])
