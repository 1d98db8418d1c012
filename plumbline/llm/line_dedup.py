"""Line dedup by an exact set-similarity join over the whole corpus.

A line is the set of its lower-cased words. Lines with equal sets collapse first, so that a line copied into
a third of all documents is one row. Two sets with Jaccard similarity of at least ``threshold`` share a word among
their rarest ones (prefix filter), so only the prefixes are joined, with length and positional filters inside
the join, and 128 parities of word hashes that bound how much two sets can share; the surviving pairs are verified on the full sets. A line goes when an earlier line, by document and
line number, is as similar as that. Each distinct text under an id is a document of its own, named by the id and a hash of the text.
Until they are verified, lines travel under their rank in that order.

Families of many similar lines would make the join emit all their pairs, though one earlier match is enough for a
line to go. So every line is first compared with the earliest line that shares two neighbours among its three rarest words; lines
that go by this look for no further match in the join, where they still count as earlier lines. Of the pairs that the join
finds, a later line is first verified with the earlier one whose parities are nearest, and with the others only if that fails.

Rarity comes from exact counts over all words, taken per hash bucket in steps of an eighth of an octave: the order stays
one total order over words, which is all that exactness needs, and the table of ``BUCKETS`` bytes has a fixed size.
Words are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.relational import shuffled
from plumbline.llm.graph import maybe_in, stored, table_of
from plumbline.llm.words import has_word, lines, texts

BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
LOW = (1 << 54) - 1
LINE_FLAGS = 1 << 22  # bits that tell which lines are confirmed
ODD_SPACE = r"[\t\x0B\f\r]"


def _plain(text: Column) -> Column:
    """The text in lower case with every white space within a line as a blank."""
    low = F.lower(text)
    return F.when(low.rlike(ODD_SPACE), F.regexp_replace(low, ODD_SPACE, " ")).otherwise(low)


def _hashes(line: Column) -> Column:
    """Distinct hashes of the words of a plain line."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def rarity(plain: DataFrame) -> Column:
    """One byte per bucket: how many words fall into it, as eighths of an octave."""
    each = plain.select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("w")).where("w != ''")
    counts = each.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    held = counts.select("b", F.least(F.floor(F.log2("c") * 8), F.lit(255)).cast("int").alias("step")).toArrow()  # at most BUCKETS rows of two numbers
    steps = np.zeros(BUCKETS, np.uint8)
    steps[held["b"].to_numpy()] = held["step"].to_numpy()
    return table_of(plain.sparkSession, steps)


def _ordered(hashes: Column, steps: Column) -> Column:
    """A set with its rarest word first: step above, hash below, so that a plain sort orders by rarity."""
    def key(h: Column) -> Column:
        step = F.ascii(F.decode(F.substring(steps, _bucket(h) + 1, F.lit(1)), "ISO-8859-1"))
        return F.shiftleft(step.cast("bigint"), 54).bitwiseOR(h.bitwiseAND(F.lit(LOW)))
    return F.sort_array(F.transform(hashes, key))


def _document(id_: Column, mark: Column) -> Column:
    """Name of a document; as parts of a struct, null ids are equal and come first."""
    return F.struct(id_.alias("id"), mark.alias("mark"))


def _least(n: Column, t: Fraction) -> Column:
    """ceil(t * n) in whole numbers."""
    return F.floor((n * t.numerator + (t.denominator - 1)) / F.lit(t.denominator)).cast("int")


def _confirmed(pairs: DataFrame, kinds: DataFrame, plain: DataFrame, t: Fraction) -> DataFrame:
    """Ranks of the later lines ``y`` of pairs (x, y) that reach the threshold on their full sets.

    Lines travel as texts, which take less room than the hashes of their words; only lines of pairs are hashed.
    """
    members = stored(pairs.select(F.explode(F.array("x", "y")).alias("rank")).distinct().join(shuffled(kinds.select("rank", "line")), "rank"))
    inside = plain.where(maybe_in(members.select(F.col("line.doc_id").alias("doc")), "doc")("doc_id"))
    again = inside.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "body")).where(has_word(F.col("body")))
    full = again.select(F.struct("doc_id", "line_no").alias("line"), "body").where(maybe_in(members, "line", LINE_FLAGS)("line"))
    whole = shuffled(members).join(full, "line").dropDuplicates(["line"])
    x, y = (whole.select(F.col("rank").alias(c), F.col("body").alias(f"{c}_body")) for c in "xy")
    met = shuffled(pairs).join(x, "x").join(shuffled(y), "y").select("y", _hashes(F.col("x_body")).alias("a"), _hashes(F.col("y_body")).alias("b"))
    sized = met.select("y", F.size("a").alias("n1"), F.size("b").alias("n2"), F.size(F.array_intersect("a", "b")).alias("both"))
    alike = F.col("both") * t.denominator >= (F.col("n1") + F.col("n2") - F.col("both")) * t.numerator
    return sized.where(alike).select(F.col("y").alias("rank")).distinct()


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: str = "0.8") -> DataFrame:
    """(doc_id, mark, line_no) of every line with a word that no earlier line resembles; numbers start at 0.

    ``mark`` is the hash of the row's text. Rows without a key come first. Different texts that share a key, or have none, are
    documents of their own, in the order of their marks; rows that repeat key and text are one. A null or empty text has no
    lines; further columns are not read.
    """
    t = Fraction(threshold)
    plain = texts(docs, key, text).select(_document(F.col("doc_id"), F.xxhash64("text")).alias("doc_id"), _plain(F.col("text")).alias("text"))
    each = plain.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "body")).where(has_word(F.col("body")))
    sets = each.withColumn("steps", rarity(plain)).select("doc_id", "line_no", _ordered(_hashes(F.col("body")), F.col("steps")).alias("tokens"))
    n = F.size("tokens")
    def parities(half: int) -> Column:
        """64 of the 128 parities: bit i tells whether an odd number of words fall on it."""
        def one(k: Column) -> Column:
            upper = F.shiftright(k, 6).bitwiseAND(F.lit(1))
            return F.call_function("shiftleft", upper if half else F.lit(1) - upper, k.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("tokens", F.lit(0).cast("bigint"), lambda bits, k: bits.bitwiseXOR(one(k)))
    heads = sets.select(
        F.xxhash64("tokens").alias("m1"), F.xxhash64(F.lit(1), "tokens", n).alias("m2"), F.struct("doc_id", "line_no").alias("line"), n.alias("n"),
        F.transform(F.slice("tokens", 1, n - _least(n, t) + 1), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"),
        parities(0).alias("low"), parities(1).alias("high"))
    same = heads.groupBy("m1", "m2").agg(F.min("line").alias("line"), *[F.first(c).alias(c) for c in ("n", "prefix", "low", "high")])
    kinds = stored(same.select("line", "n", "prefix", "low", "high").orderBy("line").withColumn("rank", F.monotonically_increasing_id()))

    def differ(a: str, b: str) -> Column:
        """The sets of two lines differ in at least one word for every parity that differs."""
        return F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low"))) + F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high")))

    def could_share(n1: Column, n2: Column, a: str, b: str) -> Column:
        """What differs at least leaves room for the overlap that the sets need."""
        return n1 + n2 - differ(a, b) >= 2 * _least(n1 + n2, t / (1 + t))

    # a smaller set resembles none but itself: one word more on the other side is too many already
    least = math.ceil(t / (1 - t)) if t < 1 else 1 << 30
    p = F.col("prefix")
    twos = F.array(*[F.xxhash64(F.get(p, F.lit(i)), F.get(p, F.lit(j))) for i, j in ((0, 1), (1, 2))])
    # the smallest and the largest hash of a prefix are those of another one as often as the two have words in common
    ends = F.array(F.xxhash64(F.array_min(p), F.lit(0)), F.xxhash64(F.array_max(p), F.lit(1)))
    keys = F.when(F.size(p) < 2, F.array(F.xxhash64(F.get(p, F.lit(0))))).when(F.size(p) < 3, F.concat(F.slice(twos, 1, 1), ends)).otherwise(F.concat(twos, ends))
    star = kinds.where(F.col("n") >= least).select("rank", "n", "low", "high", F.explode(F.array_distinct(keys)).alias("two"))
    firsts = star.groupBy("two").agg(F.min(F.struct("rank", "n", "low", "high")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("two", "first")
    close = F.col("first.n") * t.denominator >= F.col("n") * t.numerator
    close &= F.col("n") * t.denominator >= F.col("first.n") * t.numerator
    close &= could_share(F.col("n"), F.col("first.n"), "", "first.")
    beside = star.join(firsts, "two").where((F.col("rank") != F.col("first.rank")) & close).select(F.col("first.rank").alias("x"), F.col("rank").alias("y")).distinct()
    gone = stored(_confirmed(stored(beside), kinds, plain, t))

    posted = kinds.where(F.col("n") >= least).join(shuffled(gone.withColumn("gone", F.lit(True))), "rank", "left")
    # lines that go already have a negative size, which no later line of a pair may have: nothing to filter on one side alone, so
    # both sides of the join read one and the same shuffle
    posted = posted.select(F.posexplode("prefix").alias("at", "token"), "prefix", "rank", F.when(F.col("gone"), -F.col("n")).otherwise(F.col("n")).alias("n"), "low", "high")
    # two lines that share the word before as well met there already, with more room for the overlap: a run of shared words gives one row
    posted = posted.select("at", "token", F.get("prefix", F.col("at") - 1).alias("before"), "rank", "n", "low", "high")
    a, b = posted.alias("a"), posted.alias("b")
    an, bn, ai, bi = F.abs("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at")
    near = (
        (F.col("a.token") == F.col("b.token")) & (F.col("a.rank") < F.col("b.rank")) & ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
        & (F.least(an, bn) >= _least(F.greatest(an, bn), t)) & (F.least(an - ai, bn - bi) >= _least(an + bn, t / (1 + t)))
        & could_share(an, bn, "a.", "b."))
    pairs = stored(a.join(b, near).select(F.col("a.rank").alias("x"), F.col("b.rank").alias("y"), differ("a.", "b.").alias("apart")).distinct())
    nearest = stored(pairs.groupBy("y").agg(F.min(F.struct("apart", "x")).alias("one")).select("one.x", "y"))
    gone = stored(gone.union(_confirmed(nearest, kinds, plain, t)))
    others = pairs.select("x", "y").join(shuffled(gone.withColumnRenamed("rank", "y")), "y", "left_anti").join(shuffled(nearest), ["x", "y"], "left_anti")
    later = gone.union(_confirmed(stored(others), kinds, plain, t))
    kept = kinds.select("rank", "line").join(shuffled(later), "rank", "left_anti")
    return kept.select(F.col("line.doc_id.id").alias("doc_id"), F.col("line.doc_id.mark").alias("mark"), F.col("line.line_no").alias("line_no"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: str = "0.8") -> DataFrame:
    """Per row of ``docs``: lines with a word, how many go, and the numbers of those that stay, in order."""
    kept = kept_lines(docs, key, text, threshold).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("kept_lines"))
    kept = kept.withColumnsRenamed({"doc_id": "_key", "mark": "_mark"})
    rows = texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("mark"), F.size(F.filter(lines(F.col("text")), has_word)).cast("bigint").alias("n_lines"))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_key"]) & (rows["mark"] == kept["_mark"]), "left")
    stay = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.greatest(F.col("n_lines") - F.size(stay), F.lit(0)).alias("n_removed"), stay.alias("kept_lines"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: str = "0.8") -> DataFrame:
    """``docs`` without the lines that an earlier one resembles; a document with no line left goes.

    Lines without a word stay where they are, other columns as they came. Documents without any word stay.
    """
    kept = kept_lines(docs, key, text, threshold).groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("stay")).withColumnRenamed("doc_id", "other")
    held = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.join(kept, F.col("doc_id").eqNullSafe(F.col("other")) & (F.xxhash64("body") == F.col("mark")), "left").where(F.col("stay").isNotNull() | ~has_word(F.col("body")))
    # every kept number sorts right before its line, which makes the lookup one sort of the document's own lines
    marks = F.transform("stay", lambda i: F.struct(i.alias("i"), F.lit(0).alias("of"), F.lit("").alias("line")))
    merged = F.sort_array(F.concat(marks, F.transform(lines(F.col("body")), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("of"), x.alias("line")))))
    def stays(x: Column, k: Column) -> Column:
        return (x["of"] == 1) & (~has_word(x["line"]) | F.coalesce((F.get("merged", k - 1)["of"] == 0), F.lit(False)))
    left = F.array_join(F.transform(F.filter("merged", stays), lambda x: x["line"]), "\n")
    done = joined.select("row", merged.alias("merged")).select("row", left.alias("left"), F.col("merged").isNotNull().alias("cut"))
    return done.select(*[F.when(F.col("cut"), F.col("left")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
