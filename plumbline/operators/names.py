"""Closest names by a string similarity join.

The similarity of two names is that of longest matching blocks: twice the characters matched by the longest common block and, on
either side of it, by the longest common blocks there, over both lengths. Names of at least ``cutoff`` are similar.

Candidates come from an index, without losing a pair. M matched characters of two names of lengths n and m stand in the same
order in both, so the M - 1 steps from one to the next cover at most n - 1 places here and m - 1 there. With M >= cutoff * (n + m) / 2
many of these steps must be short in both; a step of at most ``REACH`` places is a pair of characters that both names hold close
together. Names therefore post their short-step character pairs, and a pair of names is scored only if it shares as many as the
bound below demands. Names so short that the bound can demand none post their characters as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.relational import shuffled
from plumbline.session import stored

REACH = 3
LEAST_CUTOFF = 0.5  # below, the bound says nothing about names of ordinary length


def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest-matching-block similarity of two columns of text."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def _demanded(n: int, m: int, cutoff: float) -> int:
    steps = math.ceil(cutoff * (n + m) / 2 - 1e-9) - 1
    return math.ceil(((REACH + 2) * steps - (n + m - 2)) / REACH)


def short(cutoff: float) -> int:
    """Length up to which a name can have a similar partner from which the bound demands no pair of characters."""
    return max([0] + [max(n, m) for n in range(1, 40) for m in range(1, 40) if 2 * min(n, m) >= cutoff * (n + m) and _demanded(n, m, cutoff) < 1])


def postings(names: DataFrame, name: str, cutoff: float) -> DataFrame:
    """``names`` with one row per ``gram`` of column ``name``: kind of gram, characters, and its number among equal ones of that name."""
    text, n = F.col(name), F.length(name)
    none = F.array().cast("array<string>")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(REACH)), lambda d: F.when(
        n > d, F.transform(F.sequence(F.lit(1), n - d), lambda i: F.concat(F.substring(text, i, F.lit(1)), F.substring(text, i + d, F.lit(1))))).otherwise(none)))
    singles = F.when(n.between(1, short(cutoff)), F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1)))).otherwise(none)
    counted = names.select("*", F.explode(F.concat(pairs, singles)).alias("_g")).groupBy(*names.columns, "_g").agg(F.count(F.lit(1)).cast("int").alias("_c"))
    return counted.select(*names.columns, F.col("_g"), F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_nth")).select(
        *names.columns, F.struct(F.length("_g").alias("kind"), F.col("_g").alias("chars"), F.col("_nth").alias("nth")).alias("gram"))


def demanded(n: Column, m: Column, cutoff: float) -> Column:
    """Pairs of characters that names of lengths n and m share at least when they are similar.

    Of M - 1 steps with n + m - 2 places at most, those beyond ``REACH`` in either name take ``REACH`` + 2 places or more and the others
    two, so (REACH + 2) * (M - 1) - (n + m - 2) of them over REACH are short.
    """
    steps = F.ceil(cutoff * (n + m) / 2 - 1e-9) - 1
    return F.ceil(((REACH + 2) * steps - (n + m - 2)) / F.lit(float(REACH)))


def similar_names(asked: DataFrame, candidates: DataFrame, scope: Sequence[str], name: str = "name", top: int = 1, cutoff: float = 0.6,
                  row_numbers: bool = False) -> DataFrame:
    """(scope…, name, rank, closest, ratio): the ``top`` most similar candidates of every name within its scope, ties to the larger one.

    Case does not count. A name that is itself a candidate finds itself without being scored against others when one match is asked. A null scope value
    equals a null one. Null names and candidates take no part, nor do candidates that are row-number columns (``RowNumber-``…) without ``row_numbers``.
    """
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"names are found from a similarity of {LEAST_CUTOFF} on")
    scope = list(scope)
    low = F.lower(F.col("candidate"))
    # both sides are read several times: as tables they keep the plan small, whatever they were made from
    known = stored(candidates.where(F.col("candidate").isNotNull() & (F.lit(row_numbers) | ~F.upper("candidate").startswith("ROWNUMBER-"))).groupBy(*scope, low.alias("_low")).agg(F.min("candidate").alias("_shown")))
    wanted = stored(asked.where(F.col(name).isNotNull()).select(*scope, F.lower(F.col(name)).alias("_name")).distinct())
    other = known.withColumnsRenamed({s: f"_s_{s}" for s in scope})

    def same_scope(right: str = "_s_") -> Column:
        return reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"{right}{s}")) for s in scope], F.lit(True))
    exact = wanted.join(shuffled(other), same_scope() & (F.col("_name") == F.col("_low"))).select(*scope, "_name", "_low", "_shown", F.lit(1.0).alias("ratio"))
    searched = wanted
    if top == 1:
        found = exact.select(*[F.col(s).alias(f"_e_{s}") for s in scope], F.col("_name").alias("_e_name"))
        searched = wanted.join(shuffled(found), same_scope("_e_") & (F.col("_name") == F.col("_e_name")), "left_anti")
    left = postings(searched, "_name", cutoff)
    right = postings(other, "_low", cutoff).withColumnRenamed("gram", "_gram")
    n, m = F.length("_name"), F.length("_low")
    fits = (2 * F.least(n, m) >= cutoff * (n + m) - 1e-9) & (F.col("_name") != F.col("_low"))
    met = left.join(shuffled(right), same_scope() & (F.col("gram") == F.col("_gram")) & fits)
    shared = met.groupBy(*scope, "_name", "_low", "_shown").agg(
        F.count_if(F.col("gram.kind") == 2).alias("pairs"), F.count_if(F.col("gram.kind") == 1).alias("singles"))
    few = demanded(n, m, cutoff) < 1
    likely = shared.where((F.col("pairs") >= F.greatest(demanded(n, m, cutoff), F.lit(1))) | (few & (F.col("singles") >= cutoff * (n + m) / 2 - 1e-9)))
    score = F.pandas_udf(block_ratio, "double")
    scored = likely.select(*scope, "_name", "_low", "_shown", score("_low", "_name").alias("ratio")).where(F.col("ratio") >= cutoff)
    scored = scored.unionByName(exact.select(*scored.columns))
    best = Window.partitionBy(*scope, "_name").orderBy(F.desc("ratio"), F.desc("_low"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(*scope, F.col("_name").alias(name), "rank", F.col("_shown").alias("closest"), "ratio")
