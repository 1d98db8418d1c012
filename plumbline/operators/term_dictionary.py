"""Redaction with a dictionary of terms: one pass over a text, whatever the number of terms.

A text is cut into pieces: runs of word characters, and every other character on its own. A term is a sequence of pieces, so it only
matches whole words where it starts or ends with one. The dictionary is a tree over the pieces of its terms, held in arrays; all pieces of some
hundred rows walk it side by side, in Arrow and numpy, and most leave at the first step. The tree travels with the task: the plan
has the same few expressions for five terms and for five thousand. No row leaves its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StringType, StructField, StructType

from plumbline.operators.text import PIECE, ordered_terms

ROWS = 256  # rows that are searched side by side


class _Terms:
    """The tree: the node behind ``parent * len(words) + word``, and per node the places in ``terms`` of those that end there."""

    def __init__(self, spark: SparkSession, replacements: dict[str, str]):
        ranked = [t for t in ordered_terms(list(replacements)) if t]
        cut = {}
        if ranked:
            listed = spark.createDataFrame([(i, t) for i, t in enumerate(ranked)], "rank int, term string").select(
                "rank", F.regexp_extract_all(F.lower("term"), F.lit(PIECE), F.lit(0)).alias("pieces"))
            cut = {ranked[r["rank"]]: r["pieces"] for r in listed.collect()}
        self.terms = sorted(ranked)
        self.tokens = [replacements[t] for t in self.terms]
        place = {t: i for i, t in enumerate(self.terms)}
        self.rank = np.zeros(len(ranked), np.int64)
        words, tree, self.ends = {}, {}, {}
        for rank, t in enumerate(ranked):
            self.rank[place[t]] = rank
            node = 0
            for w in cut[t]:
                node = tree.setdefault((node, words.setdefault(w, len(words))), len(tree) + 1)
            self.ends.setdefault(node, []).append(place[t])
        self.words = list(words)
        keys = sorted((node * len(words) + w, to) for (node, w), to in tree.items())
        self.keys, self.to = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        self.is_end = np.zeros(len(tree) + 1, bool)
        self.is_end[list(self.ends)] = True

    def found(self, low: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every match in the lists ``low``: place of its first piece, node where it ends, pieces."""
        code = pc.fill_null(pc.index_in(low.flatten(), value_set=pa.array(self.words, pa.string())), -1).to_numpy()
        at = np.flatnonzero(code >= 0)
        stop, node, n, out = np.repeat(offsets[1:], np.diff(offsets))[at], np.zeros(len(at), np.int64), 0, []
        while len(at):
            inside = at + n < stop
            at, stop, node = at[inside], stop[inside], node[inside]
            word = code[at + n]
            key = node * len(self.words) + word
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (word >= 0) & (self.keys[spot] == key)
            at, stop, node, n = at[on], stop[on], self.to[spot[on]], n + 1
            end = self.is_end[node]
            out.append((at[end], node[end], np.full(int(end.sum()), n)))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))

    def per_row(self, offsets: np.ndarray, at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Offsets of the rows, their different terms in alphabetical order, and how often each occurs."""
        size = max(1, len(self.terms))
        pairs, n = np.unique((np.searchsorted(offsets, at, "right") - 1) * size + term, return_counts=True)
        starts = np.searchsorted(pairs // size, np.arange(len(offsets)))
        return starts.astype(np.int32), pa.array(self.terms, pa.string()).take(pa.array(pairs % size)), n


def _level(low: pa.Array, pieces: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The lists of every row at the length of the longer one, and their offsets: few letters leave a word in lower case or join one."""
    pairs = [(a or [], b or []) for a, b in zip(low.to_pylist(), pieces.to_pylist())]
    sizes = [max(len(a), len(b)) for a, b in pairs]
    low = pa.array([a + [None] * (n - len(a)) for (a, _), n in zip(pairs, sizes)], pa.list_(pa.string()))
    pieces = pa.array([b + [""] * (n - len(b)) for (_, b), n in zip(pairs, sizes)], pa.list_(pa.string()))
    return low, pieces, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def _mapped(df: DataFrame, text: str, made: dict[str, DataType], run: Callable[..., dict[str, pa.Array]], rewrites: bool = False) -> DataFrame:
    """``df`` with columns of ``run``, from the pieces in lower case and the offsets of the rows in them, and from the texts and their pieces if it rewrites them."""
    def pieces(c):
        return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    columns = [F.col(f"`{c}`") for c in df.columns]
    whole = [F.col(text).cast("string").alias("_text"), pieces(F.col(text)).alias("_pieces")] if rewrites else []
    held = df.select(*columns, pieces(F.lower(text)).alias("_low"), *whole)
    own, new = [f.name for f in df.schema], {n.lower(): n for n in made}
    fields = [StructField(f.name, made[new[f.name.lower()]]) if f.name.lower() in new else f for f in df.schema]
    added = [n for n in made if n.lower() not in {c.lower() for c in own}]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                low = part.column(len(own))
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(low), 0).to_numpy())])
                got = run(low, offsets, *part.columns[len(own) + 1:])
                yield pa.RecordBatch.from_arrays([got[new[c.lower()]] if c.lower() in new else part.column(k) for k, c in enumerate(own)] + [got[n] for n in added], own + added)

    return held.mapInArrow(each, StructType(fields + [StructField(n, made[n]) for n in added]))


def redact_dictionary(df: DataFrame, text: str, replacements: dict[str, str], counts: str = "term_hits") -> DataFrame:
    """Replace the terms, longest first, and count the replacements per term that occurs in a map column.

    Case does not count. Of overlapping matches that of the longer term is replaced, of equally long terms that of the first in the alphabet, of one term
    the earliest; of terms of one piece that only differ in case, that of the first replacement. A replacement is never searched again.
    A null text stays null, with an empty map; other columns stay as they are.
    """
    tree = _Terms(df.sparkSession, replacements)
    first = np.zeros(len(tree.is_end), np.int64)
    single = first.copy()
    for node, ends in tree.ends.items():
        first[node] = min(ends, key=lambda e: tree.rank[e])
        single[node] = min(ends, key=lambda e: (tree.tokens[e], e))

    def run(low: pa.Array, offsets: np.ndarray, body: pa.Array, pieces: pa.Array) -> dict[str, pa.Array]:
        if not pc.list_value_length(low).equals(pc.list_value_length(pieces)):
            low, pieces, offsets = _level(low, pieces)
        at, node, n = tree.found(low, offsets)
        wide = np.flatnonzero(n > 1)
        wide = wide[np.lexsort((at[wide], tree.rank[first[node[wide]]]))]
        inside, kept = bytearray(int(offsets[-1])), []
        # a term of several pieces is longer than whatever term it covers
        for k, a, m in zip(wide.tolist(), at[wide].tolist(), n[wide].tolist()):
            if inside.find(1, a, a + m) < 0:
                inside[a:a + m] = b"\1" * m
                kept.append(k)
        gone = np.frombuffer(inside, np.uint8).astype(bool)
        alone = np.flatnonzero(n == 1)
        alone = alone[~gone[at[alone]]]
        where = np.concatenate([at[kept], at[alone]]).astype(np.int64)
        term = np.concatenate([first[node[kept]], single[node[alone]]]).astype(np.int64)
        # a replaced term stands at its first piece and leaves nothing at the others
        becomes = np.full(len(gone), len(tree.terms))
        becomes[where] = term
        gone[where] = True
        new = pa.array([*tree.tokens, ""], pa.string()).take(pa.array(becomes[gone]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.replace_with_mask(pieces.flatten(), pa.array(gone), new)), "")
        starts, terms, times = tree.per_row(offsets, where, term)
        return {text: pc.if_else(pa.array(np.diff(starts) > 0), joined, body), counts: pa.MapArray.from_arrays(starts, terms, pa.array(times.astype(np.int32)))}

    return _mapped(df, text, {text: StringType(), counts: MapType(StringType(), IntegerType())}, run, rewrites=True)


def surviving_terms(df: DataFrame, text: str, terms: Sequence[str], name: str = "surviving") -> DataFrame:
    """``df`` with the terms that occur in the text, each looked for on its own, in alphabetical order; empty for a null text."""
    tree = _Terms(df.sparkSession, {t: "" for t in terms})

    def run(low: pa.Array, offsets: np.ndarray) -> dict[str, pa.Array]:
        at, node, _ = tree.found(low, offsets)
        ends = [tree.ends[k] for k in node.tolist()]
        starts, present, _ = tree.per_row(offsets, np.repeat(at, [len(e) for e in ends]).astype(np.int64), np.array([e for own in ends for e in own], np.int64))
        return {name: pa.ListArray.from_arrays(pa.array(starts), present)}

    return _mapped(df, text, {name: ArrayType(StringType())}, run)
