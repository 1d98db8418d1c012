"""Vector code compression by exact integer k-means per part of the vector, assigned with dual trees.

A vector becomes integers, is cut into equal parts, and each part is replaced by the number of the nearest entry of its
position's codebook. Rows lie in blocks of at most ``BLOCK``; each block keeps, per part position, a tree over its parts: a node
has the box around its parts, their count and their sum. A second tree holds the entries of the codebook. Both are walked
together, level by level: the least and greatest squared distance between two boxes tell which entries cannot be nearest to
any part of a node. A node with a single entry left is assigned whole, with its cached sum; a leaf with several left compares
its parts with those entries one by one, in integers. An entry is only ruled out when another is strictly nearer, so ties
still go to the lower index, and every result equals that of plain integer k-means.

Rounds return one row per (part, entry, position) to the driver, whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import stored

BLOCK = 4_096  # rows of a block
LEAF = 16  # parts of a leaf
LARGEST = float(1 << 29)  # greatest integer component whose squared distances still fit a long


class Settings(NamedTuple):
    """Shape of the code."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


class Codebooks(NamedTuple):
    """``entries[part]`` is an integer matrix (entry x position)."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


class Tree(NamedTuple):
    """Nodes in order of their depth; a node covers ``order[start:stop]``, ``left`` is 0 for a leaf and its sibling follows it."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def whole(vector: Column) -> Column:
    """True for a vector, be it empty, without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def grow(x: np.ndarray, leaf: int) -> Tree:
    """A balanced tree: every node above ``leaf`` rows is halved along the widest side of its box."""
    order, start, stop, left = np.arange(len(x)), [0], [len(x)], []
    low, high, total = [], [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        rows = x[order[a:b]]
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        total.append(rows.sum(axis=0))
        wide = high[-1] - low[-1]
        side = int(wide.argmax()) if len(wide) else 0
        if b - a > leaf and len(wide) and wide[side] > 0:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, side], half)]
            left.append(len(start))
            start += [a, a + half]
            stop += [a + half, b]
        else:
            left.append(0)
        at += 1
    return Tree(order, *(np.array(v, np.int64) for v in (start, stop, left, low, high, total)))


def assign(x: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every row of ``x``, ties to the lower index, with the sums and counts per entry."""
    codes = np.zeros(len(x), np.int64)
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    other = grow(book, 1)
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of a node of parts and a node of entries
    open_leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(node):
        gap = np.maximum(0, np.maximum(tree.low[node] - other.high[entry], other.low[entry] - tree.high[node]))
        reach = np.maximum(tree.high[node] - other.low[entry], other.high[entry] - tree.low[node])
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        bound = np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(node))))
        keep = least <= bound
        node, entry = node[keep], entry[keep]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(first, len(node)))
        one_kind = other.left[entry] == 0  # a leaf of the other tree holds one entry, or equal ones
        settled = (sizes == 1) & one_kind[first]
        for p in first[settled]:
            n, e = node[p], int(other.order[other.start[entry[p]]:other.stop[entry[p]]].min())
            codes[tree.order[tree.start[n]:tree.stop[n]]] = e
            sums[e] += tree.total[n]
            counts[e] += tree.stop[n] - tree.start[n]
        still = np.repeat(~settled, sizes)
        node, entry, one_kind = node[still], entry[still], one_kind[still]
        # a leaf whose entries are all single compares its parts one by one
        ended = (tree.left[node] == 0)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(first, len(node)))
        ready = ended & np.repeat(np.logical_and.reduceat(one_kind, first) if len(first) else one_kind, sizes)
        if ready.any():
            open_leaves.append((node[ready], entry[ready]))
        node, entry, one_kind, ended = node[~ready], entry[~ready], one_kind[~ready], ended[~ready]
        # go down: both children of a node of entries, then both of a node of parts
        e = np.where(one_kind, entry, other.left[entry])
        node = np.repeat(node, np.where(one_kind, 1, 2))
        ended = np.repeat(ended, np.where(one_kind, 1, 2))
        e = np.repeat(e, np.where(one_kind, 1, 2))
        e[np.flatnonzero(np.diff(np.arange(len(one_kind)).repeat(np.where(one_kind, 1, 2)), prepend=-1) == 0)] += 1
        below = np.where(ended, node, tree.left[node])
        node, entry = np.concatenate([below, below[~ended] + 1]), np.concatenate([e, e[~ended]])
        sort = np.lexsort((entry, node))
        node, entry = node[sort], entry[sort]
    if open_leaves:
        node, entry = np.concatenate([n for n, _ in open_leaves]), np.concatenate([e for _, e in open_leaves])
        leaves, row = np.unique(node, return_inverse=True)
        allowed = np.zeros((len(leaves), len(book)), bool)
        for e in np.unique(entry):
            allowed[np.ix_(row[entry == e], other.order[other.start[e]:other.stop[e]])] = True
        sizes = tree.stop[leaves] - tree.start[leaves]
        at = np.repeat(np.arange(len(leaves)), sizes)
        rows = tree.order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tree.start[leaves], sizes)]
        far = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
        for e in range(len(book)):
            mine = np.flatnonzero(allowed[at, e])
            away = x[rows[mine]] - book[e]
            far[mine, e] = (away * away).sum(axis=1)
        codes[rows] = far.argmin(axis=1)
        for e in np.unique(codes[rows]):
            mine = rows[codes[rows] == e]
            sums[e] += x[mine].sum(axis=0)
            counts[e] += len(mine)
    return codes, sums, counts


def _tree_bytes(tree: Tree) -> bytes:
    return b"".join(np.asarray(a, np.int64).tobytes() for a in tree[1:])


def _tree_of(order: bytes, nodes: bytes, width: int) -> Tree:
    flat = np.frombuffer(nodes, np.int64)
    n = len(flat) // (3 + 3 * width)
    start, stop, left = flat[:3 * n].reshape(3, n)
    low, high, total = flat[3 * n:].reshape(3, n, width)
    return Tree(np.frombuffer(order, np.int32).astype(np.int64), start, stop, left, low, high, total)


def _integers(vectors: list, width: int, scale: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    x = np.floor(x * scale)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"a component beyond {LARGEST / scale} in size has no code: its squared distances don't fit a long")
    return x.astype(np.int64)


def _blocks(rows: DataFrame, width: int, settings: Settings) -> DataFrame:
    """Rows as they lie, in blocks of integers with a tree per part position."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    size = width // settings.parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {c: rows_schema.field(c).type for c in ("id", "label")}
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            x = _integers(table.column("v").to_pylist(), width, settings.scale)
            trees = [grow(x[:, p * size:(p + 1) * size], LEAF) for p in range(settings.parts)]
            lists = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).combine_chunks().cast(names[c])) for c in names}
            return pa.RecordBatch.from_arrays(
                [*lists.values(), pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([[t.order.astype(np.int32).tobytes() for t in trees]], pa.list_(pa.binary())),
                 pa.array([[_tree_bytes(t) for t in trees]], pa.list_(pa.binary()))], ["ids", "labels", "x", "orders", "nodes"])
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held = table.slice(BLOCK).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    rows_schema = _arrow(rows)
    return rows.mapInArrow(build, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary, orders array<binary>, nodes array<binary>")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def _assigned(batch: pa.RecordBatch, r: int, books: list[np.ndarray], size: int) -> tuple[np.ndarray, list]:
    x = np.frombuffer(batch.column("x")[r].as_py(), np.int32).reshape(-1, size * len(books)).astype(np.int64)
    orders, nodes = batch.column("orders")[r].as_py(), batch.column("nodes")[r].as_py()
    return x, [assign(x[:, p * size:(p + 1) * size], _tree_of(orders[p], nodes[p], size), book) for p, book in enumerate(books)]


def _moved(blocks: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one round: floors of the means; unused entries stay."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), object) for b in books]
        for batch in batches:
            for r in range(batch.num_rows):
                for p, (_, s, c) in enumerate(_assigned(batch, r, books, size)[1]):
                    sums[p] += s
                    counts[p] += c
        out = [(p, e, i, str(sums[p][e, i]), int(counts[p][e])) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e] for i in range(size)]
        if out:
            yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(("part", "entry", "at", "total", "count"), zip(*out))},
                                             schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.string()), ("count", pa.int64())]))
    parts = blocks.mapInArrow(add, "part int, entry int, at int, total string, count bigint")
    moved = [b.copy() for b in books]
    for row in parts.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")).collect():
        moved[row["part"]][row["entry"], row["at"]] = int(row["total"]) // row["count"]
    return moved


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors and the codebooks behind them.

    The frame has, per kept row: ``id``, ``label``, ``codes`` (one byte per part) and ``error`` (its squared distances to the
    entries, summed). Rows whose vector is null or holds null or non-finite components are left out; a null id or label is
    kept. Shorter vectors count as filled up with zeros, and so does a length that the number of parts does not divide.
    Repeated rows are coded each. The codebooks start from the rows with the smallest ids (null ids last, equal ids by their vectors); fewer
    rows than entries make smaller codebooks. An empty table gives no rows and empty codebooks. Further columns are not read.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(whole(F.col("v")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    shape = f"id {kinds['id']}, label {kinds['label']}, codes binary, error bigint"
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], shape), Codebooks([])
    size = max(1, -(-longest // settings.parts))
    width = size * settings.parts
    blocks = stored(_blocks(rows, width, settings))
    seeds = _integers([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(settings.entries).collect()], width, settings.scale)
    books = [seeds[:, p * size:(p + 1) * size].copy() for p in range(settings.parts)]
    for _ in range(settings.rounds):
        books = _moved(blocks, books, size)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, found = _assigned(batch, r, books, size)
                codes = np.stack([c for c, _, _ in found], axis=1)
                away = x - np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)
                told = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, batch.column("labels")[r].values, told, pa.array((away * away).sum(axis=1))], ["id", "label", "codes", "error"])
    return blocks.mapInArrow(code, shape), Codebooks(books)


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over the rows of equal label; null labels are equal.

    Labels are summed before they are joined back, so a label with a third of all rows moves one row per task.
    """
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")
