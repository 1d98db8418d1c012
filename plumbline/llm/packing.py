"""Packing of token sequences by non-negative least squares over their length histogram.

Documents are cut into pieces of at most the window; their lengths are counted, and the counts, of fixed number, are all
that reaches the driver. For the fillings, lengths are rounded up to ``BARS`` steps. Every combination of up to ``DEPTH`` bars that fills
the window exactly is a column; non-negative least squares finds how often to repeat each, the counts are rounded
down to what the histogram has, and the rest is packed greedily by exact length, largest first, pattern by
pattern. Pieces then find their place from their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import encoder, small
from plumbline.session import cut_lineage

WINDOW, BARS, DEPTH = 2048, 256, 3


class Plan(NamedTuple):
    """Patterns (units of each piece, largest first), how often each is repeated, and the first sequence of each."""

    patterns: list[tuple[int, ...]]
    copies: list[int]
    bases: list[int]

    def places(self) -> dict[int, np.ndarray]:
        """Per unit: rows (first number, pieces per copy, first sequence, first slot), by first number."""
        used, rows = {}, {}
        for pattern, n, base in zip(*self):
            for u in sorted(set(pattern)):
                k, at = pattern.count(u), used.get(u, 0)
                rows.setdefault(u, []).append((at, k, base, pattern.index(u)))
                used[u] = at + k * n
        return {u: np.array(r, np.int64) for u, r in rows.items()}


def combinations(bars: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` bars (1..bars) that add up to ``bars``."""
    def fill(left: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if deep > 1:
            for first in range(min(most, left - 1), 0, -1):
                for rest in fill(left - first, first, deep - 1):
                    yield (first, *rest)
    return list(fill(bars, bars, depth))


def nonnegative_least_squares(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - h|, by active sets, with a trace of ridge so that every system has one solution."""
    x, passive, barred = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        gain = (h - a[:, passive] @ x[passive]) @ a
        gain[passive | barred] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        passive[best] = True
        while passive.any():
            on = np.flatnonzero(passive)
            solved = np.linalg.solve(a[:, on].T @ a[:, on] + 1e-9 * np.eye(len(on)), h @ a[:, on])
            if (solved > 0).all():
                x[:] = 0
                x[on] = solved
                break
            low = solved <= 0
            step = (x[on][low] / (x[on][low] - solved[low])).min()
            x[on] += step * (solved - x[on])
            passive[on[low & (x[on] <= 1e-12)]] = False
            x[~passive] = 0
        barred[best] = not passive[best]  # rounding threw it out at once: do not ask again
    return x


def _planned(patterns: list[tuple[int, ...]], copies: list[int], base: int) -> Plan:
    return Plan(patterns, copies, (base + np.concatenate([[0], np.cumsum(copies)[:-1]])).astype(int).tolist() if copies else [])


def fill(histogram: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Exact fillings by least squares, and what they leave of the histogram (count per bar, index 0 unused)."""
    left, bars = histogram.astype(np.int64).copy(), len(histogram) - 1
    patterns, copies = [], []
    found = [p for p in combinations(bars) if all(left[b] for b in p)]
    if found:
        a = np.zeros((bars, len(found)))
        for j, pattern in enumerate(found):
            for b in pattern:
                a[b - 1, j] += 1
        x = nonnegative_least_squares(a, left[1:] / left.sum()) * left.sum()
        for j in np.argsort(-x, kind="stable"):
            need = np.bincount(found[j], minlength=bars + 1)
            n = min(int(x[j]), int((left[need > 0] // need[need > 0]).min()))
            if n:
                left -= n * need
                patterns.append(found[j])
                copies.append(n)
    return _planned(patterns, copies, 0), left


def greedy(histogram: np.ndarray, base: int) -> Plan:
    """Largest first: the fullest pattern that the remaining lengths give, as often as they give it."""
    left, room_of = histogram.astype(np.int64).copy(), len(histogram) - 1
    patterns, copies = [], []
    while left.any():
        room, pattern, have = room_of, [], left.copy()
        while room and (fits := np.flatnonzero(have[:room + 1])).size:
            b = int(fits[-1])
            k = int(min(have[b], room // b))
            pattern += [b] * k
            have[b] -= k
            room -= k * b
        need = np.bincount(pattern, minlength=room_of + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        left -= n * need
        patterns.append(tuple(pattern))
        copies.append(n)
    return _planned(patterns, copies, base)


class Placement:
    """Sequence and slot of every piece from its length and its number among the pieces of that length."""

    def __init__(self, lengths: np.ndarray):
        """``lengths``: count of pieces per length 1..window (index 0 unused)."""
        window = len(lengths) - 1
        bars = BARS if window % BARS == 0 else window
        self.bar = -(-np.arange(window + 1) // (window // bars))
        histogram = np.bincount(self.bar, lengths, bars + 1).astype(np.int64)
        exact, left = fill(histogram)
        self.used = (histogram - left)[self.bar]  # pieces of the bar that stand in exact fillings, shortest first
        total = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(self.bar, np.arange(bars + 1))
        self.before = total[:-1] - total[first[self.bar]]  # pieces of the same bar that are shorter
        self.taken = np.clip(self.used - self.before, 0, lengths)
        rest = greedy(lengths - self.taken, sum(exact.copies))
        self.exact, self.rest = exact.places(), rest.places()
        self.sequences = sum(exact.copies) + sum(rest.copies)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        late = number >= self.taken[length]
        unit = np.where(late, length, self.bar[length])
        order = np.where(late, number - self.taken[length], number + self.before[length])
        for tail, table in ((False, self.exact), (True, self.rest)):
            for u in np.unique(unit[late == tail]):
                on, rows = np.flatnonzero((late == tail) & (unit == u)), table[int(u)]
                r = rows[np.searchsorted(rows[:, 0], order[on], "right") - 1]
                copy, turn = np.divmod(order[on] - r[:, 0], r[:, 1])
                sequence[on], slot[on] = r[:, 2] + copy, r[:, 3] + turn
        return sequence, slot


def token_pieces(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every row: its ids and the end id, cut at multiples of the window.

    Null text counts as empty, which leaves the end id alone. ``row`` tells rows that repeat a key apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        seen, row, end = np.zeros(window + 1, np.int64), 0, np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            keys, out = [], {c: [] for c in ("row", "start", "length", "crc", "tokens", "number", "ids")}
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start:4 * (start + window)]
                    size = len(piece) // 4
                    keys.append(i)
                    for c, v in zip(out, (row, start, size, zlib.crc32(piece), n, int(seen[size]), piece if keep_ids else None)):
                        out[c].append(v)
                    seen[size] += 1
                row += 1
            columns = [pa.array([part] * len(keys), pa.int64())] + [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], ["doc_id", "part", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, part bigint, row bigint, start bigint, length bigint, crc bigint, tokens bigint, number bigint, ids binary")


def pack(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every piece with its place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Null and empty texts are the end id alone; repeated rows and a null key are packed like any other row. An
    empty table gives no piece. Further columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = cut_lineage(token_pieces(docs, path, end_id, window, keep_ids))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("c"))
    lengths = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect():  # one row per length
        lengths[r["length"]] = r["c"]
    placement = Placement(lengths)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(offsets, ["part", "length"]).withColumn("number", F.col("number") + F.col("shift")).drop("shift")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = placement.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])

    kept = numbered.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "number", *(["ids"] if keep_ids else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", sequence_id bigint, slot bigint"
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a window's worth of pieces at most
    placed = kept.mapInArrow(place, schema).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.drop("number", "slot")


def sequences(packed: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids array<bigint>, n_tokens): the pieces of ``pack(keep_ids=True)`` put together and padded."""
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("offset").to_numpy())
        data = b"".join(group.column("ids").take(pa.array(order)).to_pylist())
        ids = np.full(window, pad_id, np.int64)
        ids[:len(data) // 4] = np.frombuffer(data, "<u4")
        return pa.table({"sequence_id": group.column("sequence_id").slice(0, 1), "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "n_tokens": pa.array([len(data) // 4], pa.int64())})
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id bigint, ids array<bigint>, n_tokens bigint")
