"""Token-id files: documents in ascending id order, ids compressed by an adaptive context-mixing range coder.

A file is a Parquet table of segments, so Spark's committer and any store it can reach hold it. A segment has
whole documents and a binary payload: a header, then blocks of ``BLOCK`` ids. Every block starts from an empty model and carries
the CRC-32 of its ids, so blocks decode independently; a task codes the blocks of a segment side by side as lanes
of numpy arrays.

Model of an id: the order-2 and order-1 contexts each predict the id that last followed them, order 0 predicts the ids
of the block so far in proportion to their counts (brought up to date whenever the block has doubled). Weights
kept per pair of confidences mix the three and an escape that codes the id plainly; they move towards the
prediction that was right. The mixed probabilities drive a 48-bit carry-free range coder with 16-bit output words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import encoder, small

MAGIC = b"PLID"
BLOCK = 4096  # ids of a block
LANES = 1024  # blocks coded side by side
SEGMENT = BLOCK * LANES  # a segment is closed at the first document end from here on
SLOTS = 4096  # hashed contexts of each order
NOTHING = np.uint32(0xFFFFFFFC)
M32, M48 = np.int64((1 << 32) - 1), np.int64((1 << 48) - 1)
HIGH, LOW = 64512, 1024  # what a weight can grow or shrink to, of 65536


class DamagedBlock(ValueError):
    """A block whose ids do not have the checksum in its header."""


class _Lanes:
    """Model and coder of many blocks in step; lanes are ordered by length, longest first."""

    def __init__(self, lengths: np.ndarray, id_bits: int):
        self.lengths, self.id_bits = lengths, id_bits
        k = len(lengths)
        self.lane = np.arange(k)
        self.after1, self.after2 = (np.full(k * SLOTS, NOTHING, np.uint32) for _ in range(2))
        self.weights = [np.full(k * 32, 32768, np.int64) for _ in range(3)]
        self.low, self.range = np.zeros(k, np.int64), np.full(k, 1 << 48, np.int64)
        self.history = np.zeros((k, int(lengths[0])), np.uint32)
        self.sorted = np.zeros((k, 0), np.uint32)
        self.place = np.zeros(k, np.int64)
        self.words: np.ndarray | None = None
        self.code: np.ndarray | None = None

    def shift(self, k: int) -> None:
        """Write or read 16-bit words until every range has 32 bits again."""
        need = np.flatnonzero(self.range[:k] <= M32)
        while need.size:
            low, size = self.low[need], self.range[need]
            split = ((low ^ (low + size - 1)) >> 32) != 0
            size = np.where(split, (-low) & M32, size)
            if self.code is None:
                self.words[need, self.place[need]] = low >> 32
            else:
                self.code[need] = ((self.code[need] << 16) | self.words[need, self.place[need]]) & M48
            self.place[need] += 1
            self.low[need] = (low << 16) & M48
            self.range[need] = size = size << 16
            need = need[size <= M32]

    def run(self, ids: np.ndarray | None) -> np.ndarray:
        """Encode ``ids`` (lanes x length), or decode when it is None; returns the ids."""
        decoding, history = ids is None, self.history
        if not decoding:
            history[:, :] = ids
        total = 0
        older, before = np.zeros(len(self.lane), np.int64), np.zeros(len(self.lane), np.int64)
        alive = np.searchsorted(-self.lengths, -np.arange(history.shape[1]), "left")
        starts = ends = None
        for t in range(history.shape[1]):
            k = int(alive[t])
            lane = self.lane[:k]
            if t >= 16 and t & (t - 1) == 0:
                total = t
                self.sorted = np.sort(history[:k, :t], axis=1)
                if decoding:
                    new = np.ones((k, t + 1), bool)
                    new[:, 1:t] = self.sorted[:, 1:] != self.sorted[:, :-1]
                    at = np.arange(t + 1, dtype=np.int32)
                    starts = np.maximum.accumulate(np.where(new[:, :t], at[:t], 0), axis=1)
                    ends = np.minimum.accumulate(np.where(new[:, 1:], at[1:], t)[:, ::-1], axis=1)[:, ::-1]
                else:
                    upto = min(2 * t, history.shape[1])
                    starts, ends = np.empty((k, upto - t), np.int32), np.empty((k, upto - t), np.int32)
                    for i in range(k):
                        starts[i] = np.searchsorted(self.sorted[i], history[i, t:upto], "left")
                        ends[i] = np.searchsorted(self.sorted[i], history[i, t:upto], "right")
            bits = total.bit_length() - 1 if total else 0
            slot1 = lane * SLOTS + (((before[:k] * 0x9E3779B1) >> 15) & (SLOTS - 1))
            slot2 = lane * SLOTS + ((((older[:k] * 0x85EBCA77) ^ (before[:k] * 0x9E3779B1)) >> 13) & (SLOTS - 1))
            entry1, entry2 = self.after1[slot1], self.after2[slot2]
            guess1, guess2 = entry1 >> 2, entry2 >> 2
            same = guess1 == guess2
            mix = lane * 32 + ((entry2 & 3) * 8 + (entry1 & 3) * 2 + same)
            w2, w1, w0 = (w[mix] for w in self.weights)
            f2 = w2
            rest = 65536 - f2
            f1 = (rest * w1) >> 16
            rest = rest - f1
            f0 = np.maximum((rest * w0) >> 16, 1)
            up1, up0 = f2 + f1, f2 + f1 + f0
            unit = self.range[:k] >> 16
            if decoding:
                value = np.minimum((self.code[:k] - self.low[:k]) // unit, 65535)
                is2, is1, in0 = value < f2, (value >= f2) & (value < up1), (value >= up1) & (value < up0)
            else:
                now = history[:k, t]
                is2, is1 = now == guess2, now == guess1
                is1 &= ~is2
                in0 = ~(is2 | is1)
                if total:
                    first, last = starts[:k, t - total], ends[:k, t - total]
                    in0 &= last > first
                else:
                    in0[:] = False
            from_ = np.where(is2, 0, np.where(is1, f2, np.where(in0, up1, up0)))
            freq = np.where(is2, f2, np.where(is1, f1, np.where(in0, f0, 65536 - up0)))
            self.low[:k] += unit * from_
            self.range[:k] = unit * freq
            if self.id_bits > 16:
                self.shift(k)
            on = np.flatnonzero(~(is2 | is1))
            if on.size:
                seen = in0[on]
                unit = self.range[on] >> np.where(seen, bits, self.id_bits)
                if decoding:
                    value = np.minimum((self.code[on] - self.low[on]) // unit, np.where(seen, max(total, 1), 1 << self.id_bits) - 1)
                    if total:
                        spot = np.where(seen, value, 0)
                        first, last, known = starts[on, spot], ends[on, spot], self.sorted[on, spot]
                        from_, freq = np.where(seen, first, value), np.where(seen, last - first, 1)
                        plain = np.where(seen, known, value)
                    else:
                        from_, freq, plain = value, 1, value
                    now = np.where(is2, guess2, guess1)
                    now[on] = plain
                    history[:k, t] = now
                elif total:
                    from_, freq = np.where(seen, first[on], now[on]), np.where(seen, last[on] - first[on], 1)
                else:
                    from_, freq = now[on].astype(np.int64), 1
                self.low[on] += unit * from_
                self.range[on] = unit * freq
            elif decoding:
                history[:k, t] = now = np.where(is2, guess2, guess1)
            self.shift(k)
            self.weights[0][mix] = w2 + ((np.where(is2, HIGH, LOW) - w2) >> 5)
            self.weights[1][mix] = w1 + np.where(is2, 0, (np.where(is1, HIGH, LOW) - w1) >> 5)
            self.weights[2][mix] = w0 + np.where(is2 | is1, 0, (np.where(in0, HIGH, LOW) - w0) >> 5)
            fresh = now << np.uint32(2)
            self.after1[slot1] = np.where(now == guess1, np.where(entry1 & 3 == 3, entry1, entry1 + 1), fresh)
            self.after2[slot2] = np.where(now == guess2, np.where(entry2 & 3 == 3, entry2, entry2 + 1), fresh)
            older[:k], before[:k] = before[:k], now
        return history


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), LANES):
        yield order[i:i + LANES]


def compress(ids: np.ndarray, id_bits: int) -> bytes:
    """Payload of a segment: header, block headers (ids, checksum, words), then the words of all blocks."""
    n = -(-len(ids) // BLOCK)
    lengths = np.full(n, BLOCK)
    if n:
        lengths[-1] = len(ids) - BLOCK * (n - 1)
    data: list[bytes] = [b""] * n
    for lanes in _batches(lengths):
        block = np.zeros((len(lanes), int(lengths[lanes[0]])), np.uint32)
        for row, b in enumerate(lanes):
            part = ids[b * BLOCK:b * BLOCK + lengths[b]]
            block[row, :len(part)] = part
        coder = _Lanes(lengths[lanes], id_bits)
        coder.words = np.zeros((len(lanes), 3 * block.shape[1] + 8), np.uint16)
        coder.run(block)
        for row, b in enumerate(lanes):
            tail = [(int(coder.low[row]) >> s) & 0xFFFF for s in (32, 16, 0)]
            data[b] = coder.words[row, :coder.place[row]].astype("<u2").tobytes() + struct.pack("<3H", *tail)
    heads = b"".join(struct.pack("<III", int(lengths[b]), zlib.crc32(ids[b * BLOCK:b * BLOCK + lengths[b]].astype("<u4").tobytes()), len(data[b]) // 2) for b in range(n))
    return MAGIC + struct.pack("<BI", id_bits, n) + heads + b"".join(data)


def expand(payload: bytes) -> np.ndarray:
    """Ids of a payload; refuses another format and a block that fails its checksum."""
    if payload[:4] != MAGIC:
        raise DamagedBlock("not a token-id segment")
    id_bits, n = struct.unpack_from("<BI", payload, 4)
    heads = np.frombuffer(payload, "<u4", 3 * n, 9).reshape(n, 3).astype(np.int64)
    lengths, base = heads[:, 0], 9 + 12 * n
    at = np.concatenate([[0], np.cumsum(heads[:, 2])])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.zeros(int(lengths.sum()), "<u4")
    words = np.frombuffer(payload, "<u2", int(at[-1]), base)
    for lanes in _batches(lengths):
        coder = _Lanes(lengths[lanes], id_bits)
        coder.words = np.zeros((len(lanes), int(heads[lanes, 2].max()) + 4), np.int64)
        for row, b in enumerate(lanes):
            coder.words[row, :heads[b, 2]] = words[at[b]:at[b + 1]]
        coder.code = (coder.words[:, 0] << 32) | (coder.words[:, 1] << 16) | coder.words[:, 2]
        coder.place[:] = 3
        found = coder.run(None)
        for row, b in enumerate(lanes):
            part = found[row, :lengths[b]].astype("<u4")
            if zlib.crc32(part.tobytes()) != heads[b, 1]:
                raise DamagedBlock(f"block {b} fails its checksum")
            ids[starts[b]:starts[b + 1]] = part
    return ids


def write(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> None:
    """Encode every text and write the files. Rows are ordered by key (nulls first), rows that share one by their text.

    Null and empty texts are the end id alone. An empty table writes files without a segment. Further columns are not read.
    """
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number = encoder(path), TaskContext.get().partitionId(), 0
        bits = max(1, (max(tokens.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) - 1).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        keys, data, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.concat_arrays(keys)),
                pa.array([[len(d) // 4 for d in data]], pa.list_(pa.int64())), pa.array([compress(ids, bits)], pa.binary())],
                ["part", "segment", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in small(batches):
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = tokens.encode(t) + end
                keys.append(batch.column(0).slice(i, 1))
                data.append(ids)
                held += len(ids) // 4
                if held >= segment:
                    yield close()
                    keys, data, held, number = [], [], 0, number + 1
        if data:
            yield close()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, f"part bigint, segment bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<bigint>, payload binary").write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` as little-endian 32-bit integers."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0)))
    starts = sizes.withColumn("first", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("first") + F.col("before")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths = expand(batch.column("payload")[r].as_py()), batch.column("lengths")[r].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(lengths)])
                parts = [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("part").take(pa.array([r] * n)), batch.column("segment").take(pa.array([r] * n)), batch.column("doc_ids")[r].values,
                    pa.array(at[:-1]), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if keep_ids else [None] * n, pa.binary())],
                    ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    docs = files.select("part", "segment", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"part bigint, segment bigint, doc_id {kind}, within bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    placed = docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return placed if keep_ids else placed.drop("ids")
