"""Byte-level BPE encoding and decoding of whole texts, long ones by tree concatenation.

A long text is cut into leaves of ``LEAF`` characters wherever they end, all leaves are encoded in parallel, and
neighbours are joined as a balanced tree. A cut changes only the tokens near it: around each join a window of tokens is
encoded again and grown until its first and last tokens are those of the two sides. From there on every
neighbouring pair of tokens is one the tokenizer itself produced, which makes the joined ids those of the whole text.
A special token's string is a cut that needs no joining.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import BYTES, encoder, small

LEAF = 16_384
MARGIN = 4  # tokens that must agree on either side of a window
START = 16  # tokens of the first window on either side


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary, special tokens included."""
    byte_of = {c: b for b, c in enumerate(BYTES)}
    tokenizer = encoder(path).tokenizer
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
    return table


@lru_cache(maxsize=4)
def _sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(path)], np.int64)


def leaves(text: str, specials: list[str], size: int = LEAF) -> list[tuple[str, bool]]:
    """Pieces of a text in order, each with whether its left edge is a hard one (start, or beside a special token)."""
    parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]
    out = []
    for k, part in enumerate(parts):
        step = max(1, len(part)) if k % 2 else size
        out += [(part[i:i + step], i == 0) for i in range(0, len(part), step)]
    return out or [("", True)]


def join(path: str, a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Text and ids of two neighbours put together; ids equal those of the joined text."""
    (at, ai), (bt, bi) = a, b
    if not len(ai) or not len(bi):
        return at + bt, np.concatenate([ai, bi])
    size, encode = _sizes(path), encoder(path).tokenizer
    ends = np.concatenate([[0], np.cumsum(size[ai])]), np.concatenate([[0], np.cumsum(size[bi])])
    k = START
    while True:
        i, j = max(0, len(ai) - k), min(len(bi), k)
        while i and at[ends[0][i]] & 0xC0 == 0x80:  # not inside a character
            i -= 1
        while j < len(bi) and bt[ends[1][j]] & 0xC0 == 0x80:
            j += 1
        window = (at[ends[0][i]:] + bt[:ends[1][j]]).decode()
        ids = np.array(encode.encode(window, add_special_tokens=False).ids, np.uint32)
        left = i == 0 or np.array_equal(ids[:MARGIN], ai[i:i + MARGIN])
        right = j == len(bi) or np.array_equal(ids[-MARGIN:], bi[j - MARGIN:j])
        if left and right:
            return at + bt, np.concatenate([ai[:i], ids, bi[j:]])
        k *= 2


def concatenate(path: str, parts: list[tuple[bytes, np.ndarray, bool]]) -> np.ndarray:
    """Ids of a text from its leaves (text, ids, hard left edge), as a balanced tree over each stretch without a hard edge."""
    def tree(lo: int, hi: int) -> tuple[bytes, np.ndarray]:
        if hi - lo == 1:
            return parts[lo][0], parts[lo][1]
        mid = (lo + hi) // 2
        return join(path, tree(lo, mid), tree(mid, hi))
    starts = [i for i, p in enumerate(parts) if p[2]] + [len(parts)]
    return np.concatenate([tree(a, b)[1] for a, b in zip(starts, starts[1:])])


def decode(path: str, ids: np.ndarray) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD, as in the library."""
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


def _digest(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    data = batch.column("ids").to_pylist()
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array([len(i) // 4 for i in data], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in data], pa.string()),
        pa.array([hashlib.sha256(decode(path, np.frombuffer(i, "<u4")).encode()).hexdigest() for i in data], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """(doc_id, ids): per row of ``docs`` the ids of its whole text as little-endian 32-bit integers.

    Null and empty texts have no ids; repeated rows and null keys are encoded like any other. Further columns are not read.
    Only leaves of texts longer than one leaf are shuffled. With ``digests`` the task that has the ids decodes them and
    gives (doc_id, n_tokens, ids_sha256, decoded_sha256) instead.
    """
    def result(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _digest(batch, path) if digests else batch

    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield result(pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(encoder(path).encode, batch.column(1).to_pylist())), pa.binary())], ["doc_id", "ids"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in small(batches, 16):
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = leaves(t, encoder(path).special, leaf)
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([i] * n)), pa.array([part] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()),
                    pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found])], ["doc_id", "part", "row", "leaf", "text", "hard"])
                row += 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            ids = pa.array(list(map(encoder(path).encode, batch.column("text").to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, doc = None, [], None
        def done() -> pa.RecordBatch:
            ids = concatenate(path, [(t.encode(), np.frombuffer(i, "<u4"), h) for t, i, h in parts])
            return result(pa.RecordBatch.from_arrays([doc, pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["doc_id", "ids"]))
        for batch in small(batches, 64):
            for k, (part, row, t, h, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "row", "text", "hard", "ids")))):
                if at != (part, row):
                    if at is not None:
                        yield done()
                    at, parts, doc = (part, row), [], batch.column("doc_id").slice(k, 1)
                parts.append((t, i, h))
        if at is not None:
            yield done()

    made = f"doc_id {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    short, long = docs.where(F.length("text") <= leaf), docs.where(F.length("text") > leaf)
    shape = f"doc_id {kind}, part bigint, row bigint, leaf bigint, text string, hard boolean"
    spread = long.mapInArrow(cut, shape).repartition("part", "row", "leaf").mapInArrow(each, shape + ", ids binary")
    joined = spread.repartition("part", "row").sortWithinPartitions("part", "row", "leaf").mapInArrow(gather, made)
    return short.mapInArrow(whole, made).union(joined)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) from the output of ``encode``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [decode(path, np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, shape + ", text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from the output of ``encode``; no text leaves the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_digest(batch, path) for batch in small(batches))
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
