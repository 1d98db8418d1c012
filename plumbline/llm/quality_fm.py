"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its hashed words (log counts, scaled to length one), statistics of its structure, each as a
value and as a one-hot bin, and numeric metadata columns. The machine scores

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where every feature i has a short vector v_i. The pairwise part equals half of |sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2, so
a score costs one pass over the features of a document, however many pairs they form.

The machine is fitted on at most ``TRAIN_ROWS`` labelled documents, drawn by a hash of their ids, in one task of bounded
memory; every document is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import small

TRAIN_ROWS = 4_096  # labelled documents a machine is fitted on at most
WORDS = 1 << 14  # slots of hashed words
BINS = 24  # bins of a statistic
RANK = 8  # length of a feature's vector
CACHE = 400_000  # words whose slot a worker remembers

#: Structure statistics in the order of their slots, all between 0 and 1.
STATISTICS = (
    "words", "word_bytes", "distinct_words", "commonest_word", "upper", "digits", "symbols", "shouts", "sentence_ends", "commas",
    "lines", "repeated_lines", "beyond_ascii", "longest_word")


class Machine(NamedTuple):
    """A fitted machine; ``metadata`` names the columns that follow the text."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    metadata: tuple[str, ...]


def width(metadata: Sequence[str]) -> int:
    return WORDS + (len(STATISTICS) + len(metadata)) * (BINS + 1)


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return slot


_SLOTS = _Slots()
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+\\{}[]", np.uint8)


def _share(part: float, whole: float) -> float:
    return min(1.0, part / whole) if whole else 0.0


def statistics(text: str, counts: Counter, words: int) -> list[float]:
    """Values of ``STATISTICS``; all but the counts of words come from one histogram of bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(seen[_UPPER].sum() + seen[_LOWER].sum())
    lines = [line for line in text.split("\n") if line]
    return [
        min(1.0, np.log2(1 + words) / 24), _share(len(raw) / 40, words), _share(len(counts), words), _share(max(counts.values(), default=0), words),
        _share(int(seen[_UPPER].sum()), letters), _share(int(seen[_DIGIT].sum()), len(raw)), _share(int(seen[_SYMBOLS].sum()), 4 * words),
        _share(int(seen[33] + seen[63]), 2 * words), _share(int(seen[46] + seen[33] + seen[63]), words), _share(int(seen[44]), words),
        _share(len(lines), words), _share(len(lines) - len(set(lines)), len(lines)), _share(int(seen[128:].sum()), len(raw)),
        min(1.0, max(map(len, counts), default=0) / 100)]


def features(text: str, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document. A missing metadata value sets no slot of its column."""
    counts = Counter(text.lower().split())
    words = sum(counts.values())
    slots = np.fromiter(map(_SLOTS.__getitem__, counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    values /= np.sqrt((values * values).sum()) or 1.0
    known = statistics(text, counts, words) + [None if m is None or m != m else min(1.0, np.log2(1 + abs(m)) / 64) for m in metadata]
    at = np.array([i for i, s in enumerate(known) if s is not None], np.int32)
    stats = np.array([s for s in known if s is not None])
    bins = WORDS + len(known) + at * BINS + np.minimum(BINS - 1, stats * BINS).astype(np.int32)
    each = np.full(len(at), 1 / np.sqrt(len(known)))
    return np.concatenate([slots, WORDS + at, bins]).astype(np.int32), np.concatenate([values, stats * each, each]).astype(np.float32)


def _joined(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([s for s, _ in docs]), np.concatenate([v for _, v in docs]).astype(float), np.cumsum([0] + [len(s) for s, _ in docs])[:-1]


def raw_scores(machine: Machine, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores before the logistic function by the sum-of-squares identity; every document has features."""
    placed = machine.factors[slots] * values[:, None]
    sums = np.add.reduceat(placed, starts)
    pairs = (sums * sums).sum(axis=1) - np.add.reduceat((placed * placed).sum(axis=1), starts)
    return machine.bias + np.add.reduceat(machine.weights[slots] * values, starts) + pairs / 2


def _chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, metadata: Sequence[str], epochs: int = 8, batch: int = 256,
        rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss by AdaGrad over shuffled batches, from a fixed seed. No rows give the machine that scores 0.5."""
    dice, n = np.random.default_rng(17), width(metadata)
    bias, weights, factors = 0.0, np.zeros(n), dice.normal(0, 0.05, (n, RANK))
    if not docs:
        return Machine(0.0, weights, factors * 0, tuple(metadata))
    past = np.full((n, RANK + 1), 1e-6)
    past_bias = 1e-6
    for _ in range(epochs):
        order = dice.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            slots, values, starts = _joined([docs[i] for i in chosen])
            sizes = np.diff(np.append(starts, len(slots)))
            machine = Machine(bias, weights, factors, ())
            slope = (_chance(raw_scores(machine, slots, values, starts)) - target[chosen]) / len(chosen)
            placed = factors[slots] * values[:, None]
            sums = np.repeat(np.add.reduceat(placed, starts), sizes, axis=0)
            steps = np.repeat(slope, sizes) * values
            used, where = np.unique(slots, return_inverse=True)
            grads = np.empty((len(used), RANK + 1))
            grads[:, 0] = np.bincount(where, steps)
            for f in range(RANK):
                grads[:, f + 1] = np.bincount(where, steps * (sums[:, f] - placed[:, f]))
            grads[:, 0] += decay * weights[used]
            grads[:, 1:] += decay * factors[used]
            past[used] += grads * grads
            steps = rate * grads / np.sqrt(past[used])
            weights[used] -= steps[:, 0]
            factors[used] -= steps[:, 1:]
            past_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(past_bias)
    return Machine(bias, weights, factors, tuple(metadata))


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on ``rows`` labelled documents at most, those whose ids have the smallest hashes.

    Rows of ``labels`` without an id or a label don't count; several labels of one id count as their mean, labels beyond 0 and 1
    as the nearer of the two. Documents that share an id are examples each, as long as the bound allows. The labels are
    drawn before they meet the documents, so the join broadcasts ``rows`` small rows at most, and texts never move.
    """
    known = labels.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_y")).where("_id is not null and _y is not null and not isnan(_y)")
    known = known.groupBy("_id").agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_y"))).alias("_y"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    told = _texts(docs, metadata, key, text)
    met = told.join(F.broadcast(drawn), told["doc_id"] == drawn["_id"]).select("_y", F.xxhash64("doc_id", "text").alias("h"), "text", "metadata")

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [features(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("metadata").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("_y"), pa.array([s.tobytes() for s, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["h", "y", "slots", "values"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((h, y, s, v) for b in batches for h, y, s, v in zip(*(c.to_pylist() for c in b.columns)))
        made = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, _, s, v in known]
        m = fit(made, np.array([y for _, y, _, _ in known]), metadata)
        yield pa.RecordBatch.from_pydict({"bias": [float(m.bias)], "weights": [m.weights.astype(np.float32).tobytes()], "factors": [m.factors.astype(np.float32).tobytes()]})

    examples = met.mapInArrow(example, "h bigint, y double, slots binary, values binary").orderBy("h", "y").limit(rows)
    m = examples.coalesce(1).mapInArrow(fitted, "bias double, weights binary, factors binary").first()
    return Machine(m["bias"], np.frombuffer(m["weights"], np.float32), np.frombuffer(m["factors"], np.float32).reshape(-1, RANK), tuple(metadata))


def _texts(docs: DataFrame, metadata: Sequence[str], key: str, text: str) -> DataFrame:
    whole = F.array(*[F.col(f"`{m}`").cast("double") for m in metadata]).cast("array<double>")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), whole.alias("metadata"))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the chance of label 1.

    A null text is the empty one; it has its structure and its metadata, so it gets a score too. A null or non-finite metadata
    value counts as missing. Repeated rows and a null key give rows as they come; further columns are not read; an empty table
    gives no rows. Whole texts count, whatever their length.
    """
    told = _texts(docs, machine.metadata, key, text)
    kind = told.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [features(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("metadata").to_pylist())]
            if made:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_chance(raw_scores(machine, *_joined(made))))], ["doc_id", "score"])

    return told.mapInArrow(scored, f"doc_id {kind}, score double")
