"""Approximate nearest neighbours by inner product with a permutation index.

A vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in order. In a block of vectors every pivot has an inverted
file with the vectors that have the pivot in their prefix and the place it takes there: ``PREFIX / PIVOTS`` of the block on average. A
query reads the files of its own prefix pivots only, ranks the block by the footrule distance of the prefixes (a pivot outside
a prefix counts as just behind it), and reranks the best share of it by the exact inner product.

Equal vectors are indexed once, with their k + 1 smallest ids and how often each occurs: no query can return more of
them, however many copies there are. They become rows again after the rerank.

Inner products are turned into nearness by the usual extra coordinate that makes all vectors equally long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.graph import stored

PIVOTS = 2_048
PREFIX = 64
BLOCK = 8_192  # distinct vectors
CHUNK = 1_024  # queries searched together
SLICE = 512  # vectors whose nearness to all pivots is in memory at once
SHARE = 0.12  # part of a block that is reranked
LEAST = 256  # vectors of a block that are reranked at least


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components and with one that isn't zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width)), 0
    for i, n in enumerate(sizes):
        out[i, :n], at = flat[at:at + n], at + n
    return out


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int, longest: float | None) -> np.ndarray:
    """The ``size`` nearest pivots of every vector, nearest first (vectors x size)."""
    out = np.empty((len(x), size), np.int32)
    for i in range(0, len(x), SLICE):
        part = x[i:i + SLICE]
        near = part @ pivots[:, :-1].T
        if longest is not None:
            near += np.sqrt(np.maximum(longest ** 2 - (part * part).sum(axis=1), 0))[:, None] * pivots[None, :, -1]
        some = np.sort(np.argpartition(-near, size - 1, axis=1)[:, :size], axis=1)
        order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[i:i + SLICE] = np.take_along_axis(some, order, 1)
    return out


def inverted(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of a block: where each pivot's file starts (and the last one ends), the vectors, and their places."""
    flat = order.ravel()
    at = np.argsort(flat, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))]).astype(np.int32)
    return starts, (at // order.shape[1]).astype(np.int32), (at % order.shape[1]).astype(np.int32)


def _kinds(base: DataFrame, k: int, width: int) -> DataFrame:
    """Every distinct vector ``v``, filled up with zeros, with ``ids``: its k + 1 smallest ids in order, each with its rows ``c`` up to k.

    A query leaves out one id at most, so what stays is enough for k rows.
    """
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    counted = base.select("id", filled.alias("v")).groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("c"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "c"))).alias("ids"))


def search(base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found per query, ties to the smaller id.

    Takes no account of rows with a null id or an unusable vector, neither as query nor as candidate; rows with the
    query's own id aren't its candidates. Shorter vectors count as filled up with zeros. Repeated rows are candidates each.
    Empty tables give no rows; further columns are not read.
    """
    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, queries = rows(base), rows(queries)
    kind = base.schema["id"].dataType.simpleString()
    shape = base.agg(F.max(F.size("v")).alias("width"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    out = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not shape["width"] or not asked["n"]:
        return base.sparkSession.createDataFrame([], out)
    width, longest = max(shape["width"], asked["width"]), shape["longest"]
    kinds = stored(_kinds(base, k, width))
    drawn = kinds.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()
    pivots = np.zeros((len(drawn), width + 1))
    for i, r in enumerate(drawn):
        pivots[i, :width] = r["v"]
    pivots[:, -1] = np.sqrt(np.maximum(longest ** 2 - (pivots * pivots).sum(axis=1), 0))
    prefix = min(PREFIX, -(-len(pivots) // 2))
    blocks, chunks = -(-kinds.count() // BLOCK), -(-asked["n"] // CHUNK)

    def index(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v").combine_chunks(), width)
        starts, posted, placed = inverted(prefixes(x, pivots, prefix, longest), len(pivots))
        lists = group.column("ids").combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()).astype(np.int32), lists.flatten()
        return pa.table({"block": group.column("block").slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.field("id")),
                         "times": pa.array([flat.field("c").to_numpy().astype(np.int32).tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                         "vectors": pa.array([x.tobytes()], pa.binary()), "starts": pa.array([starts.tobytes()], pa.binary()),
                         "posted": pa.array([posted.tobytes()], pa.binary()), "placed": pa.array([placed.tobytes()], pa.binary())})

    def chunk(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks()
        return pa.table({"q_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "q_vectors": pa.array([_matrix(group.column("v").combine_chunks(), width).tobytes()], pa.binary())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, ids = batch.column("q_ids")[r].values, batch.column("ids")[r].values
                q = np.frombuffer(batch.column("q_vectors")[r].as_py()).reshape(-1, width)
                x = np.frombuffer(batch.column("vectors")[r].as_py()).reshape(-1, width)
                times, sizes, starts, posted, placed = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in ("times", "sizes", "starts", "posted", "placed"))
                ends = np.cumsum(sizes)
                view = prefixes(q, pivots, prefix, None)
                names = np.array(ids.to_pylist(), dtype=object) if not pa.types.is_integer(ids.type) else ids.to_numpy()
                single, first = sizes == 1, names[ends - sizes]
                found = ([], [], [])
                for i, who in enumerate(own.to_pylist()):
                    # the footrule distance is a constant less twice the sum, over shared pivots, of what the larger place leaves of the prefix
                    files = [slice(starts[p], starts[p + 1]) for p in view[i]]
                    larger = np.concatenate([np.maximum(placed[f], place) for place, f in enumerate(files)])
                    far = -np.bincount(np.concatenate([posted[f] for f in files]), prefix - larger, len(x))
                    rest = np.flatnonzero(~(single & (first == who)))  # vectors that not only the query's own id has
                    take = min(len(rest), max(LEAST, k + 1, int(np.ceil(share * len(x)))))
                    if not take:
                        continue
                    near = far[rest]
                    best = rest[near <= np.partition(near, take - 1)[take - 1]]
                    score = (x[best] * q[i]).sum(axis=1)
                    if len(best) > k:
                        on = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        best, score = best[on], score[on]
                    at = np.concatenate([np.arange(ends[b] - sizes[b], ends[b]) for b in best])
                    score = np.repeat(score, sizes[best])
                    other = names[at] != who
                    at, score = at[other], score[other]
                    at, score = np.repeat(at, times[at]), np.repeat(score, times[at])
                    order = np.lexsort((names[at], -score))[:k]
                    found[0].extend([i] * len(order))
                    found[1].extend(at[order].tolist())
                    found[2].extend(score[order].tolist())
                yield pa.RecordBatch.from_arrays([own.take(pa.array(found[0], pa.int64())), ids.take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    built = kinds.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(
        index, f"block int, ids array<{kind}>, times binary, sizes binary, vectors binary, starts binary, posted binary, placed binary")
    asking = queries.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int")).groupBy("chunk").applyInArrow(chunk, f"q_ids array<{kind}>, q_vectors binary")
    met = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "q_ids", "q_vectors").join(built, "block")
    near = met.select("q_ids", "q_vectors", "ids", "times", "sizes", "vectors", "starts", "posted", "placed").mapInArrow(find, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
