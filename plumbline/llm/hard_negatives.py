"""Hard-negative mining by shared candidate lists per cluster of anchors.

Every row lies in the cone of its nearest pivot, rows of a cone in blocks of about ``BLOCK``. Anchors that share a pivot form a
cluster. In a block, a cluster sorts the candidates once by an upper bound of the inner product that holds for all its
members: the candidate's length times the cosine of its angle to the cluster's centre, less the angle of the cluster's widest
member. Every member walks that one list in steps and stops as soon as its own length times the next bound
lies below what it already has: nothing further down can be among its best. The walk is exact, whatever the pivots.

Members first walk the blocks of their own cone. The best they find there is a floor that cones, blocks and lists
must reach in the second walk, so far cones are left out by one bound each. Two such searches make the result: the
nearest rows of the anchor's own label, then for every such positive the best rows of other labels inside its window of scores.

Scores are integers: components are floors of ``scale`` times the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.relational import shuffled
from plumbline.llm.graph import stored

PIVOTS = 64
BLOCK = 4_096  # candidates of a block
CHUNK = 512  # members that travel together
STEP = 256  # candidates of a step down the list
ROOM = 1 << 13  # places of a block, in the low bits of a key (score, place)
LONGEST = float(1 << 24)  # greatest integer length of a vector, so that a key fits a long
NONE = np.iinfo(np.int64).min


class Settings(NamedTuple):
    """Positives per anchor, negatives per positive, and the window of a negative's score in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 5
    scale: int = 256
    low: int = 80
    high: int = 100


class Cones(NamedTuple):
    """Unit directions with, per cone, the greatest angle and length of its rows and the number of its blocks."""

    directions: np.ndarray
    angle: np.ndarray
    length: np.ndarray
    blocks: np.ndarray


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(vectors: list, width: int, scale: int) -> np.ndarray:
    """Rows of whole numbers (as doubles, which hold them exactly), shorter vectors filled up with zeros."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    x = np.floor(x * scale)
    if len(x) and np.sqrt((x * x).sum(axis=1)).max() >= LONGEST:
        raise ValueError(f"a vector longer than {LONGEST / scale} has no exact score here")
    return x


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def _angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def _bound(length: np.ndarray, angle: np.ndarray, slack: float | np.ndarray) -> np.ndarray:
    """Upper bound of the inner product with any unit vector within ``slack`` of where ``angle`` is measured from."""
    return length * np.cos(np.minimum(np.pi, np.maximum(0, angle - slack)))


def _reaches(bound: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Is the bound, with room for rounding, at least what is needed?"""
    return bound + np.abs(bound) * 1e-6 + 1e-3 >= needed


def walk(asks: dict[str, np.ndarray], block: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Best keys (asks x k, falling) of the block for every ask; ``NONE`` where there are fewer.

    A key is score * ROOM + ROOM - 1 - place, places following the candidates' ids, so ties go to the smaller id.
    """
    best = np.full((len(asks["x"]), k), NONE)
    units, length = _units(asks["x"])
    for cone in np.unique(asks["pivot"]):
        members = np.flatnonzero(asks["pivot"] == cone)
        middle = units[members].sum(axis=0)
        middle /= np.sqrt((middle * middle).sum()) or 1.0
        slack = float(_angles(units[members], middle).max()) + 1e-7
        bounds = _bound(block["length"], _angles(block["units"], middle), slack)
        shared = np.argsort(-bounds, kind="stable")
        needed = asks["floor"][members].astype(float)
        for at in range(0, len(shared), STEP):
            alive = _reaches(length[members] * bounds[shared[at]], needed)  # a bound below 0 counts for members of any length
            if not alive.any():
                break
            members, needed = members[alive], needed[alive]
            step = shared[at:at + STEP]
            score = asks["x"][members] @ block["x"][step].T
            fits = (asks["low"][members][:, None] <= score) & (score <= asks["high"][members][:, None])
            fits &= (asks["label"][members][:, None] == block["label"][step][None, :]) == asks["same"][members][:, None]
            fits &= asks["id"][members][:, None] != block["id"][step][None, :]
            keys = np.where(fits, score.astype(np.int64) * ROOM + (ROOM - 1 - block["place"][step])[None, :], NONE)
            both = np.concatenate([best[members], keys], axis=1)
            best[members] = _top(both, k)
            last = best[members][:, -1]
            needed = np.maximum(needed, np.where(last == NONE, -np.inf, (last // ROOM).astype(float)))
    return best


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:], axis=1)[:, ::-1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.int32) for x in column]).astype(float) if len(column) else np.zeros((0, width))


def _names(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)


def _cast(table: pa.Table, kind: str) -> pa.Array:
    return table.column(kind).combine_chunks()


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _placed(rows: DataFrame, directions: np.ndarray, width: int, scale: int) -> DataFrame:
    """Rows as integers with their cone, their angle to its pivot and their length."""
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v").to_pylist(), width, scale)
            units, length = _units(x)
            near = units @ directions.T
            cone = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cone], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array(cone.astype(np.int32)), pa.array(angle), pa.array(length)],
                ["id", "label", "anchor", "x", "pivot", "angle", "length"])
    return rows.mapInArrow(place, f"id {kind}, label bigint, anchor boolean, x binary, pivot int, angle double, length double")


def _blocks(placed: DataFrame, cones: Cones) -> DataFrame:
    kind = placed.schema["id"].dataType.simpleString()
    salts = F.get(F.lit(cones.blocks.tolist()), F.col("pivot"))
    salted = placed.select("id", "label", "x", "pivot", F.pmod(F.xxhash64("id", "label", "x"), salts).cast("int").alias("salt"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("label", "ascending"), ("x", "ascending")])
        x = b"".join(group.column("x").to_pylist())
        return pa.table({"pivot": group.column("pivot").slice(0, 1), "salt": group.column("salt").slice(0, 1), "ids": _one(_cast(group, "id")), "labels": _one(_cast(group, "label")), "xs": pa.array([x], pa.binary())})
    return salted.groupBy("pivot", "salt").applyInArrow(pack, f"pivot int, salt int, ids array<{kind}>, labels array<bigint>, xs binary")


def _found(asks: DataFrame, blocks: DataFrame, cones: Cones, width: int, k: int, own: bool) -> DataFrame:
    """(name, slot, other, score): the ``k`` best of every block that an ask walks: blocks of its own cone, or all others it may need."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    counts = {r["pivot"]: r["n"] for r in asks.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counts.get(p, 0) for p in range(len(cones.blocks))], np.int64)
    start = F.get(F.lit((np.cumsum(sizes) - sizes).tolist()), F.col("pivot"))
    spread = F.pmod(F.xxhash64("name", "slot"), F.greatest(F.get(F.lit(sizes.tolist()), F.col("pivot")), F.lit(1)))
    chunked = asks.withColumn("chunk", F.floor((start + spread) / CHUNK).cast("int"))
    filled = np.flatnonzero(cones.blocks)

    def reach(pivots: np.ndarray, x: np.ndarray, floors: np.ndarray, cone: int) -> np.ndarray:
        if own:
            return pivots == cone
        units, length = _units(x)
        bound = length * _bound(cones.length[cone], _angles(units, cones.directions[cone]), cones.angle[cone] + 1e-7)
        return (pivots != cone) & _reaches(bound, floors)

    def pack(group: pa.Table) -> pa.Table:
        x = _matrix(_cast(group, "x"), width)
        pivots, floors = group.column("pivot").to_numpy(), group.column("floor").to_numpy()
        meets = [{"pivot": int(c), "salt": s} for c in filled if reach(pivots, x, floors, c).any() for s in range(cones.blocks[c])]
        lists = {f"{c}s": _one(_cast(group, c)) for c in ("name", "slot", "id", "label", "pivot", "same", "low", "high", "floor")}
        return pa.table({**lists, "x": pa.array([x.astype(np.int32).tobytes()], pa.binary()), "meets": pa.array([meets], pa.list_(pa.struct([("pivot", pa.int32()), ("salt", pa.int32())])))})

    packed = chunked.groupBy("chunk").applyInArrow(pack, (
        f"names array<bigint>, slots array<int>, ids array<{kind}>, labels array<bigint>, pivots array<int>, sames array<boolean>, lows array<bigint>, "
        "highs array<bigint>, floors array<double>, x binary, meets array<struct<pivot:int,salt:int>>"))
    sent = packed.select(F.explode("meets").alias("m"), F.struct(*[c for c in packed.columns if c != "meets"]).alias("asks")).select("m.pivot", "m.salt", "asks")
    met = shuffled(sent).join(shuffled(blocks), ["pivot", "salt"]).select("pivot", "asks", "ids", "labels", "xs")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                told = b.column("asks")[r]
                asks = {c: _names(told[f"{c}s"].values) for c in ("name", "slot", "id", "label", "pivot", "same", "low", "high", "floor")}
                asks["x"] = np.frombuffer(told["x"].as_py(), np.int32).reshape(-1, width).astype(float)
                mine = np.flatnonzero(reach(asks["pivot"], asks["x"], asks["floor"], b.column("pivot")[r].as_py()))
                asks = {c: a[mine] for c, a in asks.items()}
                ids = b.column("ids")[r].values
                x = np.frombuffer(b.column("xs")[r].as_py(), np.int32).reshape(-1, width).astype(float)
                units, length = _units(x)
                block = {"x": x, "units": units, "length": length, "id": _names(ids), "label": b.column("labels")[r].values.to_numpy(), "place": np.arange(len(x))}
                best = walk(asks, block, k)
                row, at = np.nonzero(best != NONE)
                key = best[row, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks["name"][row].astype(np.int64)), pa.array(asks["slot"][row].astype(np.int32)), ids.take(pa.array(ROOM - 1 - key % ROOM)), pa.array(key // ROOM)],
                    ["name", "slot", "other", "score"])
    return met.mapInArrow(walked, f"name bigint, slot int, other {kind}, score bigint")


def _nearest(asks: DataFrame, blocks: DataFrame, cones: Cones, width: int, k: int) -> DataFrame:
    """(name, slot, rank, other, score) of the ``k`` best per ask: its own cone first, then whatever can still reach what was found there."""
    order = Window.partitionBy("name", "slot").orderBy(F.desc("score"), "other")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = stored(top(_found(asks, blocks, cones, width, k, own=True)))
    kth = near.where(F.col("rank") == k).select(F.col("name").alias("_n"), F.col("slot").alias("_s"), F.col("score").cast("double").alias("_f"))
    raised = asks.join(shuffled(kth), (F.col("name") == F.col("_n")) & (F.col("slot") == F.col("_s")), "left").withColumn("floor", F.greatest("floor", F.coalesce("_f", "floor"))).drop("_n", "_s", "_f")
    far = _found(stored(raised), blocks, cones, width, k, own=False)
    return top(near.drop("rank").unionByName(far))


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds.

    An anchor's positives are its best other rows of the same label; a positive's negatives are the best rows of other labels
    with ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score. Ties go to the smaller id.

    Rows with a null id or label, or a null vector or one with null or non-finite components, take no part; a null in ``anchors`` is
    false. Rows equal in id, label and vector count once; different rows under one id are rows each, and none of them is a
    candidate of an anchor with that id. Shorter vectors, empty ones too, count as filled up with zeros.
    Empty tables give no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                          F.coalesce(anchors, F.lit(False)).alias("anchor")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint"
    # one vector per bucket of hashes: copies share a bucket, so a vector with very many of them is one pivot
    drawn = rows.withColumn("h", F.xxhash64("v")).groupBy(F.pmod("h", F.lit(PIVOTS)).alias("bucket")).agg(F.min_by("v", F.struct("h", "v")).alias("v"), F.max(F.size("v")).alias("width")).orderBy("bucket").collect()
    width = max((r["width"] for r in drawn), default=0)
    if not width:
        return spark.createDataFrame([], out)
    directions = _units(integers([r["v"] for r in drawn], width, settings.scale))[0]
    placed = stored(_placed(rows.distinct(), directions, width, settings.scale))
    shape = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.max("length").alias("length")).collect()}
    known = [shape.get(p) for p in range(len(directions))]
    cones = Cones(directions, np.array([r["angle"] if r else 0.0 for r in known]), np.array([r["length"] if r else 0.0 for r in known]), np.array([-(-r["n"] // BLOCK) if r else 0 for r in known], np.int64))
    blocks = stored(_blocks(placed, cones))
    far = 1 << 52
    chosen = placed.where("anchor").select(F.xxhash64("id", "label", "x").alias("name"), "id", "label", "x", "pivot")
    first = chosen.select("*", F.lit(0).alias("slot"), F.lit(True).alias("same"), F.lit(-far).cast("bigint").alias("low"), F.lit(far).cast("bigint").alias("high"), F.lit(float("-inf")).alias("floor"))
    positives = stored(_nearest(first, blocks, cones, width, settings.positives))
    least = F.ceil(F.col("score").cast("decimal(20,0)") * settings.low / 100).cast("bigint")
    most = F.floor(F.col("score").cast("decimal(20,0)") * settings.high / 100).cast("bigint")
    windows = positives.select("name", F.col("rank").alias("slot"), least.alias("low"), most.alias("high")).where("low <= high")
    second = stored(windows.join(shuffled(chosen), "name").select("*", F.lit(False).alias("same"), F.col("low").cast("double").alias("floor")))
    negatives = _nearest(second, blocks, cones, width, settings.negatives).withColumnRenamed("slot", "_slot")
    told = positives.select(F.col("name").alias("_name"), F.col("rank").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chosen.select(F.col("name").alias("_anchor"), F.col("id").alias("anchor_id"))
    both = negatives.join(shuffled(told), (F.col("name") == F.col("_name")) & (F.col("_slot") == F.col("slot"))).join(shuffled(named), F.col("name") == F.col("_anchor"))
    return both.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
