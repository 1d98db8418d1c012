"""Near-duplicate groups of documents from SetSketch registers.

A document is the set of its distinct word shingles. Its sketch holds ``REGISTERS`` truncated minima on an
exponential scale: register i is floor(1 - log_b(e_i)) with e_i the smallest of the exponentially distributed
hashes of its shingles, so sketches of parts merge by taking maxima and equal registers are as likely as the sets are
similar. Bands of registers propose pairs, the joint maximum-likelihood estimate of the similarity drops those far below
the threshold, and every link is confirmed on the full sets.

Documents with equal sets are one node from the start. In a bucket all members are compared with one pivot,
the one that shares most bands; only buckets whose members are still in different components afterwards are compared among themselves, in tiles
of bounded size. A tile holds the full sets of its members, so what the likelihood lets through is confirmed where it is found, and a
tile tells no more links than join its components: a family just below the threshold leaves no pairs behind.

Chance of missing a pair at exactly 0.8: no common band (1 - 0.8^6)^48 < 1e-6, estimate six standard
deviations low 1e-9, for pairs with a pivot as inside families; it falls fast above, and a missed pair matters only
where no other path links the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import components, maybe_in
from plumbline.session import cut_lineage

BASE, RATE = 1.1, 20.0
BAND, BANDS = 6, 48
REGISTERS = BAND * BANDS
DEVIATIONS = 6  # what a pair may be estimated below the threshold
TILE = 1024
TILE_HASHES = 1 << 20  # shingles of one side of a tile, on average
FAN = 256
WORDS = 300_000  # cached word hashes of a worker


class Rules(NamedTuple):
    words: int = 5
    percent: int = 80


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
_RANDOM = np.random.default_rng(20240607)
_A = (_RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (UTF-8, A-Z lower-cased); empty without words."""
    found = (text or b"").lower().split()  # on bytes: A-Z, and \\x20 \\x09-\\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i])
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, one byte each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (_A * x[None, i:i + 1024] + _B).min(axis=1), out=low)
    e = -np.log1p(-(low + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, 255).astype(np.uint8)


def estimate(above: np.ndarray, below: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity from the registers that are larger and smaller, on a grid of 0.005."""
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :]
    top = np.minimum(u / v, v / u)
    def share(part: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(part, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best = np.empty(len(nx))
    for i in range(0, len(nx), 4096):
        s = slice(i, i + 4096)
        j = np.minimum(grid, top[s])
        more, less = share(u[s] - v[s] * j), share(v[s] - u[s] * j)
        equal = np.maximum(1 - more - less, 1e-12)
        a, b = above[s][:, None], below[s][:, None]
        value = a * np.log(np.maximum(more, 1e-12)) + b * np.log(np.maximum(less, 1e-12)) + (REGISTERS - a - b) * np.log(equal)
        best[s] = np.take_along_axis(j, value.argmax(axis=1)[:, None], 1)[:, 0]
    return best


def _floor(percent: int) -> float:
    t = percent / 100
    return t - DEVIATIONS * float(np.sqrt(t * (1 - t) / REGISTERS))


def _sketches(docs: DataFrame, rules: Rules) -> DataFrame:
    words = rules.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, sizes, marks, registers = batch.column(0), batch.column(1), [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                marks.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                registers.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "held", "n_shingles", "mark", "registers"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held bigint, n_shingles bigint, mark binary, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(i), F.substring("registers", i * BAND + 1, BAND)) for i in range(BANDS)]
    return nodes.select(F.posexplode(F.array(*keys)).alias("band", "key"), "node")


def _likely(pairs: DataFrame, nodes: DataFrame, rules: Rules) -> DataFrame:
    """Pairs (x, y) whose estimated similarity leaves the threshold possible."""
    floor, percent = _floor(rules.percent), rules.percent
    x = nodes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("registers").alias("rx"))
    y = nodes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("registers").alias("ry"))
    sized = pairs.join(x, "x").join(y, "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rx, ry = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("rx", "ry"))
            nx, ny = (b.column(c).to_numpy().astype(float) for c in ("nx", "ny"))
            good = estimate((rx > ry).sum(axis=1), (rx < ry).sum(axis=1), nx, ny) >= floor
            yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(good)), b.column("y").filter(pa.array(good))], ["x", "y"])

    return sized.select("x", "y", "nx", "ny", "rx", "ry").mapInArrow(run, "x bigint, y bigint")


def _name() -> Column:
    """Name of a row's text; as parts of a struct, null ids are equal."""
    return F.struct("doc_id", "held")


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """Pairs (x, y) with the size of their intersection (``both``) and whether full sets link them.

    The text of a node is that of one row, named by its id, which may be null, and the hash of its text.
    Partners of one x are split into groups of about ``FAN``; a task holds one x at a time.
    """
    words, percent = rules.words, rules.percent
    parts = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).alias("parts"))
    dealt = pairs.join(parts, "x").select("x", F.pmod(F.hash("y"), F.col("parts").cast("int")).alias("part"), "y")
    roles = dealt.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("node")).union(
        dealt.select("x", "part").distinct().select("x", "part", F.lit(0).alias("role"), F.col("x").alias("node")))
    named = cut_lineage(roles.join(nodes.select("node", _name().alias("key"), "mark"), "node"))
    held = docs.where(maybe_in(named, "key")(_name())).select(_name().alias("key"), "text").dropDuplicates(["key"])
    rows = named.join(held, "key").select("x", "part", "role", "node", "mark", "text").repartition("x", "part").sortWithinPartitions("x", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            xs, ys, shared, good = [], [], [], []
            for x, part, role, node, mark, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                found = shingles(text, words)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() != mark:
                    continue  # another text with the same hash under the same id
                if role == 0:
                    at, own = (x, part), found
                elif at == (x, part):
                    small, large = (own, found) if len(own) < len(found) else (found, own)
                    where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[where] == small).sum())
                    xs.append(x)
                    ys.append(node)
                    shared.append(both)
                    good.append(100 * both >= percent * (len(own) + len(found) - both))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (xs, ys, shared)), pa.array(good, pa.bool_())], ["x", "y", "both", "linked"])

    return rows.mapInArrow(run, "x bigint, y bigint, both bigint, linked boolean").distinct()


def _sets(members: DataFrame, nodes: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """``node, n, registers, hashes`` of the nodes of ``members``, with their full sets as bytes."""
    words = rules.words
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    named = cut_lineage(wanted.select("node", _name().alias("key"), "mark", "n", "registers"))
    held = docs.where(maybe_in(named, "key")(_name())).select(_name().alias("key"), "text").dropDuplicates(["key"])
    rows = named.join(held, "key").select("node", "n", "registers", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words) for t in b.column("text").to_pylist()]
            good = pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() == m for h, m in zip(found, b.column("mark").to_pylist())], pa.bool_())
            sets = pa.array([h.tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in (b.column("node"), b.column("n"), b.column("registers"), sets)], ["node", "n", "registers", "hashes"])

    return rows.mapInArrow(run, "node bigint, n bigint, registers binary, hashes binary")


def _numbered(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets one after another with their hashes numbered from 0, and where each starts."""
    starts = np.concatenate([[0], np.cumsum([len(x) // 8 for x in sets])])
    return np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1], starts


def _across(members: DataFrame, nodes: DataFrame, rules: Rules) -> DataFrame:
    """Likely pairs between different components of one bucket, from tiles of at most about 2 * ``TILE`` sketches.

    Where ``nodes`` has the full sets (``hashes``), the pairs are links confirmed on them, at most as many as join the components of a tile.

    Insiders share the pivot's component, and no two of them are compared, so they are not copied for each other:
    every block of insiders meets every block of outsiders, and blocks of outsiders meet among themselves.
    ``shared`` is the size of a member's intersection with the pivot, where that was counted: two members share no more
    than the smaller of their parts inside the pivot and the smaller of those outside. A pair is told in the first of its
    common bands only.
    """
    floor, percent = _floor(rules.percent), rules.percent
    inside = (F.col("component") == F.col("home")).cast("int")
    exact = "hashes" in nodes.columns
    held = members.join(nodes.select("node", "n"), "node")
    sized = held.groupBy("key").agg(F.sum(inside).alias("n_in"), F.sum(1 - inside).alias("n_out"), F.sum(inside * F.col("n")).alias("h_in"), F.sum((1 - inside) * F.col("n")).alias("h_out"))
    blocks = [F.greatest(F.ceil(F.col(f"n_{c}") / F.lit(TILE)), F.ceil(F.col(f"h_{c}") / F.lit(TILE_HASHES)), F.lit(1)).cast("int") for c in ("in", "out")]
    dealt = members.join(sized, "key").select("key", "band", "node", "component", "pivot", F.coalesce("shared", F.lit(-1)).alias("shared"), (inside == 1).alias("inside"), blocks[0].alias("ins"), blocks[1].alias("outs"))
    own = F.when(F.col("inside"), F.pmod(F.hash("node"), F.col("ins"))).otherwise(F.pmod(F.hash("node"), F.col("outs")))
    def tile(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    def each(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    among = F.filter(each("outs", lambda j: tile(1, F.least("own", j), F.greatest("own", j))), lambda t: t["i"] != t["j"])
    tiles = F.when(F.col("inside"), each("outs", lambda j: tile(0, F.col("own"), j))).otherwise(F.concat(each("ins", lambda i: tile(0, i, F.col("own"))), among))
    tiled = dealt.withColumn("own", own).select("key", "band", "node", "component", "pivot", "shared", "inside", "own", F.inline(tiles))
    rows = tiled.join(nodes.select("node", "n", "registers", *(["hashes"] if exact else [])), "node")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, kind, i, _ = (k.as_py() for k in key)
        node, comp, n, own, pivot = (group.column(c).to_numpy() for c in ("node", "component", "n", "own", "pivot"))
        inner, c, band = group.column("inside").to_numpy(), group.column("shared").to_numpy(), group.column("band")[0].as_py()
        regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        xs, ys = [], []
        if exact:
            comp, (words, at) = comp.copy(), _numbered(group.column("hashes").to_pylist())
            own_words = np.zeros(int(words.max()) + 1, bool)
        for a in np.flatnonzero(~inner):
            partner = (inner & (node != pivot)) if i else (inner & (node != pivot)) | (~inner & (node > node[a]))
            if kind:
                partner = (own > own[a])
            rest = np.flatnonzero(partner & (comp != comp[a]) & (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent))
            if c[a] >= 0:
                most = np.minimum(c[a], c[rest]) + np.minimum(n[a] - c[a], n[rest] - c[rest])
                rest = rest[(c[rest] < 0) | (100 * most >= percent * (n[a] + n[rest] - most))]
            if band and len(rest):
                earlier = (regs[a, :band * BAND] == regs[rest, :band * BAND]).reshape(len(rest), band, BAND).all(axis=2).any(axis=1)
                rest = rest[~earlier]
            if len(rest):
                more, less = (regs[a] > regs[rest]).sum(axis=1), (regs[a] < regs[rest]).sum(axis=1)
                good = rest[estimate(more, less, np.full(len(rest), float(n[a])), n[rest].astype(float)) >= floor]
                if exact and len(good):
                    own_words[words[at[a]:at[a + 1]]] = True
                    both = np.array([np.count_nonzero(own_words[words[at[r]:at[r + 1]]]) for r in good])
                    own_words[words[at[a]:at[a + 1]]] = False
                    good = good[100 * both >= percent * (n[a] + n[good] - both)]
                    # one link to each component that it joins; they are one from here on
                    reached, first = np.unique(comp[good], return_index=True)
                    good = good[first]
                    comp[np.isin(comp, reached)] = comp[a]
                xs += np.minimum(node[a], node[good]).tolist()
                ys += np.maximum(node[a], node[good]).tolist()
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return rows.groupBy("key", "kind", "i", "j").applyInArrow(run, "x bigint, y bigint").distinct()


def _placed(docs: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """Per row: ``doc_id``, ``held`` (hash of its text), ``n_shingles``, its ``component`` (null without a shingle) and the component's smallest id."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("held"), "text")
    rows = cut_lineage(_sketches(docs, rules))
    full = rows.where("mark is not null")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "held")).alias("row")
    sets = full.groupBy("mark").agg(row, F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    nodes = cut_lineage(sets.select(F.monotonically_increasing_id().alias("node"), "mark", "row.doc_id", "row.held", "n", "registers"))
    bands = _bands(nodes)
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = cut_lineage(bands.join(buckets, "key"))
    # the original of a family shares more bands with its copies than they do with each other, so it becomes their pivot
    weights = shared.groupBy("node").agg(F.sum("c").alias("weight"))
    weighed = shared.join(weights, "node")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("low"))).alias("top"))
    members = cut_lineage(weighed.join(pivots.select("key", (-F.col("top.low")).alias("pivot")), "key").drop("weight"))
    pairs = members.where("node != pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct()
    tested = cut_lineage(_confirm(cut_lineage(_likely(pairs, nodes, rules)), nodes, docs, rules))
    links = tested.where("linked").select("x", "y")
    labels = components(links)

    # buckets of three or more that the pivots did not bring together
    placed = members.where("c > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    home = placed.where("node = pivot").select("key", F.col("component").alias("home"))
    counted = tested.select(F.col("x").alias("pivot"), F.col("y").alias("node"), F.col("both").alias("shared"))
    open_members = placed.join(split, "key").join(home, "key").join(counted, ["pivot", "node"], "left")
    open_members = cut_lineage(open_members)
    more = cut_lineage(_across(open_members, cut_lineage(_sets(open_members, nodes, docs, rules)), rules))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = nodes.select("node", "mark", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = named.join(least, "component").select("mark", "component", "component_id")
    alone = rows.where("mark is null").select("doc_id", "held", "n_shingles", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id"))
    linked = full.select("doc_id", "held", "n_shingles", "mark").join(final, "mark").select("doc_id", "held", "n_shingles", "component", "component_id")
    return linked.unionByName(alone)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    A text of fewer words than a shingle is one shingle of all its words; a null, empty or wordless text has
    no shingle and is linked with nothing. Equal texts are linked. A null key takes part, as the largest id: its
    row is kept only where nothing with an id is alike, and then has a null component. Repeated rows give the
    same result each. Further columns of ``docs`` are not read.
    """
    placed = _placed(docs, key, text, rules).select("doc_id", "n_shingles", "component_id")
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with one text of each group: the one under the smallest id (null ids last), of several under it the one with the smallest hash.

    Rows are told apart by id and text, so near copies go although they have no id or share one with a text that stays. Rows that
    repeat both the id and the text of the one that stays stay with it, and so do all rows without a shingle. Columns stay as they came,
    whatever their names; an empty table stays empty.
    """
    placed = cut_lineage(_placed(docs, key, text, rules).select("doc_id", "held", "component"))
    first = placed.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "held")).alias("one"))
    kept = first.select("one.doc_id", "one.held").unionByName(placed.where("component is null").select("doc_id", "held").distinct())
    kept = kept.select(F.col("doc_id").alias("other"), F.col("held").alias("mark"))
    own = docs.select(F.col(f"`{key}`").alias("own"), F.xxhash64(F.col(f"`{text}`").cast("string").cast("binary")).alias("held"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stays = own.join(kept, F.col("own").eqNullSafe(F.col("other")) & F.col("held").eqNullSafe(F.col("mark")), "left_semi")
    return stays.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
