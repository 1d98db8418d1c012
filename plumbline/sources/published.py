"""File digests by byte ranges, and result sets that are published once under a manifest."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.scalars import sha256_hex
from plumbline.sources.evidence import check_output_names, path_exists, verify_fingerprint

RANGE = 8 << 20
FAN = 4_096  # range digests under one node
WHOLE = 256 << 20  # longest file that is read as one row


def _fold(digests: Column) -> Column:
    return sha256_hex(F.array_join(digests, "").cast("binary"))


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the byte ranges (path, offset, size) of files, one range in memory at a time."""
    import hashlib
    from urllib.parse import quote

    from pyarrow import fs
    for batch in batches:
        out = []
        for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size"))):
            local = re.match(r"file:/*(/.*)", path, re.S)
            system, name = (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
            with system.open_input_file(name) as file:
                body = file.read_at(size, offset)
            if len(body) != size:
                raise OSError(f"{path} ended at {offset + len(body)}, before {offset + size}")
            out.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), batch.column("i"), pa.array(out, pa.string())], ["path", "length", "i", "digest"])


def tree_fingerprint(spark: SparkSession, path: str, range_bytes: int = RANGE, whole_bytes: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of every file below a path, however long. Spark lists no empty files: one that was emptied counts as missing.

    The digest is that of a tree: sha256 of each range of ``range_bytes``, sha256 over the hex
    digests of every ``FAN`` ranges in order, sha256 over those. Files of up to ``whole_bytes`` are read as rows by Spark; the ranges
    of longer ones are dealt over all tasks and read through the file systems of pyarrow. Both give the same digest.
    """
    if not 0 < range_bytes <= whole_bytes <= FAN * range_bytes:
        raise ValueError("a file that is read whole must lie under one node")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ranges = F.ceil(F.col("length") / F.lit(range_bytes)).cast("int")
    each = F.transform(F.sequence(F.lit(0), ranges - 1), lambda i: sha256_hex(F.substring("content", i * range_bytes + 1, F.lit(range_bytes))))
    short = files.where(F.col("length") <= whole_bytes).select("path", "length", _fold(F.array(_fold(each))).alias("sha256"))

    start = F.col("i").cast("bigint") * range_bytes
    long = files.where(F.col("length") > whole_bytes).select("path", "length", F.explode(F.sequence(F.lit(0), ranges - 1)).alias("i"))
    long = long.select("path", "length", "i", start.alias("offset"), F.least(F.lit(range_bytes), F.col("length") - start).alias("size"))
    dealt = long.repartition(4 * spark.sparkContext.defaultParallelism, "path", "i")
    digests = dealt.mapInArrow(_read_ranges, "path string, length bigint, i int, digest string")

    def ordered(at: str, digest: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(at, digest))), lambda x: x[digest])
    nodes = digests.groupBy("path", "length", F.floor(F.col("i") / F.lit(FAN)).alias("node")).agg(_fold(ordered("i", "digest")).alias("digest"))
    return short.unionByName(nodes.groupBy("path", "length").agg(_fold(ordered("node", "digest")).alias("sha256")))


def _manifest(spark: SparkSession, folder: str) -> dict:
    name = f"{folder}/manifest.json"
    if not path_exists(spark, name):
        raise ValueError(f"{folder} is not published")
    try:
        return json.loads(spark.read.text(name, wholetext=True).first()[0])
    except (ValueError, TypeError):
        raise ValueError(f"the manifest of {folder} is incomplete") from None


def _create(spark: SparkSession, name: str, text: str) -> None:
    """A file that must not exist yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    if path_exists(spark, name):
        raise ValueError(f"{name} exists")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _inventory(spark: SparkSession, folder: str, name: str) -> DataFrame:
    files = tree_fingerprint(spark, f"{folder}/set-{name}")
    return files.select(F.substring_index("path", f"/set-{name}/", -1).alias("path"), "length", "sha256")


def _summary(files: DataFrame) -> dict:
    """Count, bytes and one digest of a file list in any order: the words of its lines' sha256, each folded with exclusive or."""
    line = sha256_hex(F.to_json(F.struct("path", "length", "sha256")).cast("binary"))
    words = [F.hex(F.bit_xor(F.conv(F.substring(line, 8 * i + 1, 8), 16, 10).cast("bigint"))) for i in range(8)]
    row = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.concat_ws("-", *words).alias("digest")).first()
    return row.asDict()


def publish(df: DataFrame, folder: str, fmt: str = "parquet") -> dict:
    """Write a result set so that it is readable only when it is whole, and only once. Gives the manifest.

    Every writer fills a set folder of its own, then a table with the length and digest of every file of it, and last the manifest, which
    names the set; its size does not grow with the data. The manifest is created only where none exists, which is the file system's
    promise (a local disk only looks first), and read back: of two writers one fails, and its set is never read.
    """
    spark = df.sparkSession
    if path_exists(spark, f"{folder}/manifest.json"):
        raise ValueError(f"{folder} is published; write into a new folder")
    name = uuid.uuid4().hex
    check_output_names(df).write.format(fmt).save(f"{folder}/set-{name}")
    _inventory(spark, folder, name).write.parquet(f"{folder}/files-{name}")
    files = spark.read.parquet(f"{folder}/files-{name}")
    said = {"set": name, "format": fmt, "schema": df.schema.jsonValue(), **_summary(files)}
    try:
        _create(spark, f"{folder}/manifest.json", json.dumps(said))
    except Exception as problem:
        if not path_exists(spark, f"{folder}/manifest.json"):
            raise
        raise ValueError(f"{folder} was published by another writer") from problem
    if _manifest(spark, folder)["set"] != name:
        raise ValueError(f"{folder} was published by another writer")
    return said


def published_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a published set added, missing or changed since; the file list itself must be the one the manifest sealed."""
    manifest = _manifest(spark, folder)
    sealed = spark.read.parquet(f"{folder}/files-{manifest['set']}")
    if _summary(sealed) != {k: manifest[k] for k in ("files", "bytes", "digest")}:
        raise ValueError(f"the file list of {folder} is not the one its manifest sealed")
    return verify_fingerprint(_inventory(spark, folder, manifest["set"]), sealed)


def read_published(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame:
    """Rows of a published set with the schema of its manifest; with ``verify`` every file is held against its digest first."""
    manifest = _manifest(spark, folder)
    if verify:
        changed = published_changes(spark, folder)
        some = [f"{r['path']} {r['change']}" for r in changed.orderBy("path").select("path", "change").limit(5).collect()]
        if some:
            raise ValueError(f"{folder} changed since it was published: {'; '.join(some)}")
    return spark.read.format(manifest["format"]).schema(StructType.fromJson(manifest["schema"])).load(f"{folder}/set-{manifest['set']}")
