"""Reading and writing result sets, event logs, articles and file fingerprints."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.relational import shuffled
from plumbline.functions.scalars import sha256_hex
from plumbline.operators.text import front_matter

WHOLE = 16 << 20  # longest file that is read as one row
CHUNK = 8 << 20
LONGEST_ROW = 1 << 30  # the same for files that Spark's text reader would unpack

#: Names of files that Spark's text reader unpacks.
PACKED = r"\.(gz|deflate|bz2|lz4|snappy|zst|passthrough)$"
MARK = b"\xef\xbb\xbf"  # the text reader leaves it out at the start of a file

#: Parsed statements that write although they are no commands yet.
WRITING_NODES = ("InsertIntoStatement", "CacheTable", "UncacheTable", "CreateTable", "CreateTableAsSelect", "ReplaceTable", "ReplaceTableAsSelect", "InsertIntoDir")


def check_output_names(df: DataFrame) -> DataFrame:
    """Refuse a result whose column names repeat (case-insensitive, as Spark resolves them)."""
    seen: set[str] = set()
    for name in df.columns:
        if name.lower() in seen:
            raise ValueError(f"duplicate output column {name!r}; use explicit aliases")
        seen.add(name.lower())
    return df


def sql_evidence(spark: SparkSession, query: str) -> tuple[DataFrame, DataFrame]:
    """A read-only query as a frame, with a one-row frame that describes it.

    The query is parsed before anything runs, and refused if any part of it is more than a query.
    """
    def refuse(node) -> None:
        if command.isInstance(node) or node.getClass().getSimpleName() in WRITING_NODES:
            raise ValueError("evidence queries must be a single SELECT")
        parts = node.children()
        for i in range(parts.size()):
            refuse(parts.apply(i))

    if not query.strip():
        raise ValueError("evidence queries must be a single SELECT")
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    refuse(spark._jsparkSession.sessionState().sqlParser().parsePlan(query))
    frame = check_output_names(spark.sql(query))
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields]
    about = spark.createDataFrame(
        [("sql", query, columns, dt.datetime.now(dt.timezone.utc).isoformat())], "kind string, query string, columns array<string>, started_at string")
    return frame, about


def bounded(df: DataFrame, limit: int = 5000, strict: bool = False) -> tuple[DataFrame, bool]:
    """First ``limit`` rows for a report and whether that is all of them; statistics never need this."""
    complete = df.limit(limit + 1).count() <= limit
    if strict and not complete:
        raise ValueError(f"more than {limit} rows; narrow the query")
    return df.limit(limit), complete


def table_metadata(spark: SparkSession, table: str) -> DataFrame:
    """Column names, types, nullability and the row count of a table or view."""
    frame = spark.table(table)
    columns = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(frame.schema.fields)],
        "position int, column string, type string, nullable boolean")
    return columns.withColumn("table", F.lit(table)).withColumn("rows", frame.agg(F.count(F.lit(1))).scalar())


def table_details(spark: SparkSession, table: str) -> DataFrame:
    """Size, partitioning, provider and view text of a catalog table, as the catalog reports them."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name != ''")


def read_table(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Any Spark source: ``parquet``, ``csv``, ``json``, ``jdbc``… with its own options."""
    return check_output_names(spark.read.format(source).options(**options).load())


def read_texts(spark: SparkSession, path: str, *columns: str, partitions: int | None = None) -> DataFrame:
    """Text columns of a parquet source, split as its row groups are.

    ``partitions`` spreads the rows of a source with few large row groups first, which shuffles all text.
    """
    frame = spark.read.parquet(path)
    frame = frame.select(*columns) if columns else frame
    return frame if partitions is None else frame.repartition(partitions)


def read_evidence(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, bool]:
    """Rows of a saved JSON result set and its ``complete`` flag. ``schema`` is the row schema."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(f"complete boolean, rows array<struct<{schema}>>")
    document = reader.json(path)
    complete = document.select(F.coalesce(F.bool_and("complete"), F.lit(False)) if "complete" in document.columns else F.lit(False)).first()[0]
    return check_output_names(document.select(F.inline("rows"))), bool(complete)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_evidence(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write once: an existing path, or a folder that a manifest seals, is refused."""
    spark = df.sparkSession
    scheme, bare = path.split("://", 1) if "://" in path else ("", path)
    start, parts = (f"{scheme}://" if scheme else ""), bare.rstrip("/").split("/")
    for depth in range(len(parts) - 1, 0, -1):  # the seal of any folder above counts
        parent = start + "/".join(parts[:depth])
        if parent and parent != start and path_exists(spark, f"{parent}/manifest.json"):
            raise ValueError(f"{parent} is sealed; write into a new folder")
    check_output_names(df).write.mode("errorifexists").format(fmt).save(path)


def parse_events(lines: DataFrame, line: str = "value", by: Sequence[str] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """Event rows of JSON lines, and per ``by`` the events and malformed lines. Blank lines are skipped.

    A line that is not a JSON object counts as malformed and stops nothing.
    """
    text = F.trim(F.col(line))
    parsed = lines.where(text != "").withColumn("event", F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text)))
    counts = parsed.groupBy(*by).agg(F.count("event").alias("events"), F.count_if(F.col("event").isNull()).alias("malformed_lines"))

    def at(pointer: str):
        return F.try_variant_get("event", pointer, "string")

    good = parsed.where("event is not null")
    events = good.select(
        *[c for c in lines.columns if c != line],
        F.coalesce(at("$.sessionId"), at("$.session_id")).alias("session_id"), at("$.type").alias("type"), at("$.timestamp").alias("timestamp"),
        F.to_json(F.try_variant_get("event", "$.message.content", "variant")).alias("content"))
    return events, counts


def scan_events_jsonl(spark: SparkSession, path: str, since_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tolerant JSON-lines scan of the files modified within ``since_days``."""
    reader = spark.read
    if since_days is not None:
        cutoff = dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=since_days)
        reader = reader.option("modifiedAfter", cutoff.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"), "value")
    return parse_events(lines)


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with their front matter split from the body."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return front_matter(files, "text")


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of files (path, length), ``CHUNK`` bytes in memory at a time."""
    import hashlib
    from urllib.parse import quote

    from pyarrow import fs
    for batch in batches:
        out = []
        for path, length in zip(*(batch.column(c).to_pylist() for c in ("path", "length"))):
            local = re.match(r"file:/*(/.*)", path, re.S)
            system, name = (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
            digest, seen = hashlib.sha256(), 0
            with system.open_input_stream(name, buffer_size=0, compression=None) as file:
                while body := file.read(CHUNK):
                    digest.update(body)
                    seen += len(body)
            if seen != length:
                raise OSError(f"{path} has {seen} bytes instead of {length}")
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(out, pa.string())], ["path", "length", "sha256"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of files from their lines (uri, length, value), which come file by file and in order."""
    import hashlib

    import pyarrow.compute as pc

    def told() -> pa.RecordBatch:
        left = length - seen  # a line end, a byte order mark, or both
        if left not in (0, 1, 3, 4):
            raise OSError(f"{uri} has {seen} bytes in lines instead of {length}")
        digest = digests[left >= 3]
        digest.update(b"\n" if left in (1, 4) else b"")
        return pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["uri", "sha256"])

    uri = None
    for batch in batches:
        runs, start = pc.run_end_encode(batch.column("uri")), 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            body = b"\n".join(batch.column("value").slice(start, end - start).to_pylist())
            if name == uri:
                body = b"\n" + body
            else:
                if uri is not None:
                    yield told()
                uri, length, seen, digests = name, batch.column("length")[start].as_py(), 0, (hashlib.sha256(), hashlib.sha256(MARK))
            for digest in digests:
                digest.update(body)
            seen, start = seen + len(body), end
    if uri is not None:
        yield told()


def _by_lines(spark: SparkSession, path: str, files: DataFrame, chosen: Column) -> DataFrame:
    """sha256 of the chosen files (uri, path, length) through Spark's text reader, which splits them at line ends whatever bytes they hold.

    The lines of a file meet in one task, in order; a task holds some of them, the longest line at least.
    """
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True).where(chosen).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"),
        F.col("value").cast("binary").alias("value"))
    ordered = lines.repartition("uri").sortWithinPartitions("uri", "block", "position").select("uri", "length", "value")
    digests = ordered.mapInArrow(_chain, "uri string, sha256 string")
    missing = F.raise_error(F.concat("path", F.lit(" has no lines"))).cast("string")
    return files.join(shuffled(digests), "uri", "left").select("path", "length", F.coalesce("sha256", missing).alias("sha256"))


def fingerprint(spark: SparkSession, path: str, whole_bytes: int = WHOLE) -> DataFrame:
    """sha256 of every file below a path, spread over the executors.

    Files of up to ``whole_bytes`` are read as rows by Spark. Longer ones are read piece by piece: files of a machine's own file system by pyarrow, others
    as lines by Spark's text reader, so a line can be as long as a row (2 GB). Packed files (by their names), which that reader would unpack, are rows of up to
    1 GB and pass through pyarrow beyond. The digest is a chain over the whole file, so the bytes of one file pass through one task however long it is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    through = "path string, length bigint, sha256 string"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        short = F.col("length") <= whole_bytes
        long = files.where(~short).select("path", "length").mapInArrow(_read_through, through)
    else:
        whole_bytes = max(whole_bytes, len(MARK))  # nothing but a mark has no line
        size, packed = F.col("_metadata.file_size"), F.col("_metadata.file_name").rlike(PACKED)  # by these Spark leaves out files before it opens them
        short = size <= F.when(packed, F.lit(max(whole_bytes, LONGEST_ROW))).otherwise(F.lit(whole_bytes))
        long = _by_lines(spark, path, files.where(~short & ~packed).select(F.col("_metadata.file_path").alias("uri"), "path", "length"), ~short & ~packed)
        long = long.unionByName(files.where(~short & packed).select("path", "length").mapInArrow(_read_through, through))
    return files.where(short).select("path", "length", sha256_hex("content").alias("sha256")).unionByName(long)


def verify_fingerprint(now: DataFrame, sealed: DataFrame) -> DataFrame:
    """Files added, missing or changed since sealing; no row means nothing changed."""
    both = now.select("path", F.col("sha256").alias("_n"), F.lit(None).cast("string").alias("_s")).unionByName(
        sealed.select("path", F.lit(None).cast("string").alias("_n"), F.col("sha256").alias("_s")))
    sides = both.groupBy("path").agg(F.max("_n").alias("now"), F.max("_s").alias("sealed"))
    change = F.when(F.col("sealed").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sealed"), "changed")
    return sides.withColumn("change", change).where("change is not null")
