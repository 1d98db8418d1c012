"""WARC records and the resolution of not-modified revisits.

A revisit record says that the server answered 304 to a conditional request. Resolving it is an as-of join: by
canonical URL, the latest full response captured before. The validators decide whether that response is the one the
server meant, and its headers are updated with those of the 304 that may be merged.

The join sorts (URL, time, record) by range, which spreads a URL that holds a third of all records over many partitions,
looks back inside each partition, and hands the last response of a URL from partition to partition in a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

CRLF = "\r\n"
#: Headers of a stored response that a 304 must not change: they describe the body or the connection.
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that only track where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid|sid)(=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Key of a URL: no scheme, user, ``www``, default port, fragment, tracking parameter or trailing slash; host in lower case, query sorted.

    Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    whole = F.regexp_extract(bare, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(whole), "^.*@", ""), ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _block(first: Column, headers: Column) -> Column:
    return F.concat(first, F.lit(CRLF), F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF))), ""), F.lit(CRLF))


def pair(name: str, value: Column | str) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def write_records(rows: DataFrame) -> DataFrame:
    """``record``: the WARC/1.1 text of rows (record_id, kind, uri, at, status, headers, body); other columns stay behind.

    ``kind`` is ``response`` or ``revisit``. A null body is an empty block, a null URI an empty header, a null status an empty one; a null date has no header.
    """
    body = F.coalesce("body", F.lit(""))
    http = F.concat(_block(F.concat(F.lit("HTTP/1.1 "), F.coalesce(F.col("status").cast("string"), F.lit(""))), F.coalesce("headers", F.array().cast(HEADERS))), body)
    revisit = F.col("kind") == "revisit"
    warc = F.array(
        pair("WARC-Type", F.col("kind")), pair("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        pair("WARC-Target-URI", F.coalesce("uri", F.lit(""))), pair("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        pair("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/server-not-modified").otherwise("")),
        pair("WARC-Payload-Digest", F.when(revisit, "").otherwise(F.concat(F.lit("sha256:"), F.sha2(body, 256)))),
        pair("Content-Type", "application/http"), pair("Content-Length", F.octet_length(http).cast("string")))
    filled = F.filter(warc, lambda h: h["value"] != "")
    return rows.select(F.concat(_block(F.lit("WARC/1.1"), filled), http, F.lit(CRLF + CRLF)).alias("record"))


def header(headers: Column, name: str) -> Column:
    """First value of a header, whatever its case; null without one."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def _headers(block: Column) -> Column:
    named = F.filter(F.split(block, CRLF), lambda x: F.contains(x, F.lit(":")))
    return F.transform(named, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))


def read_records(records: DataFrame, record: str = "record") -> DataFrame:
    """The fields of WARC records again: record_id, kind, uri, at, status, headers, payload_digest, body. No record, no row.

    A record that was cut off or holds no HTTP block keeps what can be read of it; the other fields are null, the date too where it is no date.
    """
    r = F.col(f"`{record}`")
    split = records.where(r.isNotNull()).select(r.alias("r"), F.instr(r, CRLF + CRLF).alias("a")).where("a > 0")
    split = split.select(F.substring("r", F.lit(1), F.col("a") - 1).alias("warc"), F.substring("r", F.col("a") + 4, F.length("r")).alias("http"))
    split = split.select("warc", "http", F.instr("http", CRLF + CRLF).alias("b"), _headers(F.col("warc")).alias("w"))
    http = F.substring("http", F.lit(1), F.col("b") - 1)
    return split.select(
        F.regexp_extract(header(F.col("w"), "WARC-Record-ID"), "<urn:record:(.*)>", 1).alias("record_id"), header(F.col("w"), "WARC-Type").alias("kind"),
        F.coalesce(header(F.col("w"), "WARC-Target-URI"), F.lit("")).alias("uri"), F.try_to_timestamp(header(F.col("w"), "WARC-Date")).alias("at"),
        F.regexp_extract(http, r"^HTTP/[0-9.]+ (\d+)", 1).try_cast("int").alias("status"), _headers(http).alias("headers"),
        header(F.col("w"), "WARC-Payload-Digest").alias("payload_digest"),
        F.substring("http", F.col("b") + 4, F.length("http") - F.col("b") - 7).alias("body"))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Headers of the stored response, with those of the 304 that may be merged in place of, or behind, them."""
    allowed = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(FIXED_HEADERS))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: ``record_id, uri, at, state, source_id, headers, payload_digest``.

    The candidate is the latest response with status 200 of the same canonical URL strictly before the revisit (ties: the
    larger record id). ``state`` is ``resolved``; ``no earlier response``; or ``validator mismatch`` when entity
    tags (weak comparison) differ or, where one side lacks a tag, the modification dates differ or are missing. Unresolved
    revisits keep their own headers and have no source. An empty or null URI, or a null time, finds no response. Repeated
    records are resolved each; further columns are not read.
    """
    keyed = records.select("record_id", "kind", "uri", canonical_url(F.col("uri")).alias("url"), "at", "headers", "payload_digest", (F.col("status") == 200).alias("full"))
    keyed = keyed.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & F.col("full")))
    keyed = keyed.withColumn("rank", F.when(F.col("kind") == "revisit", 0).otherwise(1))  # a revisit looks strictly before its own time
    keyed = cut_lineage(keyed)  # the range sort samples its input, which must not read all records again for that
    ordered = keyed.repartitionByRange("url", "at", "rank", "record_id").withColumn("part", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    can_match = (F.col("url") != "") & F.col("at").isNotNull()
    response = F.when((F.col("rank") == 1) & can_match, F.struct("record_id", "headers", "payload_digest"))
    here = Window.partitionBy("part", "url").orderBy("at", "rank", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    tails = ordered.where((F.col("rank") == 1) & can_match).groupBy("url", "part").agg(F.max_by(F.struct("record_id", "headers", "payload_digest"), F.struct("at", "record_id")).alias("tail"))
    spans = ordered.select("url", "part").distinct().join(tails, ["url", "part"], "left")
    carried = spans.withColumn("carry", F.last("tail", ignorenulls=True).over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    looked = ordered.withColumn("near", F.last(response, ignorenulls=True).over(here)).where("rank = 0")
    looked = looked.join(carried.where("carry is not null").select("url", "part", "carry"), ["url", "part"], "left")
    found = looked.withColumn("source", F.when(can_match, F.coalesce("near", "carry")))
    mine, theirs = (header(F.col(c), "ETag") for c in ("headers", "source.headers"))
    mine_date, theirs_date = (header(F.col(c), "Last-Modified") for c in ("headers", "source.headers"))
    agree = F.coalesce(_weak(mine) == _weak(theirs), mine_date == theirs_date, F.lit(False))
    state = F.when(F.col("source").isNull(), "no earlier response").when(agree, "resolved").otherwise("validator mismatch")
    done = found.withColumn("state", state)
    ok = F.col("state") == "resolved"
    return done.select(
        "record_id", "uri", "at", "state", F.when(ok, F.col("source.record_id")).alias("source_id"),
        F.when(ok, merge_headers(F.col("source.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("source.payload_digest")).alias("payload_digest"))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their source; record ids are unique."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("source_id"), "body")
    return resolved.join(bodies, "source_id", "left")


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture history of web pages: each page as a full response, and a conditional request for it before and after.

    The later request carries the page's own validators, the earlier one can only meet another capture of the same URL.
    """
    html = F.coalesce("html", F.lit(""))
    tag, day = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.date_format(F.timestamp_seconds(F.col("page_id")), "yyyy-MM-dd")
    full = F.array(pair("Content-Type", "text/html; charset=utf-8"), pair("Content-Length", F.octet_length(html).cast("string")), pair("ETag", tag), pair("Last-Modified", day), pair("Age", "0"))
    not_changed = F.array(pair("ETag", F.concat(F.lit("W/"), tag)), pair("Age", F.col("page_id").cast("string")), pair("Content-Length", "0"), pair("Cache-Control", "max-age=60"))
    def visit(kind: str, shift: int, status: int, headers: Column, body: Column) -> Column:
        name = F.concat(F.col("page_id").cast("string"), F.lit(f"-{kind}-{shift}"))
        return F.struct(name.alias("record_id"), F.lit(kind).alias("kind"), F.col("url").alias("uri"), F.timestamp_seconds(F.col("page_id") * 10 + shift).alias("at"),
                        F.lit(status).alias("status"), headers.alias("headers"), body.alias("body"))
    visits = F.array(visit("response", 5, 200, full, html), visit("revisit", 0, 304, not_changed, F.lit("")), visit("revisit", 9, 304, not_changed, F.lit("")))
    return pages.select(F.inline(visits))
