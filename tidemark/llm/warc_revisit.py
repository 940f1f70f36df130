"""Not-modified revisits of web archives: an as-of join to the latest earlier full response.

A revisit record has no body, only its validators. It is resolved by the latest response of the same canonical URL
captured before it (in the same instant: of lower record id), if a validator agrees: the payload digest where both
have one, else the entity tag (weak comparison), else the Last-Modified date. The resolved record takes body, digest
and status from that response, and its headers, with those that a not-modified answer may renew taken from the revisit.

The join never gathers a URL: captures are dealt to ranges of (URL, date, record), so that a hot URL spans several.
The last response of a URL in each range is found with partial aggregation and carried over the URL's ranges, of which
there are no more than partitions; what lies inside of one range is ordered there. Bodies take no part in it; they are
joined at the end by record id, those of hot originals as copies.

A URL without an authority (opaque, or relative) is a key by its own text, without fragment. Null and blank URLs match nothing, null dates order first, null validators don't agree with anything. Records that repeat in
full count once as candidates and are resolved each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import chunks_by_bytes, release, text_of, through_table

#: Originals with more than 1 / HOT_ORIGINALS of all revisits are hot: at most so many.
HOT_ORIGINALS = 5000
#: Headers that a 304 answer may renew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host lower-case without a default port, fragment and tracking parameters dropped, the
    rest of the query in order of its text, no slash at the end of the path; after a colon, what has no authority."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    parameters = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)")))
    joined = F.array_join(parameters, "&")
    known = F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(host != "", known).when(bare != "", F.concat(F.lit(":"), bare))


def validators_agree(revisit: str, response: str) -> Column:
    """Whether the records of two prefixes have a validator that settles that the body is the same."""
    r = lambda c: F.col(f"{revisit}{c}")
    o = lambda c: F.col(f"{response}{c}")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    both = lambda c: r(c).isNotNull() & o(c).isNotNull()
    return F.when(both("digest"), r("digest") == o("digest")).when(both("etag"), weak(r("etag")) == weak(o("etag"))).when(both("last_modified"), r("last_modified") == o("last_modified")).otherwise(F.lit(False))


def merged_headers(own: Column, original: Column) -> Column:
    """The original's headers, those that may be renewed replaced by the revisit's where it has them."""
    renewed = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(renewed), lambda k: F.lower(k))
    kept = F.map_filter(F.coalesce(original, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, F.lower(k)))
    return F.map_concat(kept, renewed)


def latest_responses(records: DataFrame) -> DataFrame:
    """record_id of each revisit and original_id of the latest earlier response of its URL."""
    slim = records.select("record_id", "kind", canonical_url(F.col("url")).alias("key"), F.coalesce(F.unix_micros("captured"), F.lit(-(1 << 62))).alias("at")).where("key is not null and kind in ('response', 'revisit')")
    slim = through_table(slim, "slim-captures")  # ranges are found by reading it once more
    slim = through_table(slim.repartitionByRange("key", "at", "record_id").withColumn("range", F.spark_partition_id()), "captures")
    inside = Window.partitionBy("key", "range").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = slim.withColumn("_near", F.last(F.when(F.col("kind") == "response", F.col("record_id")), ignorenulls=True).over(inside)).where("kind = 'revisit'")
    # over ranges, not captures: what each range's last response is to the ranges after it
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id"))
    seen = slim.groupBy("key", "range").agg(F.max(response).alias("end")).select("key", "range", F.col("end.record_id").alias("_last"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumn("_far", F.last("_last", ignorenulls=True).over(before)).where("_far is not null").select("key", "range", "_far")
    return own.join(carried, ["key", "range"], "left").select("record_id", F.coalesce("_near", "_far").alias("original_id"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit with what it resolves to.

    Records: record_id long (null only if never referred to), kind ('response' or 'revisit'), url, captured timestamp,
    status int, digest, etag, last_modified, headers map, body. Gives record_id, url, captured, original_id, resolved,
    and for resolved ones status, digest, headers and body; others have nulls and their own headers.
    """
    revisits = records.where("kind = 'revisit'").select(*(F.col(c).alias(f"r_{c}") for c in ("record_id", "url", "captured", "digest", "etag", "last_modified", "headers")))
    originals = records.where("kind = 'response'").dropDuplicates(["record_id"]).select(*(F.col(c).alias(f"o_{c}") for c in ("record_id", "status", "digest", "etag", "last_modified", "headers", "body")))
    found = through_table(latest_responses(records).distinct().withColumnRenamed("record_id", "l_record_id"), "latest-responses")
    share = max(1, found.count() // HOT_ORIGINALS)
    hot = found.where("original_id is not null").groupBy("original_id").count().where(F.col("count") > share)
    hot = F.broadcast(hot.select(F.col("original_id").alias("_hot"), F.least(F.ceil(F.col("count") / share), F.lit(1024)).cast("int").alias("_salts")))
    copies = originals.join(hot, F.col("o_record_id") == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts")
    salt = F.coalesce(F.pmod(F.xxhash64("l_record_id"), F.col("_salts")).cast("int"), F.lit(0))
    found = found.join(hot, F.col("original_id") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    # a key of its own for each revisit without an original, else all of them meet in one task
    key = F.coalesce(F.col("original_id"), F.lit(-(1 << 62)) - F.abs(F.coalesce("r_record_id", F.lit(0))))
    both = revisits.join(found, F.col("r_record_id").eqNullSafe(F.col("l_record_id")), "left").join(copies, (key == F.col("o_record_id")) & (F.coalesce("_salt", F.lit(0)) == F.col("_copy")), "left")
    good = F.col("original_id").isNotNull() & F.coalesce(validators_agree("r_", "o_"), F.lit(False))
    return both.select(
        F.col("r_record_id").alias("record_id"),
        F.col("r_url").alias("url"),
        F.col("r_captured").alias("captured"),
        "original_id",
        good.alias("resolved"),
        *(F.when(good, F.col(f"o_{c}")).alias(c) for c in ("status", "digest")),
        F.when(good, merged_headers(F.col("r_headers"), F.col("o_headers"))).otherwise(F.col("r_headers")).alias("headers"),
        F.when(good, F.col("o_body")).alias("body"),
    )


# ---------------------------------------------------------------- the file format


def write_warc(records: list[dict]) -> bytes:
    """WARC/1.1 with one gzip member for each record: kind, url, captured (ISO), id, status, digest, headers, body."""
    out = io.BytesIO()
    for r in records:
        lines = [f"HTTP/1.1 {r['status']} X", *(f"{k}: {v}" for k, v in (r.get("headers") or {}).items())]
        block = ("\r\n".join(lines) + "\r\n\r\n").encode() + (r.get("body") or b"" if r["kind"] == "response" else b"")
        head = ["WARC/1.1", f"WARC-Type: {r['kind']}", f"WARC-Record-ID: <urn:tidemark:{r['id']}>", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {r['captured']}", "Content-Type: application/http; msgtype=response"]
        if r.get("digest"):
            head.append(f"WARC-Payload-Digest: {r['digest']}")
        if r["kind"] == "revisit":
            head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
        head.append(f"Content-Length: {len(block)}")
        out.write(gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", mtime=0))
    return out.getvalue()


def _dechunked(data: bytes) -> bytes:
    """The body of a chunked message; one that breaks off gives what there is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def _decoded(body: bytes, headers: dict[str, str]) -> bytes:
    """A message body without its transfer and content codings; as it is where they are unknown or broken."""
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = _dechunked(body)
    coding = headers.get("content-encoding", "").lower()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


class _Members(io.RawIOBase):
    """The bytes of a file's gzip members, one after another, up to where the file ends or is damaged."""

    def __init__(self, source: BinaryIO):
        self.source, self.rest, self.machine = source, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            self.rest = self.rest or self.source.read(1 << 16)
            if not self.rest:
                return 0
            try:
                got = self.machine.decompress(self.rest, len(into))
            except zlib.error:
                self.rest, self.source = b"", io.BytesIO()
                return 0
            self.rest = self.machine.unconsumed_tail
            if self.machine.eof:
                self.rest, self.machine = self.machine.unused_data, zlib.decompressobj(31)
            if got:
                into[: len(got)] = got
                return len(got)


def read_warc(data: bytes | BinaryIO) -> Iterator[dict]:
    """The response and revisit records of a WARC file, plain or with gzip members, one in memory at a time. A file that
    breaks off or is damaged gives the records before that place."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    packed = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    stream = io.BufferedReader(_Members(source)) if packed else source
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := stream.readline().strip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = int(fields.get("content-length", 0))
            if fields.get("warc-type") not in ("response", "revisit"):
                while size > 0 and (skipped := len(stream.read(min(size, 1 << 20)))):
                    size -= skipped
                continue
            block = stream.read(size)
            if len(block) < size:
                return
            head, _, body = block.partition(b"\r\n\r\n")
            first, *rest = head.decode("latin-1").split("\r\n")
            headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k}
            low = {k.lower(): v for k, v in headers.items()}
            status = first.split()[1:2]
            yield {"kind": fields["warc-type"], "id": fields.get("warc-record-id", "").strip("<>"), "url": fields.get("warc-target-uri"), "captured": fields.get("warc-date"), "status": int(status[0]) if status and status[0].isdigit() else None, "digest": fields.get("warc-payload-digest"), "etag": low.get("etag"), "last_modified": low.get("last-modified"), "headers": headers, "body": _decoded(body, low) if fields["warc-type"] == "response" else None}
    except ValueError:
        return


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below a path, as resolve() takes them. record_id is a hash of WARC-Record-ID. Spark
    opens the files; a task holds one file as stored, and its records one at a time."""
    names = ["record_id", "kind", "url", "captured", "status", "digest", "etag", "last_modified", "headers", "body"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())

    def build(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        release()
        for batch in batches:
            for content in batch.column(0):
                rows = ((int.from_bytes(xxhash.xxh64_digest(r["id"]), "big", signed=True), *(r[c] for c in names[1:8]), list(r["headers"].items()), r["body"]) for r in read_warc(content.as_py()))
                yield from chunks_by_bytes(rows, lambda r: 500 + len(r[9] or b""), build)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    found = files.mapInArrow(run, "record_id long, kind string, url string, captured string, status int, digest string, etag string, last_modified string, headers map<string,string>, body binary")
    return found.withColumn("captured", F.try_to_timestamp("captured"))


# ---------------------------------------------------------------- the query's captures


def captures(pages: DataFrame) -> DataFrame:
    """Five captures of every page: a response, a revisit of it by a variant of the URL with a weak entity tag, a second
    response, and two later revisits, by digest or another entity tag, and by Last-Modified, a third of these outdated.
    Times and tags follow from page_id."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    base = F.coalesce(F.col("page_id"), F.lit(-1))
    own = own.withColumn("sum", F.md5("html")).withColumn("tag", F.concat(F.lit('"'), F.substring("sum", 1, 12), F.lit('"')))
    own = own.withColumn("new", F.concat(F.lit("changed "), F.col("sum"))).withColumn("new_tag", F.concat(F.lit('"n'), base.cast("string"), F.lit('"')))
    null = F.lit(None).cast("string")
    even = F.pmod(base, F.lit(2)) == 0

    def record(k, kind, url, seconds, status, digest, etag, modified, headers, body):
        names = ("record_id", "kind", "url", "captured", "status", "digest", "etag", "last_modified", "headers", "body")
        values = (base * 5 + k, F.lit(kind), url, F.timestamp_seconds(F.lit(1_700_000_000) + base % 1000 * 60 + seconds), F.lit(status), digest, etag, modified, headers, body)
        return F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))

    head = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    weak = F.concat(F.lit("W/"), F.col("tag"))
    every = F.array(
        record(0, "response", F.col("url"), 0, 200, F.concat(F.lit("md5:"), "sum"), F.col("tag"), F.lit("Mon"), head("Content-Type", "text/html", "ETag", F.col("tag"), "Cache-Control", "no-cache"), F.col("html")),
        record(1, "response", F.col("url"), 3600, 200, F.concat(F.lit("md5:"), F.md5("new")), F.col("new_tag"), F.lit("Tue"), head("Content-Type", "text/plain", "ETag", F.col("new_tag")), F.col("new")),
        record(2, "revisit", F.concat(F.col("url"), F.lit("#again")), 900, 304, null, weak, null, head("ETag", weak, "Cache-Control", "max-age=60", "Server", "x"), null),
        record(3, "revisit", F.regexp_replace("url", "^http", "HTTP"), 7200, 304, F.when(even, F.concat(F.lit("md5:"), F.md5("new"))), F.when(~even, F.lit('"other"')), null, head("Date", "later"), null),
        record(4, "revisit", F.col("url"), 90_000, 304, null, null, F.when(F.pmod(base, F.lit(3)) == 0, F.lit("Mon")).otherwise("Tue"), head("Expires", "never", "Server", "y"), null),
    )
    return own.select(F.explode(every).alias("r")).select("r.*")


def revisit_rows(pages: DataFrame) -> DataFrame:
    """One row for each revisit of the pages' captures: what it resolved to, its headers as text and its body's digest."""
    found = resolve(captures(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.select("record_id", "url", "original_id", "resolved", F.col("status").cast("long").alias("status"), "digest", text.alias("headers"), F.md5("body").alias("body_md5"), F.char_length("body").cast("long").alias("body_chars"))


#: The same rows by a window over each URL's captures. DuckDB's regular expressions and text order agree here.
ORACLE = r"""
WITH own AS (
  SELECT coalesce(page_id, -1) AS id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS sum FROM pages
), tagged AS (
  SELECT *, '"' || substr(sum, 1, 12) || '"' AS tag, 'changed ' || sum AS new, '"n' || id || '"' AS new_tag, id % 1000 * 60 AS t FROM own
), records AS (
  SELECT id * 5 AS record_id, 0 AS k, url, t, 200 AS status, 'md5:' || sum AS digest, tag AS etag, 'Mon' AS lm, 'text/html' AS ctype, html AS body FROM tagged
  UNION ALL SELECT id * 5 + 1, 1, url, t + 3600, 200, 'md5:' || md5(new), new_tag, 'Tue', 'text/plain', new FROM tagged
  UNION ALL SELECT id * 5 + 2, 2, url || '#again', t + 900, 304, NULL, 'W/' || tag, NULL, NULL, NULL FROM tagged
  UNION ALL SELECT id * 5 + 3, 3, regexp_replace(url, '^http', 'HTTP'), t + 7200, 304, CASE WHEN id % 2 = 0 THEN 'md5:' || md5(new) END, CASE WHEN id % 2 <> 0 THEN '"other"' END, NULL, NULL, NULL FROM tagged
  UNION ALL SELECT id * 5 + 4, 4, url, t + 90000, 304, NULL, NULL, CASE WHEN id % 3 = 0 THEN 'Mon' ELSE 'Tue' END, NULL, NULL FROM tagged
), cut AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM records
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest
  FROM cut
), keyed AS (
  SELECT *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), 'string_agg', '&') AS query
  FROM parts
), named AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN coalesce(query, '') <> '' THEN '?' || query ELSE '' END WHEN bare <> '' THEN ':' || bare END AS key FROM keyed
), seen AS (
  SELECT *, last_value(CASE WHEN k < 2 THEN record_id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM named
), joined AS (
  SELECT r.record_id, r.k, r.url, CASE WHEN r.key IS NOT NULL THEN r.before END AS original_id, r.etag, o.digest AS digest, o.etag AS otag, o.ctype, o.body, o.status, CASE WHEN o.k = 0 THEN 'Cache-Control: no-cache; ' ELSE '' END AS cc,
    o.record_id IS NOT NULL AND coalesce(CASE WHEN r.digest IS NOT NULL THEN r.digest = o.digest WHEN r.etag IS NOT NULL THEN regexp_replace(r.etag, '^W/', '') = o.etag ELSE r.lm = o.lm END, false) AS resolved
  FROM seen r LEFT JOIN named o ON o.record_id = r.before AND o.k < 2 AND r.key IS NOT NULL WHERE r.k >= 2
)
SELECT record_id, url, original_id, resolved, CASE WHEN resolved THEN CAST(status AS BIGINT) END AS status, CASE WHEN resolved THEN digest END AS digest,
  CASE WHEN resolved AND k = 2 THEN 'Cache-Control: max-age=60; Content-Type: ' || ctype || '; ETag: ' || etag
       WHEN resolved AND k = 3 THEN cc || 'Content-Type: ' || ctype || '; Date: later; ETag: ' || otag
       WHEN resolved AND k = 4 THEN cc || 'Content-Type: ' || ctype || '; ETag: ' || otag || '; Expires: never'
       WHEN k = 2 THEN 'Cache-Control: max-age=60; ETag: ' || etag || '; Server: x'
       WHEN k = 3 THEN 'Date: later' ELSE 'Expires: never; Server: y' END AS headers,
  CASE WHEN resolved THEN md5(body) END AS body_md5, CASE WHEN resolved THEN CAST(length(body) AS BIGINT) END AS body_chars
FROM joined
"""
