"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textsluice.llm.common import kept, marked

#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_REVISIT = 100
#: Records in a file at most.  A reader holds a file as it is stored and one
#: record of it unzipped.
FILE_RECORDS = 3_000
#: Bytes unzipped at a time.
PIECE = 1 << 20
#: Fixed value: date of records made from tables that carry none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the blank lines that end it; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    head = F.concat_ws(CRLF, F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind), *lines,
                       F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), block)


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, body, digest, size, copy, kind, first_id, first_url): what to
    write for every row.  Of equal payloads of ``LEAST_REVISIT`` bytes or more the
    one with the smallest page_id (then url) is the response, the others revisit
    it.  Payloads are not grouped: groups are counted on digests alone."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce("html", F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("size", F.octet_length("body").cast("long"))
    small = p.where(F.col("size") < LEAST_REVISIT).groupBy("page_id", "url", "body", "digest", "size").agg(F.count("*").alias("n"))
    small = small.select("page_id", "url", "body", "digest", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"),
                         F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers"))
    large = p.where(F.col("size") >= LEAST_REVISIT)
    narrow = large.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    leads = (narrow.groupBy("digest").agg(F.min(order).alias("lead"), F.sum("n").alias("total")).where("total > 1")
             .select("digest", F.col("lead.page_id").alias("lead_id"), F.col("lead.url").alias("lead_url")))
    shared = narrow.join(leads, "digest").withColumn("leads", F.col("page_id").eqNullSafe(F.col("lead_id")) & F.col("url").eqNullSafe(F.col("lead_url")))
    spare = F.when(F.col("leads"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    revisits = (shared.where(F.col("n") > spare)
                .select("page_id", "url", F.lit("").alias("body"), "digest", "size",
                        F.explode(F.sequence(spare, F.col("n") - 1)).alias("copy"), F.lit("revisit").alias("kind"),
                        _uuid(F.col("lead_id"), F.col("lead_url"), F.col("digest"), F.lit(0), F.lit("response")).alias("refers")))
    gone = shared.where("not leads").select("page_id", "url", "digest")
    often = shared.where("leads and n > 1").select("page_id", "url", "digest")
    near = marked(large, F.col("digest"), shared, F.col("digest"))       # payloads that no other page has are not shuffled
    alone, some = near.where("not _near").drop("_near"), near.where("_near").drop("_near")
    by = lambda t: [some.page_id.eqNullSafe(t.page_id), some.url.eqNullSafe(t.url), some.digest == t.digest]
    once = some.join(often, by(often), "left_semi").dropDuplicates(["page_id", "url", "digest"])
    rest = gone.unionByName(often)
    responses = (alone.unionByName(some.join(rest, by(rest), "left_anti")).unionByName(once)
                 .select("page_id", "url", "body", "digest", "size", F.lit(0).cast("long").alias("copy"), F.lit("response").alias("kind"),
                         F.lit(None).cast("string").alias("refers")))
    return responses.unionByName(revisits).unionByName(small)


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives ``pages`` (page_id, url, html): a request, a response or revisit,
    and a metadata record for every row, gzip files of whole records.

    Rows that repeat in all columns are archived each.  A null html is an empty
    payload, a null url an empty target; line breaks in a url are escaped.
    """
    c = captures_of(pages)
    own = lambda kind: _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"), F.lit(kind))
    main = own("response")
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    base = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)]
    path_only = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|\s", "")
    asked = F.concat(F.lit("GET "), F.when(path_only.startswith("/"), path_only).otherwise(F.concat(F.lit("/"), path_only)), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record(F.lit("request"), [("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", main), *base,
                                         ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                      F.col("size").cast("string"), F.lit(CRLF * 2))
    revisit = F.when(F.col("kind") == "revisit", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    answer = _record(F.col("kind"), [("WARC-Record-ID", main), *base, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                                     ("WARC-Refers-To", F.col("refers")), ("WARC-Profile", revisit),
                                     ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(status, F.col("body")))
    about = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit("via: table"))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", own("request")), *base,
                                           ("Content-Type", F.lit("application/warc-fields"))], F.concat(about, F.lit(CRLF)))
    (c.select(F.explode(F.array(request, answer, metadata)).alias("value")).write
     .option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def _plain(content: bytes) -> Iterator[bytes]:
    """A file's bytes without gzip, of one member or many, a piece at a time."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        member, left, piece = zlib.decompressobj(31), content, b"first"
        while not member.eof and (piece or left):
            piece = member.decompress(left, PIECE)
            left = member.unconsumed_tail
            yield piece
        content = member.unused_data if member.eof else b""


def records_in(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (by lower-case name) and block of every record of a file, gzip or
    plain, by its length.  The file is unzipped as far as the record reaches."""
    pieces, held = _plain(content), bytearray()

    def until(mark: bytes, at: int) -> int:
        while (found := held.find(mark, at)) < 0:
            at = max(at, len(held) - len(mark) + 1)
            if (piece := next(pieces, None)) is None:
                return -1
            held.extend(piece)
        return found

    while (at := until(b"WARC/", 0)) >= 0:
        del held[:at]
        end = until(b"\r\n\r\n", 0)
        if end < 0:
            return
        headers: dict[str, list[str]] = {}
        for line in held[:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        stop = end + 4 + int(headers.get("content-length", ["0"])[0])
        while len(held) < stop and (piece := next(pieces, None)) is not None:
            held.extend(piece)
        yield headers, bytes(held[end + 4:stop])
        del held[:stop]


RECORD = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
          "payload_digest string, payload_bytes long, payload_sha256 string, payload binary")
ANSWERS = ("response", "revisit", "resource", "conversion")


def _reader(kinds: tuple[str, ...], payloads: tuple[str, ...]):
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for files in batches:
            for k in range(files.num_rows):
                rows, size = [], 0
                for headers, block in records_in(files.column(0)[k].as_py()):
                    one = lambda name: headers.get(name, [None])[0]  # noqa: B023, E731
                    kind = one("warc-type")
                    if kind not in kinds:
                        continue
                    http = (one("content-type") or "").startswith("application/http")
                    body = block.partition(b"\r\n\r\n")[2] if http else block
                    kept_body = body if kind in payloads else None
                    rows.append((one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-refers-to"),
                                 one("warc-target-uri"), one("warc-date"), one("warc-payload-digest"), len(body), hashlib.sha256(body).hexdigest(), kept_body))
                    size += len(kept_body or b"")
                    if len(rows) >= 2_000 or size > 1 << 22:
                        yield batch()
                        rows, size = [], 0
                if rows:
                    yield batch()
    return run


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...], payloads: tuple[str, ...] = ANSWERS + ("request", "metadata")) -> DataFrame:
    """Records of the given types, a row each, with HTTP heads taken off; size
    and digest of all payloads, and the payloads of the types ``payloads``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(kinds, payloads), RECORD)


def read_captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: the response, revisit or resource with its
    request and its metadata records.

    Records name each other through WARC-Concurrent-To in either direction, and
    metadata may name the request instead of the response; both are followed.
    A capture without request or metadata has null and an empty list; a request
    or metadata record that names no capture belongs to none.  The archive is
    read once for all but the payloads, with their size and digest, and once more
    for these, which are shuffled once; without ``payloads`` they are null.
    """
    links = kept(read_records(spark, path, ANSWERS + ("request", "metadata"), ("request", "metadata")), "records")
    own = F.col("record_type").isin(*ANSWERS)
    main, side = read_records(spark, path, ANSWERS) if payloads else links.where(own), links.where(~own)
    named = side.select("record_id", "record_type", "target_uri", "date", "payload", F.explode_outer("concurrent_to").alias("to"))
    asks = named.where("record_type = 'request'").select(F.col("record_id").alias("ask"), F.col("to").alias("answer")).distinct()
    owns = links.where(own).select(F.explode("concurrent_to").alias("ask"), F.col("record_id").alias("answer"))
    hops = asks.unionByName(owns).where("ask is not null and answer is not null").distinct()
    direct = named.join(hops, named["to"] == hops["ask"], "left").select(named["*"], F.coalesce("answer", "to").alias("anchor"))
    listed = side.join(owns.distinct(), side.record_id == F.col("ask")).select(
        "record_id", "record_type", "target_uri", "date", "payload", F.lit(None).cast("string").alias("to"), F.col("answer").alias("anchor"))
    part = F.struct("record_id", "target_uri", "date", "payload")
    sides = (direct.unionByName(listed).where("anchor is not null").groupBy("anchor")
             .agg(F.min(F.when(F.col("record_type") == "request", part)).alias("request"),
                  F.array_sort(F.collect_set(F.when(F.col("record_type") == "metadata", part))).alias("metadata")))
    return (main.join(sides, main.record_id == sides.anchor, "left").drop("anchor")
            .withColumn("metadata", F.coalesce("metadata", F.array().cast(sides.schema["metadata"].dataType))))


def resolved(captures: DataFrame) -> DataFrame:
    """(page_id, record_id, record_type, payload_bytes, payload_digest, refers_to) of
    captures, with those of revisits taken from the response they refer to."""
    fields = F.col("metadata")[0]["payload"].cast("string")
    return captures.select(F.regexp_extract(fields, r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"), "record_id", "record_type",
                           "payload_bytes", F.col("payload_sha256").alias("payload_digest"), "refers_to")
