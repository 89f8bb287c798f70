"""WARC archives: writing captures, reading them back and assembling transactions.

A capture is three records: the request, the response (or a revisit, where an earlier response
has the same payload) and metadata.  Request and metadata name the response in
``WARC-Concurrent-To``; the reader joins them through it into one nested row per capture.
Archives are written by the executors through Spark's text sink, whose line separator is the
end of a WARC record, so they land on any file system with Spark's commit protocol.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import hold_batches, join_measured, new_path, rested, stored

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100

#: Bytes of payloads, and records, that an archive file is meant to hold; three records for each capture.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 15_000

_VERSION = "WARC/1.1"
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def _urn(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _record(kind: Column, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last two line ends; headers with a null value are left out."""
    lines = [F.lit(_VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {_DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id and refers_to of every capture whose payload an earlier page_id already has.

    Only digests are shuffled; the smallest page_id of a digest is found by a partial
    aggregation, and a digest that very many pages share is split by Spark's skew join.
    """
    known = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    known = known.filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top")).filter("refers_to < top").drop("top")
    return known.join(first, "digest").filter("page_id > refers_to").select("page_id", F.col("digest").alias("same_digest"), "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzip archives under ``path``.

    Null html is an empty payload; a null url is left out.  A null page_id is written as a
    response of its own.  Line ends in urls become ``%0D`` and ``%0A``.
    """
    told = roles(pages, least).groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("same_digest", "refers_to"))).alias("same"))
    rows = join_measured(pages.select("page_id", "url", "html"), told, "page_id", "warc-roles")
    body = F.coalesce("html", F.lit(""))
    rows = rows.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), "same")
    rows = rows.withColumn("refers_to", F.try_element_at("same", "digest"))
    page, digest, again = F.col("page_id"), F.col("digest"), F.col("refers_to").isNotNull()
    answer = _urn("response", page, digest)
    name = page.cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END))
    request = _record(
        F.lit("request"), _urn("request", page, digest),
        [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + _END)),
    )
    response = _record(
        F.when(again, "revisit").otherwise("response"), answer,
        [
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            ("WARC-Refers-To", F.when(again, _urn("response", F.col("refers_to"), digest))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record(
        F.lit("metadata"), _urn("metadata", page, digest),
        [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(name, F.lit("")), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # The mean payload tells how many records make a file of the size that is meant.
    told = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("size")).first()
    most = max(3, min(RECORDS_PER_FILE, 3 * told.n * FILE_BYTES // max(told.size or 0, 1)))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class RecordReader:
    """Records of one archive, plain or gzip (one member or many), as bytes arrive."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.packed = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.packed is not None and self.packed.eof:
            rest = self.packed.unused_data
            self.at -= len(rest)
            if self.at >= len(self.raw):
                return False
            self.packed = zlib.decompressobj(31)
        part = bytes(self.raw[self.at : self.at + (1 << 16)])
        if not part:
            return False
        self.at += len(part)
        self.held += self.packed.decompress(part) if self.packed is not None else part
        return True

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a header")
                    return
            head = self._take(end + 4)[:end].decode("utf-8").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {head[0][:40]!r}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
            block = self._take(int(fields["Content-Length"]))
            self._take(4)
            yield fields, block


_RECORD = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()),
     ("head", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("claimed_digest", pa.string())]
)
_RECORD_DDL = "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, head string, payload string, payload_bytes long, payload_digest string, claimed_digest string"


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for f, block in RecordReader(batch.column("content")[k].as_py()):
                    kind, head, payload = f["WARC-Type"], None, block
                    if f.get("Content-Type", "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        head = top.decode("utf-8", "replace")
                    full = kind == "response"
                    keep = payload.decode("utf-8", "replace") if kind != "response" or with_payload else None
                    rows.append((f["WARC-Record-ID"], kind, f.get("WARC-Concurrent-To"), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f.get("WARC-Date"), head, keep,
                                 len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None, f.get("WARC-Payload-Digest")))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    An archive is one task's input; its records are unpacked as a stream, so memory holds the
    packed file and one record.
    """
    hold_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rested(_parse(with_payload)), _RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: response joined with its request and metadata.

    Columns: record_id, kind, uri, date, page, request, metadata, response (struct), refers_to
    (record id) and payload_bytes, payload_digest of the full payload; a revisit takes these,
    and the payload, from the response it refers to.  A capture whose request or metadata is
    missing has null there.  Repeated record ids count once as a partner.
    """
    side = records.filter("kind IN ('request', 'metadata') AND concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("answer")).agg(
        F.first(F.when(F.col("kind") == "request", F.struct("record_id", "uri", "head")), True).alias("request"),
        F.first(F.when(F.col("kind") == "metadata", F.struct("record_id", F.col("payload").alias("fields"))), True).alias("metadata"),
    )
    # Written, like ``first`` below, so that Spark may split the side of the join that is skewed.
    side, _ = stored(side, "warc-partners")
    answers = records.filter("kind IN ('response', 'revisit')")
    whole = answers.join(side, F.col("record_id") == F.col("answer"), "left")
    first = records.filter("kind = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.first(F.struct("payload", "payload_bytes", "payload_digest")).alias("full")
    )
    first, _ = stored(first, "warc-originals")
    whole = whole.join(first, F.col("refers_to") == F.col("of"), "left")
    pick = lambda c: F.when(F.col("kind") == "revisit", F.col(f"full.{c}")).otherwise(F.col(c)).alias(c)
    return whole.select(
        "record_id", "kind", "uri", "date", F.regexp_extract("metadata.fields", "page-id: ([^\r\n]*)", 1).alias("page"),
        "request", "metadata", F.struct(F.col("head"), pick("payload")).alias("response"), "refers_to", pick("payload_bytes"), pick("payload_digest"), "claimed_digest",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    records, _ = stored(read_records(spark, path, with_payload=False), "warc-records")
    found = captures(records).withColumn("page_id", F.expr(f"try_cast(page AS {kind})"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "record_id", F.col("refers_to").alias("target"))


def page_rows(found: DataFrame) -> DataFrame:
    """Name the page that each revisit refers to instead of its record."""
    named = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.min("page_id").alias("refers_to"))
    named, _ = stored(named, "warc-pages")
    return found.join(named, F.col("target") == F.col("of"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
