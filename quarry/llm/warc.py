"""WARC archives: writing with revisits and segments, and reassembly on reading.

Each record, its closing line ends included, is a gzip member. Tasks gather
members into archives of ARCHIVE_BYTES and a record at most, and each archive is
one row and one file of Spark's text writer, whose line separator is the empty
member that closes a file. A block longer than `segment` bytes becomes a first
record and continuations, which may lie in other files. A revisit names its
response in WARC-Refers-To and its page in X-Refers-To-Page-ID, so it stands in
a part of the archives too. Reading parses each archive member by member, groups
continuations by origin identifier, orders them by segment number, verifies the
total length, and decodes the chunked transfer framing.

Defined results: null html is an empty payload; of rows equal in page_id and
payload all are responses, and revisits of them have no WARC-Refers-To; a null page_id counts as the largest; a null url
leaves the target out; a record whose segments are missing or whose length or
digest is wrong comes back with valid = false and no payload; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, remove_path, shared_path, written

SEGMENT, ARCHIVE_BYTES, CHUNK, REVISIT_LEAST = 32 * 1024, 8 * 1024 * 1024, 4096, 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, ident: str, block: bytes, **headers: str | int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    return gzip.compress(raw, 3, mtime=0)


def members(archive: bytes) -> Iterator[bytes]:
    """What each gzip member holds, one at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            part = view[at : at + 16384]  # so that little is copied of what follows the member
            if not part:
                raise ValueError("a member is cut short")
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def ident(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('/'.join(map(str, parts)).encode()).hexdigest())}>"


def records(page_id: int | None, url: str | None, payload: bytes, revisit: bool, least: int | None, alike: int | None, uid: int, segment: int) -> list[bytes]:
    """The record of a page, or its segments. least: the smallest page_id with this payload; alike: the rows that it has with it."""
    digest = base32_sha1(payload)
    about = {"WARC_Target_URI": url or None, "X_Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{digest}"}
    if revisit:
        refers = {"WARC_Refers_To": ident(least, digest, 1) if alike == 1 else None, "X_Refers_To_Page_ID": least}
        return [record("revisit", ident("revisit", page_id, digest, uid), HTTP, **about, **refers, WARC_Profile=REVISIT_PROFILE, Content_Type="application/http; msgtype=response")]
    own = (page_id, digest) if alike in (None, 1) and page_id is not None else (page_id, digest, "row", uid)
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [record("response", ident(*own, 1), block, **about, Content_Type="application/http; msgtype=response")]
    cut = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = record("response", ident(*own, 1), cut[0], **about, WARC_Segment_Number=1, Content_Type="application/http; msgtype=response")
    return [first, *(record("continuation", ident(*own, n), part, WARC_Segment_Origin_ID=ident(*own, 1), WARC_Segment_Number=n, WARC_Segment_Total_Length=len(block) if n == len(cut) else None) for n, part in enumerate(cut[1:], 2))]


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        n = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, archive_bytes: int = ARCHIVE_BYTES, revisit_least: int = REVISIT_LEAST) -> None:
    """Writes page_id, url, html as archives under path. Of equal payloads of revisit_least bytes or more, the smallest page_id is the response."""
    source = pick(pages, "page_id", "url", "html").withColumn("body", F.encode(F.coalesce("html", F.lit("")), "utf-8")).drop("html")
    source = source.withColumn("sum", F.sha1("body"))
    # only payloads seen twice or more meet the pages again; a hot one is pre-aggregated here and its join is split by AQE
    sums = pick(pages, "page_id", "html").select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("_sum"))
    rows = sums.groupBy("_sum", "page_id").agg(F.count("*").alias("_c"))
    # a null page_id counts as the largest
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_c"))
    again = rows.groupBy("_sum").agg(first.alias("_f"), F.sum("_c").alias("_n")).where("_n > 1").select("_sum", F.col("_f.page_id").alias("_least"), F.col("_f._c").alias("_alike"))
    told = source.join(again, source["sum"] == again["_sum"], "left")
    long_enough = F.octet_length("body") >= revisit_least
    late = F.col("_least").isNotNull() & long_enough & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_least")))
    # rows that are responses beside the first of their payload take identifiers of their own
    alike = F.when(F.col("_alike").isNull(), F.lit(None)).when(late | (long_enough & F.col("_least").isNotNull()), F.col("_alike")).otherwise(F.lit(0))
    told = told.select("page_id", "url", "body", F.coalesce(late, F.lit(False)).alias("revisit"), F.col("_least").alias("least"), alike.cast("long").alias("alike"), F.monotonically_increasing_id().alias("uid"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                for r in records(*(c[i].as_py() for c in b.columns), segment):
                    held.append(member(r))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    archives = told.mapInArrow(emit, "value binary")
    # a cast keeps the bytes as they are
    archives.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


PARSED = "origin string, number int, total long, kind string, page_id long, url string, digest string, refers long, block binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, digest, refers (the page of a revisit's response), payload_bytes, payload, valid of each reassembled record.

    payload is null in a revisit, and everywhere unless with_payload.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, held = [], 0
                for raw in members(content.as_py()):
                    for h, block in parse(raw):
                        kind, page, refers, total = h["warc-type"], h.get("x-page-id"), h.get("x-refers-to-page-id"), h.get("warc-segment-total-length")
                        number = int(h.get("warc-segment-number", 0))
                        if not number and not with_payload and kind == "response":  # whole here: decoded now, so that no body is shuffled
                            number, block = -1, _decoded(block, h.get("warc-payload-digest"))
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        out.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number, total and int(total), kind, page and int(page), h.get("warc-target-uri"), digest, refers and int(refers), block))
                        held += len(block)
                    if held > 4 * ARCHIVE_BYTES:
                        yield _batch(out, PARSED)
                        out, held = [], 0
                if out:
                    yield _batch(out, PARSED)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out = []
                for segments in b.column(0).slice(lo, 256).to_pylist():
                    out.append(_assembled(segments, with_payload))
                yield _batch(out, RECORDS)

    archives = spark.read.format("binaryFile").load(path).select("content")
    parts = archives.mapInArrow(rows, PARSED)
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "kind", "page_id", "url", "digest", "refers", "block"))).alias("segments"))
    return grouped.select("segments").mapInArrow(decode, RECORDS)


RECORDS = "page_id long, url string, record_type string, digest string, refers long, payload_bytes long, payload binary, valid boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _decoded(block: bytes, digest: str | None) -> bytes:
    """The length of a whole block's payload, in decimal; empty if the payload is wrong."""
    try:
        payload = http_payload(block)
    except ValueError:
        return b""
    return b"%d" % len(payload) if digest in (None, f"sha1:{base32_sha1(payload)}") else b""


def _assembled(segments: list[dict], with_payload: bool) -> tuple:
    first = segments[0]
    head = (first["page_id"], first["url"], "response" if first["kind"] == "continuation" else first["kind"], first["digest"], first["refers"])
    if first["number"] == -1:
        return (*head, int(first["block"]) if first["block"] else None, None, bool(first["block"]))
    if first["kind"] == "revisit":
        return (*head, None, None, True)
    block = b"".join(s["block"] for s in segments)
    whole = len(segments) == 1 and first["number"] == 0 or [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
    try:
        payload = http_payload(block) if whole else None
    except ValueError:
        payload = None
    if payload is None or first["digest"] not in (None, base32_sha1(payload)):
        return (*head, None, None, False)
    return (*head, len(payload), payload if with_payload else None, True)


def resolved(found: DataFrame) -> DataFrame:
    """Read records with refers_to (the page that a revisit names) and the payload_bytes of its response, null if that is not among them."""
    source = found.where("record_type = 'response'").groupBy("digest").agg(F.min("payload_bytes").alias("_bytes")).withColumnRenamed("digest", "_digest")
    late = F.col("record_type") == "revisit"
    both = found.join(source, late & (found["digest"] == source["_digest"]), "left")
    return both.select("page_id", F.coalesce("payload_bytes", F.when(late, F.col("_bytes"))).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers").alias("refers_to"), "valid")


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back, and removes the archives."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, **options)
    found = written(read_warc(spark, path, with_payload=False), "warc-records")
    remove_path(spark, path)
    return resolved(found)
