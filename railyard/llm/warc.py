"""Legacy archives to WARC: read ARC 1 and 2 files, write and read WARC 1.1 files.

An ARC file starts with a version block that names its version and the fields
of its header lines; every record is a header line, as many bytes as the line's
last field declares, and a newline.  The converter makes of each record the
WARC fields that ARC lacks: record id, ISO date, record type and digests.
Records whose payload was archived before become ``revisit`` records.

Files are gzip-compressed and hold a bounded number of records each; a file is
parsed by one task.  All files go through Spark's writers and readers.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# fixed format values -------------------------------------------------------
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---------------------------------------------------------------------------

FILE_BYTES = 16 << 20
MIN_REVISIT = 100


def records_per_file(df: DataFrame, size_col: str) -> int:
    n, total = df.agg(F.count("*"), F.sum(size_col)).first()
    return max(1, min(1 << 20, int(FILE_BYTES * n / total) if total else 1 << 20))


def _arrow(schema: str):
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def _text(df: DataFrame, path: str, end: str, per_file: int) -> None:
    (df.write.mode("append").option("lineSep", end).option("compression", "gzip")
       .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path))


# ---------------------------------------------------------------------------
# ARC
# ---------------------------------------------------------------------------
def _field(value) -> bytes:
    """A header field: white space percent-encoded, nothing as a dash."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], value.encode()) if value else b"-"


def arc_record(version: int, url, ip, date, mime, block: bytes) -> bytes:
    middle = [] if version == 1 else [b"200", b"-", b"-", b"0", b"-"]
    line = b" ".join([_field(url), _field(ip), _field(date), _field(mime), *middle, b"%d" % len(block)])
    return line + b"\n" + block


def arc_version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 railyard\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, "filedesc://railyard.arc", "0.0.0.0", date, "text/plain", body)


def write_arc(records: DataFrame, path: str, version: int = 1) -> None:
    """Append ``records`` (url, ip, date, mime strings; block binary) to the folder as ARC files."""
    per_file = records_per_file(records, F.octet_length("block"))

    def run(batches):
        n = 0
        for b in batches:
            out = []
            for url, ip, date, mime, block in zip(*(c.to_pylist() for c in b.columns)):
                if n % per_file == 0:               # each file starts with a version block
                    out.append(arc_version_block(version, "19700101000000"))
                out.append(arc_record(version, url, ip, date, mime, block or b""))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    made = records.select("url", "ip", "date", "mime", "block").mapInArrow(run, "value binary")
    _text(made.select(F.col("value").cast("string")), path, "\n", per_file + 1)


def parse_arc(data: bytes):
    """``(offset, fields, block)`` of each record after the version block."""
    at, names = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode().split(" ")
        size = int(line[-1])
        block = data[end + 1:end + 1 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(block)} are left")
        if line[0].startswith("filedesc://"):
            names = block.decode().split("\n")[1].split(" ")
        else:
            if names is None or len(line) != len(names):
                raise ValueError(f"record at {at} has {len(line)} header fields, not {len(names or [])}")
            yield at, dict(zip(names, line)), block
        at = end + 1 + size


def _unzipped(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:                                     # one or many gzip members
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content", "path")


def _name(path: str) -> str:
    """A file's name without the id of the job that wrote it, so that reruns agree."""
    return re.sub(r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "", path.rpartition("/")[2])


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), head and payload of an archived HTTP response; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode(errors="replace").split("\r\n")[1:]))
    return fields, head + mark, payload


def _iso(date14: str) -> str:
    d = (date14 + "00000101000000"[len(date14):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# ---------------------------------------------------------------------------
# conversion
# ---------------------------------------------------------------------------
_RECORD = "record_id string, page_id bigint, digest string, payload_bytes bigint"


def converted(spark: SparkSession, folder: str, blocks: bool) -> DataFrame:
    """Identifiers and digests of every ARC record below ``folder``; with ``blocks`` also url, ip, date, mime and
    the packed head and payload.  ``page_id`` is the archived response's ``X-Page-Id``, if any."""
    schema = _arrow(_RECORD + (", url string, ip string, date string, mime string, head binary, packed binary" if blocks else ""))

    def run(batches):
        for b in batches:
            for data, path in zip(b.column(0), b.column(1).to_pylist()):
                rows = []
                for at, f, block in parse_arc(_unzipped(data.as_py())):
                    http, head, payload = split_http(block)
                    digest = hashlib.sha256(payload).hexdigest()
                    name = uuid.UUID(bytes=hashlib.md5("|".join([_name(path), f["URL"], f["Archive-date"], str(at), digest]).encode()).digest(), version=4)
                    page = http.get("x-page-id", "")
                    row = (f"urn:uuid:{name}", int(page) if re.fullmatch(r"-?\d+", page) else None, digest, len(payload))
                    if blocks:
                        row += (f["URL"], f["IP-address"], _iso(f["Archive-date"]), f["Content-type"], head, zlib.compress(payload, 1))
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else
                                                 [pa.array([], t) for t in schema.types], schema=schema)
    extra = ", url string, ip string, date string, mime string, head binary, packed binary" if blocks else ""
    return _files(spark, folder).mapInArrow(run, _RECORD + extra)


def _lines(pairs) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None) + b"\r\n"


def warc_record(record_id, digest, size, url, ip, date, mime, head, payload, refers) -> bytes:
    block = head if refers else head + payload
    return _lines([
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", None if ip == "-" else ip),
        ("WARC-Profile", REVISIT_PROFILE if refers else None), ("WARC-Refers-To", f"<{refers}>" if refers else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", size), ("WARC-Identified-Payload-Type", None if mime == "-" else mime),
        ("Content-Type", "application/http;msgtype=response" if head else "application/octet-stream"),
        ("Content-Length", len(block))]) + block


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Convert all ARC files below ``arc_path``.

    Of records with equal payloads of at least ``min_revisit`` bytes the one
    with the smallest page id (null last, then by record id) stays a response,
    the others refer to it and keep only their head.
    """
    light, full = converted(spark, arc_path, False), converted(spark, arc_path, True)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    first = (light.filter(F.col("payload_bytes") >= min_revisit).groupBy("digest")
                  .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
                  .select("digest", F.col("first.record_id").alias("first")))
    rows = full.join(first, "digest", "left").select(
        "record_id", "digest", "payload_bytes", "url", "ip", "date", "mime", "head", "packed",
        F.when(F.col("first") != F.col("record_id"), F.col("first")).alias("refers"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):    # unpacked, a few hundred records at a time
                part = b.slice(at, 256)
                out = [warc_record(*row[:8], zlib.decompress(row[8]), row[9]) for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    per_file = records_per_file(light, F.col("payload_bytes") + 1000)
    # a WARC record ends with two line breaks
    _text(rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")), warc_path, "\r\n\r\n", per_file)


# ---------------------------------------------------------------------------
# WARC
# ---------------------------------------------------------------------------
def parse_warc(data: bytes):
    """``(fields, block)`` of each record; field names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        size = int(fields["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(block)} are left")
        yield fields, block
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, page_id, digest, payload_bytes, record_type, refers`` of every record below ``path``.

    Digest and size come from the payload of a response, and from the header
    of a revisit; a response whose payload does not have the digest its header
    states is an error.
    """
    schema = _arrow(_RECORD + ", record_type string, refers string")

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, block in parse_warc(_unzipped(data.as_py())):
                    http, _, payload = split_http(block)
                    kind, digest, size = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{f['warc-record-id']}: payload and digest differ")
                    page = http.get("x-page-id", "")
                    rows.append((f["warc-record-id"].strip("<>"), int(page) if page else None, digest, size, kind,
                                 f["warc-refers-to"].strip("<>") if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else
                                                 [pa.array([], t) for t in schema.types], schema=schema)
    return _files(spark, path).mapInArrow(run, _RECORD + ", record_type string, refers string")


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as archived HTTP responses: url, ip, date, mime, block.  Null html is an empty payload; the crawl time
    is one second per id after a fixed day; a null id leaves the ``X-Page-Id`` field empty."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"),
                    F.lit("\r\nX-Page-Id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\r\n\r\n"))
    seconds = F.lit(1704067200) + F.pmod(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.lit(10 ** 8))
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyyMMddHHmmss")
    return pages.select(F.col(url_col).alias("url"), F.lit("0.0.0.0").alias("ip"), date.alias("date"),
                        F.lit("text/html").alias("mime"), F.concat(head, html).cast("binary").alias("block"))


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                       min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages to ARC (version 1 and 2, by parity of the row's hash), to WARC, and read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every
    page; repeated rows are separate records; other columns are ignored; no
    pages give no rows.
    """
    spark = pages.sparkSession
    side = F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(2))
    for version in (1, 2):
        write_arc(page_responses(pages.filter(side == version - 1), id_col, url_col, html_col), f"{folder}/arc", version)
    arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", min_revisit)
    back = read_warc(spark, f"{folder}/warc")
    first = back.filter(F.col("record_type") == "response").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    wanted = back.select("refers").filter(F.col("refers").isNotNull()).distinct()
    return (back.join(first.join(wanted, "refers", "left_semi"), "refers", "left")
                .select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
