"""Web archives: read old ARC files, convert them to WARC, and read WARC back.

ARC parsing follows each record's header line, whose fields depend on the version that the file's first record
declares, and trusts only declared lengths, so payloads may hold anything. WARC records get identifiers, dates, types
and digests that depend on the record alone, so a task that runs again writes the same bytes.

Archives are written by Spark's own file writer, one gzip file a segment: any store that Spark writes to will do, and a
task that dies leaves nothing behind. A segment closes once it passes SEGMENT bytes, so memory holds one segment and
one record more, whatever the table's size. Reading checks every digest and raises on a mismatch.

Nulls: a null payload is empty, a null url is `urn:null`, a null page_id is kept as null. Rows that repeat a page_id
are all written. An empty table makes no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

SEGMENT = 16 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
SALTS = 16

# The field names of ARC header lines, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("warc_date", pa.string()), ("target_uri", pa.string())])


class ArchiveError(ValueError):
    """The archive's bytes break its format."""


def arc_header(version: int, name: str, date: str) -> bytes:
    fields = " ".join(ARC_FIELDS[version]).encode()
    body = f"{version} 0 tidemill\n".encode() + fields + b"\n\n"
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(first.get(f, "-") for f in ARC_FIELDS[1 if version == 1 else 2]).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, kind: str, content: bytes, ip: str = "0.0.0.0") -> bytes:
    """One record; a space or line end in the URL, which a header line can't hold, is percent-encoded."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:null"
    v = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(content))}
    return " ".join(v[f] for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record but the file's own description."""
    end = data.find(b"\n")
    first = data[: max(end, 0)].split(b" ")
    if not first[0].startswith(b"filedesc://") or not first[-1].isdigit():
        raise ArchiveError("an ARC file starts with a filedesc record")
    body = data[end + 1 : (at := end + 1 + int(first[-1]))]
    declared = body.split(b"\n", 1)[0].split(b" ", 1)[0]
    if declared not in (b"1", b"2"):
        raise ArchiveError(f"unknown ARC version {declared!r}")
    names = ARC_FIELDS[int(declared)]
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        if (end := data.find(b"\n", at)) < 0:
            raise ArchiveError("a header line doesn't end")
        values = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ArchiveError(f"a header line has {len(values)} fields, its version {len(names)}")
        at = end + 1 + int(values[-1])
        if at > len(data):
            raise ArchiveError("a record is shorter than it declares")
        yield dict(zip(names, values, strict=True)), data[end + 1 : at]


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def warc_date(date: str) -> str:
    """YYYYMMDDhhmmss, or a part of it, as a WARC date."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", date):
        raise ArchiveError(f"{date!r} is no date")
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(fields: dict[str, str], content: bytes, page: int | None, refers: int | None) -> bytes:
    """A response, or a revisit without its payload, from an ARC record whose content is an HTTP response."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    digest = hashlib.sha256(payload).hexdigest()
    block = head + gap + (b"" if refers is not None else payload)
    lines = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if page is not None:
        lines.append(("WARC-Page-ID", str(page)))
    if refers is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Refers-To-Page-ID", str(refers))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        if not data.startswith(b"WARC/1.", at) or (end := data.find(b"\r\n\r\n", at)) < 0:
            raise ArchiveError("a record starts with WARC/1. and has a header")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(fields["Content-Length"])
        if at > len(data):
            raise ArchiveError("a record is shorter than it declares")
        block = data[end + 4 : at]
        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ArchiveError(f"{fields['WARC-Record-ID']}: the block's digest differs")
        yield fields, block


def http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + b"\r\n\r\n" + payload


def convert(records: Iterable[tuple], date: str, versions: tuple[int, ...] = (1, 2)) -> Iterator[bytes]:
    """(page, url, payload, refers) -> WARC segments, each by way of an ARC archive; the archives' versions take turns."""
    turn, arc, ids, size = 0, [], [], 0

    def out() -> bytes:
        found = read_arc(arc_header(version, "pages.arc", date) + b"".join(arc))
        return b"".join(to_warc(f, c, page, refers) for (f, c), (page, refers) in zip(found, ids, strict=True))

    for page, url, payload, refers in records:
        version = versions[turn % len(versions)]
        arc.append(arc_record(version, url or "", date, "text/html", http(payload)))
        ids.append((page, refers))
        size += len(arc[-1])
        if size >= SEGMENT:
            yield out()
            turn, arc, ids, size = turn + 1, [], [], 0
    if ids:
        yield out()


def _segments(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    page, url, html, refers = (b.column(k)[i].as_py() for k in range(4))
                    yield page, url, (html or "").encode(), refers

        for segment in convert(rows(), date):
            # the writer ends its only line with the \n that the last record ends with
            yield pa.RecordBatch.from_arrays([pa.array([segment.removesuffix(b"\n")], pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, out: str, date: str = "20240101000000") -> None:
    """pages (page_id, url, html, refers_to) -> .warc files, gzipped, in the folder."""
    d = pages.select("page_id", "url", "html", "refers_to").mapInArrow(_segments(date), "value binary")
    # a cast from binary keeps every byte, and the writer adds back the final line end
    d.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            rows = []
            for f, block in read_warc(gzip.decompress(b.column(0)[i].as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(re.search(rb"(?i)content-length: (\d+)", head)[1])
                if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ArchiveError(f"{f['WARC-Record-ID']}: the payload differs")
                number = lambda k, f=f: int(f[k]) if k in f else None
                rows.append((number("WARC-Page-ID"), size, digest, f["WARC-Type"], number("WARC-Refers-To-Page-ID"), f["WARC-Date"], f["WARC-Target-URI"]))
            if rows:  # an empty table leaves an empty file
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


def read_archives(spark, folder: str) -> DataFrame:
    """One row for each record of the folder's archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, warc_date string, target_uri string")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds refers_to: of rows with equal payloads of `least` bytes or more, the smallest page_id, else null.

    Payload digests are pre-aggregated, and only those that occur twice or more join back, salted: a payload that a
    third of the pages share is spread over SALTS tasks.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"_d": F.sha2("html", 256), "_n": F.octet_length("html"), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    first = p.where(F.col("_n") >= least).groupBy("_d").agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    first = first.select("_d", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    p = p.join(first, ["_d", "_salt"], "left")
    return p.select("page_id", "url", "html", F.when(F.col("_first") < F.col("page_id"), F.col("_first")).alias("refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc"
    write_archives(with_revisits(pages), folder)
    return read_archives(spark, folder)
