"""Legacy archive converter: ARC files (versions 1 and 2) become WARC files.

ARC: a version block, then records of one header line whose last field is the declared length, and that many bytes.
Version 1 lines have five fields, version 2 lines ten.  HTTP messages become WARC responses, all else resources, and either a revisit
of the record with the same payload.  What is no record of its version becomes a row of rejects.  A task hands
on one row a file, of a bounded number of bytes, and Spark's text writer writes each to a file of its own.  Each record of either
format is a gzip member, and so is the writer's line separator, an empty one."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small, stored

#: Bytes of a file's records before compression, about: what a writing or reading task holds at once, unless a single record is larger.
FILE_BYTES = 32 << 20
#: Compressed bytes that are looked at together.
STEP = 16 << 10
#: Level of compression.
LEVEL = 6
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 1000
# Fixed values of the formats: the field names of header lines, and the profile of a revisit.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = re.compile(r"\d{4,14}")
# An empty gzip member: header without time stamp, empty block, check sum and size 0.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arborix:arc-record")


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file, without the newline after it."""
    body = f"{version} 0 arborix\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - 0 pages.arc"
    return f"{url} {ip} {date} {kind}{extra} {len(body)}\n".encode("utf-8", "surrogatepass") + body


def when(date: str) -> datetime | None:
    """An archive date of 14 digits, or fewer that end with a whole field; None of anything else."""
    if not DATE.fullmatch(date) or len(date) % 2:
        return None
    try:
        return datetime.strptime(date + "00000101000000"[len(date):], "%Y%m%d%H%M%S")
    except ValueError:
        return None


def _fields(line: str, version: int) -> list[str] | None:
    """The fields of a header line, None if it is none of the version."""
    count = len(FIELDS[version].split())
    fields = line.rsplit(" ", count - 1)
    good = len(fields) == count and fields[-1].isdecimal() and fields[-1].isascii() and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", fields[0])
    return fields if good else None


def parse_arc(data: bytes, rejects: list[tuple[int, str, str]] | None = None) -> Iterator[dict]:
    """The records of an ARC file; a line's fields are those of the version that the version block declares.

    What isn't a record adds (byte, reason, line) to ``rejects`` (without such a list: an error), and the search goes on at the next
    line that is a header line.  A record with a date that is none is passed over whole."""
    version, at = 1, 0

    def reject(place: int, reason: str, line: str) -> None:
        if rejects is None:
            raise ValueError(f"{reason} at byte {place}: {line[:200]}")
        rejects.append((place, reason, line[:200]))

    while at < len(data):
        if data[at:at + 1] == b"\n":  # the separator
            at += 1
            continue
        end = data.find(b"\n", at)
        end = end if end >= 0 else len(data)
        line = data[at:end].decode("utf-8", "replace")
        first, start = line.startswith("filedesc://"), at
        tail = line.rsplit(" ", 1)[-1]
        if first and tail.isdecimal() and tail.isascii():
            declared = data[end + 1:end + 1 + int(tail)].split(b" ", 1)[0]
            if declared not in (b"1", b"2"):
                reject(start, "another version", line)
                at = end + 1 + int(tail)
                continue
            version = int(declared)
        fields = _fields(line, version)
        if fields is None:
            reject(start, f"not a header line of version {version}", line)
            at = end + 1
            while at < len(data):  # to the next header line
                stop = data.find(b"\n", at)
                stop = stop if stop >= 0 else len(data)
                found = _fields(data[at:stop].decode("utf-8", "replace"), version) if stop - at < 1 << 16 else None
                if found and when(found[2]):
                    break
                at = stop + 1
            continue
        length = int(fields[-1])
        body = data[end + 1:end + 1 + length]
        at = end + 1 + length
        if len(body) != length:
            reject(start, f"declares {length} bytes where {len(body)} are left", line)
        elif when(fields[2]) is None:
            reject(start, "no date", line)
        else:
            yield {"version": version, "url": fields[0], "ip": fields[1], "date": fields[2], "kind": fields[3], "first": first, "body": body}


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header block with its blank line, payload.  Without one all is payload."""
    at = body.find(b"\r\n\r\n") if body[:5] == b"HTTP/" else -1
    return (body[:at + 4], body[at + 4:]) if at >= 0 else (b"", body)


def _header(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", block)
    return found[1].decode("utf-8", "replace") if found and found[1] else None


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(ID_SPACE, f'{page_id} {url} {date} {digest}')}"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the two line ends after it."""
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at:at + 9] != b"WARC/1.0\r":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


def _plain(data: bytes) -> bytes:
    """The bytes of a file, member by member if it is gzipped.  ``gzip.decompress`` copies all that is left with each member."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, parts, member = memoryview(data), 0, [], None
    while at < len(view):
        member = member or zlib.decompressobj(zlib.MAX_WBITS | 16)
        piece = view[at:at + STEP]
        parts.append(member.decompress(piece))
        at += len(piece) - len(member.unused_data)
        if member.eof:
            member = None
    if member:
        raise EOFError("the last gzip member has no end")
    return b"".join(parts)


class _Files:
    """Collects records, each a gzip member, and hands on files of about ``most`` bytes before compression as batches of one row."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.size, self.count = most, [], 0, 0

    def add(self, record: bytes) -> None:
        self.parts.append(gzip.compress(record, LEVEL, mtime=0))
        self.size += len(record)

    def full(self, more: int = 0) -> bool:
        return bool(self.parts) and self.size + more > self.most

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(self.parts)], pa.binary())], names=["file"])
        self.parts, self.size, self.count = [], 0, self.count + 1
        return out


def _write(files: DataFrame, target: str) -> None:
    """Each row to a file of its own, followed by an empty member."""
    (files.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", 1).text(target))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def write_arc(pages: DataFrame, target: str, file_bytes: int = FILE_BYTES) -> None:
    """Legacy input from a table of pages (page_id, url, html): HTTP responses in ARC files, versions 1 and 2
    by turns.  A null html is an empty payload; a url that is null or has no scheme becomes urn:page:<id>, and white space
    and control characters in one are percent-encoded, as a header line has blanks between its fields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), _Files(file_bytes)
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                date = datetime.fromtimestamp(946684800 + (page or 0) % 631152000, timezone.utc).strftime("%Y%m%d%H%M%S")
                body = html or b""
                if files.full(len(body)):
                    yield files.take()
                version = 1 + (part + files.count) % 2
                if not files.parts:
                    files.add(version_block(version, f"pages-{part}-{files.count}.arc.gz", date) + b"\n")
                name = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url) else f"urn:page:{page}"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n"
                files.add(arc_record(version, name, "0.0.0.0", date, "text/html", head.encode() + body) + b"\n")
        if files.parts:
            yield files.take()

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    _write(rows.mapInArrow(run, "file binary"), target)


def _files(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("path", "content")


KEYS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
WHOLE = [("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("kind", pa.string()), *KEYS, ("head", pa.binary()), ("payload", pa.binary())]


def read_arc(spark: SparkSession, target: str, whole: bool) -> DataFrame:
    """The records of ARC files: page_id, payload_bytes, digest, and if ``whole`` the rest too."""
    schema = WHOLE if whole else KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for r in parse_arc(_plain(content.as_buffer().to_pybytes()), []):
                    if r["first"]:
                        continue
                    head, payload = split_http(r["body"])
                    page = _header(head, "X-Page-Id")
                    keys = (int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest())
                    rows.append((r["url"], r["ip"], r["date"], r["kind"], *keys, head, payload) if whole else keys)
                    if len(rows) == 256:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return _files(spark, target).mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in schema))


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """What isn't a record in ARC files: file, byte, reason, line (its first 200 characters)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list = []
                for _ in parse_arc(_plain(content.as_buffer().to_pybytes()), rows):
                    pass
                yield _batch([(path, *r) for r in rows], [("file", pa.string()), ("byte", pa.int64()), ("reason", pa.string()), ("line", pa.string())])

    return _files(spark, target).mapInArrow(run, "file string, byte bigint, reason string, line string")


def convert(spark: SparkSession, arc: str, target: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """ARC files to WARC files; what isn't a record is left out, ``rejected`` lists it.  Of records with equal payloads of ``least`` bytes or more, that of the largest
    page_id is the response and the others revisit it (of several such records, equal ones, all are responses);
    a record without page_id ranks below all with one."""
    keys = stored(read_arc(spark, arc, whole=False), "warc-keys")
    same = (keys.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes")
            .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept")).filter(F.col("n") > 1))
    same = stored(same, "warc-copies").select(F.col("digest").alias("_d"), F.col("payload_bytes").alias("_b"), "kept")
    rows = read_arc(spark, arc, whole=True)
    # the response's record, to name it in its revisits
    kept = (rows.select("page_id", "url", "date", "digest", "payload_bytes").join(small(same), (F.col("digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")))
            .filter(F.col("page_id").eqNullSafe(F.col("kept"))).groupBy("_d", "_b").agg(F.min_by(F.struct("page_id", "url", "date"), F.struct("url", "date")).alias("to")))
    kept = stored(kept, "warc-responses") if same.take(1) else kept.limit(0)
    rows = rows.join(small(kept) if same.take(1) else F.broadcast(kept), (F.col("digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, files = b"software: arborix ARC converter\r\nformat: WARC File Format 1.0\r\n", _Files(file_bytes)

        def record_of(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
            return warc_record(kind, fields, block) + b"\r\n\r\n"

        for batch in batches:
            for r in batch.to_pylist():
                day = when(r["date"]).strftime("%Y-%m-%dT%H:%M:%SZ")
                to = r["to"] if r["to"] and r["to"]["page_id"] != r["page_id"] else None
                block = r["head"] if to else r["head"] + r["payload"]
                http = bool(r["head"])
                fields = [("WARC-Record-ID", f"<{record_id(r['page_id'], r['url'], r['date'], r['digest'])}>"), ("WARC-Date", day),
                          ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                          ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode()), ("WARC-Block-Digest", _sha1(block)),
                          ("Content-Type", "application/http; msgtype=response" if http else r["kind"])]
                if to:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(to['page_id'], to['url'], to['date'], r['digest'])}>"),
                               ("WARC-Refers-To-Target-URI", to["url"])]
                record = record_of("revisit" if to else "response" if http else "resource", fields, block)
                if files.full(len(record)):
                    yield files.take()
                if not files.parts:
                    about = [("WARC-Record-ID", f"<{record_id(None, 'warcinfo', r['date'], r['digest'])}>"), ("WARC-Date", day), ("Content-Type", "application/warc-fields")]
                    files.add(record_of("warcinfo", about, info))
                files.add(record)
        if files.parts:
            yield files.take()

    rows = rows.select("url", "ip", "date", "kind", "page_id", "digest", "head", "payload", "to")
    _write(rows.mapInArrow(run, "file binary"), target)


def read_warc(spark: SparkSession, target: str) -> DataFrame:
    """The response, resource and revisit records of WARC files, digests checked: record_id, record_type, page_id, payload_bytes
    (of a revisit: what its HTTP header declares), payload_digest (hexadecimal), refers_to_id."""
    schema = [("record_id", pa.string()), ("record_type", pa.string()), *KEYS[:2], ("payload_digest", pa.string()), ("refers_to_id", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in parse_warc(_plain(content.as_buffer().to_pybytes())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: its payload has another digest")
                    page = _header(head, "X-Page-Id")
                    size = len(payload) if kind != "revisit" else int(_header(head, "Content-Length") or 0)
                    to = fields.get("warc-refers-to")
                    rows.append((fields["warc-record-id"].strip("<>"), kind, int(page) if page else None, size, digest, to.strip("<>") if to else None))
                yield _batch(rows, schema)

    return _files(spark, target).mapInArrow(
        run, "record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to_id string")


def pages_through_warc(pages: DataFrame, target: str | None = None, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold: page_id, payload_bytes, payload_digest, record_type,
    refers_to (page_id of the response that a revisit names).

    A null html is an empty payload, a response.  Rows equal in page_id and payload are all
    responses if theirs is the largest page_id.  Null ids are kept; such a record is a revisit where a copy has an id, else a
    response.  Empty tables give empty archives and results.  Only page_id, url and html are read."""
    spark: SparkSession = pages.sparkSession
    target = target or scratch_path(spark, "archives")
    write_arc(pages, f"{target}/arc", file_bytes)
    convert(spark, f"{target}/arc", f"{target}/warc", least, file_bytes)
    rows = stored(read_warc(spark, f"{target}/warc"), "warc-read")
    responses = rows.filter(F.col("record_type") != "revisit")
    named: Column = F.col("refers_to_id") == F.col("_id")
    revisits = rows.filter(F.col("record_type") == "revisit")
    to = (responses.join(revisits.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
          .groupBy(F.col("record_id").alias("_id")).agg(F.max("page_id").alias("refers_to")))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*names)
            .unionByName(revisits.join(to, named, "left").select(*names)))
