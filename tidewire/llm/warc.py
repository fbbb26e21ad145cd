"""Legacy archives to WARC: ARC 1 and 2 records are parsed and written anew.

An ARC file starts with a version block whose second line names the fields of
every later header line; each record is such a line, then as many bytes as the
line declares, then a line feed.  The converter reads either version and makes
the WARC records that say the same: identifier, timestamp, type and digests are
synthesised.  A payload that another record holds becomes a revisit of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import lookup
from .storage import fresh_path, stage, table
from .textnum import tidy

ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "X-Page-Id"
#: Bytes of ARC converted at a time, and of an archive file before the next begins.
CHUNK, FILE = 4 << 20, 256 << 20
_SPACE = 0x7469646577 << 8


class ArchiveError(ValueError):
    """The bytes are not an archive of the kind they claim to be."""


# -- ARC --------------------------------------------------------------------

def _word(value: str | None) -> str:
    """A header field cannot hold white space or controls, so these are percent-encoded; all else stays as it is, and nothing is a dash."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or ord(c) < 32 or ord(c) == 127 else c for c in value or "") or "-"


class ArcWriter:
    """Records in ARC form, version 1 or 2."""

    def __init__(self, version: int = 1, name: str = "pages.arc", date: str = "19700101000000"):
        self.version, self.name, self.out = version, name, io.BytesIO()
        block = f"{version} 0 tidewire\n{' '.join(ARC_FIELDS[version])}\n".encode()
        self._put(f"filedesc://{name}", "0.0.0.0", date, "text/plain", "-", block)

    def _put(self, url: str, ip: str, date: str, kind: str, status: str, block: bytes) -> None:
        values = [_word(url), ip, date, kind]
        if self.version == 2:
            values += [status, hashlib.md5(block).hexdigest(), "-", str(self.out.tell()), self.name]
        self.out.write(f"{' '.join(values)} {len(block)}\n".encode() + block + b"\n")

    def add(self, url: str | None, block: bytes, ip: str = "0.0.0.0", date: str = "19700101000000", kind: str = "text/html", status: str = "200") -> None:
        self._put(url or "", ip, date, kind, status, block)

    def size(self) -> int:
        return self.out.tell()

    def bytes(self) -> bytes:
        return self.out.getvalue()


def _header(line: str, names: tuple[str, ...]) -> dict[str, str] | None:
    """The fields of a header line, None if it cannot be read.

    Old archives have spaces in URLs and content types, so fields behind the type
    are taken from the end, and the date, with the address before it, parts URL and type.
    """
    values = line.split(" ")
    if len(values) == len(names):
        return dict(zip(names, values))
    if names[:4] != ARC_FIELDS[1][:4] or len(values) < len(names):
        return None
    tail = len(names) - 4
    front, back = values[:-tail], values[len(values) - tail :]
    dates = [k for k in range(2, len(front) - 1) if front[k].isdigit() and len(front[k]) in (8, 12, 14)]
    at = next((k for k in dates if re.fullmatch(r"-|[0-9.]+|[0-9A-Fa-f:]+", front[k - 1])), None)
    if at is None:
        return None
    return dict(zip(names, [" ".join(front[: at - 1]), front[at - 1], front[at], " ".join(front[at + 1 :]), *back]))


def read_arc(data: bytes, bad: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block.

    A record whose header line has a length but cannot be read otherwise raises
    ArchiveError; with a list in ``bad`` it is left out and its line put there.
    Without a length, or with fewer bytes than declared, nothing behind it can be
    found, so that raises always.
    """
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"a header line at byte {at} has no end")
        if end == at or data[at:end].strip() == b"":  # blank lines between records
            at = end + 1
            continue
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        try:
            length = int(line.rpartition(" ")[2])
        except ValueError:
            raise ArchiveError(f"no length in the header line at byte {at}") from None
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) != length:
            raise ArchiveError(f"the record at byte {at} is shorter than it declares")
        if names is None:
            lines = block.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            if not line.startswith("filedesc://") or version not in ("1", "2"):
                raise ArchiveError("no version block")
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[int(version)]
        elif fields := _header(line, names):
            yield fields, block
        elif bad is None:
            raise ArchiveError(f"{len(line.split(' '))} fields in the header line at byte {at}, {len(names)} expected")
        else:
            bad.append(line)
        at = end + 1 + length


# -- WARC -------------------------------------------------------------------

def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page: int) -> str:
    """A record identifier (UUID version 8) that holds a 64-bit page number."""
    u = page & ((1 << 64) - 1)
    return f"urn:uuid:{uuid.UUID(int=(_SPACE << 80) | (8 << 76) | ((u >> 62) << 64) | (2 << 62) | (u & ((1 << 62) - 1)))}"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.removeprefix("urn:uuid:")).int
    if n >> 80 != _SPACE:
        return None
    u = ((n >> 64 & 3) << 62) | (n & ((1 << 62) - 1))
    return u - (1 << 64) if u >> 63 else u


def timestamp(date: str) -> str:
    """A 14-digit ARC date, or a shorter one, as an ISO time."""
    d = (date if date.isdigit() else "") + "19700101000000"[len(date) if date.isdigit() else 0 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    end = block.find(b"\r\n\r\n")
    return (b"", block) if end < 0 or not block.startswith(b"HTTP/") else (block[: end + 4], block[end + 4 :])


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def convert(fields: dict[str, str], content: bytes, revisit_of: int | None = None) -> bytes:
    """One ARC record as a WARC record.

    HTTP content makes a response, or a revisit that keeps the HTTP head; a DNS
    answer or anything else makes a resource.
    """
    head, payload = _split_http(content)
    http = _fields(head)
    kind = "resource" if not head else "response" if revisit_of is None else "revisit"
    page = http.get(PAGE)
    own = page_urn(int(page)) if page else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(fields.values()) + digest(content))}"
    block = head if kind == "revisit" else content
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {timestamp(fields.get('Archive-date', ''))}",
        f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields.get('IP-address', '0.0.0.0')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {'application/http;msgtype=response' if head else fields.get('Content-type', 'application/octet-stream')}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{page_urn(revisit_of)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[Record]:
    """Records of a WARC stream, one in memory at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no record begins with {line[:40]!r}")
        head = [line]
        while (line := stream.readline()).strip():
            head.append(line)
        headers = _fields(b"".join(head))
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ArchiveError("a record is shorter than it declares")
        http, payload = _split_http(block)
        yield Record(headers, block, _fields(http), payload)


# -- on Spark ---------------------------------------------------------------

def _file_system(uri: str):
    """pyarrow's file system of a Hadoop URI, and the path in it."""
    from pyarrow import fs

    for hadoop, arrow in (("s3a://", "s3://"), ("file:/", "file:///")):
        if uri.startswith(hadoop) and not uri.startswith(arrow):
            uri = arrow + uri.removeprefix(hadoop)
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str) -> Callable:
    """Rows (page_id, url, html, winner) to archive files; returns (path, records) of each file."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _file_system(folder)
        system.create_dir(at, recursive=True)
        out, name, records, size, made, version = None, "", 0, 0, [], 1
        arc, whose = ArcWriter(1), []

        def flush() -> None:
            nonlocal out, name, records, size, arc, whose, version
            if not whose:
                return
            if out is None:
                name, records, size = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0  # a retried task writes another file
                out = system.open_output_stream(name, compression=None)
            for (fields, content), of in zip(read_arc(arc.bytes()), whose, strict=True):
                got = gzip.compress(convert(fields, content, of), 1)
                out.write(got)
                size += len(got)
                records += 1
            version = 3 - version
            arc, whose = ArcWriter(version), []
            if size > FILE:
                close()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, records))
                out = None

        for batch in batches:
            for i in range(0, len(batch), 256):
                for page, url, html, winner in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    body = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{'' if page is None else f'{PAGE}: {page}' + chr(13) + chr(10)}Content-Length: {len(body)}\r\n\r\n"
                    arc.add(url, head.encode() + body)
                    whose.append(None if winner is None or winner == page else winner)
                    if arc.size() > CHUNK:
                        flush()
        flush()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["path", "records"])

    return run


def _reader(folder: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as text, io.BufferedReader(text, 1 << 20) as stream:
                    for r in read_warc(stream):
                        said, kind = r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers["WARC-Type"]
                        if kind != "revisit" and digest(r.payload) != said:
                            raise ArchiveError(f"the digest of a record in {path} is wrong")
                        n = int(r.http["Content-Length"]) if kind == "revisit" else len(r.payload)
                        page, of = r.http.get(PAGE), r.headers.get("WARC-Refers-To")
                        rows.append((int(page) if page else None, n, said, kind, page_of(of.strip("<>")) if of else None, r.headers["WARC-Record-ID"].strip("<>"), r.headers["WARC-Target-URI"], r.headers["WARC-Date"]))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) to archives; returns (path, records) of the files.

    Equal payloads are kept once, in the record of the largest page_id; the
    others revisit it.  Null html is an empty payload, empty payloads are equal
    like others, a null url is a dash.  Rows that repeat the largest page_id are
    responses each.  A row without page_id revisits, if any equal row has one.
    Other columns are ignored.  Files of a lost task stay behind unlisted.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    known = stage(rows.groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    repeated, total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    marked = _marked(rows, known, repeated)
    single = marked.filter(~F.col("maybe")).select("page_id", "url", "html", F.lit(None).cast("long").alias("winner"))
    several = lookup(marked.filter("maybe").drop("maybe"), known, "sha1", "n", total).select("page_id", "url", "html", "winner")
    return stage(single.unionByName(several).mapInArrow(_writer(folder), "path string, records long"), "archives", done=(known,))


def _marked(rows: DataFrame, known: DataFrame, repeated: int) -> DataFrame:
    """``rows`` and whether their digest may be one of ``known``: others need no look-up, and their html no shuffle.

    The digests are bits of a bitmap with room for 32 times their number, of 2 ** 28
    bits at most; it is broadcast in rows of 4 KB.
    """
    bits = min(1 << 28, max(1 << 15, 1 << (32 * repeated).bit_length()))
    place = F.pmod(F.xxhash64("sha1"), F.lit(bits)) + 1
    bitmap = known.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = rows.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return at.join(F.broadcast(bitmap), "bucket", "left").select(*rows.columns, maybe.alias("maybe"))


def read_archives(files: DataFrame, folder: str | None = None) -> DataFrame:
    """A row for each record of the files that write_archives listed."""
    spark = files.sparkSession
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"
    return spread.mapInArrow(_reader(folder or fresh_path(spark, "warc")), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(1, 6), lambda c: (instr('0123456789abcdef', substr(hex, 5 * g + c, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b)) AS words FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(words, lambda w: substr('{_ABC}', (w >> 15) + 1, 1) || substr('{_ABC}', ((w >> 10) & 31) + 1, 1) || substr('{_ABC}', ((w >> 5) & 31) + 1, 1) || substr('{_ABC}', (w & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM v
"""
