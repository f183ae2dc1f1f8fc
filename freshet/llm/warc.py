"""WARC archives: a deduplicating writer and a salvage reader.

Writer: one gzip member a record (WARC/1.1), files of bounded size below a folder.  Of the records with equal payloads of at
least ``min_bytes`` bytes, that with the smallest page_id is a ``response``, the others are ``revisit`` records that
name it; smaller payloads are all responses.

Salvage reader: reads member after member from a seekable file, with one record and a window of bytes in memory.  Where a member fails a check (gzip frame, version line, header block,
Content-Length, block digest), it logs the bytes from the member's start on as quarantined and searches for the next byte position at
which a whole valid member (or, in uncompressed files, a version line with a valid record) begins; reading goes on
there, so later records are recovered.  :func:`op2_warc` stores the gaps as a quarantine table and fails if there is one, if records are missing, or if a revisit
states another length or digest than the record it refers to: what it returns is whole.

Defined results: null html is an empty payload; null urls are written as an empty target; repeated page_ids give one record each
(rows that share the smallest id of equal payloads are all responses).  Rows with a null page_id can be no other record's target
unless no copy has an id; they carry a null page_id back.  Extra columns are ignored.  An empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common

VERSION = b"WARC/1.1"
#: Uncompressed bytes of the records of one archive.
FILE_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
#: Characters of payloads in one batch of rows.
_BATCH = 8 << 20
#: A record's block is checked against this header by the reader; the payload digest covers the full page.
BLOCK_DIGEST = "WARC-Block-Digest"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record, uncompressed.  A revisit has an empty block; its payload digest and length are those of the full payload."""
    block = payload if kind == "response" else b""
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:freshet:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"{BLOCK_DIGEST}: sha1:{digest32(block)}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:freshet:page:{'' if refers_to is None else refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int
    length: int


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    #: (offset, length, reason) of every stretch of bytes that gave no record.
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class Invalid(Exception):
    pass


#: Bytes read from a file at a time, and the longest header block.
_STEP, _HEADERS = 1 << 16, 1 << 20


class Window:
    """Bytes of a seekable file by their place, with the stretch read last in memory."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.begin, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.begin <= at and at + n <= self.begin + len(self.held)):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(max(n, min(_STEP, self.size - at)))
        return self.held[at - self.begin : at - self.begin + n]

    def find(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on; -1 if there is none."""
        while at < self.size:
            got = self.get(at, _STEP)
            hit = got.find(mark)
            if hit >= 0:
                return at + hit
            at += max(1, len(got) - len(mark) + 1)
        return -1


def parse(data: bytes | Window, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at ``at``; :class:`Invalid` if any check fails."""
    file = data if isinstance(data, Window) else Window(io.BytesIO(data), len(data))
    if file.get(at, 5) != b"WARC/":
        raise Invalid("no version line")
    head, n = b"", _STEP // 16
    while b"\r\n\r\n" not in head:
        if len(head) >= min(_HEADERS, file.size - at):
            raise Invalid("no end of headers")
        head, n = file.get(at, n), 2 * n
    end = at + head.find(b"\r\n\r\n")
    lines = head[: end - at].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        raise Invalid("version line is damaged")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Invalid("header without colon")
        try:
            headers[name.decode("utf-8").strip()] = value.decode("utf-8").strip()
        except UnicodeDecodeError:
            raise Invalid("header not in UTF-8") from None
    length = headers.get("Content-Length", "")
    if not length.isdigit():
        raise Invalid("no content length")
    start = end + 4
    stop = start + int(length)
    if file.get(stop, 4) != b"\r\n\r\n":
        raise Invalid("record does not end where its length says")
    block = file.get(start, stop - start)
    if headers.get(BLOCK_DIGEST, f"sha1:{digest32(block)}") != f"sha1:{digest32(block)}":
        raise Invalid("block digest differs")
    return headers, block, stop + 4


def stream(file, size: int) -> Iterator[Record | tuple[int, int, str]]:
    """The valid records of a seekable archive of ``size`` bytes in its order, and (offset, length, reason) of every gap between them."""
    data = Window(file, size)
    begin = data.get(0, 5)
    zipped = begin[:2] == MAGIC[:2] or (begin != VERSION[:5] and data.find(MAGIC, 0) >= 0)
    mark = MAGIC if zipped else b"WARC/"
    at, bad, reason = 0, None, ""
    while at < size:
        try:
            if zipped:
                body, end = _read_member(data, at)
                headers, block, stop = parse(body)
                if stop != len(body):
                    raise Invalid("bytes after the record")
            else:
                headers, block, end = parse(data, at)
        except Invalid as e:
            if bad is None:
                bad, reason = at, str(e)
            at = data.find(mark, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            yield bad, at - bad, reason
            bad = None
        yield Record(headers, block, at, end - at)
        at = end
    if bad is not None:
        yield bad, size - bad, reason


def salvage(data: bytes) -> Salvaged:
    """Every valid record of an archive in memory, and the byte gaps between them."""
    found = Salvaged()
    for x in stream(io.BytesIO(data), len(data)):
        found.records.append(x) if isinstance(x, Record) else found.gaps.append(x)
    return found


def _read_member(data: Window, at: int) -> tuple[bytes, int]:
    """The plain bytes of the gzip member at ``at``, and its end."""
    z, out, i = zlib.decompressobj(31), [], at
    try:
        while not z.eof and i < data.size:
            got = data.get(i, _STEP)
            out.append(z.decompress(got))
            i += len(got)
    except zlib.error as e:
        raise Invalid(f"gzip: {e}") from None
    if not z.eof:
        raise Invalid("gzip: member is cut off")
    return b"".join(out), i - len(z.unused_data)


# --- Spark --------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``first_id``, the page_id of the response of equal payloads.

    The digests are aggregated without the payloads (one short row a distinct payload and task), then joined back; Spark
    splits the join's skewed partitions.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), common.text_column(pages, "html").alias("html")
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = pages.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    alone = first.where("n > 1").select("sha1", "first_id")
    return pages.join(alone, "sha1", "left").withColumn("refer", F.col("first_id").isNotNull() & (F.octet_length("html") >= min_bytes) & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False)))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; one row a file: file, records, (uncompressed) bytes.  Stage the result before reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            common.put(uri := f"{root}/{common.unique_name('.warc.gz')}", b"".join(held))
            return pa.record_batch({"file": [uri], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "sha1", "first_id", "refer")]
            for row in zip(*cols, strict=True):
                page_id, url, html, sha1, first_id, refer = (x.as_py() for x in row)
                payload = html.encode("utf-8")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode("ascii")
                plain = record("revisit" if refer else "response", page_id, url, payload, digest, len(payload), first_id)
                held.append(member(plain))
                size += len(plain)
                if size >= FILE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return plan_records(pages, min_bytes).mapInArrow(run, "file string, records long, bytes long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string, file string, offset long, length long, gap string"


def _id(value: str | None) -> int | None:
    tail = (value or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Salvage-read archives (column ``file``): one row a record, and one a quarantined gap (``gap`` holds its reason).

    A response's payload length and digest are measured on the bytes read; a response whose payload does not have the
    digest its header states is quarantined too.
    """

    def rows(uri: str) -> Iterator[dict]:
        fs, path = common.fs_path(uri)
        with fs.open_input_file(path) as f:
            yield from found(uri, stream(f, f.size()))

    def found(uri: str, read: Iterator[Record | tuple[int, int, str]]) -> Iterator[dict]:
        for r in read:
            if not isinstance(r, Record):
                yield dict(zip(("file", "offset", "length", "gap"), (uri, *r), strict=True))
                continue
            h = r.headers
            stated = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            kind = h.get("WARC-Type")
            if kind == "response" and digest32(r.block) != stated:
                yield {"file": uri, "offset": r.offset, "length": r.length, "gap": "payload digest differs"}
                continue
            yield {
                "page_id": _id(h.get("WARC-Record-ID")), "payload_bytes": len(r.block) if kind == "response" else int(h.get("X-Payload-Length", "0")), "payload_digest": stated,
                "record_type": kind, "refers_to": _id(h.get("WARC-Refers-To")), "url": h.get("WARC-Target-URI"),
                "payload": r.block.decode("utf-8", "replace") if payloads and kind == "response" else None, "file": uri, "offset": r.offset, "length": r.length, "gap": None,
            }

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in READ_SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(batch.schema.get_field_index("file")).to_pylist():
                held: list[dict] = []
                size = 0
                for row in rows(uri):
                    held.append(row)
                    size += len(row.get("payload") or "")
                    if len(held) >= 2000 or size >= _BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("file").mapInArrow(run, READ_SCHEMA)


class Damaged(ValueError):
    """Archives do not hold what was written to them."""


def unmatched(read: DataFrame) -> DataFrame:
    """Revisits of ``read`` (see :func:`read_archives`) whose length or digest no record that they refer to has, as (refers_to, payload_digest, payload_bytes)."""
    what = ("payload_digest", "payload_bytes")
    asked = read.where("record_type = 'revisit'").select("refers_to", *what).distinct()
    return asked.join(read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *what), ["refers_to", *what], "left_anti")


def op2_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    root = common.scratch(spark, "warc")
    manifest = common.stage(spark, write_archives(pages, f"{root}/archives"), f"{root}/manifest")
    files, records = manifest.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    return checked(spark, read_archives(manifest.repartition(max(1, min(files, 4096))), payloads=False), records, root)


def checked(spark: SparkSession, read: DataFrame, records: int, root: str) -> DataFrame:
    """The records of ``read``, staged below ``root`` with its quarantine table; :class:`Damaged` unless there are ``records`` of them and all agree."""
    found = common.stage(spark, read.drop("url", "payload"), f"{root}/read")
    gaps = found.where("gap is not null").select("file", "offset", "length", "gap")
    n, lost = found.agg(F.count_if(F.col("gap").isNull()), F.count("gap")).first()
    if n != records or lost:
        common.stage(spark, gaps, f"{root}/quarantine")
        raise Damaged(f"{records} records were written, {n} read; {lost} gaps are listed in {root}/quarantine")
    if not unmatched(found).isEmpty():
        raise Damaged("a revisit states another length or digest than the record it refers to")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
         + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
