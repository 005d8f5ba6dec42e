"""WARC archives: a writer through Spark's committer and a salvaging reader.

:func:`write_warc` writes one record a row: a ``response`` with its HTTP head and
payload, or a ``revisit`` (identical payload digest) with the head alone. Each
record is a gzip member of its own, or plain. Files are written by Spark's text
writer, so they need no path that executors open themselves, and lost tasks
leave nothing behind.

:func:`read_warc` checks every member (CRC, length) and record (version line,
header, Content-Length, end of record, SHA-1 digests). After a failed check it
searches for the next place where a member or record is valid, goes on there,
and logs the bytes between as a ``gap``. The content of a member, as far as it
inflates, is searched for version lines the same way: its valid records are kept,
and gaps have the offsets of the member and, in ``inner_start`` and
``inner_end``, their own in its content. Where the compressed data are corrupt,
only records whose block digest holds are valid. A record that ends where its
length says but whose digest differs is one gap: it isn't searched for records in
its block. So plain bytes and contents are read in time proportional to them,
whatever they hold; members that begin inside a failing member are inflated one
by one.

Defined cases: a null html is an empty payload; a null url or id leaves its
header out and reads back as null; line breaks in a url are percent-encoded;
equal payloads under ``REVISIT_BYTES`` are all responses; rows that share the
largest id of a group are all responses; a group without any id has no
revisits; repeated rows each have their record; very long payloads are written
whole, each to a file of its own at the latest; columns other than the named ones
are ignored, whatever their names; an empty table writes an archive without
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import bounded_batches, materialise

REVISIT_BYTES = 1000
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
#: A file ends with the record that brings it to so many bytes, so that one task can read it.
FILE_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
_ID = "urn:loomtext:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 65_536


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """Bytes of one WARC/1.1 record; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{_ID}{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [
        f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member that ends with a zero byte.

    Its last byte is the high byte of the length, so zero below 16 MiB; a longer
    one is followed by an empty member.
    """
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + member(b"", level)


class Invalid(Exception):
    """A failed check; the message is the reason that is logged. ``end`` is where the record ends, if its own lines and its end agree on that."""

    def __init__(self, reason: str, end: int | None = None) -> None:
        super().__init__(reason)
        self.end = end


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_VERSION_BYTES = 10


class Records:
    """Records of a stretch of bytes, looked for at rising places.

    The header lines up to a blank line are split once, however many version
    lines stand before it, so a search takes time in proportion to the bytes.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.low, self.body = data, 0, -2

    def _lines(self, pos: int) -> None:
        """Hold the header lines after ``pos`` up to the next blank line."""
        if self.body == -1 or self.low <= pos <= self.body:
            return
        self.low, self.body = pos, self.data.find(b"\r\n\r\n", pos)
        self.fields: dict[str, list[tuple[int, str]]] = {}
        self.malformed = -1
        at = pos + _VERSION_BYTES
        if self.body < at:
            return
        for line in self.data[at : self.body].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon:
                self.fields.setdefault(name.decode("latin-1").strip().lower(), []).append((at, value.decode("utf-8", "replace").strip()))
            else:
                self.malformed = at
            at += len(line) + 2

    def at(self, pos: int, sure: bool = True) -> tuple[dict, bytes, int]:
        """(headers in lower case, block, end) of the record at ``pos``, all checks passed; if not ``sure``, a block digest must be there."""
        data = self.data
        if not _VERSION.match(data, pos):
            raise Invalid("no version line")
        self._lines(pos)
        if self.body < 0:
            raise Invalid("header has no end")
        first = pos + _VERSION_BYTES
        if self.malformed >= first:
            raise Invalid("malformed header")
        headers = {name: each[-1][1] for name, each in self.fields.items() if each[-1][0] >= first}
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            raise Invalid("no content length")
        start, end = self.body + 4, self.body + 4 + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            raise Invalid("truncated record" if end + 4 > len(data) else "wrong content length")
        block = data[start:end]
        if not sure and not hex_digest(headers.get("warc-block-digest")):
            raise Invalid("record without digest in a corrupt member", end + 4)
        if not _matches(headers.get("warc-block-digest"), block):
            raise Invalid("block digest differs", end + 4)
        if headers.get("warc-type") != "revisit" and not _matches(headers.get("warc-payload-digest"), payload_of(headers, block)):
            raise Invalid("payload digest differs", end + 4)
        return headers, block, end + 4

    def all(self, sure: bool = True):
        """Yield (start, end, headers, block) and, for the bytes between valid records, (start, end, reason, None)."""
        pos, gap = 0, None
        while pos < len(self.data):
            try:
                headers, block, end = self.at(pos, sure)
            except Invalid as e:
                gap = gap or (pos, str(e))
                found = None if e.end else _VERSION.search(self.data, pos + 1)
                pos = e.end or (found.start() if found else len(self.data))
                continue
            if gap:
                yield gap[0], pos, gap[1], None
                gap = None
            yield pos, end, headers, block
            pos = end
        if gap:
            yield gap[0], pos, gap[1], None


def parse_record(data: bytes, pos: int) -> tuple[dict, bytes, int]:
    """(headers in lower case, block, end) of the record at ``pos``, all checks passed."""
    return Records(data).at(pos)


def payload_of(headers: dict, block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` digest in base 32 or hex, else null."""
    name, _, digest = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", digest):
        return digest.lower()
    try:
        return base64.b32decode(digest).hex()
    except ValueError:
        return None


def _matches(value: str | None, data: bytes) -> bool:
    """Whether a digest holds; unknown algorithms can't be checked and pass."""
    if not value or not value.lower().startswith("sha1:"):
        return True
    return hex_digest(value) == hashlib.sha1(data).hexdigest()


def inflated(data: bytes, pos: int) -> tuple[bytes, int | None, str | None]:
    """Content of the gzip member at ``pos`` up to its end or fault, its end, and the fault; length and CRC are checked."""
    z, out, at, step, view = zlib.decompressobj(31), [], pos, 32, memoryview(data)
    while not z.eof:
        chunk = view[at : at + step]
        if not chunk:
            return b"".join(out), None, "truncated member"
        try:
            out.append(z.decompress(chunk))
        except zlib.error:
            return b"".join(out) + _rest(view[pos:at], chunk), None, "corrupt member"
        at, step = at + len(chunk), min(2 * step, _CHUNK)
    return b"".join(out), at - len(z.unused_data), None


def _rest(sound: memoryview, chunk: memoryview) -> bytes:
    """What ``chunk``, whose inflation fails after that of ``sound``, gives up to the byte of the fault, by halves."""
    z, out = zlib.decompressobj(31), b""
    z.decompress(sound)
    while len(chunk) > 1:
        half, held = chunk[: len(chunk) // 2], z.copy()
        try:
            out += z.decompress(half)
        except zlib.error:
            chunk, z = half, held
        else:
            chunk = chunk[len(half) :]
    return out


#: Heads of members, reserved flags unset, and version lines.
_NEXT = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")


class _Try:
    """What stands at a place: ``units`` are (kind, inner range or none, headers or reason, block)."""

    def __init__(self, data: bytes, plain: Records, pos: int) -> None:
        self.units, self.end, self.reason, self.skip = [], None, None, None
        if data[pos : pos + 2] == b"\x1f\x8b":
            content, self.end, self.reason = inflated(data, pos)
            for start, end, what, block in Records(content).all(self.reason != "corrupt member"):
                if block is not None or self.end is not None:
                    self.units.append(("gap" if block is None else "record", (start, end), what, block))
            return
        try:
            headers, block, self.end = plain.at(pos)
            self.units = [("record", None, headers, block)]
        except Invalid as e:
            self.reason, self.skip = str(e), e.end

    @property
    def resumes(self) -> bool:
        return self.end is not None or any(u[0] == "record" for u in self.units)


def salvage(data: bytes):
    """Yield ("record", start, end, headers, block, inner) and ("gap", start, end, reason, None, inner) over all bytes.

    ``inner`` is the range in the content of the member from start to end, for
    records of members and for gaps in a member whose own checks hold.
    """
    plain, pos = Records(data), 0
    here = _Try(data, plain, pos) if data else None
    while pos < len(data):
        end, after = here.end, None
        if end is None:
            end, at = len(data), here.skip or pos + 1
            while m := _NEXT.search(data, at):
                after = _Try(data, plain, m.start())
                if after.resumes:
                    end = m.start()
                    break
                at = after.skip or m.start() + 1
        for kind, inner, what, block in here.units:
            yield kind, pos, end, what, block, inner
        if here.end is None:
            yield "gap", pos, end, here.reason, None, None
        pos = end
        if pos < len(data):
            here = after if after and after.resumes else _Try(data, plain, pos)


# ---------------------------------------------------------------- tables


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): within equal payloads of ``least`` bytes all but the largest id refer to it.

    Payloads are compared by SHA-1 and length. Only groups of several rows are
    joined back; they are broadcast while they are few.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.when(F.col("n") >= least, F.sha1("payload")))
    groups = rows.where(F.col("digest").isNotNull()).groupBy("digest", "n").agg(F.max("page_id").alias("original"), F.count("*").alias("size"))
    groups = materialise(groups.where("size > 1").select("digest", "n", "original"), "payloads")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(groups, ["digest", "n"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(records: DataFrame, path: str, *, compress: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Write (page_id, url, payload, refers_to) rows as WARC files under ``path``, cut by bytes."""
    bounded_batches(records.sparkSession)

    def run(batches):
        file, size = 0, 0
        for b in batches:
            out, files = [], []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(page_id, url, payload or b"", refers_to)
                out.append(member(data)[:-1] if compress else data[:-1])
                files.append(file)
                size += len(out[-1]) + 1
                if size >= file_bytes:
                    file, size = file + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], names=["record", "file"])

    # every record ends with the same byte, which Spark's writer adds as the line separator
    rows = records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "record binary, file int")
    writer = rows.select(F.col("record").cast("string"), "file").write.option("lineSep", "\0" if compress else "\n")
    writer.partitionBy("file").text(path)


ROW = (
    "path string, status string, start bigint, end bigint, reason string, page_id bigint, record_type string, url string, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, inner_start bigint, inner_end bigint"
)


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def _row(unit: tuple, keep_payload: bool) -> tuple:
    status, start, end, what, block, inner = unit
    inner = inner or (None, None)
    if status == "gap":
        return (status, start, end, what, *[None] * 7, *inner)
    kind = what.get("warc-type")
    if kind == "revisit":
        n = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)\r\n", block)
        size, digest, payload = int(n[1]) if n else None, hex_digest(what.get("warc-payload-digest")), None
    else:
        payload = payload_of(what, block)
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (status, start, end, None, _page(what.get("warc-record-id")), kind, what.get("warc-target-uri"), _page(what.get("warc-refers-to")), size, digest, payload if keep_payload else None, *inner)


def read_warc(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, one task or more for each group of files."""
    schema = pa.schema([
        ("path", pa.string()), ("status", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()),
        ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("inner_start", pa.int64()), ("inner_end", pa.int64()),
    ])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                name, rows = name.as_py(), []
                for unit in salvage(content.as_py()):
                    rows.append((name, *_row(unit, keep_payload)))
                    if len(rows) == 2000:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
