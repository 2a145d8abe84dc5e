"""WARC archives: records, revisits of equal payloads, and a reader that salvages damaged archives.

After a failed check the reader searches for the next valid member or version line, goes on from there, and logs the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CRLF, END = "\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: No archive has more bytes than this, so that one fits in a reader's memory; but one longer record is an archive alone.
ARCHIVE_BYTES = 64 << 20
#: Pages up to these bytes are written together, those beyond the last by the longest: a long page then doesn't make the others' archives small.
SIZE_CLASSES = (16 << 10, 1 << 20)
#: A record's headers end within so many bytes; a gzip member that has none by then is quarantined. Its content may be as long as the headers say.
HEADER_BYTES = 1 << 20
#: Bytes that are read, or inflated, at once.
PIECE = 1 << 20
LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes that belong to no valid record; `reason` is the check that failed at `offset`."""

    offset: int
    length: int
    reason: str


@dataclass
class _Failed(Exception):
    """`end`: where the record ends by its header, length and end mark, if these agree and another record, or nothing, follows."""

    reason: str
    end: int | None = None


@dataclass
class Salvage:
    """Iterates over the valid records of an archive held in memory; afterwards `gaps` has what was passed over.

    A record whose frame is whole but whose content fails its digest is passed over whole: a record that its payload quotes isn't one of the archive's.
    Where the frame is broken the next place that may begin a record is tried.
    """

    data: bytes
    gaps: list[Gap] = field(default_factory=list)
    header_bytes: int = HEADER_BYTES

    def __iter__(self) -> Iterator[Record]:
        at, bad, reason = 0, None, ""
        while at < len(self.data):
            try:
                record = self._gzip(at) if self.data.startswith(MAGIC, at) else self._plain(self.data, at, at)
            except _Failed as e:
                if bad is None:
                    bad, reason = at, e.reason
                at = self._next(at + 1) if e.end is None else e.end
                continue
            if bad is not None:
                self.gaps.append(Gap(bad, at - bad, reason))
                bad = None
            yield record
            at += record.length
        if bad is not None:
            self.gaps.append(Gap(bad, len(self.data) - bad, reason))

    def _next(self, at: int) -> int:
        """The next place at which a record may begin."""
        line, member = VERSION.search(self.data, at), self.data.find(MAGIC, at)
        return min(line.start() if line else len(self.data), member if member >= 0 else len(self.data))

    def _gzip(self, at: int) -> Record:
        """A member is inflated in pieces and kept as far as its record's header says that the record goes, however far that is; a member that holds more is inflated to its end without being kept."""
        unpack, data, place, left = zlib.decompressobj(wbits=31), bytearray(), at, b""
        most, told = self.header_bytes, False
        while not unpack.eof:
            if not left:
                left = self.data[place : place + PIECE]
                place += len(left)
                if not left:
                    raise _Failed("gzip: cut short")
            try:
                piece = unpack.decompress(left, PIECE)
            except zlib.error as e:
                raise _Failed(f"gzip: {e}") from None
            left = unpack.unconsumed_tail
            if len(data) <= most:
                data += piece
                if not told and (head := data.find(b"\r\n\r\n", 0, self.header_bytes + 4)) >= 0:
                    length, told = LENGTH.search(data, 0, head + 2), True
                    most = head + 8 + int(length[1]) if length else len(data)
        end = place - len(unpack.unused_data)
        if len(data) > most:
            raise _Failed("gzip: member holds more than a record" if told else f"gzip: headers of more than {self.header_bytes} bytes", end)
        try:
            record = self._plain(bytes(data), 0, at)
        except _Failed as e:
            raise _Failed(e.reason, end) from None
        if record.length != len(data):
            raise _Failed("gzip: member holds more than a record", end)
        return Record(at, end - at, record.headers, record.block)

    @staticmethod
    def _begins(data: bytes, at: int) -> bool:
        return at == len(data) or data.startswith(MAGIC, at) or VERSION.match(data, at) is not None

    @classmethod
    def _plain(cls, data: bytes, at: int, offset: int) -> Record:
        if not VERSION.match(data, at):
            raise _Failed("no version line")
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            raise _Failed("headers cut short")
        headers: dict[str, str] = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise _Failed("header without colon")
            headers[name.strip().lower()] = value.strip()
        if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
            raise _Failed("no content length")
        start = head + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise _Failed("record end not where its length says")
        block = data[start:end]
        if wrong := differs(headers, block):
            raise _Failed(wrong, end + 4 if cls._begins(data, end + 4) else None)
        return Record(offset, end + 4 - at, headers, block)


def differs(headers: dict[str, str], block: bytes) -> str | None:
    """What a record's digests and lengths say that its block doesn't bear out. Only SHA-256 in hex is compared; a response's payload is its block, unless that is an HTTP message."""
    own: str | None = None
    names = ["warc-block-digest"]
    if headers.get("warc-type") == "response" and not headers.get("content-type", "").startswith("application/http"):
        names.append("warc-payload-digest")
        if (told := headers.get("payload-length")) is not None and told != str(len(block)):
            return "payload length differs"
    for name in names:
        if (told := headers.get(name, "")).startswith("sha256:"):
            own = own or hashlib.sha256(block).hexdigest()
            if told.removeprefix("sha256:").lower() != own:
                return f"{name.removeprefix('warc-').replace('-', ' ')} differs"
    return None


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    return gzip.compress(record, mtime=0)


def classified(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of the records with one payload of at least min_revisit bytes, that with the smallest page_id is a response and the others revisit it;
    among rows that repeat the smallest page_id, all are responses. A null html is an empty payload, a null url an empty one; very long pages are records like others; a null page_id sorts last and, alone in its group, is
    a response. Other columns are left out. Only payloads that occur twice go to the join, and only as digests; they are a written table, which the
    planner sends to all tasks when it is small and joins with split partitions when not.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    again = own.where(F.col("payload_bytes") >= min_revisit).groupBy(F.col("payload_digest").alias("_digest")).agg(F.count("*").alias("n"), F.min("page_id").alias("_first"))
    again = written(again.where("n > 1").select("_digest", "_first"), "payloads")
    out = own.join(again, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_revisit), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first"))}).drop("_digest", "_first")


def record_text():
    """A WARC record without the blank lines that end it, as a column over classified()'s."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", " ")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), clean(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.when(revisit, F.sha2(F.lit(""), 256)).otherwise(F.col("payload_digest"))),
        F.concat(F.lit("Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), clean(F.col("refers_to")), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def sizes(pages: DataFrame) -> DataFrame:
    """payload_bytes of pages(html), as classified() has them, without its join."""
    return pages.select(F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, classes: tuple[int, ...] = SIZE_CLASSES, known: DataFrame | None = None) -> None:
    """Write classified pages as WARC files under path, a folder for each class of sizes that occurs. A record ends with two blank lines, which is the writer's line separator, so the files go through
    Spark's own committer to any store it knows. An archive holds so many records of its class that even the longest together stay below archive_bytes.
    `known` are the pages' sizes(), if they are cheaper to read than pages."""
    size = F.col("payload_bytes")
    own = F.lit(len(classes))
    for k in reversed(range(len(classes))):
        own = F.when(size <= classes[k], F.lit(k)).otherwise(own)
    found = (pages if known is None else known).groupBy(own.alias("k")).agg(F.max(size).alias("longest")).collect()  # one row a class
    if not found:
        pages.select(record_text().alias("value")).write.text(f"{path}/0")
    for r in found:
        text = pages.where(own == r["k"]).select(record_text().alias("value"))
        text.write.option("lineSep", END).option("maxRecordsPerFile", max(1, archive_bytes // (r["longest"] + 2048))).text(f"{path}/{r['k']}")


FOUND = "archive string, offset long, length long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, html string, reason string"


def read_archives(spark: SparkSession, path: str, with_html: bool = True, gaps: str = "rows", header_bytes: int = HEADER_BYTES) -> DataFrame:
    """Salvage all archives under path, at any depth: one row a record, and one of record_type `gap` with its reason for each quarantined gap (gaps="raise": an error instead). A record that fails its
    digests or lengths is quarantined. html is null for revisits and, unless asked for, for all. Repeated records are rows of their own; very long ones are read whole, in the memory of one task; a folder without archives gives no rows."""
    if gaps not in ("rows", "raise"):
        raise ValueError("gaps are rows or raise")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in FOUND.split(", "))])
        for b in batches:
            for k in range(b.num_rows):
                archive, salvage, rows = b["path"][k].as_py(), Salvage(b["content"][k].as_py(), header_bytes=header_bytes), []
                for r in salvage:
                    h, digest = r.headers, r.headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    html = r.block.decode("utf-8", "replace") if with_html and h.get("warc-type") == "response" else None
                    rows.append((archive, r.offset, r.length, h.get("warc-type"), _urn(h.get("warc-record-id")), h.get("warc-target-uri"), _urn(h.get("warc-refers-to")), digest, int(h.get("payload-length", len(r.block))), html, None))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                rows += [(archive, g.offset, g.length, "gap", None, None, None, None, None, None, g.reason) for g in salvage.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select("path", "content").mapInArrow(read, FOUND)
    if gaps == "rows":
        return out
    why = F.concat_ws(" ", F.lit("damaged archive"), "archive", "offset", "reason")
    return out.withColumn("record_type", F.when(F.col("record_type") == "gap", F.raise_error(why).cast("string")).otherwise(F.col("record_type")))


def _urn(value: str | None) -> str | None:
    return (value or "").removeprefix("<urn:page:").removesuffix(">") or None
