"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are written by Spark's text writer, whose line separator is the last CRLF of a record, so
that every file is a plain WARC file wherever Spark can write. Archives are read as binary files;
where a check fails the reader looks for the next gzip member or version line that passes, goes on
there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

_PLACE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
RECORD_URN = "urn:matloom:page:"


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def payload(self) -> bytes:
        """The block, without its HTTP header if it has one."""
        if self.headers.get("content-type", "").startswith("application/http"):
            head, mark, body = self.block.partition(b"\r\n\r\n")
            return body if mark else b""
        return self.block

    def http_length(self) -> int | None:
        found = re.search(rb"(?mi)^content-length: *([0-9]{1,18})\r?$", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else None


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    """A check of a record failed."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(whole: bytes | bytearray, at: int) -> Record:
    """The record whose version line is at ``at``; raises Damaged if any check fails."""
    headers: dict[str, str] = {}
    last = ""
    line_end = whole.find(b"\r\n", at)
    while True:  # line by line, of any length: what is no header line ends the search
        begin = line_end + 2
        line_end = whole.find(b"\r\n", begin)
        if line_end < 0:
            raise Damaged("header without end")
        if line_end == begin:
            break
        line = whole[begin:line_end]
        if line[:1] in (b" ", b"\t") and last:
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line without colon")
        last = name.strip().decode("utf-8", "replace").lower()
        headers[last] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damaged("no content length")
    begin, end = line_end + 2, line_end + 2 + int(length)
    if end + 4 > len(whole):
        raise Damaged("cut off")
    if whole[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end mark after the block")
    record = Record(at, end + 4, headers, bytes(whole[begin:end]))
    claimed = headers.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed[5:] != digest32(record.block):
        raise Damaged("block digest differs")
    claimed = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and claimed.startswith("sha1:") and claimed[5:] != digest32(record.payload()):
        raise Damaged("payload digest differs")
    return record


def _unzipped(whole: bytes, at: int, step: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """The content of the gzip member at ``at`` in pieces, each with the place up to which the file is read; then the member's end."""
    unzip, pos, view, rest = zlib.decompressobj(31), at, memoryview(whole), b""
    while not unzip.eof:
        if not rest:
            if pos >= len(whole):
                raise Damaged("gzip member cut off")
            rest, pos = view[pos : pos + 65536], min(pos + 65536, len(whole))  # in steps, for what is not used is copied
        try:
            piece = unzip.decompress(rest, step)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        rest = unzip.unconsumed_tail
        yield piece, pos - len(unzip.unused_data)


def _member(whole: bytes, at: int) -> Iterator[Record]:
    """The records of the gzip member at ``at``, with the member's place, once all of it has passed its checks.

    The member is unzipped twice, to check it and to give out its records, so that no more than a
    record is held of it, however large it is.
    """
    end = at
    count, place = 0, [at]
    for _ in _records(whole, at, place):
        count += 1
    if not count:
        raise Damaged("empty gzip member")
    for record in _records(whole, at, [at]):
        record.start, record.end = at, place[0]
        yield record


def _records(whole: bytes, at: int, place: list[int]) -> Iterator[Record]:
    """Records of the gzip member at ``at``; raises Damaged where a check fails. place[0] is up to where the file is read."""
    held, pos, wanted = bytearray(), 0, 1
    pieces, done = _unzipped(whole, at), False
    while True:
        while not done and len(held) - pos < wanted:
            piece, place[0] = next(pieces, (None, place[0]))
            done = piece is None
            held += piece or b""
        if done and pos == len(held):
            return
        record = None
        if done or len(held) - pos >= 10:
            if not held.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), pos):
                raise Damaged("gzip member without version line")
            try:
                record = _plain(held, pos)
            except Damaged:
                if done:
                    raise
        if record is None:  # perhaps only not read to its end: on with twice as much
            wanted = max(2 * (len(held) - pos), 65536)
            continue
        pos, wanted = record.end, 1
        if pos > 1 << 20:
            del held[:pos]
            pos = 0
        yield record


def salvage(whole: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of a plain or gzip archive, in order; together they cover it all."""
    at, bad, why = 0, None, ""
    while at < len(whole):
        try:
            if whole.startswith(b"\x1f\x8b\x08", at):
                found: Iterator[Record] = _member(whole, at)
            elif whole.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
                found = iter([_plain(whole, at)])
            else:
                raise Damaged("neither version line nor gzip member")
            first = next(found)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            later = _PLACE.search(whole, at + 1)
            at = later.start() if later else len(whole)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        at = first.end
        yield first
        yield from found
    if bad is not None:
        yield Gap(bad, at, why)


def base32_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given in hex: four characters for every five hex digits."""
    parts = []
    for k in range(8):
        v = F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> None:
    """One WARC 1.1 record per row in plain archives under ``path``.

    Of the rows with equal payloads of at least ``least_bytes`` bytes, those of the smallest id
    become response records and the others revisits; smaller payloads are all responses. Null
    payloads are empty, null urls an empty target. Rows that repeat the smallest id are all
    responses; a null id comes last and is written as an empty name. An empty table gives an empty
    archive; other columns are not read. A file holds as many records as come to ``file_bytes`` by
    the mean payload, so that it is a value and a task of bounded size for read_warc.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    owners = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = materialize(owners.where("n > 1").select(F.col("sha1").alias("of"), "first"), "warc-shared")
    met = rows.join(shared, (F.col("sha1") == F.col("of")) & (F.col("bytes") >= least_bytes), "left")
    again = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    end = "\r\n"
    name = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    met = met.withColumn("http", F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("bytes").cast("string"), F.lit(end + end)))
    met = met.withColumn("block", F.when(again, F.col("http")).otherwise(F.concat("http", "body"))).withColumn("digest", base32_sha1(F.col("sha1")))
    url = F.regexp_replace("url", "[\\r\\n]+", " ")
    record = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{end}WARC-Date: {date}{end}WARC-Target-URI: "), url,
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), F.octet_length("block").cast("string"),
        F.lit(end + end), F.col("block"), F.lit(end),
    )
    most = max(1, int(file_bytes / (mean + 600)))
    met.select(record.alias("value")).write.option("lineSep", end).option("compression", "none").option("maxRecordsPerFile", most).text(path)


def read_warc(spark: SparkSession, path: str, most_bytes: int = (1 << 31) - 1) -> DataFrame:
    """Records and gaps of all archives under ``path``, whole and damaged alike.

    Columns: file, start, end, gap (why bytes were quarantined; null for records), record_id,
    record_type, url, refers_to, payload (null for gaps), payload_bytes and payload_digest (of the
    full payload, which for revisits is told by their headers). An archive is read by one task, as
    one value of at most 2 GB: keep files to some hundred MB, as write_warc does. One of more than
    ``most_bytes`` is a gap as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, rows, held = batch.column(0)[k].as_py(), [], 0
                for r in salvage(batch.column(1)[k].as_py()):
                    rows.append(_row(file, r))
                    held += r.end - r.start
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    texts = ["gap", "record_id", "record_type", "url", "refers_to"]
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((t, pa.string()) for t in texts), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kinds = "file string, start bigint, end bigint, " + ", ".join(f"{t} string" for t in texts)
    found = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, f"{kinds}, payload binary, payload_bytes bigint, payload_digest string")
    whole = {"file": F.col("path"), "start": F.lit(0).cast("bigint"), "end": F.col("length"), "gap": F.lit("archive too large")}
    large = files.where(F.col("length") > most_bytes).select(*(whole.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema))
    return found.unionByName(large)


def _row(file: str, r: Record | Gap) -> dict:
    if isinstance(r, Gap):
        return {"file": file, "start": r.start, "end": r.end, "gap": r.reason}
    kind = r.headers.get("warc-type")
    out = {"file": file, "start": r.start, "end": r.end, "record_id": r.headers.get("warc-record-id", "").strip("<>"), "record_type": kind, "url": r.headers.get("warc-target-uri")}
    if kind == "revisit":
        claimed = r.headers.get("warc-payload-digest", "")
        return out | {"refers_to": r.headers.get("warc-refers-to", "").strip("<>"), "payload_bytes": r.http_length(), "payload_digest": claimed.removeprefix("sha1:")}
    data = r.payload()
    return out | {"payload": data, "payload_bytes": len(data), "payload_digest": digest32(data)}


def page_of(name: Column) -> Column:
    """The page id in a record's name."""
    return F.nullif(F.regexp_extract(name, f"^{RECORD_URN}(-?[0-9]+)$", 1), F.lit("")).cast("bigint")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """What read_warc finds in the archives that write_warc makes of ``pages``; an empty table gives no rows."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, **options)
    return read_warc(spark, path)
