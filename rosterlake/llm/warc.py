r"""Legacy archives to WARC.

An ARC file starts with a filedesc record that names its version. Version 1 headers have five fields (URL, IP address,
date, content type, length), version 2 headers ten (URL, IP address, date, content type, result code, checksum,
location, offset, file name, length). The body follows by its declared length, so bodies may hold anything, header lines
included. Every http record becomes one WARC record: WARC-Record-ID is a name-based UUID of the record's own content,
WARC-Date is made from the 14 digits, digests are base32 SHA-1, and the type is `response`, or `revisit` where another
record has the same payload.

Archives are read twice, each time a file at a time: first only digests, keys and places leave the tasks, and types are
decided on these; then each file meets the list of its own revisits and is written as WARC. So no message is shuffled by
its payload, and a payload that a third of all pages share costs one row for each task.

Files are written by Spark's text writer, one record to a row: a WARC record ends in two line ends, an ARC record in one
line feed, and the writer adds the last byte. The commit protocol makes retried tasks safe on any file system. Files are
gzipped as a whole, and hold about FILE_MB of records. Bodies are copied byte by byte, whatever their encoding.

Nulls: a null payload is empty, a null URL is `urn:none`, a null key is written as `-` and read back as null. Repeated
rows are records of their own; wholly equal ones share a record id and a type, and of equal keys and payloads the one with
the larger URL is the response. Other columns are not read, whatever their names. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILE_MB = 32
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
KEY_HEADER = "X-Page-Id"


def octets(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def http_message(key: Column, payload: Column) -> Column:
    key = F.coalesce(key.cast("string"), F.lit("-"))
    return F.concat(F.lit(f"HTTP/1.1 200 OK\r\n{KEY_HEADER}: "), key, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), octets(payload), F.lit("\r\n\r\n"), payload)


def in_files(rows: DataFrame, size: Column) -> DataFrame:
    """Deals rows out so that a file holds about FILE_MB of records, the largest record apart.

    Rows of one key are dealt by their other columns, and wholly equal ones by the task they come from, so that no file holds
    all of them. None of it depends on the order of rows, so a task that runs again deals alike.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    files = max(1, -(-int(total) // (FILE_MB << 20)))
    return rows.withColumn("_task", F.spark_partition_id()).repartition(files, F.xxhash64(*rows.columns, "_task")).drop("_task")


def write_arc(pages: DataFrame, path: str, version: int, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000") -> None:
    """Writes pages as ARC files of one version. White space in a URL is percent-encoded."""
    pages = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    address = F.regexp_replace(F.regexp_replace(F.coalesce("u", F.lit("urn:none")), " ", "%20"), r"[\x00-\x20\x7f]", "%20")
    address = F.when(address == "", "urn:none").otherwise(address)
    message = http_message(F.col("k"), F.col("p"))
    rows = in_files(pages, F.octet_length("p") + 300).select(address.alias("a"), message.alias("m"))
    middle = " 0.0.0.0 " + date + " text/html " + ("200 - - 0 legacy.arc " if version == 2 else "")
    record = F.concat("a", F.lit(middle), octets(F.col("m")), F.lit("\n"), "m")
    block = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n"
    filedesc = f"filedesc://legacy.arc 0.0.0.0 {date} text/plain " + ("200 - - 0 legacy.arc " if version == 2 else "") + f"{len(block)}\n{block}"
    # Each file has a filedesc of its own, before its first record.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows.select(F.when(first, F.concat(F.lit(filedesc + "\n"), record)).otherwise(record).alias("value")).write.option("compression", "gzip").text(path)


class Stream:
    """Reads lines and counted bytes from a gzipped or plain file without inflating it whole."""

    PIECE = 1 << 20

    def __init__(self, raw: bytes):
        self.raw, self.next = raw, 0
        self.gz = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
        self.held, self.at = b"", 0  # what is inflated, and how much of it is read
        self.pieces = self._pieces()

    def _pieces(self) -> Iterator[bytes]:
        """The rest of the file, inflated, in pieces of bounded size."""
        while self.next < len(self.raw):
            piece = self.raw[self.next : self.next + self.PIECE]
            self.next += len(piece)
            if self.gz is None:
                yield piece
                continue
            while piece:
                yield self.gz.decompress(piece, self.PIECE)
                piece = self.gz.unconsumed_tail
                if self.gz.eof:
                    piece, self.gz = self.gz.unused_data, zlib.decompressobj(31)

    def _fill(self, wanted: int) -> bool:
        """Drops what is read and inflates until `wanted` bytes are held; False at the end of the file."""
        parts = [self.held[self.at :]]
        size, before = len(parts[0]), len(parts[0])
        while size < wanted and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            size += len(piece)
        self.held, self.at = b"".join(parts), 0
        return size > before

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the file."""
        frm = self.at
        while (k := self.held.find(b"\n", frm)) < 0:
            seen = len(self.held) - self.at
            if not self._fill(2 * seen + 1):
                k = len(self.held) - 1
                break
            frm = seen
        got, self.at = self.held[self.at : k + 1], k + 1
        return got or None

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            self._fill(n)
        if len(self.held) - self.at < n:
            raise ValueError(f"a record declares {n} bytes, {len(self.held) - self.at} are left")
        got, self.at = self.held[self.at : self.at + n], self.at + n
        return got


def arc_records(raw: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """URL, 14-digit date, content type, body of every record of an ARC file of version 1 or 2, the filedesc apart."""
    stream, version = Stream(raw), 1
    while (line := stream.line()) is not None:
        fields = line.decode("utf-8", "replace").split()
        if not fields:
            continue
        if fields[0].startswith("filedesc:"):
            body = stream.take(int(fields[-1]))
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(fields) != len(ARC_FIELDS[version].split()):
            raise ValueError(f"an ARC {version} header has {len(fields)} fields: {line[:200]!r}")
        yield fields[0], fields[2], fields[3], stream.take(int(fields[-1]))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_payload(body: bytes) -> tuple[bytes, bytes]:
    """Header lines and payload of an HTTP message."""
    head, _, payload = body.partition(b"\r\n\r\n")
    return head, payload


def header_fields(head: bytes) -> dict[str, str]:
    """Fields by their names in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def key_of(head: bytes) -> int | None:
    value = header_fields(head).get(KEY_HEADER.lower())
    return int(value) if value and value != "-" else None


def warc_date(digits: str) -> str:
    """Missing digits count as the first day, hour, minute or second."""
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, body: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {hashlib.sha1(body).hexdigest()}')}>"


def read_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """url, date, record_id, key, digest, payload_bytes, path, place (in its file) of all records; both versions may be mixed."""
    schema = "url string, date string, record_id string, key long, digest string, payload_bytes long, path string, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for place, (url, date, _, body) in enumerate(arc_records(raw.as_py())):
                    head, payload = http_payload(body)
                    rows.append((url, warc_date(date), record_id(url, date, body), key_of(head), base32_sha1(payload), len(payload), path, place))
                    if len(rows) >= 10_000:
                        yield as_batch(rows, schema)
                        rows = []
                if rows:
                    yield as_batch(rows, schema)

    return whole_files(spark, *paths).mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Contents of archive files, one row each; a file is far below Spark's row limit, see in_files."""
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(list(paths)).select("path", "content")


def revisits(records: DataFrame) -> DataFrame:
    """path, place, refers_to (key), refers_id of the records that repeat a payload: of equal ones the largest key is the response.

    The largest key of each digest is found by an aggregate with partial results and written, so that the join meets plain
    rows on both sides, and Spark splits a digest that many records share.
    """
    at = records.select("digest", F.struct("key", "url", "record_id").alias("at"))
    best = at.groupBy("digest").agg(F.max("at").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = common.written(best.select(F.col("digest").alias("d"), F.col("best.key").alias("refers_to"), F.col("best.record_id").alias("refers_id")), "responses")
    return records.join(best, F.col("digest") == F.col("d")).where("record_id <> refers_id").select("path", "place", "refers_to", "refers_id")


def warc_record(url: str, date: str, body: bytes, again: dict | None) -> bytes:
    """A WARC/1.1 record, without its last line feed. A revisit keeps its whole HTTP message."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(url, date, body)}", f"WARC-Date: {warc_date(date)}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(http_payload(body)[1])}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
    ]
    if again:
        to = again["refers_to"]
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {again['refers_id']}", f"X-Refers-To-Page: {'-' if to is None else to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r"


def convert_arc(spark: SparkSession, path: str, *arc_paths: str) -> None:
    """Writes the records of ARC files as WARC files at path."""
    records = common.written(read_arc(spark, *arc_paths), "arc-records")
    size = records.agg(F.avg("payload_bytes")).first()[0] or 0
    # As many rows for a file as it has records, see whole_files.
    again = revisits(records).groupBy("path").agg(F.collect_list(F.struct("place", "refers_to", "refers_id")).alias("again"))
    files = whole_files(spark, *arc_paths).join(common.written(again, "revisits"), "path", "left").select("content", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, marks in zip(batch.column("content"), batch.column("again")):
                again = {x["place"]: x for x in marks.as_py() or ()}
                out, held = [], 0
                for place, (url, date, _, body) in enumerate(arc_records(raw.as_py())):
                    out.append(warc_record(url, date, body, again.get(place)))
                    held += len(out[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Bytes become a string as they are.
    rows = files.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.options(compression="gzip", maxRecordsPerFile=max(1, (FILE_MB << 20) // int(size + 700))).text(path)


def warc_records(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of every record of a WARC file."""
    stream = Stream(raw)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts here: {line[:80]!r}")
        head = io.BytesIO()
        while (line := stream.line()) is not None and line.strip():
            head.write(line)
        head = head.getvalue()
        yield head, stream.take(int(header_fields(head).get("content-length") or 0))


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """key, url, date, record_id, payload_bytes, payload_digest (of the bytes read), declared_digest, record_type, refers_to, refers_id."""
    schema = "key long, url string, date string, record_id string, payload_bytes long, payload_digest string, declared_digest string, record_type string, refers_to long, refers_id string" + ", payload string" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for head, block in warc_records(raw.as_py()):
                    http, payload = http_payload(block)
                    get = header_fields(head).get
                    to = get("x-refers-to-page")
                    row = (key_of(http), get("warc-target-uri"), get("warc-date"), get("warc-record-id"), len(payload), base32_sha1(payload), get("warc-payload-digest", "").removeprefix("sha1:"), get("warc-type"), int(to) if to and to != "-" else None, get("warc-refers-to"))
                    rows.append(row + ((payload.decode("utf-8", "replace"),) if with_payload else ()))
                    if len(rows) >= 1000:
                        yield as_batch(rows, schema)
                        rows = []
                if rows:
                    yield as_batch(rows, schema)

    return whole_files(spark, path).mapInArrow(run, schema)
