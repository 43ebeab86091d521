"""Web archives: one gzip member per record, written by Spark, read back in sequence with bounded memory.

An archive is a WARC file whose records are gzip members one after another, of bounded bytes unless one record has more.
Spark's text writer writes it: a member ends in the top byte of its length, which is zero for records under 16 MiB, so an
archive without that byte, closed by the writer's separator ``\\0``, is the archive again; after a larger record the
separator is zero padding, which gzip allows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.llm.common import batches, record
from fabgrain.session import durable

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
BLOCK = 1 << 16
SEPARATOR = "\0"
#: Compressed bytes of an archive, unless its only record has more. A reader holds one archive's compressed bytes and one record.
ARCHIVE_BYTES = 1 << 25
#: Longest header that is written, and that a reader accepts, so that a damaged file can't fill its memory.
MOST_HEADER = 1 << 26

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard one for addresses


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class DamagedArchive(ValueError):
    """A record's framing, length or digest does not hold."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def record_id(key: int | None, payload_digest: str) -> str:
    """Rows that repeat a key have records of their own where their payloads differ."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{key}/{payload_digest}')}>"


def _clean(value: str) -> str:
    """A header's value stays on its line: each run of white space becomes one blank, at the ends none."""
    return " ".join(value.split())


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed. A revisit holds the response's headers only and names the record with the payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    own = digest(payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(key, own),
        "WARC-Date": date,
        "WARC-Target-URI": _clean(url or ""),
        "Page-Id": "" if key is None else str(key),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": own,
        "WARC-Block-Digest": digest(block),
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Refers-To": record_id(refers_to, own), "WARC-Profile": REVISIT_PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    top = f"{VERSION}\r\n{lines}\r\n".encode("utf-8", "surrogatepass")
    if len(top) > MOST_HEADER:
        raise ValueError(f"page {key} has an address that makes a header of more than {MOST_HEADER} bytes")
    return top + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A record as a gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def archive(members: list[bytes]) -> bytes:
    """Members one after another, without a last zero byte, as the separator supplies it."""
    out = b"".join(members)
    return out[:-1] if out.endswith(b"\0") else out


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of plain bytes, decompressed as the stream is read."""
    held = b""

    def plain() -> Iterator[bytes]:
        nonlocal held
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            data = unzip.unconsumed_tail or held or stream.read(block)
            held = b""
            if not data:
                raise DamagedArchive("the file ends within a record")
            try:
                if part := unzip.decompress(data, block):
                    yield part
            except zlib.error as e:
                raise DamagedArchive(str(e)) from e
        held = unzip.unused_data

    while True:
        held = held.lstrip(b"\0")
        if not held and not (held := stream.read(block).lstrip(b"\0")):
            if not (more := stream.read(block)):
                return
            held = more
            continue
        yield plain()


def read_record(parts: Iterator[bytes]) -> Record:
    """One record from the plain bytes of its member: headers, a block of the stated length, two line ends."""
    data = bytearray()
    seen = 0
    while (end := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(data)
        if seen > MOST_HEADER or not (part := next(parts, b"")):
            raise DamagedArchive("no end of the headers")
        data += part
    first, *lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise DamagedArchive(f"not a record: {first[:20]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    if not headers.get("Content-Length", "").isdigit():
        raise DamagedArchive("no length")
    size = int(headers["Content-Length"])
    rest = data[end + 4 :]
    for part in parts:  # the length frames the block; what comes beyond must be the closing line ends
        rest += part
        if len(rest) > size + 4:
            break
    if bytes(rest[size:]) != b"\r\n\r\n":
        raise DamagedArchive("the block does not have the stated length")
    block = bytes(rest[:size])
    if (stated := headers.get("WARC-Block-Digest")) and stated != digest(block):
        raise DamagedArchive("the block's digest differs")
    if headers.get("WARC-Type") == "response" and (stated := headers.get("WARC-Payload-Digest")) and stated != digest(payload_of(block)):
        raise DamagedArchive("the payload's digest differs")
    return Record(headers, block)


def payload_of(block: bytes) -> bytes:
    """What follows the headers of the answer."""
    return block.partition(b"\r\n\r\n")[2]


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    return (read_record(parts) for parts in members(stream))


# -- with Spark ----------------------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   least_shared: int = LEAST_SHARED, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per page, in archives of ``archive_bytes``. Of equal payloads of at least ``least_shared`` bytes, the
    largest key holds the response.

    The others become revisits that refer to it; rows that repeat the largest key are all responses. Payloads count as equal
    by length, SHA-1 and SHA-256. A null payload counts as empty; a null key is smaller than any other; a null address is
    written as empty, and white space in an address as single blanks. A header of more than ``MOST_HEADER`` bytes is refused.
    An empty table gives no record. Other columns are not looked at.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"))
    same = ["n_bytes", "sha1", "sha256"]
    rows = rows.withColumns({"n_bytes": F.length("payload"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    large = F.col("n_bytes") >= least_shared
    # Only payloads that occur again are named by a table; where that is small, Spark sends it instead of the payloads.
    shared = durable(rows.where(large).groupBy(*same).agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    known = rows.join(shared, same, "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to")) & large
    schema = pa.schema([("data", pa.binary())])

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in parts:
            for s in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                for row in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    data = member(record_bytes(*row, date))
                    if held and size + len(data) > archive_bytes:
                        yield record(schema, [[archive(held)]])
                        held, size = [], 0
                    held.append(data)
                    size += len(data)
        if held:
            yield record(schema, [[archive(held)]])

    made = known.select("key", "url", "payload", "refers_to", revisit.alias("revisit")).mapInArrow(pack, "data binary")
    made.select(F.col("data").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records: type, ids, address, payload digest (hex) and the payload (null for revisits).

    Each archive is read once, in sequence, record by record; a damaged record stops the read with an error.
    """
    schema = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "refers_to_record", "url", "payload_digest")]
                       + [("key", pa.int64()), ("payload", pa.binary())])

    def rows(content: pa.Buffer) -> Iterator[tuple]:
        for r in read_archive(io.BufferedReader(pa.BufferReader(content))):
            h = r.headers
            response = h["WARC-Type"] == "response"
            yield (h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], hex_digest(h["WARC-Payload-Digest"]),
                   int(h["Page-Id"]) if h["Page-Id"] else None, payload_of(r.block) if response else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for content in b.column(0):
                yield from batches(schema, rows(content.as_buffer()), 200)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_type string, record_id string, refers_to_record string, url string, payload_digest string, key bigint, payload binary")


def payload_table(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """Per record: ``key``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    A revisit's payload is that of the response it refers to, by record id and payload digest; without it the read stops.
    """
    rows = durable(read_archives(spark, path).select("record_type", "record_id", "refers_to_record", "payload_digest", "key",
                                                     F.length("payload").cast("long").alias("payload_bytes")))
    name = ["refers_to_record", "payload_digest"]
    wanted = rows.where("record_type = 'revisit'").select(*name).distinct()
    target = durable(  # stored, so that the join below can be split where one response has very many revisits
        rows.where("record_type = 'response'").withColumnRenamed("record_id", "id").drop("refers_to_record").withColumnRenamed("id", "refers_to_record")
        .join(wanted, name, "left_semi").groupBy(*name).agg(F.max("payload_bytes").alias("n"), F.max("key").alias("to"), F.lit(True).alias("there"))
    )
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes").join(target, name, "left")
    bad = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("refers_to_record")))
    return rows.where("record_type = 'response'").select(
        F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(
        F.col("key").alias(key), F.when(F.col("there"), F.col("n")).otherwise(bad.cast("long")).alias("payload_bytes"), "payload_digest",
        "record_type", F.col("to").alias("refers_to")))
