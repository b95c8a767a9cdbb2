"""WARC archives with one Zstandard frame for each record and the archive's own dictionary in a leading skippable frame.

write() digests every payload, finds in Spark which row of equal payloads is the response (the largest page_id), and
lets each task write the records of its partition into archives: a dictionary is trained on a bounded sample of the
archive's records, put into a skippable frame at its head, and each record is compressed on its own with it. The archives are binary cells of a
table in the shared folder, so that they can be kept in any store that Spark writes to; export() turns them into files.
read_back() parses them.

Null html is an empty payload. Rows with null page_id sort below all others, and refer to the response as the rest
do. Rows that repeat a page_id and its payload are responses each. Blanks and control characters of a URL (line feeds
would end its header) are written, and read back, in per cent form. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: The magic of the skippable frame that holds a dictionary, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_uri(url: str) -> str:
    """A URL that fits one header line: blanks and control characters in per cent form."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id: int | None, url: str, payload: bytes, name: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Target-URI: {plain_uri(url)}"] if url else []
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{name}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def archive(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> bytes:
    """An archive file. The dictionary learns from slices spread over all records, sample_bytes in all; where none can be trained, those slices are the dictionary."""
    import zstandard

    total = sum(map(len, records))
    piece = max(256, min(4096, total // 64))
    slices = [r[at : at + piece] for r in records for at in range(0, len(r), piece)]
    samples = slices[:: max(1, -(-len(slices) * piece // sample_bytes))]
    size = min(dictionary_bytes, sum(map(len, samples)) // 8 + 256)
    try:
        raw = zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        # raw content; its first bytes are text of a record, never the magic number of a trained dictionary
        raw = b"".join(samples)[:size]
    dictionary = zstandard.ZstdCompressionDict(raw)
    lead = struct.pack("<II", SKIPPABLE, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return lead + b"".join(map(press.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive file."""
    import zstandard

    dictionary = None
    if data[:4] == struct.pack("<I", SKIPPABLE):
        (size,) = struct.unpack("<I", data[4:8])
        dictionary, data = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :]
    press = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(data)
    while len(rest):
        one = press.decompressobj()
        parts, at = [], 0
        while not one.eof:
            if at >= len(rest):
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(rest[at : at + 16384]))
            at += 16384
        at = min(at, len(rest)) - len(one.unused_data)
        rest = rest[at:]
        yield b"".join(parts)


def write(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10, sample_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """A table of archives (archive_id, data) of all pages. Payloads smaller than least_bytes are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    # written first: both sides of the join are then plain exchanges, which Spark may split where one payload has very many pages
    first = stored(rows.filter(large).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-first")
    kinds = rows.join(first, "sha1", "left").withColumn("revisit", large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = archive(waiting, dictionary_bytes, sample_bytes, level)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([digest(data)]), pa.array([data], pa.binary())], ["archive_id", "data"])

        for batch in batches:
            for page_id, url, html, first_id, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                waiting.append(record(page_id, url or "", payload, digest(payload), bool(revisit), first_id if revisit else None))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if waiting:
            yield close()

    return stored(kinds.select("page_id", "url", "html", "first", "revisit").mapInArrow(run, "archive_id string, data binary"), "warc", codec="none")


def read_back(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives (columns of ROWS). The digest of a response is computed from the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda s: int(s[10:-1]) if len(s) > 11 else None
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for one in frames(data.as_py()):
                    fields, http, payload = parse(one)
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != name):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                    rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, name, fields["WARC-Type"], refers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("data").mapInArrow(run, ROWS)


def export(archives: DataFrame, folder: str) -> int:
    """Write each archive as a .warc.zst file into a folder that all executors share; gives the number of files."""

    def put(rows) -> Iterator[int]:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(f"{folder}/{row.archive_id}.warc.zst", "wb") as f:
                f.write(row.data)
            yield 1

    return archives.rdd.mapPartitions(put).sum()
