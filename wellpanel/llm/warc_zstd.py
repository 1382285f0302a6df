"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Archives are written by Spark's text sink into the shared folder, so they reach any file system Spark does and
follow its commit protocol.  Each row of the sink is one frame; the sink's line separator is an empty skippable
frame, which every Zstandard reader passes over.  An archive holds the rows of one task.

Of records with equal payloads (SHA-1 and length) the one with the largest page id is a response; the others
are revisits that carry its id and digest and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import hash_sample, staged, table
from wellpanel.session import staging_path

#: Magic numbers of the dictionary frame, of other skippable frames (low nibble free) and of data frames.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The dictionary is trained on about so many pages, of at most so many characters each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 1 << 15
LEVEL = 3

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; raw content where there is too little to train on."""
    pages = pages.filter("html is not null and html <> ''").select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    sample = sorted(r["html"].encode("utf-8", "replace") for r in hash_sample(pages, "page_id", SAMPLE_PAGES, 19).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if sample else b""
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(quote(c) if c < "!" or c == "\x7f" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(archive: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of each frame, found from the block headers."""
    at = 0
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at)
        start = at
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
        elif magic == FRAME_MAGIC:
            has_checksum = archive[at + 4] & 4
            at += zstandard.frame_header_size(archive[at : at + 18])
            last = False
            while not last:
                head = int.from_bytes(archive[at : at + 3], "little")
                last = bool(head & 1)
                at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            at += 4 if has_checksum else 0
        else:
            raise ValueError(f"no Zstandard frame at byte {start}")
        if at > len(archive):
            raise ValueError(f"truncated frame at byte {start}")
        yield magic, archive[start:at]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; malformed records and wrong lengths are errors."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header {line!r}")
        headers[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ValueError(f"record without {needed}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {headers['warc-record-id']} does not have its {length} bytes")
    return headers, rest[:length]


def _id(urn: str) -> int | None:
    """The page id of a record of this writer; other writers' names have none."""
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def _unpacked(frame: bytes, reader: zstandard.ZstdDecompressor) -> bytes:
    """A frame's content, also where its header does not tell the size."""
    try:
        return reader.decompressobj().decompress(frame)
    except zstandard.ZstdError as error:
        raise ValueError(f"frame cannot be decompressed: {error}") from error


def _dictionary(stored: bytes) -> zstandard.ZstdDecompressor:
    """The decompressor of a dictionary frame; the dictionary in it may be compressed itself, or empty."""
    if stored[:4] == struct.pack("<I", FRAME_MAGIC):
        stored = _unpacked(stored, zstandard.ZstdDecompressor())
    return zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(stored)) if stored else zstandard.ZstdDecompressor()


def _content(headers: dict[str, str], block: bytes) -> tuple[int, str | None, bytes | None]:
    """(payload bytes, sha1 digest, payload) of a record: of the HTTP body if it holds one, else of the whole block."""
    kind, given = headers["warc-type"], headers.get("warc-payload-digest", "")
    digest = given.removeprefix("sha1:").upper() if given.startswith("sha1:") else None
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in http.decode("utf-8", "replace").split("\r\n")[1:])}
        told = fields.get("content-length", "")
        size = int(told) if told.isdigit() else len(payload)
    if kind == "revisit":
        return size, digest, None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if len(payload) != size or (digest is not None and digest != found):
        raise ValueError(f"record {headers['warc-record-id']} does not match its length or digest")
    return size, found, payload


def read_archive(archive: bytes) -> Iterator[tuple]:
    """The records of one archive, checked, as rows of ``READ`` and their payload (None for a revisit).

    Archives of other writers are read as well: without a dictionary, with a compressed one, with frames that do not
    tell their size, with records that hold no HTTP message (their payload is the block) and without payload digests.
    """
    reader = None
    for magic, frame in frames(memoryview(archive)):
        if magic == DICTIONARY_MAGIC and reader is None:
            reader = _dictionary(bytes(frame[8:]))
        elif magic == FRAME_MAGIC:
            reader = reader or zstandard.ZstdDecompressor()
            headers, block = parse(_unpacked(bytes(frame), reader))
            size, digest, payload = _content(headers, block)
            kind, name = headers["warc-type"], headers["warc-record-id"]
            refers = _id(headers.get("warc-refers-to", "")) if kind == "revisit" else None
            yield (_id(name), headers.get("warc-target-uri"), size, digest, kind, refers, name), payload


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``path``.

    Payloads below ``least_bytes`` are never revisits.  Which digests repeat is stored first, so that its size
    decides how it is joined; where nothing repeats, no page is shuffled.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest, size = F.sha1(F.col("html").cast("binary")), F.octet_length("html")
    repeated = staged(
        pages.filter(size >= least_bytes).groupBy(digest.alias("digest"), size.alias("size")).agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
        .filter("copies > 1").drop("copies"),
        "repeated",
    )
    marked = (
        pages.withColumns({"digest": digest, "size": size}).join(repeated, ["digest", "size"], "left")
        .select("page_id", "url", F.col("html").cast("binary").alias("html"), F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))
    )
    dictionary = train_dictionary(pages)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        leading = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = leading + [writer.compress(record(r["page_id"], r["url"], r["html"], r["refers_to"])) for r in rows]
                leading = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    marked.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Rows of ``READ`` for every record of the archives below ``path``, and its bytes with ``payload``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])
        for batch in batches:
            for archive in batch.column("content"):
                rows, bodies = [], []

                def out() -> pa.RecordBatch:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    return pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.binary())] * payload, names=schema.names + ["payload"] * payload)

                for row, body in read_archive(archive.as_py()):
                    rows.append(row)
                    bodies.append(body if payload else None)
                    if len(rows) == 1024:
                        yield out()
                        rows, bodies = [], []
                if rows:
                    yield out()

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(read, READ + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and return the digest columns of what is read back.

    Null and empty pages have an empty payload, and so are copies of each other.  A null page id is written as such
    and is a revisit if a copy has an id.  Rows that repeat the largest id of their payload are responses all.  A
    null url is left out of the record.  An empty table writes no archive and gives an empty result.
    """
    spark = pages.sparkSession
    path = staging_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS newest FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM m
"""
