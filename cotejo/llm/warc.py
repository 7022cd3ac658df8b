"""WARC archives with a Zstandard dictionary: one dictionary trained on a bounded sample of the records leads every file in
a skippable frame, and every record is a frame of its own.

Archives are written and read by Spark's own file sources, so any file system that Spark reaches will do. The text
writer puts its line separator behind every row; here that separator is an empty skippable frame, which readers of
Zstandard pass over, so the files hold nothing but frames.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.llm.textops import small_batches
from cotejo.plans.staging import checkpoint_root, staged

#: Fixed values of the format: skippable frame with a dictionary, an empty skippable frame, a frame of data.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
FRAME_MAGIC = 0xFD2FB528

DICTIONARY_BYTES = 64 << 10
#: The dictionary's sample: at most this many records, and this many bytes of each.
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 16 << 10
#: Payload bytes meant for one archive.
ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 1000
_NAMESPACE = uuid.UUID("7d0c1f52-5a4e-4d0f-9a53-6d1d6f0a8b11")


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool,
                 date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the header of its payload only."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES``; with too few samples to train on, their plain bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    at, reader, view = 0, None, memoryview(data)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (None, 0)
        if magic is not None and magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and size:
                known = zstandard.ZstdCompressionDict(data[at + 8:at + 8 + size])
                reader = zstandard.ZstdDecompressor(dict_data=known)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            part = (reader or zstandard.ZstdDecompressor()).decompressobj()
            raw = part.decompress(view[at:])
            if not part.eof:
                raise ValueError("an archive ends within a record")
            at = len(data) - len(part.unused_data)
            yield raw
        else:
            raise ValueError(f"no frame at byte {at}")


def marked_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, is_revisit, refers_to``. Of the rows with equal payloads of at least ``REVISIT_BYTES``,
    those with the largest page_id are responses and the others revisit it; a null page_id is smaller than any."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    long = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = (long.join(first.drop("n"), "digest").filter("first IS NOT NULL AND NOT page_id <=> first")
              .groupBy("page_id", "digest").agg(F.max("first").alias("refers_to")))
    # Written first, so that Spark knows its size: the pages are only dealt anew for it if it is large.
    copies = staged(copies.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"), "warc-copies")
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    joined = rows.join(copies, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "payload", F.col("_digest").isNotNull().alias("is_revisit"), "refers_to")


def sample_payloads(pages: DataFrame, rows: int) -> list[bytes]:
    """Starts of at most ``SAMPLE_RECORDS`` payloads, chosen by a digest of the page id."""
    chosen = pages.filter("html IS NOT NULL")
    if rows > SAMPLE_RECORDS:
        share = 2**32 * 1.2 * SAMPLE_RECORDS / rows
        chosen = chosen.filter(F.xxhash64("page_id", "url").bitwiseAND(0xFFFFFFFF) < F.lit(int(share)))
    start = F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES)
    return [bytes(r[0]) for r in chosen.select(start).limit(SAMPLE_RECORDS).collect()]


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write ``pages`` (``page_id, url, html``) as archives to ``folder``; returns the number meant. A null html is an empty
    payload; repeated rows are repeated records; an empty table gives archives without records. Other columns are not
    read."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    dictionary = train_dictionary([record_bytes(0, "http://example.org/", p, None, False, date)
                                   for p in sample_payloads(pages, size[0])])
    archives = max(1, -(-size[1] // ARCHIVE_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary)
        writer = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        lead = dictionary_frame(dictionary)
        for batch in batches:
            frames = [lead] if lead else []
            lead = b""
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "is_revisit")]
            frames += [writer.compress(record_bytes(*row, date)) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    # Round robin by row: archives of about equal size, whatever the keys.
    frames = marked_pages(pages).repartition(archives).mapInArrow(run, "frame binary")
    (frames.select(F.col("frame").cast("string").alias("value")).write
     .option("lineSep", EMPTY_FRAME.decode()).option("compression", "none").text(folder))
    return archives


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives: ``page_id, record_type, refers_to, url, payload_bytes, payload_digest`` (bare hex
    SHA-1), ``payload`` (null for revisits). The digest of a response is computed from the payload read and must agree with
    its header; else the job ends."""
    small_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows: list[tuple] = []
                held = 0
                for raw in read_frames(content):
                    row = _read_record(raw)
                    rows.append(row)
                    held += len(raw)
                    if held > 4 << 20:
                        yield _records(rows)
                        rows, held = [], 0
                yield _records(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, "page_id bigint, record_type string, refers_to bigint, url string, "
                                 "payload_bytes bigint, payload_digest string, payload binary")


def _read_record(raw: bytes) -> tuple:
    fields, block = parse_record(raw)
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["x-payload-length"]):
            raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (page and int(page), kind, refers and int(refers), fields.get("warc-target-uri"),
            int(fields["x-payload-length"]), digest, payload)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload")
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and report each record without its payload."""
    spark = pages.sparkSession
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
m AS (SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to FROM m"""
