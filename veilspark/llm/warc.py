"""WARC archives with per-record Zstandard frames and an embedded dictionary.

Every page becomes one record. Of records with equal payloads of at least
``min_revisit`` bytes the one with the smallest ``page_id`` is a ``response``
and carries the payload; the others are ``revisit`` records that name it.
Smaller payloads are always responses.

An archive is a file ``part-<task>-<n>.warc.zst`` in a shared folder: first a
skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame a record, compressed with it, so each record can be read alone.
The dictionary is trained on the archive's own records. Tasks buffer one
archive at a time (``archive_bytes`` of raw records), write it under a
temporary name and move it into place; names depend on the task's number only,
so a retried task replaces its own files.

Records are WARC/1.1 with all mandatory fields. Blocks are HTTP messages, whose
head is made up here (a page table has none); the payload is the body. A
revisit names the response's record id, and its page id in an ``X-`` field.

Defined cases: a null html is an empty payload; a page without a url gets a
``urn:x-page:`` one and reads back with a null url; white space in a url is
written as ``%20``; rows equal in page and payload share a record id; rows with a null ``page_id``
are written and sort before any id; rows that repeat the smallest ``page_id``
of their payload are all responses; an empty table writes no archive and reads
back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
DICT_SAMPLE_BYTES = 4 << 20
DICT_MAGIC = 0x184D2A5D
LEVEL = 3
CHUNK = 16 << 10
NOT_SET = "-"
NO_URL = "urn:x-page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "archive string, records long, bytes long"
READ_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
               "payload_digest string, payload binary, archive string, offset long")


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to``: which pages are written whole and which revisit another.

    Equal payloads are found among ids and digests alone. Payloads are shuffled
    once, by id and digest together, so a payload that many pages share does
    not gather in one task."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.col("payload_bytes") >= min_revisit).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
    first = (large.groupBy(F.col("_digest").alias("_d")).agg(F.min(F.struct("_page")).getField("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").drop("_n"))
    revisits = (large.join(first, F.col("_digest") == F.col("_d")).where(~F.col("_page").eqNullSafe(F.col("_first")))
                .select("_page", "_digest", "_first").distinct())
    met = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_digest").isNotNull()
    return met.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("_first")).alias("refers_to"))


def record_id(page: str, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}').urn}>"


def record_bytes(row, date: str) -> bytes:
    """One WARC record: header lines, an empty line, the block, two line ends.
    A response's block is an HTTP message whose body is the payload; a revisit's
    block is that message's head alone, and names the response's record."""
    page, revisit = row.page_id or NOT_SET, row.record_type == "revisit"
    block = HTTP_HEAD % int(row.payload_bytes) + (b"" if revisit else bytes(row.payload))
    url = "%20".join((row.url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: {record_id(page, row.payload_digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {url or NO_URL + page}", f"WARC-Payload-Digest: sha256:{row.payload_digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
            f"X-Page-ID: {page}", f"X-Payload-Length: {int(row.payload_bytes)}"]
    if revisit:
        response = row.refers_to or NOT_SET
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(response, row.payload_digest)}", f"X-Refers-To-Page-ID: {response}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; with too few of them to train, their bytes are
    the dictionary. The sample bounds the training time only: every record is
    compressed with the result."""
    sample, total = [], 0
    for record in records:
        sample.append(record[:DICT_BYTES])
        total += len(sample[-1])
        if total >= DICT_SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 10)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"\0" * 8)


def archive_bytes(records: list[bytes]) -> bytes:
    words = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    frame = words.as_bytes()
    return b"".join([struct.pack("<II", DICT_MAGIC, len(frame)), frame, *map(packed.compress, records)])


def read_archive(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record."""
    magic, size = struct.unpack_from("<II", blob)
    if magic != DICT_MAGIC:
        raise ValueError("not a WARC archive with a leading dictionary frame")
    words = zstandard.ZstdCompressionDict(blob[8:8 + size])
    unpack, at, view = zstandard.ZstdDecompressor(dict_data=words), 8 + size, memoryview(blob)
    while at < len(blob):
        one, parts, end = unpack.decompressobj(), [], at
        while not one.eof:
            if end >= len(blob):
                raise ValueError("archive ends inside a record")
            parts.append(one.decompress(view[end:end + CHUNK]))
            end += CHUNK
        yield at, b"".join(parts)
        at = min(end, len(blob)) - len(one.unused_data)


def parse_record(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(field["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != field["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block of page {field['X-Page-ID']} does not match its digest")
    number = lambda key: None if field.get(key, NOT_SET) == NOT_SET else int(field[key])
    kind, payload = field["WARC-Type"], block.partition(b"\r\n\r\n")[2]
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {field['X-Page-ID']} does not match its digest")
    url = field["WARC-Target-URI"]
    return (number("X-Page-ID"), None if url.startswith(NO_URL) else url, kind, number("X-Refers-To-Page-ID"), int(field["X-Payload-Length"]),
            digest, payload if kind == "response" else None)


def write_archives(records: DataFrame, folder: str, size: int = ARCHIVE_BYTES, date: datetime | None = None) -> DataFrame:
    """Write the planned records below ``folder`` and, last, a manifest with one
    row an archive (``archive, records, bytes``), which is returned. ``date`` is
    the WARC-Date of all records, the time of this call unless given."""
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, number, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            blob, name = archive_bytes(held), f"part-{task:06d}-{number:05d}.warc.zst"
            attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(attempt, compression=None) as out:
                out.write(blob)
            store.move(attempt, f"{root}/{name}")
            return pd.DataFrame({"archive": [name], "records": [len(held)], "bytes": [len(blob)]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                held.append(record_bytes(row, stamp))
                held_bytes += len(held[-1])
                if held_bytes >= size:
                    yield flush()
                    number, held, held_bytes = number + 1, [], 0
        if held:
            yield flush()
    ids_as_text = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # pandas has no null long
    ordered = ids_as_text.sortWithinPartitions("page_id", "payload_digest")  # the same archives from every attempt
    manifest = f"{folder}/manifest"
    ordered.mapInPandas(write, MANIFEST).write.parquet(manifest)
    return records.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record below ``folder``, payloads checked against their digests.
    A revisit's payload is null; ``refers_to`` names the page that has it."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                out, held = [], 0
                for at, record in read_archive(bytes(blob)):
                    out.append((*parse_record(record), path.rsplit("/", 1)[-1], at))
                    held += len(record)
                    if held >= 8 << 20:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names, dtype=object)
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.warc.zst", recursiveFileLookup=True).load(folder)
    return files.select("path", "content").mapInPandas(read, READ_SCHEMA)
