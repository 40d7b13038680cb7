import hashlib
import re
import struct
from datetime import UTC, datetime

import pytest
import zstandard

from veilspark.llm import warc
from veilspark.session import scratch_path

SCHEMA = "page_id long, url string, html string"
BIG = "<html>" + "ä page of some length " * 20
ROWS = [
    (3, "http://a/1", BIG), (1, "http://a/2", BIG), (2, "http://a/\r\n3", BIG), (4, None, None), (5, "u", ""), (6, "u", "short"),
    (7, "u", "short"), (8, "u", "y" * 100), (9, "u", "y" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "WARC/1.1\r\n\r\n" * 30),
    (2**60 + 1, "u", "x" * 300_000), (None, "n", "n" * 200), (13, "n", "n" * 200),
]


def round_trip(spark, rows, size=warc.ARCHIVE_BYTES):
    folder = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(*r, "e") for r in rows], SCHEMA + ", payload string")
    made = warc.write_archives(warc.plan_records(pages), folder, size).collect()
    assert sum(m["records"] for m in made) == len(rows)
    return folder, warc.read_archives(spark, folder).collect()


@pytest.mark.parametrize("size", [1, 4000, warc.ARCHIVE_BYTES])
def test_round_trip(spark, size):
    _, got = round_trip(spark, ROWS, size)
    first = {}
    for p, _, h in ROWS:
        first[h] = min(first.get(h, p if p is not None else -1), p if p is not None else -1)
    assert len(got) == len(ROWS)
    for r in got:
        html = next(h for p, _, h in ROWS if p == r["page_id"])
        data = (html or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        own = r["page_id"] if r["page_id"] is not None else -1
        if len(data) >= 100 and own != first[html]:
            assert r["record_type"] == "revisit" and r["payload"] is None
            assert r["refers_to"] == (None if first[html] == -1 else first[html])
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == data and r["refers_to"] is None


def test_each_record_can_be_read_alone(spark):
    folder, got = round_trip(spark, ROWS)
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(folder)
    r = next(r for r in got if r["page_id"] == 12)
    blob = store.open_input_file(f"{root}/{r['archive']}").read()
    magic, size = struct.unpack_from("<II", blob)
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(blob[8:8 + size])
    record = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(blob[r["offset"]:])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and b"WARC/1.1\r\n\r\n" * 30 in record


def test_empty_and_repeats(spark):
    folder, got = round_trip(spark, [])
    assert got == []
    _, got = round_trip(spark, [(1, "u", BIG)] * 3 + [(2, "u", BIG)])
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response")] * 3 + [(2, "revisit")]


def test_records_have_the_fields_of_the_standard(spark):
    """Mandatory fields, a block of the length and type named, ids that are
    unique and a revisit that names its response's id."""
    folder = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA)
    warc.write_archives(warc.plan_records(pages), folder, date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)).collect()
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.warc.zst").load(folder).collect()
    seen = {}
    for _, record in (r for f in files for r in warc.read_archive(bytes(f["content"]))):
        version, *lines = record.partition(b"\r\n\r\n")[0].decode().split("\r\n")
        field = dict(line.split(": ", 1) for line in lines)
        assert version == "WARC/1.1" and len(field) == len(lines)
        assert field["WARC-Date"] == "2024-05-06T07:08:09Z" and field["Content-Type"] == "application/http; msgtype=response"
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", field["WARC-Record-ID"]) and re.fullmatch(r"[^\s]+", field["WARC-Target-URI"])
        block = record.partition(b"\r\n\r\n")[2]
        assert block.endswith(b"\r\n\r\n") and len(block) - 4 == int(field["Content-Length"])
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        if field["WARC-Type"] == "response":
            assert field["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        else:
            assert body == b"" and field["WARC-Profile"].endswith("identical-payload-digest")
        assert field["WARC-Record-ID"] not in seen
        seen[field["WARC-Record-ID"]] = field
    assert len(seen) == len(ROWS) - 1
    for field in seen.values():
        if field["WARC-Type"] == "revisit":
            response = seen[field["WARC-Refers-To"]]
            assert response["WARC-Type"] == "response" and response["WARC-Payload-Digest"] == field["WARC-Payload-Digest"]
            assert response["X-Page-ID"] == field["X-Refers-To-Page-ID"]


def test_a_shared_payload_is_spread(spark):
    """Payloads meet the decisions by page and digest: no exchange with payloads
    is keyed by the digest alone."""
    pages = spark.createDataFrame([(i, "u", "z" * 500) for i in range(50)], SCHEMA)
    plan = warc.plan_records(pages)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "page_id" in join and "payload_digest" in join
