"""Archives: exact round trips, byte ranges of every size, copies, members within members, damage."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from placestream.llm import warc
from placestream.llm.shared import shared_dir

PAGES = "page_id long, url string, html string"
BIG = "<p>same</p>" * 20
ROWS = [
    (1, "https://a.example/", "<p>one</p>" * 30), (2, "https://b.example/ü x\r\nEvil: 1", BIG), (3, None, BIG), (4, "https://c.example/", BIG), (5, "u", "short"), (6, "u", "short"), (7, "u", ""), (8, "u", None),
    (9, "u", "\x00\x01é中😀\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (None, "u", BIG), (None, "u", "<b>no id</b>" * 20), (None, "v", "<b>no id</b>" * 20), (2, "https://again.example/", BIG), (10, "u", "x" * 300_000),
]


def read(spark, path, **more):
    return {(r.record_id, r.uri, r.offset): r for r in warc.read_archives(spark, path, **more).collect() if r.record_type != "warcinfo"}


def test_pages_come_back_byte_for_byte(spark):
    path = shared_dir(spark, "warc")
    warc.archive_pages(spark.createDataFrame(ROWS, PAGES).withColumns({"digest": F.lit("clash"), "first": F.lit(1), "_digest": F.lit(2), "payload": F.lit(0)}), path)
    records = list(read(spark, path).values())
    assert len(records) == len(ROWS)
    texts = {n: (h or "").encode() for n, _, h in ROWS if n is not None}
    kinds: dict = {}
    for r in records:
        number = r.record_id.removeprefix("urn:page:")
        kinds.setdefault(number, []).append((r.record_type, r.refers_to))
        if number != "none":
            assert r.payload_bytes == len(texts[int(number)]) and r.digest == hashlib.sha256(texts[int(number)]).hexdigest()
            assert r.payload == (texts[int(number)] if r.record_type == "response" else None)
    full, copy = ("response", None), ("revisit", "urn:page:2")
    assert kinds["2"] == [full, full] and kinds["3"] == kinds["4"] == [copy] and sorted(kinds["none"]) == [full, full, copy]
    assert all(kinds[n] == [full] for n in "1 5 6 7 8 9 10".split())
    assert {r.uri for r in records if r.record_id == "urn:page:2"} == {"https://b.example/%C3%BC%20x%0D%0AEvil:%201", "https://again.example/"}


@pytest.mark.parametrize("step", [64, 700, 5_000, 1 << 20])
def test_every_record_is_owned_by_one_range(spark, step):
    path = shared_dir(spark, "warc")
    warc.archive_pages(spark.createDataFrame(ROWS, PAGES).repartition(3), path)
    if step == 64:  # ranges far smaller than a record
        assert read(spark, path, range_bytes=step).keys() == read(spark, path).keys()
    else:
        assert read(spark, path, range_bytes=step) == read(spark, path)


def test_archives_are_gzip_files_of_a_bounded_size(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("urn:x:"), F.col("id")).alias("record_id"), F.lit("response").alias("record_type"), F.lit("u").alias("uri"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("payload"), F.lit(128).cast("long").alias("payload_bytes"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("string")}).coalesce(1)
    warc.write_archives(rows, f"file://{tmp_path}/a", archive_bytes=10_000)
    files = spark.read.parquet(f"file://{tmp_path}/a/manifest").collect()
    assert len(files) > 3 and sum(f.records for f in files) == 200
    for f in files:
        data = (tmp_path / "a" / f.file).read_bytes()
        assert len(data) == f.bytes <= 11_000
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == f.records + 1
    assert warc.read_archives(spark, f"file://{tmp_path}/a").filter("record_type = 'response'").select("record_id").distinct().count() == 200


def test_a_member_holds_no_other_that_passes_for_one():
    inner = zlib.compressobj(0, zlib.DEFLATED, 31)
    record = warc._block([("WARC-Type", "response")], b"inner")
    nested = inner.compress(record) + inner.flush()
    noise = hashlib.sha256(b"0").digest()
    for i in range(4_000):
        noise += hashlib.sha256(noise[-32:] + bytes([i % 256])).digest()
    whole = warc._block([("WARC-Type", "response")], noise + warc.member(record) + noise + nested)
    made = warc.member(whole)
    assert zlib.decompress(made, 31) == whole
    found = list(warc._members(_file(made * 2), 0, 2 * len(made)))
    assert [at for at, *_ in found] == [0, len(made)]
    assert list(warc._members(_file(made * 2), 1, len(made))) == []


class _file:
    def __init__(self, data):
        self.data = io.BytesIO(data)

    def read_at(self, n, at):
        self.data.seek(at)
        return self.data.read(n)


def test_damage_is_an_error_and_other_bytes_are_passed_over():
    one = warc.member(warc._block([("WARC-Type", "response")], b"x" * 5_000))
    other = gzip.compress(b"not a record") + b"\x1f\x8b\x08 noise"
    found = list(warc._members(_file(other + one + other), 0, len(other + one)))
    assert [at for at, *_ in found] == [len(other)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc._members(_file(one[:-6]), 0, len(one) - 6))
    wrong = warc.member(warc._block([("WARC-Type", "response")], b"x" * 50).replace(b"Content-Length: 50", b"Content-Length: 40"))
    with pytest.raises(ValueError, match="not 40"):
        list(warc._members(_file(wrong), 0, len(wrong)))


def test_a_payload_unlike_its_digest_is_an_error(spark):
    path = shared_dir(spark, "warc")
    row = ("urn:x:1", "response", "u", bytearray(b"abc"), 3, "0" * 64, None)
    warc.write_archives(spark.createDataFrame([row], "record_id string, record_type string, uri string, payload binary, payload_bytes long, digest string, refers_to string"), path)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(spark, path).collect()


def test_no_pages_no_records(spark):
    path = shared_dir(spark, "warc")
    warc.archive_pages(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).collect() == []
