"""WARC archives: records as gzip members, repeated payloads as revisits, and a splittable reader.

Writing tasks put one member a record into archives of their own and list them in a manifest; a task that is run
again writes other files, and only those of the one that counts are listed. The reader cuts archives into byte
ranges. A task looks for gzip's magic bytes in its range, takes a place as a member if it decodes to the header of a
record, and owns the records that start inside its range, the last of which it follows beyond the range's end.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_hot, shared_dir, table

#: Payloads below so many bytes are always written in full.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 1 << 28
RANGE_BYTES = 16 << 20
#: Tasks that ranges are dealt to at most; each takes several ranges beyond.
MOST_TASKS = 20_000
_CHUNK = 1 << 15
_MOST_HEADER = 1 << 20
_BATCH_BYTES = 8 << 20

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URI_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) not in '<>"')


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records (page_id, uri, payload, payload_bytes, digest, record_type, refers_to) of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the response, the others
    revisit it and carry no payload; smaller ones are all responses. A null html is an empty payload. Rows that repeat
    the response's page_id, and copies none of which has an id, are responses too; other rows without an id revisit.
    Payloads are shuffled once, by digest and page_id, so copies of one page spread out; revisits move without.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = rows.filter(F.col("payload_bytes") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"))
    light = ["page_id", "uri", "payload_bytes"]
    again = join_hot(large.select("digest", *light), first, "digest", light).filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = again.select(*light[:2], F.lit(None).cast("binary").alias("payload"), "payload_bytes", "digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    chosen = first.withColumnsRenamed({"digest": "_digest", "first": "_first"})
    full = large.join(chosen, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_first")), "left_semi")
    responses = rows.filter(F.col("payload_bytes") < least).unionByName(full)
    return responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).unionByName(revisits)


def _block(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member in which no other place passes for a member.

    Bytes that do not shrink may stand in a member as they are, an archived archive too. Such a member is made anew
    with a flush within each magic number of the record, which sets its bytes apart.
    """
    for cut in (lambda r: [r], _parted):
        parts = cut(record)
        z, out = zlib.compressobj(6, zlib.DEFLATED, 31), b""
        for part in parts[:-1]:
            out += z.compress(part) + z.flush(zlib.Z_SYNC_FLUSH)
        out += z.compress(parts[-1]) + z.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and _header(memoryview(out)[at:]) is None:
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    raise ValueError("a record cannot be told from the records inside it")


def _parted(record: bytes) -> list[bytes]:
    """A record cut behind the first byte of each magic number."""
    cuts = [0, *(m.start() + 1 for m in re.finditer(re.escape(MAGIC), record)), len(record)]
    return [record[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _header(data: memoryview) -> tuple[dict[str, str], Any, bytes, int] | None:
    """(fields, decoder, what is decoded beyond the header, bytes read) if ``data`` begins a member that holds a record."""
    z, got, read = zlib.decompressobj(31), b"", 0
    try:
        while (end := got.find(b"\r\n\r\n")) < 0:
            if read >= len(data) or z.eof or len(got) > _MOST_HEADER or not _VERSION.startswith(got[: len(_VERSION)]) and not got.startswith(b"WARC/"):
                return None
            part = data[read : read + _CHUNK]
            got += z.decompress(part)
            read += len(part)
    except zlib.error:
        return None
    first, *lines = got[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
        return None
    return fields, z, got[end + 4 :], read


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and its path there; local paths may come as file:/x, file:///x or /x."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _record(row: dict[str, Any], date: str) -> bytes:
    payload, n = row["payload"], row["payload_bytes"]
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http;msgtype=response")]
    if row["uri"] is not None:
        fields.append(("WARC-Target-URI", quote(row["uri"], safe=_URI_SAFE)))
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", _PROFILE)]
    return _block(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + (payload or b""))


def write_archives(records: DataFrame, path: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records (record_id, record_type, uri, payload, payload_bytes, digest, refers_to) below ``path``.

    Each task writes archives of about ``archive_bytes``, each of which begins with a warcinfo record; ``path``/manifest
    lists (file, bytes, records). ``date`` is that of all records, by default now. URIs are percent-encoded where a
    header could not hold them; a null one is left out. No records, no archives.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _fs(path)
        context, out, done = TaskContext.get(), None, []
        name, size, n = "", 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, size, n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= archive_bytes:
                    close()
                    name, size, n = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):05d}.warc.gz", 0, 0
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size += out.write(member(_block(info, b"format: WARC File Format 1.1\r\n")))
                size += out.write(member(_record(row, date)))
                n += 1
        close()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "bytes", "records"])

    columns = ["record_id", "record_type", "uri", "payload", "payload_bytes", "digest", "refers_to"]
    records.select(*columns).mapInArrow(write, "file string, bytes long, records long").write.parquet(f"{path}/manifest")


def _members(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of the records that start in [start, stop)."""
    data = f.read_at(stop - start + len(MAGIC) - 1, start)
    pos = start
    while pos < stop and (at := data.find(MAGIC, pos - start)) >= 0:
        at += start
        view = memoryview(data)[at - start :]
        found = _header(view)
        if found is None and at - start + _MOST_HEADER > len(data):  # a header that the range's end cuts in two
            view = memoryview(f.read_at(_MOST_HEADER, at))
            found = _header(view)
        if found is None:
            pos = at + 1
            continue
        fields, z, rest, read = found
        parts, size = [rest], int(fields["content-length"])
        while not z.eof:
            part = view[read : read + _CHUNK] if read < len(view) else f.read_at(_CHUNK, at + read)
            if not len(part):
                raise ValueError(f"an archive ends within the record at {at}")
            parts.append(z.decompress(part))
            read += len(part)
        block = b"".join(parts)
        if len(block) != size + 4:
            raise ValueError(f"the record at {at} has {len(block) - 4} bytes, not {size}")
        pos = at + read - len(z.unused_data)
        yield at, pos - at, fields, block[:size]


_READ = "file string, offset long, length long, record_id string, record_type string, uri string, date string, refers_to string, digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives that ``path``/manifest lists, read by byte ranges of ``range_bytes``.

    (file, offset, length, record_id, record_type, uri, date, refers_to, digest, payload_bytes, payload); payloads are
    null without ``payloads`` and for revisits, whose size is that of the page they had. A payload that differs from
    its digest, or a record from its length, raises an error; bytes that are no records are passed over.
    """
    manifest = spark.read.schema("file string, bytes long, records long").parquet(f"{path}/manifest").filter("bytes > 0")
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = min(MOST_TASKS, manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1)
    ranges = ranges.select("file", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop")).repartition(int(tasks), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _fs(path)
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{folder}/{r['file']}") as f:
                    for offset, length, fields, block in _members(f, r["start"], r["stop"]):
                        row = _fields(fields, block)
                        if not payloads:
                            row["payload"] = None
                        rows.append({"file": r["file"], "offset": offset, "length": length} | row)
                        held += len(row["payload"] or b"") + 500
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _READ.split(", "))])
    return ranges.mapInArrow(read, _READ)


def _fields(fields: dict[str, str], block: bytes) -> dict[str, Any]:
    """A record's columns; its payload is what follows the header of an HTTP block."""
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    payload, n = None, None
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        n = len(payload)
        if kind == "revisit":
            payload = None
            sizes = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            n = int(sizes[0]) if sizes else None
        elif fields.get("warc-payload-digest", "").startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {bare('warc-record-id')} differs from its digest")
    return {"record_id": bare("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": bare("warc-refers-to"), "digest": digest, "payload_bytes": n, "payload": payload}


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives whose record ids hold the page's number."""
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    write_archives(with_revisits(pages).withColumns({"record_id": urn("page_id"), "refers_to": F.when(F.col("refers_to").isNotNull(), urn("refers_to"))}), path)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    records = read_archives(spark, path, payloads=False).filter(F.col("record_type").isin("response", "revisit"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP13_SQL = """with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select page_id, n::bigint as payload_bytes, p.digest as payload_digest, case when f.first is null or p.page_id is not distinct from f.first then 'response' else 'revisit' end as record_type,
 case when f.first is not null and p.page_id is distinct from f.first then f.first end as refers_to from p left join f on f.digest = p.digest and p.n >= 100"""
