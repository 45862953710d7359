"""Operator 3: token ids in a content-addressed store with recipes and Merkle manifests.

A store is a folder with three Parquet tables, so that any Spark file system can hold it:

``chunks``    key (SHA-256 of the packed ids), n, ids: every distinct chunk once.
``recipes``   rid, doc_id, n_tokens, root, keys: one row a document, files and rows in ascending
              doc_id order (nulls first, ties by root); rid is the part number times 2**33 plus the
              place in the part; root is the Merkle root of the chunk keys.
``manifest``  part, n_docs, n_tokens, root: Merkle roots over the documents of each part.

Ids are packed as little-endian integers of 16 bits where the vocabulary allows it, else 32 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .shared import join_hot, shared_dir, table
from .words import buffers, mix, slices

#: Chunk sizes in ids, and the ids that the rolling hash sees (fewer than the least size).
LEAST_CHUNK, MEAN_CHUNK, MOST_CHUNK = 256, 1024, 4096
ROLLING = 32
#: Children of an inner node of the manifests' trees.
FAN_OUT = 1024
END_ID = 0
_PART_BITS = 33


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """A gear hash of the ROLLING ids that end at each place, built by doubling its span."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    span = 1
    while span < ROLLING:
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    return h


def cut_points(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Chunk lengths of each document: a chunk ends where the rolling hash has its top bits zero.

    The least chunk is longer than the hash's span, so cuts depend on the document's own ids only.
    """
    marks = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - (MEAN_CHUNK - LEAST_CHUNK).bit_length() + 1) == 0) + 1
    out, begin = [], 0
    for n in sizes.tolist():
        end, at, lengths = begin + n, begin, []
        while end - at > LEAST_CHUNK:
            k = np.searchsorted(marks, at + LEAST_CHUNK)
            stop = min(int(marks[k]) if k < len(marks) else end, at + MOST_CHUNK, end)
            lengths.append(stop - at)
            at = stop
        if at < end:
            lengths.append(end - at)
        out.append(lengths)
        begin = end
    return out


def merkle_root(keys: list[bytes]) -> bytes:
    """Binary tree of SHA-256 over the keys; an odd node moves up as it is."""
    level = list(keys)
    while len(level) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]  # noqa: B905
        level = pairs + level[len(level) & ~1 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def _encoded(docs: DataFrame, json: str, dtype: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, root, keys, sizes, chunks) of every row, from one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            doc_ids = batch.column(0)
            for i, raw, offs in slices(*buffers(batch.column(1))):
                ids, n = encoder.encode(raw, offs)
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                cuts = cut_points(ids, n)
                flat = np.array([c for doc in cuts for c in doc], np.int64)
                packed, width = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
                edges = np.concatenate([[0], np.cumsum(flat)]) * width
                chunks = [packed[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                keys = [hashlib.sha256(c).digest() for c in chunks]
                lists = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
                roots = [merkle_root(keys[a:b]) for a, b in zip(lists[:-1], lists[1:], strict=True)]
                offsets = pa.array(lists, pa.int32())
                yield pa.record_batch(
                    [doc_ids.slice(i, len(n)), pa.array(n), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(chunks, pa.binary()))],
                    names=["doc_id", "n_tokens", "root", "keys", "sizes", "chunks"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, root binary, keys array<binary>, sizes array<int>, chunks array<binary>")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(json: str) -> Encoder:
    """The worker's encoder, kept from task to task with the pieces it knows."""
    digest = hashlib.sha256(json.encode()).hexdigest()
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(json)
    return _ENCODERS[digest]


def _hashed(children: str) -> Column:
    """SHA-256 of the children's hex roots on end."""
    return F.unhex(F.sha2(F.expr(f"array_join(transform({children}, x -> hex(x.root)), '')").cast("binary"), 256))


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): a tree of FAN_OUT-ary nodes over the documents of each part."""
    part, place = F.shiftrightunsigned("rid", _PART_BITS).alias("part"), F.col("rid").bitwiseAND((1 << _PART_BITS) - 1)
    level = recipes.select(part, place.alias("place"), "root", "n_tokens", F.lit(1).cast("long").alias("n_docs"))
    for _ in range(3):  # 1024**3 documents a part
        nodes = level.groupBy("part", F.floor(F.col("place") / FAN_OUT).alias("place")).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("place", "root"))).alias("_children")
        )
        level = nodes.select("part", "place", _hashed("_children").alias("root"), "n_tokens", "n_docs")
    return level.select("part", "n_docs", "n_tokens", "root")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write the store at ``path``.

    Null text counts as empty and is the end id alone; a null doc_id sorts first; repeated rows are
    documents of their own that share their chunks; an empty table gives empty tables. Texts are
    encoded once into a staged table, whose payload is shuffled once, by key, to keep each distinct
    chunk once; recipes move without payload.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's file; tasks get its text
        json = f.read()
    vocabulary = Encoder(json).tokenizer.get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    staged_path = f"{path}/staged"
    _encoded(docs, json, dtype, end_id).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    each = staged.select(F.explode(F.arrays_zip("keys", "sizes", "chunks")).alias("c"))
    chunks = each.select(F.col("c.keys").alias("key"), F.col("c.sizes").alias("n"), F.col("c.chunks").alias("ids")).dropDuplicates(["key"])
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    # the row parts documents that share an id and a text, so that no key of the ranges is hot
    order = F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("row")
    ordered = staged.select("doc_id", "n_tokens", "root", "keys", "row").repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    ordered.select(F.monotonically_increasing_id().alias("rid"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed."""
    p = 0
    for _ in range(32):
        if a & 0x80000000:
            p ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return p


@lru_cache(1 << 14)
def _shift(n: int) -> int:
    """x to the power 8n modulo the CRC-32 polynomial: what n more bytes do to a checksum."""
    square, power = 0x00800000, 0x80000000
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return power


def crc32_joined(parts: Iterator[tuple[int, int]]) -> int:
    """The checksum of byte strings on end, from their own (checksum, length)."""
    total = 0
    for crc, n in parts:
        total = _times(_shift(n), total) ^ crc
    return total


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, crc, ok) of every chunk file row: read whole, unpacked, held against its key."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, data = (batch.column(k).to_pylist() for k in range(3))
            crc, ok = [], []
            for k, n, d in zip(keys, sizes, data, strict=True):
                wide = np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4").astype("<u4")
                crc.append(zlib.crc32(wide.tobytes()))
                ok.append(len(wide) == n and hashlib.sha256(d).digest() == k)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], names=["key", "n", "crc", "ok"])

    return spark.read.parquet(f"{path}/chunks").select("key", "n", "ids").mapInArrow(check, "key binary, n int, crc long, ok boolean")


def starts(recipes: DataFrame) -> DataFrame:
    """(rid, start): ids of all documents before each, from sums a part and sums within the part."""
    part = F.shiftrightunsigned("rid", _PART_BITS)
    rows = recipes.select("rid", "n_tokens", part.alias("part"))
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return local.join(sums, "part").select("rid", (F.col("base") + F.col("local")).alias("start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document, read back from the files.

    Every chunk is unpacked and held against its key, every recipe against its root, and every part
    against its manifest; a difference raises an error. Checksums of documents are joined from those
    of their chunks, so no ids are shuffled. A chunk that many documents share is met once.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("rid", F.posexplode("keys").alias("seq", "key"))
    joined = join_hot(refs.select("key", "rid", "seq"), checked_chunks(spark, path), "key", ["rid", "seq"])
    listed = joined.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc", "ok", "key"))).alias("chunks"))
    whole = recipes.select("rid", "doc_id", "n_tokens", "root").join(listed, "rid", "left").join(starts(recipes), "rid")
    whole = whole.withColumn("chunks", F.coalesce("chunks", F.expr("cast(array() as array<struct<seq: int, n: int, crc: bigint, ok: boolean, key: binary>>)")))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, good = [], []
            for chunks, root, n in zip(*(batch.column(k).to_pylist() for k in (3, 4, 2)), strict=True):
                ok = all(c["ok"] for c in chunks) and merkle_root([c["key"] for c in chunks]) == root and sum(c["n"] for c in chunks) == n
                good.append(ok)
                crc.append(crc32_joined((c["crc"], 4 * c["n"]) for c in chunks) if ok else 0)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64()), pa.array([len(c) for c in batch.column(3).to_pylist()], pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "ok"])

    digests = whole.select("doc_id", "start", "n_tokens", "chunks", "root").mapInArrow(join_up, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, ok boolean")
    again = manifest_of(recipes).select("part", F.col("root").alias("again"))
    wrong = spark.read.parquet(f"{path}/manifest").join(again, "part", "full_outer").filter(~F.col("root").eqNullSafe(F.col("again")))
    if not wrong.isEmpty():
        raise ValueError(f"recipes of {path} differ from their manifest")
    checked = F.when(F.col("ok"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit(f"a document of {path} cannot be rebuilt")).cast("long"))
    return digests.select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"), "n_chunks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents themselves, rebuilt from recipes and chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("rid", F.posexplode("keys").alias("seq", "key"))
    listed = join_hot(refs.select("key", "rid", "seq"), spark.read.parquet(f"{path}/chunks"), "key", ["rid", "seq"]).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "ids"))).alias("chunks"))
    whole = recipes.select("rid", "doc_id").join(listed, "rid").join(starts(recipes), "rid")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["ids"], "<u2" if len(c["ids"]) == 2 * c["n"] else "<u4").astype(np.int32) for c in chunks]) for chunks in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "chunks").mapInArrow(unpack, "doc_id long, start long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path or default_tokenizer())
    return read_digests(spark, path)
