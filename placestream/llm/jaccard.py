"""Operator 1: n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. One pass over the texts gives each its identity (a hash of its words) and its band hashes.
2. Texts of one identity become one; of these, texts that share a band form candidate clusters.
3. The members' n-gram sets are made again and compared in bounded blocks of each cluster. Tasks
   give back counts of links and a spanning forest of them, never the pairs.
4. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SALTS, cut, join_hot, shared_dir, table
from .words import PLAIN, Words, buffers, mix, powers, shingles, slices, words

NGRAM, THRESHOLD = 5, 0.8
#: Chance that a pair exactly at the threshold shares a band, and the hashes it may cost.
RECALL, MOST_HASHES = 0.999, 144
#: Texts of a cluster compared with one another in one task, and their n-grams; twice as many in a pair
#: of blocks. Texts are dealt to blocks by a hash, so these are means, and a longer text is not cut.
BLOCK, GRAMS_A_BLOCK = 512, 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"{most} hashes cannot reach recall {recall} at similarity {threshold}")
    return best


def ngrams(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, row) of a slice; a text shorter than an n-gram is one n-gram as a whole."""
    h, at = shingles(hashes, w.row, NGRAM)
    row = w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < NGRAM))
    if len(short):
        whole = identities(w, hashes)[short]
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def identities(w: Words, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the word sequence of each row."""
    up, down = powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    return mix((total[w.first + w.count] - total[w.first]) * down[w.first] + w.count.astype(np.uint64))


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc, key, n_grams, bands) of every row, ``doc`` being the row; key and bands are null where the text has no word."""
    rng = np.random.default_rng(1)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            for i, raw, offs in slices(*buffers(doc.field("text"))):
                w = words(raw, offs, PLAIN)
                h = w.hashes()
                grams, row = ngrams(w, h)
                some = w.count > 0
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                out = np.zeros((len(begin), bands), np.uint64)
                for b in range(bands):
                    band = np.full(len(begin), np.uint64(b + 1))
                    for f in factors[b * rows : (b + 1) * rows]:
                        if len(begin):
                            band = mix(band * np.uint64(31) + np.minimum.reduceat(grams * f, begin))
                    out[:, b] = band
                key = pa.array(identities(w, h).view(np.int64), mask=~some)
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel().view(np.int64)))
                n = pa.array(np.bincount(row, minlength=len(some)).astype(np.int64))
                yield pa.record_batch([doc.slice(i, len(some)), key, n, lists], names=["doc", "key", "n_grams", "bands"])

    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return doc.mapInArrow(sign, f"doc {doc.schema['doc'].dataType.simpleString()}, key long, n_grams long, bands array<long>")


def star_edges(texts: DataFrame) -> DataFrame:
    """(a, b): texts that share a band, each tied to one least member through at most two edges."""
    member = texts.select(F.explode("bands").alias("band"), "key")
    parts = member.groupBy("band", F.pmod("key", F.lit(SALTS)).alias("salt")).agg(F.min("key").alias("least"), F.collect_set("key").alias("keys"))
    parts = cut(parts.select("band", "least", F.array_except("keys", F.array("least")).alias("keys")))
    inner = parts.filter(F.size("keys") > 0).select(F.explode("keys").alias("a"), F.col("least").alias("b"))
    heads = parts.groupBy("band").agg(F.min("least").alias("b"), F.collect_set("least").alias("heads")).filter(F.size("heads") > 1)
    outer = heads.select(F.explode("heads").alias("a"), "b").filter("a <> b")  # at most SALTS a band
    return inner.union(outer).distinct()


def least_of_node(edges: DataFrame) -> DataFrame:
    """(a, bs, m) of every node ``a`` of ``edges`` (a, b): its distinct neighbours in at most SALTS lists, and the least of them all.

    The lists of a hot node are made in as many tasks; only they meet in its window.
    """
    lists = edges.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")).agg(F.collect_set("b").alias("bs"))
    return lists.select("a", "bs", F.min(F.array_min("bs")).over(Window.partitionBy("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every node of ``edges`` (a, b): root is the least node it is connected with.

    Large-star and small-star steps in turn, each pair cut off in the shared folder, until every
    component is a star around its least node; the number of rounds grows with the logarithm of the
    longest chain. An edge may stand there more than once, as the lists of a node hold it once.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        # in a star a node with a lesser neighbour has no other one
        of_node = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        if not of_node.filter("m < a and m < most").agg(F.count("*")).first()[0]:
            break
        large = least_of_node(both).select(F.explode(F.filter("bs", lambda b: b > F.col("a"))).alias("to"), F.least("a", "m").alias("b"))
        small = least_of_node(large.select(F.col("to").alias("a"), "b"))
        edges = cut(small.select(F.explode(F.concat(F.array_except("bs", F.array("m")), F.array("a"))).alias("to"), F.col("m").alias("b")).select(F.col("to").alias("a"), "b"))
    edges = edges.distinct()
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def gram_sets(rows: DataFrame) -> DataFrame:
    """(text, key, *rest) to (key, *rest, grams): the sorted n-gram hashes of texts with that key."""
    rest = [c for c in rows.columns if c != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.select(rest)
            wanted = other.column(rest.index("key")).to_numpy(zero_copy_only=False)
            for i, raw, offs in slices(*buffers(batch.column(batch.schema.get_field_index("text")))):
                w = words(raw, offs, PLAIN)
                h = w.hashes()
                grams, row = ngrams(w, h)
                right = identities(w, h).view(np.int64) == wanted[i : i + len(w.first)]
                edges = np.searchsorted(row, np.arange(len(w.first) + 1))
                sets = [np.unique(grams[a:b]).tobytes() if ok else None for a, b, ok in zip(edges[:-1], edges[1:], right, strict=True)]
                part = other.slice(i, len(w.first))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], names=[*rest, "grams"]).filter(pa.array(right))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in rest)
    return rows.mapInArrow(make, f"{fields}, grams binary")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from 0/1 matrices over the grams that two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = n[gram] > 1
    number = np.cumsum(n > 1) - 1
    owner, gram = owner[kept], number[gram[kept]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, columns):
        a, b = np.searchsorted(gram, [low, low + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[a:b], gram[a:b] - low] = 1
        out += x @ x.T
    return out


def links_of_block(block: pd.DataFrame) -> pd.DataFrame:
    """(key, root, links) of the texts of one block, or pair of blocks, that have a link there.

    Within a pair of blocks only links across count, so each pair of texts is met once. ``links``
    counts the documents behind the linked texts; ``root`` is the least text connected here.
    """
    block = block.sort_values("key", ignore_index=True)
    sets = [np.frombuffer(g, np.uint64) for g in block.grams]
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if block.bi[0] != block.bj[0]:
        linked &= block.b.to_numpy()[:, None] != block.b.to_numpy()[None, :]
    links = linked @ block.n_docs.to_numpy(np.int64)
    root = np.arange(len(block))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(block)).min(1, initial=len(block)))
        least = least[least]
        if (least == root).all():
            break
        root = least
    out = pd.DataFrame({"key": block.key, "root": block.key.to_numpy()[root], "links": links})
    return out[links > 0]


def linked_texts(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows as written to the shared folder (row, doc, key); each text (key, head, n_docs, n_grams); links; roots (key, root).

    ``head`` (no_id, id, row) is the text's row with the least id, rows without an id last; of several, the first. Texts
    without a link have no root.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(THRESHOLD, recall)
    path = shared_dir(spark, "jaccard")
    # a number for each row, fixed as it is written: ids may be absent or repeated
    signed(docs, bands, rows).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.parquet(path)
    worded = written.filter("key is not null")
    signs = worded.groupBy("key").agg(F.first("bands").alias("bands"))
    clusters = cut(components(star_edges(signs)).withColumnRenamed("root", "cluster"))
    id_ = F.col("doc.doc_id").cast("long")
    head = F.min(F.struct(id_.isNull().alias("no_id"), id_.alias("id"), "row")).alias("head")
    info = cut(worded.groupBy("key").agg(head, F.count("*").alias("n_docs"), F.max("n_grams").alias("n_grams")))
    known = clusters.join(info.select("key", "head.row", "n_docs", "n_grams"), "key")
    n_blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_grams") / GRAMS_A_BLOCK)).cast("int")
    sizes = known.groupBy("cluster").agg(n_blocks.alias("n_blocks"))
    members = join_hot(known.select("cluster", "key", "row", "n_docs"), sizes, "cluster", ["key", "row", "n_docs"])
    sets = gram_sets(written.select("row", "doc.text").join(members, "row").drop("row"))  # one text a key
    b = F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    blocks = sets.withColumn("b", b).withColumn("o", other).select("cluster", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "key", "n_docs", "grams")
    links = cut(blocks.groupBy("cluster", "bi", "bj").applyInPandas(links_of_block, "key long, root long, links long"))
    return written, info, links, components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))


def classes(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The rows as written to the shared folder (row, doc, key), and (key, class_id, n_links) of each text."""
    written, info, links, roots = linked_texts(docs, recall)
    info = info.select("key", F.col("head.id").alias("rep"), "n_docs")
    degree = links.groupBy("key").agg(F.sum("links").alias("links"))
    linked = info.join(roots, "key").join(degree, "key")
    class_ids = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = join_hot(linked.select("root", "key", "links"), class_ids, "root", ["key", "links"])
    every = info.join(named, "key", "left").select(
        "key",
        F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return written, every


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs`` (doc_id, text).

    A link is a pair of documents whose sets of NGRAM-word runs have Jaccard similarity THRESHOLD or
    more; words are lower-cased runs of letters and digits. ``n_links`` counts the other documents
    linked to the row's, exact copies included, among the pairs of its candidate cluster. ``class_id``
    is the least doc_id connected by links. Any pair that shares a band is compared, in blocks, with
    no limit on the size of a cluster.

    Null, empty or wordless texts have no link; their class is their own id. Texts of fewer than
    NGRAM words count as one run. Repeated rows are copies of each other. Rows without an id count,
    and a class without any id has the null class. An empty table gives an empty result.
    """
    written, every = classes(docs.select("doc_id", "text"), recall)
    ids = written.select("key", F.col("doc.doc_id").cast("long").alias("doc_id"))
    worded = join_hot(ids.filter("key is not null"), every, "key", ["doc_id"]).select("doc_id", "class_id", "n_links")
    wordless = ids.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.union(wordless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all columns: of those with its least id, one.

    A class without any id keeps one row. Texts without words all stay.
    """
    written, info, _, roots = linked_texts(docs)
    heads = info.select("key", "head").join(roots, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("head").alias("head"))
    kept = heads.select("head.row").union(written.filter("key is null").select("row"))
    return written.join(kept, "row", "left_semi").select("doc.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
