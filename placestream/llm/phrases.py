"""Phrase collocations by relational mining: sorted occurrence relations, merge-joins, counts and semi-joins.

The occurrences of all words are a relation sorted by text and position, kept as Parquet with the
occurrences of some pieces as arrays. The occurrences of phrases of k + 1 words are made by a merge-join of those of k words
with themselves on text, piece and adjacent position; they are counted by phrase, and only occurrences
of frequent phrases are kept for the next length. Words are told apart by 64-bit keys, which are held
against the words themselves before they are relied on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SALTS, join_hot, shared_dir, table
from .words import SLICE_BYTES, buffers, mix, slices, span_array, span_hashes, words

LEAST_COUNT = 10
LONGEST = 3
#: Hundredths of a phrase's occurrences that lie in one longer phrase and make it redundant.
SHARE = 50
BEST = 2000
#: Bits of the table by which occurrences are semi-joined: 64 MB at most, however many groups there are.
MOST_BITS = 1 << 29
LEAST_BITS = 1 << 20
_BUCKET = 1 << 15  # bits of a value of bitmap_construct_agg
#: Occurrences that are joined and counted at a time.
SLICE_ROWS = 1 << 18
#: Words of a text whose pieces make a row of the relation.
ROW_WORDS = 128

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.uint8)
_WORD[list(b" \t" + _BREAKS)] = 0
_IS_BREAK = np.zeros(256, np.int32)
_IS_BREAK[list(_BREAKS)] = 1


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of each byte span."""
    spans = span_array(raw, start, end).dictionary_encode()
    each = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in spans.dictionary.to_pylist()]
    return np.array(each, np.uint64)[spans.indices.to_numpy()]


def _keyed(batches: Iterator[pa.RecordBatch], hashes: Callable) -> Iterator[tuple]:
    """(first row, batch, words, their keys, lower-cased bytes, position) of slices of (lang, seed, text)."""
    for batch in batches:
        for i, raw, offs in slices(*buffers(batch.column(2)), 2 * SLICE_BYTES - 2):
            w = words(raw, offs, _WORD)
            lower = _LOWER[raw]
            seeds = batch.column(1).slice(i, len(offs) - 1).to_numpy().view(np.uint64)
            keys = mix(hashes(lower, w.start, w.end) ^ seeds[w.row]).view(np.int64)
            piece = np.concatenate([[0], np.cumsum(_IS_BREAK[raw])])[w.start]
            gap = np.ones(len(keys), np.int32)
            gap[1:] += piece[1:] != piece[:-1]
            yield i, batch, w, keys, lower, np.cumsum(gap, dtype=np.int32)


def _word_counts(hashes: Callable):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch, w, keys, lower, _ in _keyed(batches, hashes):
            lang = batch.column(0).slice(i, len(w.count)).dictionary_encode()
            spans = span_array(lower, w.start, w.end).dictionary_encode()
            which = spans.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()[w.row]
            _, at, n = np.unique(which, return_index=True, return_counts=True)  # by the words themselves
            langs, texts = batch.column(0).take(pa.array(i + w.row[at])), spans.dictionary.take(spans.indices.take(pa.array(at)))
            yield pa.record_batch([pa.array(keys[at]), langs, texts.cast(pa.string()), pa.array(n)], names=["k1", "lang", "word", "n"])

    return count


class _Members:
    """A table of bits on the executors that has the bit of every frequent group, and by chance few others.

    It only saves work: groups that come in by chance are too rare in the counts, which are exact.
    """

    def __init__(self, groups: DataFrame, keys: list[str]):
        spark = groups.sparkSession
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * groups.count()).bit_length()))
        at = F.lit(0).cast("long")
        for j, k in enumerate(keys):
            at = at.bitwiseXOR(_turned(F.col(k), 21 * j))
        at = at.bitwiseAND(self.bits - 1) + 1
        parts = groups.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        table = np.zeros(max(self.bits, _BUCKET) // 8, np.uint8)
        for r in parts.toLocalIterator():
            table[(r.bucket - 1) * _BUCKET // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        self.table: Broadcast = spark.sparkContext.broadcast(table)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each row of keys may be a frequent group."""
        at = np.zeros(len(keys), np.uint64)
        for j in range(keys.shape[1]):
            k, turn = keys[:, j].view(np.uint64) if keys.shape[1] == 1 else np.ascontiguousarray(keys[:, j]).view(np.uint64), 21 * j % 64
            at ^= k << np.uint64(turn) | k >> np.uint64(64 - turn) if turn else k
        at &= np.uint64(self.bits - 1)
        return (self.table.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _turned(k: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(k, by).bitwiseOR(F.shiftrightunsigned(k, 64 - by)) if by else k


def _relation(row: np.ndarray, rows: int, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Occurrences as arrays, one of each a row: positions, and as many keys an occurrence as its phrase has words."""
    offs = np.searchsorted(row, np.arange(rows + 1))
    width = keys.shape[1]
    lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(at)), pa.ListArray.from_arrays(pa.array(offs * width, pa.int32()), pa.array(keys.reshape(-1)))]
    some = pa.array(np.diff(offs) > 0)
    return pa.record_batch([x.filter(some) for x in lists], names=["at", "keys"])


def _joined(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(row, rows, position, keys) of phrases one word longer, from the merge-join of each slice with itself."""
    for batch in batches:
        ats, keys = batch.column(0), batch.column(1)
        offs = ats.offsets.to_numpy().astype(np.int64)
        at, flat = ats.values.to_numpy(), keys.values.to_numpy()
        base, begin = offs[0], keys.offsets[0].as_py()
        for i, part, own in slices(at[base : offs[-1]], offs - base, SLICE_ROWS):
            here = begin + (offs[i] - base) * width
            k = flat[here : here + len(part) * width].reshape(-1, width)
            row = np.repeat(np.arange(len(own) - 1), np.diff(own))
            first = np.flatnonzero((row[1:] == row[:-1]) & (part[1:] == part[:-1] + 1))
            yield row[first], len(own) - 1, part[first], np.concatenate([k[first], k[first + 1][:, -1:]], axis=1)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys and how often each occurs."""
    code = np.zeros(len(keys), np.int64)
    for j in range(keys.shape[1]):
        values, own = np.unique(keys[:, j], return_inverse=True)
        code = code * len(values) + own
        if 0 < j < keys.shape[1] - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, at, n = np.unique(code, return_index=True, return_counts=True)
    return keys[at], n


#: How words are hashed: fast, and by a stronger hash if two words of the corpus have the same.
_HASHES = (span_hashes, _digests)


def _columns(k: int, first: int = 0) -> list[str]:
    return [f"k{j + 1}" for j in range(first, first + k)]


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, where: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """All words (k1, lang, word, n), and for 2 to ``longest`` words the frequent groups (k1 … kn, n) as keys of words.

    A key stands for a word of a language; two words that share one are found by the counts themselves,
    and all keys are made anew by a stronger hash. Texts are read twice: to count words, and to write the
    occurrences of frequent ones. Only partial counts are shuffled, never texts or occurrences.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "phrases")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    for seed, hashes in enumerate(_HASHES):
        source = docs.select(lang.alias("lang"), F.xxhash64(lang, F.lit(seed)).alias("seed"), F.col("text"))
        path = f"{where}/words-{seed}"
        partial = source.mapInArrow(_word_counts(hashes), "k1 long, lang string, word string, n long")
        partial.groupBy("k1", "lang", "word").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
        every = spark.read.parquet(path)
        if every.groupBy("k1").agg(F.count("*").alias("words")).filter("words > 1").isEmpty():
            break
    else:
        raise ValueError("two words have the same hash")

    frequent, groups = every.filter(F.col("n") >= least), []
    for k in range(1, longest):
        keep = _Members(frequent, _columns(k))
        path = f"{where}/occurrences-{k}"
        made = source.mapInArrow(_first_relation(keep, hashes), "at array<int>, keys array<long>") if k == 1 else relation.mapInArrow(_next_relation(k - 1, keep), "at array<int>, keys array<long>")
        made.write.option("compression", "zstd").option("parquet.dictionary.page.size", 4 << 20).parquet(path)
        relation = spark.read.parquet(path)
        names = _columns(k + 1)
        counts = relation.mapInArrow(_count_next(k), ", ".join(f"{c} long" for c in names) + ", n long")
        counts.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).write.parquet(f"{where}/groups-{k + 1}")
        frequent = spark.read.parquet(f"{where}/groups-{k + 1}")
        groups.append(frequent)
    return every, groups


def _first_relation(keep: _Members, hashes: Callable):
    """Occurrences of frequent words; a row has whole pieces that begin within so many words of a text, so rows stay small."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w, keys, _, at in _keyed(batches, hashes):
            kept = np.flatnonzero(keep.has(keys.reshape(-1, 1)))
            place = np.arange(len(keys)) - w.first[w.row]
            begins = (place == 0) | (np.diff(at, prepend=-1) != 1)
            part = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))  # the first word of each word's piece
            part = place[part] // ROW_WORDS
            new = (place == 0) | (np.diff(part, prepend=-1) != 0)
            row = np.cumsum(new) - 1
            yield _relation(row[kept], int(new.sum()), at[kept], keys[kept].reshape(-1, 1))

    return occurrences


def _next_relation(width: int, keep: _Members):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, at, keys in _joined(batches, width):
            kept = np.flatnonzero(keep.has(keys))
            yield _relation(row[kept], rows, at[kept], keys[kept])

    return occurrences


def _count_next(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, keys in _joined(batches, width):
            found, n = _counted(keys)
            yield pa.record_batch([*[pa.array(np.ascontiguousarray(found[:, j])) for j in range(width + 1)], pa.array(n)], names=[*_columns(width + 1), "n"])

    return count


def _looked_up(rows: DataFrame, by: list[str], table: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with columns of a table that is unique by ``keys``; a key that many rows share is salted."""
    right = table.select(F.struct(*[F.col(k).alias(f"f{j}") for j, k in enumerate(keys)]).alias("_by"), *[F.col(v).alias(name) for name, v in values.items()])
    left = rows.withColumn("_by", F.struct(*[F.col(k).alias(f"f{j}") for j, k in enumerate(by)]))
    return join_hot(left, right, "_by", rows.columns).drop("_by")


def score_phrases(every: DataFrame, groups: list[DataFrame], least: int = LEAST_COUNT, share: int = SHARE, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases, without those that a longer one explains."""
    counts = [every.filter(F.col("n") >= least), *groups]
    rows = None
    for m in range(2, len(counts) + 1):
        names, found = _columns(m), counts[m - 1].withColumnRenamed("n", "a")
        for longer in range(m + 1, len(counts) + 1):
            inside = [counts[longer - 1].select(*[F.col(c).alias(names[j]) for j, c in enumerate(_columns(m, first))], "n") for first in range(longer - m + 1)]
            most = inside[0]
            for other in inside[1:]:
                most = most.unionByName(other)
            redundant = most.groupBy(*names).agg(F.max("n").alias("most"))
            found = found.join(redundant, names, "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
        cuts = []
        for k in range(1, m):
            found = _looked_up(found, _columns(k), counts[k - 1], _columns(k), {f"l{k}": "n"})
            found = _looked_up(found, _columns(m - k, k), counts[m - k - 1], _columns(m - k), {f"r{k}": "n"})
            big = lambda c: F.col(c).cast("decimal(19,0)")
            score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), big(f"l{k}") * big(f"r{k}"))
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for j, c in enumerate(names):
            found = _looked_up(found, [c], counts[0], ["k1"], {f"w{j}": "word"} | ({"lang": "lang"} if j == 0 else {}))
        scored = found.select("lang", F.concat_ws(" ", *[f"w{j}" for j in range(m)]).alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut"))
        rows = scored if rows is None else rows.unionByName(scored)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS // 8))).orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= best)  # so the last step takes a bounded number a language
    top = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    n = every.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    ``docs`` has text and lang; A-Z are lower-cased, pieces end at . , ; : ! ? and line ends, words at
    spaces and tabs. A phrase's score is a million times a² / (l · r), rounded down, at its worst cut
    into two parts that occur l and r times. A null text counts as empty, a null language as 'und';
    repeated rows count each; ties go to the more frequent, then the lesser phrase by bytes; an empty
    table has no phrases.
    """
    every, groups = mine_phrases(docs, least, longest)
    return score_phrases(every, groups, least, share, best)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """with d as (select row_number() over () as doc, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
f1 as (select lang, x, count(*) as n from (select lang, unnest(w) as x from w) group by all),
f2 as (select lang, x, count(*) as n from (select lang, unnest([w[i:i + 1] for i in range(1, len(w)::bigint)]) as x from w) group by all having count(*) >= 10),
f3 as (select lang, x, count(*) as n from (select lang, unnest([w[i:i + 2] for i in range(1, len(w)::bigint - 1)]) as x from w) group by all having count(*) >= 10),
inner_ as (select lang, x, max(n) as most from (select lang, x[1:2] as x, n from f3 union all select lang, x[2:3], n from f3) group by all),
c as (select f2.lang, f2.x, f2.n as a, a1.n as l, b1.n as r, 1 as k from f2 join f1 a1 on a1.lang = f2.lang and a1.x = f2.x[1] join f1 b1 on b1.lang = f2.lang and b1.x = f2.x[2]
  left join inner_ i on i.lang = f2.lang and i.x = f2.x where i.most is null or 100 * i.most < 50 * f2.n
 union all select f3.lang, f3.x, f3.n, a1.n, b2.n, 1 from f3 join f1 a1 on a1.lang = f3.lang and a1.x = f3.x[1] join f2 b2 on b2.lang = f3.lang and b2.x = f3.x[2:3]
 union all select f3.lang, f3.x, f3.n, a2.n, b1.n, 2 from f3 join f2 a2 on a2.lang = f3.lang and a2.x = f3.x[1:2] join f1 b1 on b1.lang = f3.lang and b1.x = f3.x[3]),
s as (select lang, array_to_string(x, ' ') as phrase, a, l, r, k, (1000000::hugeint * a * a) // (l::hugeint * r) as score from c),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n::bigint as n, o.score::bigint as score from o join (select lang, sum(n) as n from f1 group by lang) t on t.lang = o.lang where o.rank <= 2000"""
