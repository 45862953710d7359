from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from placestream.llm import bpe, token_store
from placestream.llm.words import buffers

from .cases import awkward, nothing

TOKENIZER = token_store.default_tokenizer()
JSON = open(TOKENIZER, encoding="utf-8").read()
ENCODER = bpe.Encoder(JSON)
LIBRARY = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abstmdrevl'' \n\t1٣é中!?\xa0\x1c😀İ²​\x85ⅷ<|>"), max_size=16), min_size=1, max_size=5))
def test_ids_equal_the_library_s(texts):
    ids, n = ENCODER.encode(*buffers(pa.array(texts)))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 1'<|endoftext|>\n"), max_size=60), min_size=1, max_size=4), st.sampled_from([[], [AddedToken("<sep>", lstrip=True)], [AddedToken("a\nb")], [AddedToken("b a"), AddedToken("1", single_word=True)]]))
def test_ids_with_other_added_tokens_equal_the_library_s(texts, tokens):
    library = Tokenizer.from_file(TOKENIZER)
    library.add_tokens(tokens)
    texts = [*texts, "xx <sep> y", "a\nb", "a\n\nb", "b ab 1 11"]
    ids, n = bpe.Encoder(library.to_str()).encode(*buffers(pa.array(texts)))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_tokenizers_that_cut_otherwise_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, texts = bpe.Encoder(open(path, encoding="utf-8").read()), ["Some WORDS, and 12 more.", "", "é <|endoftext|> x"]
    assert not encoder.by_piece
    ids, n = encoder.encode(*buffers(pa.array(texts)))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_pieces_of_equal_beginning_are_told_apart():
    texts = [" " + "a" * k + t for k in range(12, 18) for t in ("", "b", "c", "\0", "\0\0")] + ["\0" * k for k in range(20)] + ["x" * 40, "x" * 41]
    ids, n = bpe.Encoder(JSON).encode(*buffers(pa.array(texts)))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


TOKENS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>it's", "x<|endo", "ftext|> y", "", "  <|endoftext|>  \n", "<|endoftext<|endoftext|>|>", "é<|endoftext|>中", "no token"]


def test_strings_of_added_tokens_are_their_ids():
    ids, n = bpe.Encoder(JSON).encode(*buffers(pa.array(TOKENS)))
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(TOKENS, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    assert want[0] == [64, 220, 50256, 275]


def test_added_tokens_that_look_at_their_neighbours():
    library = Tokenizer.from_file(TOKENIZER)
    library.add_tokens([AddedToken("<sep>", lstrip=True, rstrip=True), AddedToken("solo", single_word=True), AddedToken(" of the"), AddedToken("ab"), AddedToken("abc")])
    texts = ["one  <sep>  two", "solo solos 1solo (solo)", "out of the  blue", "of", " of", " the", " of a the", "xabcab ab", " ab", "", "x"]
    ids, n = bpe.Encoder(library.to_str()).encode(*buffers(pa.array(texts)))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_pieces_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    encoder = bpe.Encoder(JSON)
    for text in ("a b c d e f g h", "a b x y z", "a b c d e f g h"):
        assert encoder.encode(*buffers(pa.array([text])))[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_checksums_join():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 5, 1000, 65537)]
    assert token_store.crc32_joined((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_cuts_depend_on_the_document_alone():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 9_000, dtype=np.uint32), rng.integers(0, 50_000, 700, dtype=np.uint32)
    alone = token_store.cut_points(a, np.array([9_000]))[0]
    assert token_store.cut_points(np.concatenate([b, a]), np.array([700, 9_000]))[1] == alone
    assert all(n <= token_store.MOST_CHUNK for n in alone)
    assert sum(alone) == 9_000
    shifted = token_store.cut_points(np.concatenate([b[:50], a]), np.array([9_050]))[0]
    assert len(set(np.cumsum(alone).tolist()) & {x - 50 for x in np.cumsum(shifted).tolist()}) > len(alone) // 2


def expected(rows):
    pos, out = 0, []
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        pos += len(ids)
    return out


def test_store_gives_back_what_went_in(spark, tmp_path):
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "of", "the"]) + str(rng.randint(0, 99)) for _ in range(3_000))
    rows = [(i, base if i % 4 == 0 else base[: rng.randint(0, 9_000)]) for i in range(40)]
    path = f"file://{tmp_path}/s"
    token_store.write_store(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), path, TOKENIZER)
    got = sorted(tuple(r)[:4] for r in token_store.read_digests(spark, path).collect())
    assert got == expected(rows)
    ids = {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()}
    assert all(ids[i] == [*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for i, t in rows)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count() < sum(len(r["keys"]) for r in spark.read.parquet(f"{path}/recipes").collect())


def test_damage_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    token_store.write_store(spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string"), path, TOKENIZER)
    good = spark.read.parquet(f"{path}/chunks").toPandas()
    good["ids"] = [bytes([b[0] ^ 1]) + b[1:] for b in map(bytes, good.ids)]
    spark.createDataFrame(good, "key binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="cannot be rebuilt"):
        token_store.read_digests(spark, path).collect()


def test_awkward_rows(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    token_store.write_store(awkward(spark), path, TOKENIZER)
    got = sorted((tuple(r)[:4] for r in token_store.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 4, 4, 4, 7, 8, 9]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    empty = f"file://{tmp_path}/e"
    token_store.write_store(nothing(spark), empty, TOKENIZER)
    assert token_store.read_digests(spark, empty).count() == 0
