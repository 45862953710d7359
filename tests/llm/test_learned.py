"""Toxicity, language, quality and transcripts: held-out accuracy, gradients, awkward rows."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placestream.llm import language, quality, toxicity, transcripts
from placestream.llm.shared import fold, table
from placestream.llm.words import PLAIN, buffers, span_hashes, words

from ..compare import duck
from .cases import awkward, nothing

MEDIUM = "/root/testdata/sf0.1"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == 10_000
    assert ((got.predicted == 1) == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert held.predicted[held.toxic == 1].mean() > 0.85
    assert held.predicted[held.toxic == 0].mean() < 0.04


def test_toxicity_takes_awkward_rows(spark):
    docs = awkward(spark)
    for labels in (labels_of(spark, []), labels_of(spark, [(1, 1, 1), (2, None, 0), (None, 1, 1), (4, 1, 1), (9, 0, None)])):
        model = toxicity.fit(docs, labels)
        assert toxicity.toxicity(docs, model).filter("score is not null").count() == docs.count()
        assert toxicity.without_toxic(docs, model).columns == docs.columns
        assert toxicity.toxicity(nothing(spark), model).count() == 0


def test_features_and_scores_equal_counting_words():
    texts = ["Awful words, awful WORDS and more", "", None, "abcde abcd abcdef abcdefgh", "é" * 9 + " ü"]
    table_ = {}

    def wanted(text):
        found = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
            found |= {(w, 0)} | {(w[:k], k) for k in toxicity.PREFIXES if len(w) > k}
        return found

    for t in texts:  # the bucket of each feature, from a text that has little else
        for f in wanted(t):
            w = words(np.frombuffer(f[0] + (b"zzzzzzz" if f[1] else b""), np.uint8), np.array([0, len(f[0]) + (7 if f[1] else 0)]), PLAIN)
            at = int(span_hashes(w.bytes, w.start, w.start + len(f[0]))[0] + np.uint64(f[1])) % toxicity.BUCKETS
            table_[f] = at
    assert len(set(table_.values())) == len(table_)
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 0.3, toxicity.BUCKETS), -0.4, 0.1)
    got = model.scores(*buffers(pa.array(texts)))
    want = [1 / (1 + np.exp(0.4 - sum(model.weight[table_[f]] for f in wanted(t)))) for t in texts]
    assert np.allclose(got, want)


def test_nnpu_finds_the_telling_word():
    rng = np.random.default_rng(0)
    rows, buckets, positive = [], [], np.array([True] * 200 + [False] * 800)
    for i in range(1000):
        words = set(rng.integers(10, 500, 30).tolist())
        if positive[i] or i % 10 == 0:  # a tenth of the unlabelled is toxic too
            words.add(1)
        rows += [i] * len(words)
        buckets += sorted(words)
    row, bucket = np.array(rows), np.array(buckets)
    count = lambda flags: np.bincount(bucket[flags[row]], minlength=toxicity.BUCKETS)
    assert np.flatnonzero(toxicity.telling(count(positive), count(~positive), 200, 800)).tolist() == [1]
    weight, bias = toxicity.nnpu(row[bucket == 1], bucket[bucket == 1], positive, 0.1)
    assert weight[1] + bias > 0 > bias


@pytest.mark.parametrize("common", [0, 40, 200])
def test_nnpu_is_stable_on_long_rows(common):
    """Frequent features that stand in the same rows must not throw the steps off."""
    rng = np.random.default_rng(5)
    positive = np.array([True] * 600 + [False] * 1800)
    toxic = positive | (np.arange(2400) % 10 == 0)
    rows, buckets = [], []
    for i in range(2400):
        held = np.flatnonzero(rng.random(common) < (0.6 if i % 2 else 0.1)) + 100  # every other row is long
        held = np.append(held, rng.integers(0, 10)) if toxic[i] else held  # one of ten telling words
        rows += [i] * len(held)
        buckets += held.tolist()
    row, bucket = np.array(rows), np.array(buckets, np.int64)
    weight, bias = toxicity.nnpu(row, bucket, positive, 0.1)
    z = bias + np.bincount(row, weight[bucket], minlength=2400)
    assert (z[toxic] >= 0).mean() > 0.95
    assert (z[~toxic] >= 0).mean() < 0.01
    assert np.abs(weight).max() < 20


def test_toxicity_learns_from_the_later_positive_rows(spark):
    learn = spark.range(25_000).filter(fold(F.col("id"), toxicity.FOLDS) != toxicity.HELD_OUT)
    ids = [r.id for r in learn.orderBy(F.xxhash64("id"), "id").collect()]
    rare, toxic = set(ids[5_900:6_000]), set(ids[:6_000])
    docs = spark.createDataFrame([(i, "common zork" if i in rare else "common") for i in ids[:18_000]], "doc_id long, text string")
    model = toxicity.fit(docs, labels_of(spark, [(i, 1, int(i in toxic)) for i in ids]))
    with_, without = model.scores(*buffers(pa.array(["zork", "common"])))
    assert with_ > without


def test_language_on_held_out_rows(spark):
    docs = table(spark, MEDIUM, "documents")
    got = language.language(docs, language.fit(docs, rows=3_000)).toPandas()
    held = got[got.held_out].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert got.score.between(0, 1).all()


def test_language_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    n, k = 3, 2
    p = {key: rng.normal(0, 0.5, s) for key, s in {"e": (256, 4), "xf": (4, 3 * n), "xb": (4, 3 * n), "cf": (3 * n,), "cb": (3 * n,), "hf": (n, 3 * n), "hb": (n, 3 * n), "w": (2 * n, k), "v": (k,)}.items()}
    x, y = rng.integers(0, 6, (7, 5)), rng.integers(0, k, 5)

    def loss():
        outs = []
        for d, b in (("f", x), ("b", x[::-1])):
            g = language.Gru(p["e"] @ p["x" + d] + p["c" + d], p["h" + d])
            s = g.states(b, np.ones(b.shape, bool), 0).transpose(0, 2, 1)
            outs.append(s if d == "f" else s[::-1])
        z = np.concatenate(outs, 2) @ p["w"] + p["v"]
        z = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -z[:, np.arange(5), y].mean()

    grads = language.train_step(p, x, y)
    for key, at in (("e", (2, 1)), ("xf", (1, 4)), ("hb", (2, 7)), ("cf", (1,)), ("w", (3, 1)), ("hf", (0, 1))):
        old, eps = p[key][at], 1e-2
        p[key][at] = old + eps
        up = loss()
        p[key][at] = old - eps
        down = loss()
        p[key][at] = old
        assert abs((up - down) / (2 * eps) - grads[key][at]) < 2e-3


def test_language_reads_text_by_text_alike():
    rng = np.random.default_rng(3)
    n, size, warm = language.HIDDEN, language.SEGMENT, language.WARM_UP
    gru = lambda: language.Gru(rng.normal(0, 1, (256, 3 * n)).astype(np.float32), rng.normal(0, 0.5, (n, 3 * n)).astype(np.float32))
    model = language.Model(["a", "b", "c"], gru(), gru(), rng.normal(0, 1, (2 * n, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    texts = [bytes(rng.integers(32, 127, k, dtype=np.uint8)) for k in (0, 1, 15, size - 1, size, size + 1, 3 * size + 7, 40)]
    got = model.pooled(*buffers(pa.array([t.decode() for t in texts])))
    sig = lambda x: 1 / (1 + np.exp(-x))

    def after(g, bytes_):
        h = np.zeros(n)
        for b in bytes_:
            x = g.x[b].astype(float)
            z, r = sig(x[:n] + h @ g.h[:, :n]), sig(x[n : 2 * n] + h @ g.h[:, n : 2 * n])
            h = h + z * (np.tanh(x[2 * n :] + (r * h) @ g.h[:, 2 * n :]) - h)
        return h

    for t, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for p in range(len(t)):
            first = p // size * size
            logits = np.concatenate([after(model.forward, t[max(0, first - warm) : p + 1]), after(model.backward, t[p : first + size + warm][::-1])]) @ model.w + model.v
            total += np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(row, total / max(len(t), 1), atol=1e-4)


def test_languages_of_short_texts_are_learned(spark):
    docs = spark.createDataFrame([(i, "zq xj" if i % 2 else "the long words of another language " * 3, "short" if i % 2 else "long") for i in range(400)], "doc_id long, text string, lang string")
    got = language.language(docs, language.fit(docs, rows=400)).groupBy("lang_pred").count().collect()
    assert sorted((r.lang_pred, r["count"]) for r in got) == [("long", 200), ("short", 200)]


def test_language_takes_awkward_rows(spark):
    docs = awkward(spark)
    for model in (language.fit(docs), language.fit(nothing(spark))):
        got = {r.doc_id: r for r in language.language(docs, model).collect()}
        assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und"
        assert got[1].score == 0
        assert language.language(nothing(spark), model).count() == 0


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, repeated = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeated, len(covered)


def test_rules_equal_brute_force(data_dir):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é ", "\n", " ", "\t", "#", "\x0b", "中", "a b a b a b a b ", "\x00", "\xa0"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "\n\n", "x"]
    texts += [r[0] for r in duck(data_dir).sql("select text from documents").fetchall()]
    got = quality.rules(*buffers(pa.array(texts)))
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [brute_rules(t) for t in texts]


def test_ratio_scores_equal_brute_force():
    texts = ["abcdabcd", "", None, "abc", "zzzzzzé"]
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(0, 1, quality.BUCKETS).astype(np.float32), 0.0)
    got = model.scores(*buffers(pa.array(texts)))
    for t, s in zip(texts, got, strict=True):
        b = (t or "").encode()
        keys = [quality.buckets(np.frombuffer(b[i : i + 4], np.uint8), np.array([0, 4]))[0][0] for i in range(len(b) - 3)]
        assert s == pytest.approx(float(np.mean(model.ratio[keys])) if keys else 0.0, abs=1e-6)


def test_quality_keeps_good_and_rejects_bad(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    got = quality.quality(docs, quality.fit(docs, labels.filter(~held))).toPandas()
    joined = got[~got.base_failed].merge(labels.filter(held).toPandas(), on="doc_id")
    good, bad = joined.kept[joined.quality == 1].mean(), (~joined.kept[joined.quality == 0]).mean()
    print(f"quality, held out: {good:.4f} of {(joined.quality == 1).sum()} good kept, {bad:.4f} of {(joined.quality == 0).sum()} bad rejected")
    assert good > 0.98
    assert bad > 0.8
    assert not got.kept[got.base_failed].any()


def test_quality_target_counts_every_good_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (2, "epsilon zeta"), (3, "eta theta"), (None, "iota kappa")], "doc_id long, text string")
    labels = labels_of(spark, [(1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0)])
    got = quality.fit(docs, labels, trusted_rows=1)

    def smoothed(texts):
        key, _ = quality.buckets(*buffers(pa.array(texts)))
        return (np.bincount(key, minlength=quality.BUCKETS) + 1) / (len(key) + quality.BUCKETS)

    good = ["alpha beta", "gamma delta", "epsilon zeta"]
    want = np.log(smoothed(good)) - np.log(smoothed([*good, "eta theta", "iota kappa"]))
    assert np.allclose(got.ratio, want, atol=1e-6)


def best_cut(good, bad):
    """The threshold by trying every score."""
    gain = lambda c: quality.KEEP_WEIGHT * len(bad) * sum(s >= c for s in good) + len(good) * sum(s < c for s in bad)
    return max(sorted({*good, *bad}), key=gain)


def test_quality_threshold_is_the_best_of_all_rows(spark):
    rng = random.Random(8)
    for many, bad_share in ((400, 0.3), (60, 0.9), (5, 0.5), (300, 0.02)):
        rows = [(round(rng.gauss(0, 1), 1), 0) if rng.random() < bad_share else (round(rng.gauss(2, 1), 1), 1) for _ in range(many)] + [(0.1, 0), (1.9, 1)]
        got = quality.threshold(spark.createDataFrame(rows, "score double, kind int").repartition(3))
        assert got == best_cut([s for s, k in rows if k], [s for s, k in rows if not k])
    assert quality.threshold(spark.createDataFrame([(1.0, 1)], "score double, kind int")) == -np.inf


def test_quality_threshold_learns_from_every_label(spark):
    """More bad rows than the 4,000 that once were drawn, which left most of the middle ones out."""
    low, odd, middle, high = "xxxx jjjj kkkk vvvv", "xxxx jjjj kkkk vvvv f", "fair words of a good text z", "fair words of a good text"
    ids = [r.id for r in spark.range(7_900).orderBy(F.xxhash64("id"), "id").collect()]  # of the first 4,000 bad ones 1,600 are middle ones
    texts = dict(zip(ids, [low] * 2_400 + [middle] * 4_500 + [odd] * 50 + [high] * 950, strict=True))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = quality.fit(docs, labels_of(spark, [(i, int(t in (odd, high)), 0) for i, t in texts.items()]))
    scores = model.scores(*buffers(pa.array([low, odd, middle, high]))).tolist()
    assert scores == sorted(scores)
    assert model.threshold == scores[3]  # 65 % of the bad outweigh ten times 5 % of the good


def test_quality_takes_awkward_rows(spark):
    docs = awkward(spark)
    for labels in (labels_of(spark, []), labels_of(spark, [(4, 1, 0), (4, 0, 0), (None, 1, 1), (8, None, 0)])):
        model = quality.fit(docs, labels)
        got = quality.quality(docs, model).collect()
        assert len(got) == docs.count()
        assert all(r.kept is not None for r in got)
        assert quality.quality(nothing(spark), model).count() == 0
    quality.fit(nothing(spark), labels_of(spark, []))


def best_path(model, codes):
    """The most likely roles, by trying all."""
    best = None
    for path in itertools.product(range(len(model.roles)), repeat=len(codes)):
        s = model.start[path[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(path)) + sum(model.emit[r, c].sum() for r, c in zip(path, codes, strict=True))
        if best is None or s > best[0] + 1e-12:
            best = s, path
    return [model.roles[r] for r in best[1]]


@pytest.mark.parametrize("block", [2048, 2])
def test_roles_are_the_viterbi_path(spark, monkeypatch, block):
    monkeypatch.setattr(transcripts, "BLOCK_TURNS", block)
    rng = np.random.default_rng(3)
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    model = transcripts.Model(["a", "b", "c"], log(rng.random(3)), log(rng.random((3, 3)) ** 3), log(rng.random((3, transcripts._CODES)) ** 4))
    rows = [(c, t, "\n".join("x" * int(n) + rng.choice(["", "?"]) for n in rng.integers(0, 60, rng.integers(1, 4)))) for c in range(6) for t in range(1 + c)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.role for r in transcripts.parse_turns(turns, model).collect()}
    codes = {(r[0], r[1]): r[2] for r in turns.select("conv_id", "turn", transcripts.turn_codes(turns.text)).collect()}
    for c in range(6):
        assert [got[c, t] for t in range(1 + c)] == best_path(model, [np.array(codes[c, t]) for t in range(1 + c)])


def test_transcripts_on_held_out_conversations(spark):
    turns = table(spark, MEDIUM, "conversations")
    got = transcripts.parse_turns(turns, transcripts.fit(turns)).toPandas().merge(turns.select("conv_id", "turn", "role").toPandas(), on=["conv_id", "turn"], suffixes=("", "_true"))
    held = got[got.held_out]
    assert len(got) == turns.count()
    assert (held.role == held.role_true).mean() > 0.95
    assert got.rendered.str.startswith("<|").all()


def test_transcripts_take_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, rid long, block long"
    rows = [(1, 0, "user", "User: hello?\n  Bot> yes"), (1, 0, "user", "User: hello?\n  Bot> yes"), (1, None, None, None), (None, None, "assistant", ""), (None, 1, "x", "a" * 100_000), (2, 5, "user", "\n\n\n")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    got = transcripts.parse_turns(turns, transcripts.fit(turns)).collect()
    assert len(got) == len(rows)
    assert [r.rendered.split("\n", 1)[1] for r in got if r.conv_id == 1 and r.turn == 0] == ["hello?\nyes\n"] * 2
    assert {r.role for r in transcripts.parse_turns(turns, None).collect()} == {None}
    empty = turns.limit(0)
    assert transcripts.parse_turns(empty, transcripts.fit(empty)).count() == 0


def test_every_role_is_learned_and_rows_without_order_are_not_gathered(spark):
    said = lambda i: ("", "user: ", "assistant: ", "system: ")[i % 4] + "x" * 4 ** (1 + i // 4)
    rows = [(c, t, f"role{(c + t) % 20:02d}", said((c + t) % 20)) for c in range(60) for t in range(30)]
    rows += [(None, None, "role00", "x")] * 500
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = transcripts.fit(turns)
    assert model.roles == [f"role{i:02d}" for i in range(20)]
    got = transcripts.parse_turns(turns, model).filter("conv_id is not null and held_out").toPandas().merge(turns.select("conv_id", "turn", "role").toPandas(), on=["conv_id", "turn"])
    assert set(got.role_x) == set(model.roles) and (got.role_x == got.role_y).mean() > 0.95
    one = np.exp(model.move[model.roles.index("role00")])
    assert one.argmax() == 1 and one[0] < 0.05  # rows of no conversation are no neighbours


def test_rows_of_one_id_or_of_none_are_drawn_each_for_itself(spark, monkeypatch):
    rows = [(None if i % 2 else 7, f"text {i} about {'abc'[i % 3] * 30} " + ("e" if i % 2 else "ä") * (i % 50), "en" if i % 2 else "de") for i in range(4_000)]
    rows += [(None, "one and the same", "en")] * 3_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "train", lambda pieces, label, languages, epochs: seen.append((len(pieces), languages)))
    monkeypatch.setattr(language, "fold", lambda doc_id, k: F.lit(0))
    language.fit(docs, rows=100)
    assert seen == [(100, ["de", "en"])]
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    collected = []
    real = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda df: collected.append(real(df)) or collected[-1])
    quality.fit(docs, labels, trusted_rows=50, rejected_rows=10)
    assert [len(c) for c in collected if "score" in c] == [50]
