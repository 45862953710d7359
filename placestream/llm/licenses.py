"""Operator 2: license scans by an exact containment join of text blocks with license templates.

Tokens are pairs of words that stand together, so that a text which has a notice's common words, but
not the name of its license, holds too few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import PLAIN, Words, buffers, hash_text, shingles, slices, words

# Phrases whose words in a row give a base label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices that licenses ask for or that commonly stand for them, at most HOP words each, and the two
# words of each that tell it from notices of kin: a block without them in a row does not hold it.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", "gnu general"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see http www gnu org licenses", "affero general"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see http www gnu org licenses", "lesser general"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "released under the apache license", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "as is"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "any person"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "its contributors"),
    ("bsd", "spdx license identifier bsd 3 clause", "bsd 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ("cc-by", "this work is licensed under a creative commons attribution 3 0 unported license", "attribution 3"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial 4"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "noncommercial noderivatives"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "by nc"),
    ("cc-by", "licensed under cc by 4 0", "by 4"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("boost", "distributed under the boost software license version 1 0", "boost software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "or organization"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("proprietary", "this software is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying"),
)
#: Least share of a template's distinct word pairs that a block must hold.
THRESHOLD = 0.8
#: Blocks are BLOCK words long and begin every HOP words, so any run of HOP words lies whole in one.
BLOCK, HOP = 128, 64


def pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every two words of a row that stand together."""
    return shingles(w.hashes(), w.row, 2)


@dataclass
class Templates:
    """Templates as sets of token codes; code order is the global order, rarest in the corpus first."""

    labels: list[str]
    hashes: np.ndarray  # token hashes, sorted
    codes: np.ndarray  # rank in the global order of each sorted hash
    sets: list[np.ndarray]  # ranks of each template's tokens, ascending
    telling: list[int]  # rank of the token each template cannot do without, -1 for none

    @classmethod
    def ordered(cls, templates: tuple[tuple[str, ...], ...], frequency: dict[int, int] | None = None) -> Templates:
        tokens = lambda text: np.unique(shingles(h := hash_text(text, PLAIN), np.zeros(len(h), np.int64), 2)[0])
        each = [tokens(t[1]) for t in templates]
        hashes = np.unique(np.concatenate(each))
        seen = np.array([(frequency or {}).get(int(h), 0) for h in hashes.view(np.int64)], np.int64)
        codes = np.empty(len(hashes), np.int64)
        codes[np.lexsort((hashes, seen))] = np.arange(len(hashes))
        rank = lambda h: codes[np.searchsorted(hashes, h)]
        return cls([t[0] for t in templates], hashes, codes, [np.sort(rank(e)) for e in each], [int(rank(tokens(t[2]))[0]) if t[2:] else -1 for t in templates])

    def code(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token hash, or -1 outside the templates' vocabulary."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.codes[at], -1)

    def least(self, t: int) -> int:
        return math.ceil(THRESHOLD * len(self.sets[t]) - 1e-9)


def token_frequencies(docs: DataFrame, templates: tuple[tuple[str, ...], ...] = TEMPLATES) -> dict[int, int]:
    """How often each template token occurs in the whole corpus: one partial row a task and token."""
    plain = Templates.ordered(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plain.hashes), np.int64)
        for batch in batches:
            for _, raw, offs in slices(*buffers(batch.column(0))):
                code = plain.code(pairs(words(raw, offs, PLAIN))[0])
                total += np.bincount(code[code >= 0], minlength=len(total))
        by_hash = np.empty_like(total)
        by_hash[:] = total[plain.codes]
        yield pa.record_batch([pa.array(plain.hashes.view(np.int64)), pa.array(by_hash)], names=["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def containments(t: Templates, code: np.ndarray, row: np.ndarray, index: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(row, template, containment) of every block and template at the threshold or above.

    ``code`` has template tokens only, with their row and the index of their first word. A template is looked at in a
    block only if the block holds one of its |T| - o + 1 rarest tokens (prefix), holds o distinct
    tokens at all (length), and enough tokens stand behind the first shared one in either order
    (position), where o is the least overlap, and its telling token. The overlap is then counted in full.
    """
    # every token lies in two blocks: the one that begins at or before it, and the one before that
    last = index // HOP
    rows, blocks, codes = np.concatenate([row, row]), np.concatenate([last, last - 1]), np.concatenate([code, code])
    real = blocks >= 0
    key = np.unique(np.stack([rows[real], blocks[real], codes[real]], 1), axis=0)
    if not len(key):
        return
    prefix = np.zeros(len(t.hashes), bool)
    for k, s in enumerate(t.sets):
        prefix[s[: len(s) - t.least(k) + 1]] = True
    edge = np.flatnonzero(np.append(True, (key[1:, :2] != key[:-1, :2]).any(1)))
    hot = np.logical_or.reduceat(prefix[key[:, 2]], edge)
    ends = np.append(edge[1:], len(key))
    for a, b in zip(edge[hot], ends[hot], strict=True):
        have = key[a:b, 2]
        for k, s in enumerate(t.sets):
            o = t.least(k)
            if len(have) < o or t.telling[k] >= 0 and have[min(np.searchsorted(have, t.telling[k]), len(have) - 1)] != t.telling[k]:
                continue
            shared = np.intersect1d(s[: len(s) - o + 1], have, assume_unique=True)
            if not len(shared) or min(len(s) - np.searchsorted(s, shared[0]), len(have) - np.searchsorted(have, shared[0])) < o:
                continue
            overlap = len(np.intersect1d(s, have, assume_unique=True))
            if overlap >= o:
                yield int(key[a, 0]), k, overlap / len(s)


def license_scan(docs: DataFrame, templates: tuple[tuple[str, ...], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base places, labels and the best containment.

    Null text counts as empty: no words, no places, labels '' and score 0. Every occurrence of a
    phrase is a place, overlapping ones too. Repeated rows are scanned alike; an empty table gives
    an empty result. Whole texts are read, in blocks of words that overlap by half.
    """
    t = Templates.ordered(templates, token_frequencies(docs, templates))
    phrases = [(label, hash_text(p, PLAIN)) for p, label in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base, first, last, base, labels, score = [], [], [], [], [], [], []
            for _, raw, offs in slices(*buffers(batch.column(1))):
                w, rows = words(raw, offs, PLAIN), len(offs) - 1
                h = w.hashes()
                token, token_at = shingles(h, w.row, 2)
                code = t.code(token)
                found = [set() for _ in range(rows)]
                best = np.zeros(rows)
                places = []
                for label, p in phrases:
                    n = len(h) - len(p) + 1
                    hit = np.flatnonzero(h[: max(n, 0)] == p[0])
                    for k in range(1, len(p)):
                        hit = hit[(h[hit + k] == p[k]) & (w.row[hit + k] == w.row[hit])]
                    places.append(hit)
                    for r in set(w.row[hit].tolist()):
                        found[r].add(label)
                place = np.sort(np.concatenate(places))
                r = w.row[place]
                at = place - w.first[r]
                lo, hi = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                np.minimum.at(lo, r, at)
                np.maximum.at(hi, r, at)
                best[np.unique(r)] = 1.0
                base += [",".join(sorted(x)) for x in found]
                inside = token_at[code >= 0]
                for r_, k, c in containments(t, code[code >= 0], w.row[inside], inside - w.first[w.row[inside]]):
                    found[r_].add(t.labels[k])
                    best[r_] = max(best[r_], c)
                n_words.append(w.count)
                n_base.append(np.bincount(r, minlength=rows))
                first.append(lo)
                last.append(hi)
                labels += [",".join(sorted(x)) for x in found]
                score.append(best)
            if not n_words:
                continue
            n_words, n_base, first, last, score = map(np.concatenate, (n_words, n_base, first, last, score))
            none = last < 0
            yield pa.record_batch([batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_base.astype(np.int64)), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base), pa.array(labels), pa.array(score)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{label}', '{text}', '{telling}')" for i, (label, text, telling) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())
    return rf"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
templates as (select id, label, telling, list_distinct(list_transform(range(1, len(string_split(t, ' '))), lambda i: string_split(t, ' ')[i] || ' ' || string_split(t, ' ')[i + 1])) as tokens from (values {rows}) v(id, label, t, telling)),
phrases as (select * from (values {phrases}) v(label, p)),
vocabulary as (select distinct unnest(tokens) as token from templates),
positions as (select doc_id, unnest(w) as token, unnest(range(len(w))) as i from docs),
pairs as (select doc_id, token || ' ' || lead(token) over (partition by doc_id order by i) as token, i from positions),
places as (select d.doc_id, p.label, x.i from docs d join positions x on x.doc_id = d.doc_id join phrases p on x.token = p.p[1] and d.w[x.i + 1 : x.i + len(p.p)] = p.p),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as labels from places group by doc_id),
blocks as (select distinct doc_id, token, unnest([i // {HOP}, i // {HOP} - 1]) as block from pairs join vocabulary using (token)),
shared as (select b.doc_id, t.label, count(*) / max(len(t.tokens))::double as c from blocks b join (select id, label, telling, tokens, unnest(tokens) as token from templates) t using (token)
  where block >= 0 group by b.doc_id, b.block, t.id, t.label having count(*) >= ceil({THRESHOLD} * max(len(t.tokens)) - 1e-9) and bool_or(token = t.telling)),
method as (select doc_id, max(c) as c, list_distinct(list(label)) as labels from shared group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when b.n_base > 0 then 1.0 else coalesce(m.c, 0.0) end::double as score
from docs d left join base b using (doc_id) left join method m using (doc_id)
"""


OP2_SQL = _sql()
