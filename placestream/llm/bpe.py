"""Byte-level BPE ids of whole Arrow text columns: every distinct piece is encoded once a worker.

The tokenizers library encodes the pieces that its byte-level pre-tokenizer cuts a text into; a
piece's ids do not depend on its neighbours. So texts are cut here, by the same published pattern,
with numpy over many texts at a time, and only pieces not met before go through the library. Where a
text holds the string of an added token, the library cuts there first; that string is one piece here.
Tokenizers that cut or normalise texts in another way encode whole texts by the library itself.
"""

from __future__ import annotations

import contextlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

# Code points with the property White_Space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Suffixes that the pattern cuts off after an apostrophe.
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: How byte-level vocabularies write a space.
_SPACE_SIGN = "Ġ"
#: Pieces that are encoded in one string.
PIECES_A_STRING = 2_000
#: Distinct pieces a worker remembers before it begins anew.
CACHE_PIECES = 700_000
#: Bytes of a piece that make up its exact key; longer pieces are kept apart.
KEY_BYTES = 15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        table[_SPACES] = SPACE
        _classes = table
    return _classes


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset of each code point, its value) of UTF-8 bytes."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = raw[lead].astype(np.uint32)
    wide = np.flatnonzero(b >= 0x80)
    if len(wide):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        at, v = lead[wide], b[wide]
        tail = [padded[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
        two, three = (v & 0x1F) << 6 | tail[0], (v & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (v & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        b[wide] = np.where(v < 0xE0, two, np.where(v < 0xF0, three, four))
    return lead, b


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts, byte ends) of the pieces of all rows.

    Letters, numbers and other signs run together by class, one plain space before a run belongs to
    it, apostrophe suffixes are cut off, and of other space runs the last character stands alone.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead, cp = code_points(raw)
    n = len(cp)
    kind = char_classes()[cp]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[np.searchsorted(lead, offs)] = True
    space = kind == SPACE
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    begin = change | edge
    # where a run of spaces ends before something else of the same row, its last character parts from it
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    begin[last[cp[last] == 32] + 1] = False
    # suffixes, where the apostrophe begins a piece
    mark = np.flatnonzero((cp == 39) & begin[:n])
    if len(mark):
        more = np.concatenate([cp, np.zeros(2, np.uint32)])
        ends = np.concatenate([edge, np.ones(2, bool)])
        for suffix in _SUFFIXES:
            hit = mark
            for k, c in enumerate(suffix, 1):
                hit = hit[(more[hit + k] == ord(c)) & ~ends[hit + k]]
            for k in range(1, len(suffix) + 1):
                begin[hit + k] = False
            begin[hit + len(suffix) + 1] = True
    at = np.flatnonzero(begin[:n])
    start = lead[at]
    return start, np.append(start[1:], len(raw))


class PieceTable:
    """Where the ids of each known piece stand in a pool: open addressing over exact keys of two words."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)  # second is 0 in a free slot
        self.at, self.n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)

    def slots(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the keys still sought, slot that each looks at next), probe by probe; send back who goes on."""
        slot = (((second * np.uint64(0x9FB21C651E98DF25)) ^ first) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)
        rows = np.arange(len(first))
        while len(rows):
            more = yield rows, slot
            rows, slot = rows[more], slot[more] + 1 & len(self.first) - 1

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        out, probes, more = np.full(len(first), -1), self.slots(first, second), None
        with contextlib.suppress(StopIteration):
            while True:
                rows, slot = probes.send(more)
                there = self.second[slot]
                same = (there == second[rows]) & (self.first[slot] == first[rows])
                out[rows[same]] = slot[same]
                more = np.flatnonzero(~same & (there != 0))
        return out

    def add(self, first: np.ndarray, second: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Store distinct keys that are not there yet."""
        probes, more = self.slots(first, second), None
        with contextlib.suppress(StopIteration):
            while True:
                rows, slot = probes.send(more)
                free = np.flatnonzero(self.second[slot] == 0)
                mine, which = np.unique(slot[free], return_index=True)
                taken = free[which]
                self.first[mine], self.second[mine] = first[rows[taken]], second[rows[taken]]
                self.at[mine], self.n[mine] = at[rows[taken]], n[rows[taken]]
                more = np.ones(len(rows), bool)
                more[taken] = False


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, given as its JSON."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        described = json.loads(text)
        cuts, model = described.get("pre_tokenizer") or {}, described["model"]
        #: Whether texts may be cut into pieces here.
        self.by_piece = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and not described.get("normalizer") and not described.get("truncation") and not described.get("padding") and model.get("type") == "BPE" and not model.get("dropout")
        added = self.tokenizer.get_added_tokens_decoder().values()
        contents = sorted({t.content for t in added if t.content}, key=lambda c: -len(c.encode()))
        self.added = re.compile(b"|".join(re.escape(c.encode()) for c in contents)) if contents else None
        #: Added tokens that look at their neighbours; a text that holds one is a single piece.
        self.wary = re.compile(b"|".join(re.escape(t.content.encode()) for t in wary)) if (wary := [t for t in added if t.content and (t.lstrip or t.rstrip or t.single_word)]) else None
        line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id that parts pieces encoded in one string; None if they must be encoded one by one.
        self.parting = line_feed[0] if len(line_feed) == 1 and not any("\n" in c for c in contents) else None
        #: Whether no added token can lie across two pieces that begin with a space; ids that do.
        self.spaced = not any(c.isspace() for content in contents for c in content)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(_SPACE_SIGN)]] = True
        self.forget()

    def forget(self) -> None:
        bits = max(4, (CACHE_PIECES * 4 // 3).bit_length())
        self.table, self.known = PieceTable(bits), 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def cut(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte starts, byte ends) of the pieces of all rows; the string of an added token is one piece."""
        data = raw.tobytes()
        if self.added is None or not self.added.search(data):
            return pieces(raw, offs)
        whole = []  # spans that the library takes as they are, in order
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            row = data[a:b]
            if self.wary is not None and self.wary.search(row):
                whole.append((a, b))
            else:
                whole += [(a + m.start(), a + m.end()) for m in self.added.finditer(row)]
        spans = np.array(whole, np.int64).reshape(-1, 2)
        start, _ = pieces(raw, np.unique(np.concatenate([offs, spans.ravel()])))
        span = np.searchsorted(spans[:, 0], start, "left") - 1  # the last span that begins before the piece
        inside = (span >= 0) & (start < np.append(spans[:, 1], 0)[span])
        start = start[~inside]
        return start, np.append(start[1:], len(raw))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows on end, number of ids of each row)."""
        if not self.by_piece:
            data = raw.tobytes()
            rows = self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)
            n = np.array([len(r) for r in rows], np.int64)
            return np.concatenate([np.array(r.ids, np.uint32) for r in rows]) if rows else np.zeros(0, np.uint32), n
        if self.known + len(self.long) > CACHE_PIECES:
            self.forget()
        start, end = self.cut(raw, offs)
        size = end - start
        padded = np.concatenate([raw, np.zeros(2 * 8, np.uint8)])
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place
        first = eight[start] & _MASKS[np.minimum(size, 8)]
        second = eight[np.minimum(start + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        short = size <= KEY_BYTES
        slot = self.table.find(first, second)
        slot[~short] = -1
        fresh = np.flatnonzero((slot < 0) & short)
        if len(fresh):
            order = fresh[np.lexsort((first[fresh], second[fresh]))]
            a, b = first[order], second[order]
            new = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
            at, n = self.learn(raw, start[new], end[new])
            self.table.add(first[new], second[new], at, n)
            self.known += len(new)
            slot[fresh] = self.table.find(first[fresh], second[fresh])
        at, n = self.table.at[slot], self.table.n[slot].astype(np.int64)
        rest = np.flatnonzero(~short)
        if len(rest):
            data = [raw[a:b].tobytes() for a, b in zip(start[rest], end[rest], strict=True)]
            unknown = {d: i for d, i in zip(data, rest.tolist(), strict=True) if d not in self.long}
            if unknown:
                of = np.fromiter(unknown.values(), np.int64, len(unknown))
                self.long |= dict(zip(unknown, zip(*(x.tolist() for x in self.learn(raw, start[of], end[of])), strict=True), strict=True))
            at[rest], n[rest] = np.array([self.long[d] for d in data]).T
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(at - upto + n, n) + np.arange(upto[-1] if len(n) else 0)]
        total = np.concatenate([[0], upto])
        return ids, np.diff(total[np.searchsorted(start, offs)])  # a piece never spans two rows

    def sort(self, piece: str) -> int:
        """0: may be encoded with others on end; 1: parted by line feeds; 2: alone."""
        if self.parting is None or piece[-1:].isspace() or "\n" in piece or (self.wary and self.wary.search(piece.encode())):
            return 2
        return 0 if piece[0] == " " and self.spaced else 1

    def learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode these pieces and put their ids into the pool: (place, number of ids) of each.

        Pieces of a space and other characters stay pieces when they are put on end, and only their
        first id holds a space. A line feed is a piece of its own before anything but white space.
        So pieces of the two sorts are encoded many to a string, the others one by one.
        """
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        sort = np.array([self.sort(t) for t in texts], np.int8)
        n = np.zeros(len(texts), np.int64)
        parts, order = [], [np.flatnonzero(sort == k) for k in range(3)]
        for which, between in zip(order[:2], ("", "\n"), strict=True):
            strings = [between + between.join([texts[i] for i in which[k : k + PIECES_A_STRING]]) for k in range(0, len(which), PIECES_A_STRING)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            if found:
                ids = np.concatenate(found)
                marks = np.flatnonzero(ids == self.parting if between else self.opens[ids])
                n[which] = np.diff(marks, append=len(ids)) - len(between)
                parts.append(ids[ids != self.parting] if between else ids)
        each = self.tokenizer.encode_batch_fast([texts[i] for i in order[2]], add_special_tokens=False)
        n[order[2]] = [len(e) for e in each]
        parts += [np.array(e.ids, np.uint32) for e in each]
        ids, order = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(order)
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + len(ids), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        at = np.zeros(len(texts), np.int64)
        at[order] = self.filled + np.cumsum(n[order]) - n[order]
        self.filled += len(ids)
        return at, n
