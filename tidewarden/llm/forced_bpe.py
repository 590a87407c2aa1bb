"""Word-end BPE by forced-boundary splitting.

Certain cuts of a text are the places no token of the vocabulary can span:

* white space, which the vocabulary's normaliser drops;
* the edges of pre-tokens (letters / single digits / other marks);
* inside a pre-token, between two bytes whose pair occurs in no token.

Merges never cross such a place, so the fragments between cuts are encoded
independently and their ids concatenated; the result is that of encoding the
whole text.  White-space fragments and the pieces below them are remembered in
a bounded table, as natural text repeats them.  A special token counts only in its
exact letters; it is cut out before anything is lower-cased, as the library does.  A
fragment with characters outside Latin-1 goes through the vocabulary's own normaliser
and pre-tokeniser first, and is cut and merged like any other from there on.  Pieces
of more than ``WIDEST`` bytes go through the library's merges, which keep a heap of the
pairs, so a text of one unbroken run takes no more time than its length asks for; a
second model without the word-end mark has those that do not end their pre-token.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import filterfalse

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: Fragments longer than this are encoded but not remembered.
KEEP_CHARS = 48
#: Fragments remembered per worker, in each of two generations.
KEEP_ROWS = 250_000

#: Pieces of more bytes are merged one by one, by the library's heap.
WIDEST = 32
#: Before a pre-token that is in the vocabulary's normal form already (no fragment holds a line end).
NORMAL = "\n"

#: No token; no merge.
NONE = (1 << 31) - 1
NO_RANK = 1 << 40

# Letters and numbers of Latin-1 in lower case; the rest that is no white space is a mark.
_L = "a-zªµºß-öø-ÿ"
_N = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")
_SIMPLE = re.compile(r"([a-zà-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() takes these for white space, the vocabulary's rules do not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def resolve(vocabulary: str) -> str:
    """A path, or the name of a public vocabulary file installed on this machine."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others take the next free code
    points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


def occurring_pairs(tokens, letters: list[str]) -> frozenset[tuple[int, int]]:
    """The pairs of bytes that stand side by side inside any token."""
    value = {c: b for b, c in enumerate(letters)}
    seen: set[tuple[int, int]] = set()
    for t in tokens:
        data = [value[c] for c in t.removesuffix(WORD_END) if c in value]
        seen.update(zip(data, data[1:]))
    return frozenset(seen)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ForcedBoundaryEncoder(dict):
    """Maps a white-space fragment to its ids (little-endian bytes of ``dtype``)."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        super().__init__()
        from tokenizers import Tokenizer, models

        path = resolve(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        self.inside = occurring_pairs(self.vocab, self.letters)
        self.forced = np.ones((256, 256), bool)
        for a, b in self.inside:
            self.forced[a, b] = False
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.token = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.model = self.library.model
        self.open_model = models.BPE(vocab=self.vocab, merges=merges)  # no mark: for pieces that do not end their pre-token
        self.value = {c: b for b, c in enumerate(self.letters)}
        self.shown = {b: c for b, c in enumerate(self.letters) if c != chr(b)}
        self.byte_id = np.array([[self.vocab[c] for c in self.letters], [self.vocab[c + WORD_END] for c in self.letters]], np.int64)
        self.merged_id = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.hashed = self._hash_tables(np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in merges], np.uint64))
        self.older: dict[str, bytes] = {}

    # -- fragments ---------------------------------------------------------
    def __missing__(self, fragment: str) -> bytes:
        """Of a fragment that learn() has not seen, or that is too long to remember."""
        ids = self.older.get(fragment)
        if ids is None:
            words = self._words(fragment)
            if words is None:
                ids = self._special(fragment)
            else:
                each = {w: self._pretoken(w) for w in set(words)}
                ids = b"".join([each[w] for w in words])
        if len(fragment) <= KEEP_CHARS:
            self[fragment] = ids
        return ids

    def _words(self, fragment: str) -> list[str] | None:
        """Pre-tokens of a fragment; None for a special token."""
        word = _SIMPLE.fullmatch(fragment)
        if word:
            head, tail = word.groups()
            return [head, tail] if tail else [head]
        if fragment[0] == " ":
            return None
        if not _latin(fragment):
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(fragment))
            return [NORMAL + bytes([self.value[c] for c in w]).decode("utf-8") for w, _ in shown]
        return _PRETOKEN.findall(fragment.lower())

    @staticmethod
    def _bytes(word: str) -> bytes:
        return (word[1:] if word[0] == NORMAL else word.lower()).encode("utf-8")

    def _pieces(self, word: str) -> list[tuple[bytes, bool]]:
        """A pre-token cut at every forced place; True marks the piece that ends it."""
        data = self._bytes(word)
        cuts = [0, *(i for i, pair in enumerate(zip(data, data[1:]), 1) if pair not in self.inside), len(data)]
        return [(data[a:b], b == len(data)) for a, b in zip(cuts, cuts[1:])]

    def learn(self, fragments: set[str]) -> None:
        """Encode new fragments together: their pieces go through the merges side by side."""
        if len(self) >= KEEP_ROWS:
            self.older = dict(self)
            self.clear()
        known, plan, new = self.older, {}, set()
        for f in fragments:
            if f in known:
                self[f] = known[f]
            elif len(f) <= KEEP_CHARS:
                if f.isalpha() and _latin(f):  # letters alone: one pre-token
                    new.add(f)
                    continue
                words = self._words(f)
                if words is None:
                    self[f] = self._special(f)
                else:
                    plan[f] = words
                    new.update(words)
        self._learn_words([w for w in new if w not in self])
        for f, words in plan.items():
            if f not in self:
                self[f] = b"".join([self[w] for w in words])

    def _learn_words(self, words: list[str]) -> None:
        """Encode pre-tokens together: cut at every forced place, the pieces of one width side by side in numpy."""
        if not words:
            return
        raw = [self._bytes(w) for w in words]
        data = np.frombuffer(b"".join(raw) + bytes(WIDEST), np.uint8)
        stops = np.fromiter(map(len, raw), np.int64, len(raw)).cumsum()
        begins = np.zeros(int(stops[-1]) + 1, bool)  # of pieces
        begins[1:-1] = self.forced[data[: stops[-1] - 1], data[1 : stops[-1]]]
        begins[0] = True
        begins[stops] = True
        at = np.flatnonzero(begins)
        starts, counts = at[:-1], np.diff(at)
        last = np.zeros(len(begins), bool)
        last[stops] = True
        last = last[at[1:]]  # pieces that end their word
        found = counts.copy()
        slow = np.flatnonzero(counts > WIDEST)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for low, width in ((0, 8), (8, 16), (16, WIDEST)):
            own = np.flatnonzero((counts > low) & (counts <= width))
            if len(own):
                rows, found[own] = self._merge_matrix(data[starts[own, None] + np.arange(width)], counts[own], last[own])
                parts.append((own, rows))
        for i in slow.tolist():
            one = np.frombuffer(self._one_piece(data[starts[i] : starts[i] + counts[i]].tobytes(), bool(last[i])), self.dtype)
            found[i] = len(one)
            parts.append((np.array([i]), one[None, :].astype(np.int64)))
        places = np.concatenate([[0], found.cumsum()])
        ids = np.zeros(int(places[-1]), self.dtype)
        for own, rows in parts:
            inside = np.arange(rows.shape[1]) < found[own, None]
            ids[(places[own, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        size, flat = self.dtype.itemsize, ids.tobytes()
        ends = (places[1:][last] * size).tolist()
        begin = 0
        for w, end in zip(words, ends):
            self[w] = flat[begin:end]
            begin = end

    def _merge_matrix(self, data: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many pieces at once (a row of bytes each, ``counts`` of them its own): in each round
        every row makes its leftmost merge of least rank."""
        (n, width), counts = data.shape, counts.copy()
        at = np.arange(width)
        ids = np.where(at < counts[:, None], self.byte_id[0][data], NONE)
        rows = np.flatnonzero(ends)
        ids[rows, counts[rows] - 1] = self.byte_id[1][data[rows, counts[rows] - 1]]
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        work_ids, work_ranks = ids.copy(), ranks
        while True:
            best = work_ranks.argmin(1)
            rank = work_ranks[np.arange(len(live)), best]
            go = rank < NO_RANK
            if not go.all():
                ids[live[~go]] = work_ids[~go]
                live, work_ids, work_ranks, best, rank = live[go], work_ids[go], work_ranks[go], best[go], rank[go]
            if not len(live):
                return ids, counts
            counts[live] -= 1
            each = np.arange(len(live))
            from_ids = np.minimum(at[None, :] + (at[None, :] > best[:, None]), width - 1)
            work_ids = np.take_along_axis(work_ids, from_ids, 1)
            work_ids[:, -1] = NONE
            work_ids[each, best] = self.merged_id[rank]
            from_ranks = np.minimum(at[None, :-1] + (at[None, :-1] > best[:, None]), width - 2)
            work_ranks = np.take_along_axis(work_ranks, from_ranks, 1)
            work_ranks[:, -1] = NO_RANK
            right = np.minimum(best + 1, width - 1)
            work_ranks[each, np.minimum(best, width - 2)] = self.pair_rank(work_ids[each, np.minimum(best, width - 2)], work_ids[each, np.minimum(right, width - 1)])
            left = np.flatnonzero(best > 0)
            work_ranks[left, best[left] - 1] = self.pair_rank(work_ids[left, best[left] - 1], work_ids[left, best[left]])

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two ids, NO_RANK where there is none: two hashed tables."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(key.shape, NO_RANK, np.int64)
        for keys, ranks, factor, shift in self.hashed:
            slot = (key * factor) >> shift
            out = np.where(keys[slot] == key, ranks[slot], out)
        return out

    def _hash_tables(self, pairs: np.ndarray) -> list[tuple]:
        tables, rest, bits = [], np.arange(len(pairs)), 18
        factor = 0x9E3779B97F4A7C15
        while len(rest):
            shift = np.uint64(64 - bits)
            slot = (pairs[rest] * np.uint64(factor)) >> shift
            keys, ranks = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, np.int64)
            keys[slot[::-1]], ranks[slot[::-1]] = pairs[rest[::-1]], rest[::-1]
            tables.append((keys, ranks, np.uint64(factor), shift))
            rest = rest[keys[slot] != pairs[rest]]
            factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        return tables

    def _pretoken(self, word: str) -> bytes:
        pieces = self._pieces(word)
        each = {p: self._one_piece(*p) for p in set(pieces)}
        return b"".join([each[p] for p in pieces])

    def _one_piece(self, data: bytes, ends: bool) -> bytes:
        symbols = data.decode("latin-1").translate(self.shown)
        return b"".join([self.packed[t.id] for t in (self.model if ends else self.open_model).tokenize(symbols)])

    def _special(self, fragment: str) -> bytes:
        """Of a special token, marked by a blank before it."""
        return self.packed[self.special[fragment[1:]]]

    # -- texts -------------------------------------------------------------
    def _split(self, text: str | None) -> list[str]:
        """White-space fragments; a special token is a fragment with a blank before it."""
        if not text:
            return []
        if self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += self._fragments(text[at : m.start()])
                out.append(" " + m[0])
                at = m.end()
            return out + self._fragments(text[at:])
        return self._fragments(text)

    def _fragments(self, text: str) -> list[str]:
        if _latin(text):
            text = text.lower()
        if any(c in text for c in _NOT_SPACE):
            return [p for p in _SPACE.split(text) if p]
        return text.split()

    def encode_batch(self, texts) -> list[bytes]:
        """Ids of whole texts as little-endian bytes of ``dtype``; null is empty."""
        parts = [self._split(t) for t in texts]
        out, start = [], 0
        while start < len(parts):  # together, but no more at once than the table is to take
            new, stop = set(), start
            while stop < len(parts) and len(new) < max(KEEP_ROWS // 8, 1):
                new.update(filterfalse(self.__contains__, set(parts[stop])))
                stop += 1
            self.learn(new)
            out += [b"".join(map(self.__getitem__, p)) for p in parts[start:stop]]
            start = stop
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], self.dtype)

    def decode(self, ids) -> str:
        """As the library decodes without a decoder: token texts joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))


_ENCODERS: dict[str, ForcedBoundaryEncoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> ForcedBoundaryEncoder:
    """The encoder of this process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ForcedBoundaryEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def release() -> None:
    """Give back the memory of this process's encoders: workers go on to other operators' tasks."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
