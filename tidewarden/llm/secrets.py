"""Operator 8: secret scan with a linear-chain conditional random field.

Base spans, leftmost and non-overlapping per kind: ``assign`` (a keyword, a colon or
equals sign, a value of 6 characters or more), ``access`` (AKIA and capitals or
digits, 20 characters or more), ``hex`` (24 hexadecimal digits or more).  A span is
the whole match, in code points, end exclusive.

Method: all words and numbers are tokens, tagged O, B (secret begins) or I (goes on); a
gap of more than ``MAX_GAP`` characters ends a run.  No token is ruled out beforehand.
Features: shape (length, character classes, class changes, entropy), the word itself and
its neighbours where training knew them, the gaps, and the document (share of numbers,
lines that assign something, whether base spans exist).  Scores are sums kept per distinct token; those whose weights
alone prove O on every best path (``Tagger.possible``) cut the chain, and the stretches
between them are decoded by Viterbi with the same result as the whole run.  The weights
are trained here on the conditional log-likelihood over generated lines of known tags,
once: the shared folder keeps them under a digest of this file (``stored_tagger``).  A
word that stands three times in a row and on is filler, hence O; a tagged span counts
if its path leads the one without it by ``MARGIN``.  What a tagged run holds outside the base spans is added under kind ``crf``.

Null and empty texts have no spans; repeated rows repeat; a very long text is tagged
whole; other columns, whatever their names, take no part; an empty table gives no rows.
Of spans at one start the kinds come in the order assign, access, hex, crf.
"""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import string
import uuid
from bisect import bisect
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forced_bpe import release
from .storage import arrow_rows, map_rows, shared_dir

KINDS = ("assign", "access", "hex", "crf")
MAX_GAP = 4
STATES = 3  # O, B, I
NEVER = 30.0
#: What O is ahead for a word that stands there thrice in a row and on.
FILLER = 50.0
#: A tagged span's path must beat the one without it by so much.  On held-out lines of known tags (short_lines,
#: generated_lines) 97 and 99 of 100 true spans do; three quarters of the false ones in bundled prose do not.
MARGIN = 0.8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"
_TOKEN = re.compile(rf"([{_LATIN}+][{_LATIN}+/_.-]*|[^\W_{_LATIN}]+)")
_ZEROS = {i: "0" for i in range(48, 58)}
_ENDS = ".-/_"
_PART = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_KEYWORDS = ("pass", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def tokens_of(text: str) -> tuple[list[str], list[str]]:
    """(gaps, tokens): the text is gap, token, gap, ..., gap.  Every word and number is a token, of any length and class."""
    parts = _TOKEN.split(text)
    return parts[::2], parts[1::2]


_WIDTHS = (8, 16, 48)
#: Classes of bytes: digit, upper, lower, other marks (0: none); letters beyond ASCII come as case-true ASCII letters.
_CLASS, _VOWEL_AT, _CONSONANT_AT = np.zeros(256, np.uint8), np.zeros(256, bool), np.zeros(256, bool)
for _c in range(1, 128):
    _CLASS[_c] = 1 if chr(_c).isdigit() else 2 if chr(_c).isupper() else 3 if chr(_c).islower() else 4
    _VOWEL_AT[_c] = chr(_c) in "aeiouyAEIOUY"
    _CONSONANT_AT[_c] = chr(_c) in "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
_SORTS = ("digits", "lower", "upper", "title", "both", "mixed", "marks")
#: What the j-th repeat of a character adds to the sum of k * log2(k).
_REPEAT = np.array([j * math.log2(j) - (j - 1) * (math.log2(j - 1) if j > 1 else 0) if j else 0.0 for j in range(4097)])


def _plain(token: str) -> bytes:
    """A byte for every character: letters and numbers beyond ASCII as vowels (they are counted so) or digits, others as marks."""
    if token.isascii():
        return token.encode()
    return bytes(ord(c) if c < "\x80" else 48 if c.isdigit() else 65 if c.isupper() else 97 if c.islower() else 35 for c in token)


def measures(tokens: list[str]) -> np.ndarray:
    """What the features of tokens alone are made of: a row of small numbers (buckets) each, by the columns of ``MEASURES``."""
    out = np.zeros((len(tokens), len(MEASURES)), np.int64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    low = 0
    for width in (*_WIDTHS, int(size.max(initial=0))):
        own = np.flatnonzero((size > low) & (size <= width))
        step = max(1, (1 << 22) // max(width, 1))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            data = np.frombuffer(b"".join([_plain(tokens[i]).ljust(width, b"\0") for i in some.tolist()]), np.uint8).reshape(len(some), width)
            out[some] = _measured(data, size[some], [tokens[i] for i in some.tolist()] if width > 0 else [])
        low = max(low, width)
    return out


def _measured(data: np.ndarray, size: np.ndarray, tokens: list[str]) -> np.ndarray:
    kinds, width = _CLASS[data], data.shape[1]
    digits, upper, lower, marks = ((kinds == k).sum(1) for k in (1, 2, 3, 4))
    changes = ((kinds[:, 1:] != kinds[:, :-1]) & (kinds[:, 1:] > 0)).sum(1)
    ordered = np.sort(data, 1)
    fresh = np.ones(data.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.arange(width)
    nth = np.minimum(at - np.maximum.accumulate(np.where(fresh, at, 0), 1) + 1, len(_REPEAT) - 1)
    entropy = np.log2(size) - (_REPEAT[nth] * (ordered > 0)).sum(1) / size
    rough = _CONSONANT_AT[data].cumsum(1)
    rough = (rough - np.maximum.accumulate(np.where(_CONSONANT_AT[data], 0, rough), 1)).max(1)
    letters = upper + lower
    title = (upper == 1) & (kinds[:, 0] == 2)
    sort = np.select([digits == size, (letters == size) & (upper == 0), (letters == size) & (lower == 0), (letters == size) & title, letters == size, marks == 0], range(6), 6)
    shared = lambda edges, x: np.searchsorted(edges, x, side="right")
    return np.stack(
        [
            shared(_LENGTHS, size), sort, shared(_SHARES, digits / size), shared(_CASES, upper / size), shared(_CASES, lower / size), shared(_TURNS, changes / size), shared(_FLIPS, changes), shared(_ENTROPY, entropy),
            shared(_VOWEL, _VOWEL_AT[data].sum(1) / np.maximum(letters, 1)), np.minimum(rough, 7), np.minimum((data == 46).sum(1), 3), np.minimum((data == 47).sum(1), 3), np.minimum((data == 45).sum(1), 4), (upper > 0) & (lower > 0) & (digits > 0),
        ],
        1,
    )


MEASURES = {"long": 13, "sort": 7, "digits": 7, "upper": 6, "lower": 6, "changes": 5, "flips": 4, "entropy": 7, "vowels": 5, "rough": 8, "dots": 4, "slashes": 4, "dashes": 5, "mixed": 2}  # columns, and how many values each has
_PLACES = np.cumprod([1, *list(MEASURES.values())[:-1]])


_LENGTHS, _SHARES, _CASES, _TURNS, _FLIPS, _ENTROPY, _VOWEL = (3, 4, 6, 8, 10, 12, 16, 20, 28, 36, 48, 80), (.01, .1, .2, .35, .6, .9), (.01, .1, .25, .5, .9), (.1, .2, .35, .5), (2, 4, 7), (2, 2.8, 3.3, 3.7, 4.2), (.05, .15, .3, .45)


def shape(m: np.ndarray) -> list[str]:
    """Names of the features of a token's measures."""
    long, sort, digits, upper, lower, changes, flips, entropy, vowels, rough, dots, slashes, dashes, mixed = m.tolist()
    sort = _SORTS[sort]
    return [
        "bias", f"len{long}", f"sort{sort}", f"sort{sort}{long}", f"digits{digits}", f"upper{upper}", f"lower{lower}", f"changes{changes}", f"cased{flips}{sort}", f"entropy{entropy}",
        f"vowels{vowels}{sort}", f"rough{rough}{sort}", f"dots{dots}", f"slashes{slashes}", f"dashes{dashes}", f"mixed{mixed}",
    ]


def _head(token: str) -> str:
    return "head" + token[:4].translate(_ZEROS)


def _gap(gap: str) -> int:
    """Number of the gap's class: none, blanks, colon, equals sign, quote, line, one mark, others."""
    bare = gap.strip()
    if not bare:
        return 0 if not gap else 5 if "\n" in gap else 1
    return 4 if bare[-1] in "'\"`" else 2 if bare == ":" else 3 if bare == "=" else 6 if len(gap) == 1 else 7


GAPS = 8
REACH = 4
#: Scores a word gives to others: to the next token by gap class, to the one after it, to the next REACH, and to the one before.
_SECOND, _NEAR, _LAST, _WIDTH = GAPS, GAPS + 1, GAPS + 2, GAPS + 3
_REMEMBERED = 250_000
#: Texts whose new tokens are measured together.
GROUP = 100


class Tagger:
    """The field: emission weights (feature x state) and transitions (state x state)."""

    def __init__(self, slots: dict[str, int]):
        self.slots = slots
        self.emit = np.zeros((len(slots) + 1, STATES))  # the last is for what has no weight
        self.move = np.zeros((STATES, STATES))
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "own", "word_at", "words", "given", "gaps", "around", "shapes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.gaps: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.shapes: dict[int, np.ndarray] = {}
        self.own, self.word_at = np.zeros((1024, STATES)), np.zeros(1024, np.int32)
        self.given, self.around = np.zeros((256, _WIDTH, STATES)), None

    def _sum(self, names) -> np.ndarray:
        return self.emit[[self.slots[x] for x in names if x in self.slots]].sum(0)

    def learn_tokens(self, tokens) -> None:
        """Put tokens into the tables: their own scores and what they give their neighbours, many at a time."""
        new = [t for t in tokens if t not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > max(_REMEMBERED, len(new)):
            self.forget()
            new = list(tokens)
        first = len(self.ids)
        while first + len(new) > len(self.own):
            self.own, self.word_at = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.word_at, np.zeros_like(self.word_at)])
        cores = [t.rstrip(_ENDS) or t for t in new]
        m = measures(cores)
        codes, inverse = np.unique(m @ _PLACES, return_inverse=True)
        example = np.zeros(len(codes), np.int64)
        example[inverse] = np.arange(len(new))
        for code, i in zip(codes.tolist(), example.tolist()):
            if code not in self.shapes:
                self.shapes[code] = self._sum(shape(m[i]))
        alone = np.stack([self.shapes[c] for c in codes.tolist()])[inverse]
        slots, none = self.slots, len(self.emit) - 1
        sorts = [_SORTS[k] for k in m[:, 1].tolist()]
        names = [lexical(c, k, slots) for c, k in zip(cores, sorts)]
        at = np.fromiter((slots.get("word:" + w, none) for w in names), np.int64, len(names))
        heads = np.fromiter((slots.get(_head(c), none) for c in cores), np.int64, len(cores))
        self.own[first : first + len(new)] = alone + self.emit[heads] + self.emit[at]
        self.word_at[first : first + len(new)] = [self._word(w) for w in names]
        self.ids.update(zip(new, range(first, first + len(new))))

    def _word(self, word: str) -> int:
        """Number of a word, with what it gives its neighbours."""
        k = self.words.get(word)
        if k is None:
            k = self.words[word] = len(self.words)
            if k == len(self.given):
                self.given = np.concatenate([self.given, np.zeros_like(self.given)])
            for g in range(GAPS):
                self.given[k, g] = self._sum([f"p1:{word}", f"p1:{word}|{g}"])
            for g, name in ((_SECOND, "p2:"), (_NEAR, "near:"), (_LAST, "next:")):
                self.given[k, g] = self._sum([name + word])
        return k

    def scores(self, gaps: list[str], tokens: list[str], about: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(token x state, whether a token begins a run)."""
        if len(self.gaps) > _REMEMBERED:
            self.gaps = {}
        self.learn_tokens(dict.fromkeys(tokens))
        if self.around is None:
            self.around = np.array([[self._sum([f"{x}{g}"]) for g in range(GAPS)] for x in ("gb", "ga")])
        kinds = self.gaps
        kind = np.array([kinds[g] if g in kinds else kinds.setdefault(g, _gap(g) + GAPS * (len(g) > MAX_GAP)) for g in gaps])
        first = kind[:-1] >= GAPS
        first[0] = True
        kind %= GAPS
        own = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        word, given = self.word_at[own], self.given
        out = self.own[own] + self.around[0, kind[:-1]] + self.around[1, kind[1:]] + self._sum(about)
        out[1:] += given[word[:-1], kind[1:-1]] + (own[1:] == own[:-1])[:, None] * self._sum(["same"])
        out[2:] += given[word[:-2], _SECOND]
        near = given[word, _NEAR]
        for k in range(1, REACH + 1):
            out[k:] += near[:-k]
        out[:-1] += given[word[1:], _LAST]
        if len(own) > 2:  # a word that stands there thrice in a row and on is filler
            middle = np.flatnonzero((own[1:-1] == own[:-2]) & (own[1:-1] == own[2:])) + 1
            again = np.unique(np.concatenate([middle - 1, middle, middle + 1]))
            out[again, 1:] -= FILLER
        out[first, 2] = -NEVER
        return out, first

    def lead(self, score: np.ndarray, first: np.ndarray, tags: dict[int, int], start: int, last: int) -> float:
        """How much better the best path is than the one that has O for the tokens ``start`` to ``last``, a tagged span."""
        lead = score - score[:, :1]
        out = lead[start, 1] + (0.0 if first[start] else self.move[0, 1] - self.move[0, 0])
        for i in range(start + 1, last + 1):
            out += lead[i, 2] + self.move[tags[i - 1], 2] - self.move[0, 0]
        if last + 1 < len(score) and not first[last + 1]:
            out += self.move[tags[last], 0] - self.move[0, 0]
        return float(out)

    def possible(self, score: np.ndarray) -> np.ndarray:
        """Tokens that some best path may tag B or I; all others are O on every best path.

        A path's stretch of such tags begins with B.  With O throughout instead, the score
        falls by the B's lead over O, by the leads of the later tags and by transitions;
        each is bounded by its greatest value, whatever the neighbours are.  A token none
        of whose stretches can have a sum of zero or more is O.
        """
        move, lead = self.move - self.move[0, 0], score - score[:, :1]
        begin = lead[:, 1] + max(move[0, 1], 0.0)
        later = (lead[:, 1:] + move[1:, 1:].max(0)).max(1).cumsum()
        leave = max(*move[1:, 0], 0.0)
        return np.maximum.accumulate(begin - later) + np.maximum.accumulate(later[::-1])[::-1] + leave >= -1e-6

    def viterbi(self, score: np.ndarray, left: bool = False, right: bool = False) -> list[int]:
        """The best tags; ``left``, ``right``: the neighbour on that side is O."""
        (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = self.move.tolist()
        a, b, c = (score[0] + (self.move[0] if left else 0)).tolist()
        back = []
        for x, y, z in score[1:].tolist():
            best, came = [], []
            for p, q, r in ((a + m00, b + m10, c + m20), (a + m01, b + m11, c + m21), (a + m02, b + m12, c + m22)):
                k = 0 if p >= q and p >= r else 1 if q >= r else 2
                came.append(k)
                best.append((p, q, r)[k])
            back.append(came)
            a, b, c = best[0] + x, best[1] + y, best[2] + z
        path = [int((np.array([a, b, c]) + (self.move[:, 0] if right else 0)).argmax())]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def tags(self, score: np.ndarray, first: np.ndarray) -> dict[int, int]:
        """Token number -> B or I; all others are O.  Stretches of possible tokens are decoded one by one."""
        open_ = np.flatnonzero(self.possible(score))
        found: dict[int, int] = {}
        if len(open_):
            for part in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | first[open_[1:]]) + 1):
                a, b = int(part[0]), int(part[-1]) + 1
                path = self.viterbi(score[a:b], not first[a], b < len(score) and not first[b])
                found.update({a + i: t for i, t in enumerate(path) if t})
        return found

    def learn(self, rows: np.ndarray, tags: np.ndarray, real: np.ndarray, past: list[np.ndarray], rate: float) -> None:
        """One step up the conditional log-likelihood of a batch of lines (forward-backward), scaled by past gradients."""
        n, width = tags.shape
        score = self.emit[rows].sum(2)
        score[:, 0, 2] = -NEVER
        alpha, beta = score.copy(), np.zeros((n, width, STATES))
        for t in range(1, width):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.move, axis=1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        grad = (np.eye(STATES)[tags] - np.exp(alpha + beta - total[:, None, None])) * real[:, :, None]
        slots = rows.reshape(n * width, -1)
        flat = np.repeat(grad.reshape(-1, STATES), slots.shape[1], axis=0)
        emit = np.stack([np.bincount(slots.ravel(), flat[:, k], len(self.emit)) for k in range(STATES)], 1)
        pair = np.exp(alpha[:, :-1, :, None] + self.move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        seen = np.zeros_like(pair)
        i, j = np.indices(tags[:, 1:].shape)
        seen[i, j, tags[:, :-1], tags[:, 1:]] = 1
        move = ((seen - pair) * real[:, 1:, None, None]).sum((0, 1))
        emit[-1] = 0
        for weight, step, sums in ((self.emit, emit - 0.02 * self.emit, past[0]), (self.move, move, past[1])):
            sums += step * step
            weight += rate * step / np.sqrt(sums + 1e-6)
        self.emit[-1] = 0
        self.move[0, 2] = -NEVER  # nothing goes on that has not begun


def lexical(core: str, sort: str, slots: dict[str, int]) -> str:
    """The word itself if the field has it, else its sort."""
    low = core.lower()
    return low if "word:" + low in slots else "?" + sort


def generated_lines(n: int, seed: int = 5):
    """Lines of known tags: text and the spans of its secrets."""
    rnd = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    words = ["the", "of", "and", "report", "value", "house", "für", "der", "les", "para", "on", "page", "see", "file", "table", "from", "with", "key", "number", "code"]
    cues = ["credential", "bearer", "authorization", "private key", "access key", "auth", "client secret", "credentials are", "pwd", "key", "login", "signing key", "passphrase", "token is", "secret is"]
    secret = [
        lambda: pick(low + up + dig, rnd.randint(20, 44)), lambda: pick(low + up + dig + "+/", 40), lambda: "ghp_" + pick(low + up + dig, 36), lambda: "sk_live_" + pick(low + up + dig, 24), lambda: "xoxb-" + pick(dig, 11) + "-" + pick(low + up + dig, 24),
        lambda: "eyJ" + pick(low + up + dig, 30) + "." + pick(low + up + dig + "_-", 40), lambda: "AIza" + pick(low + up + dig + "_-", 35), lambda: pick(up + dig, 20), lambda: pick(low + dig, 32), lambda: "glpat-" + pick(low + up + dig, 20),
    ]
    plain = [
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(10, 23)}", lambda: f"www.{pick(low, 7)}{rnd.randint(1, 99)}.com/{pick(low, 6)}", lambda: f"version-{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}-beta", lambda: f"{pick(low, 6)}_{pick(low, 7)}_{rnd.randint(1, 99)}.txt",
        lambda: f"{pick(low, 10).title()}{rnd.randint(1, 2030)}", lambda: f"{pick(low, 9)}-{pick(low, 6)}-{rnd.randint(1, 9)}", lambda: f"chapter{rnd.randint(1, 30)}-section{rnd.randint(1, 30)}", lambda: f"{rnd.randint(1, 999)}km/{rnd.randint(1, 99)}h-average", lambda: f"ISBN-{pick(dig, 13)}", lambda: f"src/{pick(low, 5)}/{pick(low, 8)}{rnd.randint(1, 9)}.py",
        lambda: f"{pick(low, 5)}.{pick(low, 6)}{rnd.randint(1, 99)}", lambda: f"{pick(low, 14)}{rnd.randint(1, 9)}", lambda: f"{pick(up, 6)}-{pick(dig, 8)}", lambda: f"REF{pick(dig, 10)}X",
    ]
    for _ in range(n):
        line, spans = " ".join(rnd.choices(words, k=rnd.randint(2, 6))), []
        for _ in range(rnd.choice((1, 1, 2))):
            is_secret = rnd.random() < 0.5
            lead = rnd.choice(cues) + rnd.choice((" ", ": ", " = ", " '")) if rnd.random() < (0.75 if is_secret else 0.15) else ""
            line += " " + lead
            for _ in range(rnd.choice((1, 1, 1, 3)) if is_secret else 1):
                token = rnd.choice(secret if is_secret else plain)()
                if is_secret:
                    spans.append((len(line), len(line) + len(token)))
                line += token + " "
            line += " ".join(rnd.choices(words, k=rnd.randint(1, 4)))
        yield line, spans


def short_lines(n: int, seed: int = 11):
    """Lines of known tags whose secrets are short, or of one class of characters, with the same words, numbers and cues also in plain use."""
    rnd = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    common = (
        "the of and to in is was with for on by that this as at from or an are be not have it der die das und ist von mit für den auf im ein nicht le la les de et un une du des que qui pour dans est par el los las en es con para una no por se del al "
        "you your we our they will can new report value page file table number code please see use used then after before user name site list account version data line"
    ).split()
    syllable = lambda: rnd.choice(["", pick("bcdfghlmnprstvw", 1), rnd.choice(["th", "st", "ch", "br", "tr", "sch", "qu", "pl", "gr", "sh", "wh"])]) + rnd.choice("aeiouaeioueéèêaiouäöüáíóú") + rnd.choice(["", "", "n", "r", "s", "l", "t", "nd", "st", "ng", "ch", "ll", "ble", "x"])
    made = lambda: "".join(syllable() for _ in range(rnd.choice((1, 2, 2, 3, 3, 4, 5, 6))))
    pieces = "th er on an re he in ed nd ha at en es of or nt ea ti to io le is ou ar as de sh wh ble ing tion ly sch ch ein ung heit keit lich ver be ge st tz pf ü ä ö ß eux eau ment que ai ci os da ón ll".split()
    rough = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.choice((1, 2, 2, 3, 3, 4, 5, 6, 7))))
    plainly = lambda: "".join(c for c in made() if c < "\x7f") or "sol"
    cues = ["pwd", "password", "passwort", "passphrase", "passcode", "login", "credential", "credentials", "secret", "key", "pin", "auth", "access key", "client secret", "signing key", "bearer", "kennwort", "contraseña", "mot de passe", "clave"]
    secret = [
        lambda: plainly() + pick(dig, rnd.randint(1, 4)), lambda: plainly().title() + pick(dig, rnd.randint(1, 4)), lambda: pick(low + up + dig, rnd.randint(6, 11)), lambda: pick(low + dig, rnd.randint(6, 12)), lambda: pick(low + up, rnd.randint(12, 24)), lambda: pick(low, rnd.randint(10, 24)), lambda: pick(up, rnd.randint(10, 24)),
        lambda: pick(dig, rnd.randint(6, 24)), lambda: pick(dig, rnd.randint(16, 32)), lambda: "-".join(plainly() for _ in range(4)), lambda: "".join(plainly().title() for _ in range(rnd.randint(3, 4))), lambda: plainly() + rnd.choice("&@#!$%*") + pick(low + dig, rnd.randint(1, 5)),
        lambda: plainly().replace("o", "0").replace("a", "4").title() + pick(low + dig, 3) + rnd.choice("&@#!$%*") + pick(dig, rnd.randint(1, 2)), lambda: " ".join(plainly() for _ in range(4)), lambda: pick(low + up, rnd.randint(20, 40)), lambda: "Tr0ub4" + pick(low, 3),
    ]
    plain = [
        lambda: pick(dig, rnd.randint(1, 5)), lambda: pick(dig, rnd.randint(6, 16)), lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", lambda: f"{rnd.randint(0, 23)}:{rnd.randint(0, 59):02d}", lambda: f"{rnd.randint(1, 999)}.{rnd.randint(0, 99)}", lambda: f"+{pick(dig, 2)} {pick(dig, 3)} {pick(dig, 4)}", lambda: f"+1-555-{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"{plainly()}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.{rnd.choice(('example', 'com', 'org'))}", lambda: f"https://www.{plainly()}.com/{plainly()}/{rnd.randint(1, 99)}", lambda: f"{plainly()}{rnd.randint(1, 9)}", lambda: pick(up, rnd.randint(2, 6)), lambda: pick(up, rnd.randint(1, 4)) + pick(dig, rnd.randint(1, 4)), lambda: f"{rnd.randint(1, 30)}{rnd.choice(('th', 'st', 'km', 'kg', 'mb', 'px'))}",
        lambda: plainly() + plainly().title(), lambda: f"{plainly()}_{plainly()}", lambda: f"{plainly()}-{plainly()}", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), lambda: f"{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}", lambda: f"<{plainly()}>", lambda: f"{plainly()}/{plainly()}.{rnd.choice(('py', 'txt', 'html'))}", lambda: made().upper(), lambda: pick("#$%&*", 3) + made(), lambda: made() * 2,
    ]
    about_cues = ["policy", "must be changed", "was lost", "is required", "page", "number 12", "for the site", "of the user", "and the", "findings", "to the", "vergessen", "screen", "manager", "de la", "is not valid", "field", "is", "in", "or"]

    def prose(k: int) -> str:
        words = [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(plain)() if rnd.random() < 0.1 else rnd.choice((made, rough))() for _ in range(k)]
        words = [(w.title() if rnd.random() < 0.08 else w) + rnd.choice(["", "", "", "", "", "", ",", ".", ".\n", " |", ":", "###"]) for w in words]
        return " ".join(words)

    for _ in range(n):
        line, spans = prose(rnd.randint(0, 10)), []
        kind = rnd.random()
        if kind < 0.5:
            cue = rnd.choice(cues)
            line += (" " if line else "") + (cue.title() if rnd.random() < 0.2 else cue) + rnd.choice((" ", " ", ": ", ": ", " = ", "=", " '", " is ", " is: ", ' "', " -> "))
            for _ in range(rnd.choice((1, 1, 1, 1, 3))):
                token = rnd.choice(secret)()
                spans.append((len(line), len(line) + len(token)))
                line += token + rnd.choice((" ", " ", "\n", ", ", "' "))
        elif kind < 0.75:
            line += " " + rnd.choice(cues) + rnd.choice((" ", " ", ": ")) + rnd.choice(about_cues) + " "
        elif kind < 0.8:
            token = pick(low + up, rnd.randint(20, 40))
            line += " "
            spans.append((len(line), len(line) + len(token)))
            line += token + " "
        elif kind < 0.84:
            line += " " + " ".join([rnd.choice((rough, made, lambda: rnd.choice(common)))()] * rnd.randint(2, 12) + [rough()] * rnd.randint(0, 12)) + " "
        elif kind < 0.9:
            line += " " + rnd.choice(("is", "ist", "es", "are", "the", "en", "la", "der", "secret", "key", "login", "password")) + " " + rough() + " " + rough() + " "
        else:
            line += " " + " ".join(rnd.choice(plain)() for _ in range(rnd.randint(1, 4))) + " "
        yield line + prose(rnd.randint(0, 8)), spans


def _about(text: str, has_base: bool, tokens: list[str]) -> tuple[str, ...]:
    """Features of the file: whether base spans exist, the share of tokens that are numbers, the share of lines with an assignment."""
    numbers = sum(map(str.isdigit, tokens)) / max(len(tokens), 1)
    signs = (text.count(": ") + text.count("=")) / (text.count("\n") + 1)
    return f"base{has_base}", f"numbers{bisect(_NUMBERS, numbers)}", f"signs{bisect(_SIGNS, signs)}"


_NUMBERS, _SIGNS = (0.02, 0.1, 0.3), (0.05, 0.5)


def _places(gaps: list[str], tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every token, without the marks at its end."""
    size = np.array([len(x) for pair in zip(gaps, tokens) for x in pair])
    ends = size.cumsum()[1::2]
    return ends - size[1::2], ends - np.array([len(t) - len(t.rstrip(_ENDS)) for t in tokens])


@cache
def tagger(lines: int = 3000, epochs: int = 5) -> Tagger:
    """The trained field: ``lines`` of generated_lines and three times as many of short_lines."""
    chains, counts = [], Counter()
    for text, spans in [*generated_lines(lines), *short_lines(3 * lines)]:
        gaps, tokens = tokens_of(text)
        starts, _ = _places(gaps, tokens)
        which = [next((k for k, (a, b) in enumerate(spans) if a <= p < b), None) for p in starts.tolist()]
        near = [i > 0 and which[i - 1] is not None and len(gaps[i]) <= MAX_GAP for i in range(len(tokens))]
        cores = [t.rstrip(_ENDS) or t for t in tokens]
        counts.update({c.lower() for c in cores})
        chains.append((gaps, tokens, cores, [0 if w is None else 2 if go else 1 for w, go in zip(which, near)], _about(text, bool(base_spans(text)), tokens)))
    words = {"word:" + w: 0 for w, k in counts.items() if k >= 20}
    named, seen = [], Counter()
    for gaps, tokens, cores, tags, about in chains:
        found = measures(cores)
        word, kind = [lexical(c, _SORTS[k], words) for c, k in zip(cores, found[:, 1].tolist())], [_gap(g) for g in gaps]
        rows = []
        for i, core in enumerate(cores):
            names = [*shape(found[i]), _head(core), "word:" + word[i], f"gb{kind[i]}", f"ga{kind[i + 1]}", *about]
            names += [f"p1:{word[i - 1]}", f"p1:{word[i - 1]}|{kind[i]}"] if i else []
            names += ["same"] if i and tokens[i] == tokens[i - 1] else []
            names += [f"p2:{word[i - 2]}"] if i > 1 else []
            names += [f"near:{w}" for w in word[max(0, i - REACH) : i]] + [f"next:{w}" for w in word[i + 1 : i + 2]]
            rows.append(names)
            seen.update(names)
        named.append((rows, tags))
    model = Tagger({x: k for k, x in enumerate(sorted(x for x, k in seen.items() if k >= 10 or x[:5] == "word:"))})
    none, width = len(model.slots), max(len(x) for rows, _ in named for x in rows)
    past, rnd = [np.zeros_like(model.emit), np.zeros_like(model.move)], random.Random(7)
    named = sorted(((rows, tags) for rows, tags in named if rows), key=lambda x: len(x[1]))
    batches = []
    for at in range(0, len(named), 100):
        part = named[at : at + 100]
        size = len(part[-1][1])
        x, y, real = np.full((len(part), size, width), none), np.zeros((len(part), size), int), np.zeros((len(part), size), bool)
        for k, (rows, tags) in enumerate(part):
            y[k, : len(tags)], real[k, : len(tags)] = tags, True
            for i, names in enumerate(rows):
                slots = [model.slots[n] for n in names if n in model.slots]
                x[k, i, : len(slots)] = slots
        batches.append((x, y, real))
    model.move[0, 2] = -NEVER
    for epoch in range(epochs):
        rnd.shuffle(batches)
        for x, y, real in batches:
            model.learn(x, y, real, past, 0.3 / (1 + epoch) ** 0.5)
    return model


def weight_bytes(model: Tagger) -> bytes:
    out = io.BytesIO()
    np.savez(out, emit=model.emit, move=model.move, slots=np.frombuffer("\n".join(sorted(model.slots, key=model.slots.get)).encode("utf-8", "surrogatepass"), np.uint8))
    return out.getvalue()


def from_bytes(data: bytes) -> Tagger:
    held = np.load(io.BytesIO(data))
    names = held["slots"].tobytes().decode("utf-8", "surrogatepass").split("\n")
    model = Tagger({x: k for k, x in enumerate(names)})
    model.emit, model.move = held["emit"], held["move"]
    return model


_STORED: dict[str, Tagger] = {}


def stored_tagger(spark: SparkSession) -> Tagger:
    """The trained field, from the shared folder if a session before has put it there."""
    from pyarrow import fs

    with open(__file__, "rb") as f:
        name = f"secret-weights-{hashlib.sha256(f.read()).hexdigest()[:24]}.npz"
    path = f"{shared_dir(spark)}/{name}"
    if path in _STORED:
        return _STORED[path]
    try:
        store, root = fs.FileSystem.from_uri(path)
        if store.get_file_info(root).type == fs.FileType.File:
            with store.open_input_stream(root) as f:
                model = from_bytes(f.read())
        else:
            model = tagger()
            own = f"{root}.{uuid.uuid4().hex}"
            store.create_dir(root.rpartition("/")[0], recursive=True)
            with store.open_output_stream(own) as f:
                f.write(weight_bytes(model))
            store.move(own, root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that only Spark writes: train here
        model = tagger()
    _STORED[path] = model
    return model


def outside(text: str, start: int, end: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a tagged span that lie in no base span, without the marks at their ends; parts of marks alone go."""
    parts, at = [], start
    for a, _, b in [*taken, (end, 0, end)]:
        if b < at:
            continue
        if a >= end:
            a = end
        if at < a and (m := _PART.search(text, at, a)):
            parts.append((m.start(), m.end()))
        at = max(at, b)
        if at >= end:
            break
    return parts


def scan_all(texts: list[str | None], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """scan() of many texts: what they share is looked up once."""
    out: list[list[tuple[int, int, int]]] = []
    for at in range(0, len(texts), GROUP):
        parts = [tokens_of(t) if t else ([], []) for t in texts[at : at + GROUP]]
        model.learn_tokens({t for _, tokens in parts for t in tokens})
        out += [scan(t, model, p) for t, p in zip(texts[at : at + GROUP], parts)]
    return out


def scan(text: str | None, model: Tagger, parts: tuple[list[str], list[str]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, by start, then kind."""
    if not text:
        return []
    taken = base_spans(text)
    gaps, tokens = tokens_of(text) if parts is None else parts
    if not tokens:
        return taken
    score, first = model.scores(gaps, tokens, _about(text, bool(taken), tokens))
    tags = model.tags(score, first)
    if not tags:
        return taken
    starts, ends = _places(gaps, tokens)
    runs: list[list[int]] = []
    for i, tag in tags.items():
        if tag == 1:
            runs.append([i, i])
        else:
            runs[-1][1] = i
    tagged: list[list[int]] = []
    for i, last in runs:
        if model.lead(score, first, tags, i, last) > MARGIN:
            a = int(starts[i])
            while a and text[a - 1] in "/_-":
                a -= 1
            tagged.append([a, int(ends[last])])
    found = taken + [(a, 3, b) for x, y in tagged for a, b in outside(text, x, y, taken)]
    return sorted(found)


_SPANS = "array<struct<kind: string, start: long, end: long>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end)."""
    model = stored_tagger(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in scan_all(batch.column(1).to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def mask(text: str | None, spans: list[tuple[int, int, int]], word: str = "<SECRET>") -> str | None:
    """The text with every span (overlapping ones as one) replaced."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], word]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of column text masked; all other columns as they are."""
    model, names = stored_tagger(docs.sparkSession), docs.columns
    at = names.index("text")

    def run(batches):
        release()
        for batch in batches:
            own = batch.column(at).to_pylist()
            texts = pa.array([mask(t, spans) for t, spans in zip(own, scan_all(own, model))], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    arrow_rows(docs.sparkSession)
    return map_rows(docs, run)


def report(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s.kind != "crf")), 256).alias("base_sha256"), text("spans").alias("spans"),
    )
