"""Many phrases in one pass over a text: an Aho-Corasick automaton with places in the text as it was.

Matching is by lower case and whole words (no letter, digit, underscore or Devanagari
sign right before or after), and any white space between a phrase's words counts as one
blank.  A phrase ending in ``*`` is a stem: its last word may go on.  The work per text
does not depend on how many phrases there are.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick

_WORD_SIGN = re.compile(r"[\wऀ-ॿ]")
_BLANKS = re.compile(r"\s+")


class _Places:
    """Where the characters of the words of a text, joined by one blank, stand in the text; asked in any order."""

    def __init__(self, text: str):
        self.own, self.begins, at = [], [], 0  # the words' starts in the text and in the joined words
        for m in re.finditer(r"\S+", text):
            self.own.append(m.start())
            self.begins.append(at)
            at += 1 + m.end() - m.start()

    def __getitem__(self, at: int) -> int:
        k = bisect_right(self.begins, at) - 1
        return self.own[k] + at - self.begins[k]


def _wide_places(text: str) -> list[int]:
    """The same for a text of which some sign becomes two in lower case; a word may be long and hold many places."""
    out = []
    for m in re.finditer(r"\S+", text):
        for place, c in enumerate(m[0], m.start()):
            out += [place] * len(c.lower())
        out.append(m.end())
    return out


class PhraseMatcher:
    """Finds the places of phrases; made once in a process, sent as the list of phrases."""

    def __init__(self, phrases):
        self.phrases = tuple(phrases)
        self._built = None

    def __getstate__(self):
        return {"phrases": self.phrases, "_built": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def automaton(self):
        if self._built is None:
            self._built = ahocorasick.Automaton()
            own: dict[str, list[tuple[int, bool]]] = {}
            for i, p in enumerate(self.phrases):
                key = _BLANKS.sub(" ", p.removesuffix("*").strip().lower())
                if key:
                    own.setdefault(key, []).append((i, p.endswith("*")))
            for key, which in own.items():
                self._built.add_word(key, (len(key), which))
            if own:
                self._built.make_automaton()
        return self._built

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the phrase) of every match, by end; matches may overlap."""
        if not len(self.automaton):
            return []
        same = text.lower()  # as a whole, as the phrases are: a final sigma depends on what stands beside it
        low, places, out = " ".join(same.split()), None, []
        for last, (size, which) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            if start and _WORD_SIGN.match(low, start - 1):
                continue
            whole = end == len(low) or not _WORD_SIGN.match(low, end)
            for i, stem in which:
                stop = end
                if stem:
                    while stop < len(low) and _WORD_SIGN.match(low, stop):
                        stop += 1
                elif not whole:
                    continue
                if places is None:  # only texts with a match pay for places
                    places = _wide_places(text) if len(same) != len(text) else _Places(text) if len(low) != len(text) else range(len(text))
                out.append((places[start], places[stop - 1] + 1, i))
        return out


def longest_first(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches that do not overlap, leftmost and of these the longest, in their order."""
    out, at = [], 0
    for start, end, i in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        if start >= at:
            out.append((start, end, i))
            at = end
    return out
