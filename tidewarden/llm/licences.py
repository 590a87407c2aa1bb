"""Operator 1: licence scan by a positional rare-token index.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased
(ASCII digits and letters, and everything outside ASCII).

Base: every place where a phrase of ``PHRASES`` stands as consecutive words.

Method: the notices of ``TEMPLATES`` (whole short licences, and the notices that
longer ones ask to be put in files, by version) are indexed by word and position; a
word's IDF is taken over the notices.  A notice's anchors are its words of highest
IDF, as many as hold more than ``1 - MIN_SHARE`` of its mass: a place with
``MIN_SHARE`` of the mass has one of them at least, so nothing is lost by looking up a
file's anchors alone.  For notices with an anchor in the file, and words there that hold
``MIN_SHARE`` of the mass, the postings of all words are intersected by relative position: words whose position minus posting
agrees to within ``SLACK`` support the same place.  A notice is reported where the
mass of the distinct supported words reaches ``MIN_SHARE`` of its own and every
mandatory phrase stands inside that place.  It gives the label of its family and,
where the notice names one, of its version.

Output: doc_id, n_words, places (array of word starts of base phrases, ascending),
base_labels and labels (arrays, sorted, distinct), score: the best share of a
verified notice, at least 0.5 where a base phrase stands, else half the best share
of an unverified one that came so far.  Null and empty texts have no words, score 0; repeated rows
repeat; a very long text is scanned whole; of a place that two versions share, both
are tried, each by its own phrases.  Other columns, whatever their names, take no
part.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import arrow_rows

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_AS_IS = "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_GNU = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation {2} this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_GNU_MUST = ("free software foundation", "without any warranty")
_CREATIVE = "this work is licensed under {} visit http creativecommons org licenses {} or send a letter to creative commons"


def _gnu(thing: str, name: str, version: str, since: str = "either version {} of the license or at your option any later version") -> str:
    return _GNU.format(thing, name, since.format(version))


#: Labels (family, version), the words of the notice, its mandatory phrases.
TEMPLATES = (
    (("mit",), f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is {_AS_IS}", ("permission is hereby granted", "free of charge", "this permission notice shall be included")),
    (("mit",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "to deal in the software without restriction")),
    (("apache", "apache-2.0"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2 0", "in compliance with the license")),
    (("apache", "apache-1.1"), "this product includes software developed by the apache software foundation the names apache and apache software foundation must not be used to endorse or promote products derived from this software without prior written permission products derived from this software may not be called apache", ("apache software foundation", "endorse or promote products")),
    (("gpl", "gpl-2.0"), _gnu("program", "general public license", "2"), ("gnu general public license", "version 2 of the license", *_GNU_MUST)),
    (("gpl", "gpl-3.0"), _gnu("program", "general public license", "3"), ("gnu general public license", "version 3 of the license", *_GNU_MUST)),
    (("lgpl", "lgpl-2.1"), _gnu("library", "lesser general public license", "2 1"), ("gnu lesser general public license", "version 2 1 of the license", *_GNU_MUST)),
    (("lgpl", "lgpl-3.0"), _gnu("library", "lesser general public license", "3"), ("gnu lesser general public license", "version 3 of the license", *_GNU_MUST)),
    (("agpl", "agpl-3.0"), _gnu("program", "affero general public license", "3"), ("gnu affero general public license", "version 3 of the license", *_GNU_MUST)),
    (("bsd", "bsd-2-clause"), _BSD, ("redistribution and use in source and binary forms", "are permitted provided that")),
    (("bsd", "bsd-3-clause"), _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "neither the name of", "without specific prior written permission")),
    (("isc",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ("for any purpose with or without fee", "appear in all copies")),
    (("mpl", "mpl-2.0"), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license", "v 2 0")),
    (("mpl", "mpl-1.1"), "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl software distributed under the license is distributed on an as is basis without warranty of any kind", ("mozilla public license version 1 1",)),
    (("epl", "epl-2.0"), "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0", ("eclipse public license", "2 0")),
    (("cc-by", "cc-by-4.0"), _CREATIVE.format("the creative commons attribution 4 0 international license to view a copy of this license", "by 4 0"), ("creative commons attribution 4 0",)),
    (("cc-by", "cc-by-3.0"), _CREATIVE.format("the creative commons attribution 3 0 unported license to view a copy of this license", "by 3 0"), ("creative commons attribution 3 0",)),
    (("cc-by-sa", "cc-by-sa-4.0"), _CREATIVE.format("the creative commons attribution sharealike 4 0 international license to view a copy of this license", "by sa 4 0"), ("attribution sharealike 4 0",)),
    (("cc0",), "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work published under the cc0 1 0 universal public domain dedication", ("related or neighboring rights", "to the extent possible under law")),
    (("unlicense",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software", "public domain")),
    (("zlib",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", ("permission is granted to anyone to use this software", "must not be misrepresented")),
    (("boost", "boost-1.0"), "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ("boost software license", "to any person or organization")),
    (("wtfpl",), "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("what the fuck you want to", "public license")),
)
SLACK = 3
MIN_SHARE = 0.6

_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Index:
    """Words of the notices: their IDF, their postings (notice, place), and the anchors that find a notice."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.notices = [(labels, words_of(text), [words_of(p) for p in must]) for labels, text, must in templates]
        in_notices: dict[bytes, set[int]] = defaultdict(set)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, own, _) in enumerate(self.notices):
            for at, w in enumerate(own):
                in_notices[w].add(t)
                self.postings[w].append((t, at))
        self.idf = {w: math.log((1 + len(self.notices)) / len(ts)) for w, ts in in_notices.items()}
        self.own = [frozenset(own) for _, own, _ in self.notices]
        self.mass = [sum(self.idf[w] for w in own) for own in self.own]
        self.anchors: dict[bytes, list[int]] = defaultdict(list)
        for t, (_, own, _) in enumerate(self.notices):
            left = (1 - MIN_SHARE) * self.mass[t]
            for w in sorted({*own}, key=lambda w: (-self.idf[w], w)):
                self.anchors[w].append(t)
                left -= self.idf[w]
                if left < -1e-9:
                    break
        self.starts: dict[bytes, list[int]] = defaultdict(list)
        for i, (own, _) in enumerate(self.phrases):
            self.starts[own[0]].append(i)
        self.wanted = frozenset({*self.anchors, *self.starts})


@cache
def default_index() -> Index:
    return Index()


def _stands(words: list[bytes], phrase: list[bytes], first: int, last: int) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(max(first, 0), min(last, len(words) - len(phrase)) + 1))


def scan(text: str | None, index: Index | None = None):
    """n_words, starts of base phrases, base labels, labels, score."""
    index = index or default_index()
    words = words_of(text)
    places: list[int] = []
    base: set[str] = set()
    seen: set[int] = set()  # notices with an anchor in this file
    for i in [i for i, w in enumerate(words) if w in index.wanted]:
        w = words[i]
        for p in index.starts.get(w, ()):
            own, label = index.phrases[p]
            if words[i : i + len(own)] == own:
                places.append(i)
                base.add(label)
        seen.update(index.anchors.get(w, ()))
    if seen:  # a place's words all stand in the file: notices whose words there hold too little mass have none
        here = set(words)
        seen = {t for t in seen if sum(index.idf[w] for w in index.own[t] if w in here) >= MIN_SHARE * index.mass[t] - 1e-9}
    votes: dict[int, list[tuple[int, int, bytes]]] = {t: [] for t in sorted(seen)}
    if seen:
        for i in [i for i, w in enumerate(words) if w in index.postings]:
            for t, at in index.postings[words[i]]:
                if t in seen:
                    votes[t].append((i - at, i, words[i]))
    labels, best, unsure = set(base), 0.0, 0.0
    for t, own in votes.items():
        if len(own) < 2:
            continue
        named, notice, must = index.notices[t]
        own.sort()
        first, mass, inside = 0, 0.0, defaultdict(int)
        top: list[tuple[float, int, int]] = []
        for shift, _, w in own:  # windows of agreeing shifts, each as far as it goes
            inside[w] += 1
            mass += index.idf[w] if inside[w] == 1 else 0.0
            while shift - own[first][0] > SLACK:
                gone = own[first][2]
                inside[gone] -= 1
                mass -= index.idf[gone] if inside[gone] == 0 else 0.0
                first += 1
            top.append((mass / index.mass[t], own[first][0], shift))
        share = max(x[0] for x in top)
        unsure = max(unsure, share)
        if share >= MIN_SHARE:
            for x, low, high in top:
                if x >= MIN_SHARE and all(_stands(words, p, low - SLACK, high + len(notice) + SLACK) for p in must):
                    labels.update(named)
                    best = max(best, x)
    score = max(min(best, 1.0), 0.5 if base else 0.0, min(unsure, 1.0) / 2)
    return len(words), places, sorted(base), sorted(labels), score


def scan_licences(docs: DataFrame) -> DataFrame:
    def run(batches):
        index = default_index()
        for batch in batches:
            rows = [scan(t, index) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_words", "places", "base_labels", "labels", "score"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, places array<long>, base_labels array<string>, labels array<string>, score double")


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
