"""Operator 8, license scans: fuzzy search for short license notices.

Base phrases are found as consecutive words. For the fuzzy part each notice with at most k errors is split into k + 1
pieces (pigeonhole): one of them must occur exactly. One Aho-Corasick automaton over all pieces gives the candidate
places. Each place has a window of bounded size, so that time is linear in the text; windows that lack too many of the notice's
trigrams are dropped, and the regex library's bounded-error matching verifies the others and gives spans and edits. Of
overlapping spans of a notice the one with the fewest edits stays, the leftmost of equals. Everything needs one document
at a time, so there is no shuffle.

Defined cases: null text is empty (no words, no labels, score 0, first and last word null); equal rows and equal or null ids
give rows of their own; a very long text is read whole; an empty table gives no rows; other columns are ignored. Words and
places are counted over the whole text.
"""

from __future__ import annotations

import bisect
import functools
import re

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.common import map_texts, table

#: Phrase to label, looked for exactly.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice (lower case, words joined by one space) to label, looked for with errors.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this work is licensed under the gnu general public license version": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution license": "cc-by",
    "licensed under the bsd 3 clause license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
    "licensed under the bsd 2 clause license": "bsd",
    "licensed under the isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1 0": "boost",
    "licensed under the eclipse public license": "epl",
    "distributed under the terms of the eclipse public license": "epl",
    "licensed under the gnu free documentation license": "gfdl",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "dedicated to the public domain under cc0 1 0": "cc0",
    "licensed under the terms of the artistic license": "artistic",
    "distributed under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the zlib license": "zlib",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
#: One error (insertion, deletion or substitution of a character) for so many characters of a notice.
CHARS_PER_ERROR = 10

_WORD = rb"0-9A-Za-z\x80-\xff"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if _IS_WORD[c] else 32 for c in range(256))
_BASE = [
    (p.split()[0].encode(), re.compile(rb"(?<![%s])" % _WORD + rb" +".join(w.encode() for w in p.split()) + rb"(?![%s])" % _WORD), label)
    for p, label in PHRASES.items()
]


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 near-equal parts of the notice with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Fuzzy:
    """The automaton over all pieces and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, str], chars_per_error: int):
        self.notices = [(n, label, max(1, len(n) // chars_per_error)) for n, label in notices.items()]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in self.notices]
        places: dict[str, list] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                places.setdefault(piece, []).append((i, at, len(piece)))
        self.trigrams = [_trigrams(n) for n, _, _ in self.notices]
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()
        self.verify = functools.lru_cache(20_000)(self._verify)

    def _verify(self, i: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match of a notice in a window."""
        _, _, k = self.notices[i]
        if len(self.trigrams[i] - _trigrams(window)) > 3 * k:  # an edit spoils three trigrams at most
            return None
        m = self.patterns[i].search(window)
        return (*m.span(), sum(m.fuzzy_counts)) if m and m.end() > m.start() else None

    def find(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(start, end, edits, label, similarity) of the verified notices; those of one notice do not overlap."""
        windows: dict[int, list[list[int]]] = {}
        for end, where in self.automaton.iter(text):
            for i, at, size in where:
                n, _, k = self.notices[i]
                a = max(0, end + 1 - size - at - k)
                b = min(len(text), a + len(n) + 3 * k)
                mine = windows.setdefault(i, [])
                if mine and abs(a - mine[-1][0]) <= k:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                    if mine[-1][1] - mine[-1][0] <= len(n) + 5 * k:
                        continue
                    mine[-1][1] = mine[-1][0] + len(n) + 4 * k
                mine.append([a, b])
        found = set()
        for i, spans in windows.items():
            n, label, _ = self.notices[i]
            hits = {(m[2], a + m[0], a + m[1]) for a, b in spans if (m := self.verify(i, text[a:b]))}
            taken_s, taken_e = [], []  # sorted and disjoint
            for edits, s, e in sorted(hits):
                at = bisect.bisect_right(taken_s, s)
                if (at and taken_e[at - 1] > s) or (at < len(taken_s) and taken_s[at] < e):
                    continue
                taken_s.insert(at, s)
                taken_e.insert(at, e)
                found.add((s, e, edits, label, 1 - edits / len(n)))
        return sorted(found)


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def scan(text: str | None, fuzzy: Fuzzy) -> tuple:
    flat = (text or "").encode("utf-8", "replace").translate(_FOLD)
    inside = _IS_WORD[np.frombuffer(flat, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    n_words = int(np.count_nonzero(starts))
    base = [(m.start(), label) for first, p, label in _BASE if first in flat for m in p.finditer(flat)]
    places = (np.cumsum(starts)[[at for at, _ in base]] - 1).tolist() if base else []
    own = b" ".join(flat.split()).decode("utf-8", "replace")
    near = fuzzy.find(own)
    labels = {label for _, label in base}
    blanks = np.flatnonzero(np.frombuffer(own.encode("utf-32-le"), np.uint32) == 32) if near else []
    at_word = lambda at: int(np.searchsorted(blanks, at))
    return (
        n_words,
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {x[3] for x in near})),
        1.0 if base else max((x[4] for x in near), default=0.0),
        ",".join(f"{label}:{at_word(s)}:{at_word(e)}:{edits}" for s, e, edits, label, _ in near),
    )


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices string"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: dict[str, str] = NOTICES,
    chars_per_error: int = CHARS_PER_ERROR,
) -> DataFrame:
    """One row for each document; notices has label:first word:last word:edits of the fuzzy matches."""
    return map_texts(
        docs,
        id_col,
        text_col,
        lambda texts, fuzzy: [scan(t, fuzzy) for t in texts],
        FIELDS,
        setup=lambda: Fuzzy(notices, chars_per_error),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
