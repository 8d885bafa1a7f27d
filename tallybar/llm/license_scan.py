"""License scans: fuzzy search for short notices.

A notice of m characters that may hold k edits is split into k + 1 pieces; by the pigeonhole rule any match with
at most k edits keeps one piece unchanged. One automaton over all pieces finds these seeds in the whole text,
each seed names the window in which its notice could lie, and the regex library's bounded-error matching verifies
the window and gives the span and its edits. Places without any edit are the base places.

Defined results: a null or empty text has no words, no places, empty labels and score 0; overlapping places of one
notice all count as base places; the fuzzy spans of one notice do not overlap; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tallybar.llm.common import by_row, columns

#: Bytes other than digits, letters and non-ASCII separate words; A-Z is lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    base: bool = False


#: Fixed values. Notices: words joined by one space. Edits are characters inserted, deleted or replaced.
NOTICES = (
    Notice("mit", "under the mit license", 2, True),
    Notice("apache-2", "apache license version 2", 2, True),
    Notice("cc-by-nc", "cc by nc", 0, True),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache-2", "licensed under the apache license", 3),
    Notice("artistic-2", "the artistic license 2 0", 2),
    Notice("boost", "boost software license version 1 0", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "neither the name of the copyright holder", 3),
    Notice("cc-by", "creative commons attribution 4 0 international", 3),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("cc0", "no rights reserved", 1),
    Notice("cddl", "common development and distribution license", 3),
    Notice("cecill", "cecill free software license agreement", 3),
    Notice("epl", "eclipse public license", 2),
    Notice("eupl", "european union public licence", 3),
    Notice("gfdl", "gnu free documentation license", 3),
    Notice("gpl", "gnu general public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("lgpl", "gnu library general public license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    Notice("mpl-2", "mozilla public license version 2", 3),
    Notice("ms-pl", "microsoft public license", 2),
    Notice("odbl", "open data commons open database license", 3),
    Notice("ofl", "sil open font license", 2),
    Notice("proprietary", "all rights reserved", 1),
    Notice("python", "python software foundation license", 3),
    Notice("spdx", "spdx license identifier", 2),
    Notice("unlicense", "this is free and unencumbered software", 3),
    Notice("wtfpl", "do what the fuck you want to public license", 3),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 4),
)


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    start: int
    end: int
    edits: int
    base: bool
    likeness: float


def words_of(text: str | None) -> bytes:
    """The words of a text, folded and joined by one space, as UTF-8."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces that cover the text, with their offsets."""
    n = edits + 1
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds every notice in a text; built once a worker process."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in pieces(notice.text, notice.edits):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), tuple(uses)))
        self.seeds.make_automaton()
        self.checks = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") for n in notices]

    def spans(self, folded: bytes) -> list[Span]:
        """All base places and fuzzy spans in text order; offsets and edits count characters of the folded text."""
        text = folded.decode()
        exact: dict[int, set[int]] = {}
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for i, at in uses:
                notice = self.notices[i]
                start = end - size + 1 - at
                stop = start + len(notice.text)
                if start >= 0 and text.startswith(notice.text, start) and (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " "):
                    exact.setdefault(i, set()).add(start)
                lo, hi = max(0, start - notice.edits - 1), stop + notice.edits + 1
                kept = windows.setdefault(i, [])
                if kept and lo <= kept[-1][1]:
                    kept[-1] = [min(lo, kept[-1][0]), max(hi, kept[-1][1])]
                else:
                    kept.append([lo, hi])
        found = []
        for i, starts in exact.items():
            notice = self.notices[i]
            found += [Span(notice.label, 0, s, s + len(notice.text), 0, notice.base, 1.0) for s in sorted(starts)]
        for i, spans in windows.items():
            notice = self.notices[i]
            taken = [(s, s + len(notice.text)) for s in exact.get(i, ())]
            if not notice.edits:
                continue
            for lo, hi in spans:
                for m in self.checks[i].finditer(text, lo, min(hi, len(text))):
                    if not any(a < m.end() and m.start() < b for a, b in taken):
                        edits = sum(m.fuzzy_counts)
                        found.append(Span(notice.label, 0, m.start(), m.end(), edits, False, 1 - edits / len(notice.text)))
        found.sort(key=lambda x: (x.start, x.end, x.label))
        out, at, words = [], 0, 0
        for x in found:
            words += text.count(" ", at, x.start)
            at = x.start
            out.append(Span(x.label, words, x.start, x.end, x.edits, x.base, x.likeness))
        return out


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...] = NOTICES) -> Scanner:
    return Scanner(notices)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words and every span (label, first word, offsets in the folded text, edits, base, likeness)."""

    def make(texts: list) -> dict:
        folded = [words_of(t) for t in texts]
        find = scanner(notices)
        return {"n_words": [w.count(b" ") + 1 if w else 0 for w in folded], "spans": [[asdict(s) for s in find.spans(w)] for w in folded]}

    schema = "doc_id long, n_words long, spans array<struct<label string, first_word long, start long, end long, edits int, base boolean, likeness double>>"
    return by_row(columns(docs, doc_id="long", text="string"), make, schema)
