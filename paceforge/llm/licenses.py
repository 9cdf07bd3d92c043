"""License scans: fuzzy search for short notices.

A notice of m characters that occurs with at most k errors holds at least one of
its k + 1 pieces unchanged (pigeonhole). Exact search for the pieces therefore
finds every place worth looking at; the ``regex`` library's bounded-error matching
then verifies the window around it and reports the span and the number of errors.
Exact phrases (k = 0) go the same way: their one piece is the whole phrase.

The search runs over the words of a text, lower-cased (A-Z) and joined by single
spaces. Words are runs of digits, letters a-z and all characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from paceforge.llm.common import id_and_text, map_rows


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int = 0
    base: bool = False


BASE = (Notice("cc-by", "cc by", 0, True), Notice("gpl", "general public license", 0, True), Notice("reserved", "all rights reserved", 0, True))
FUZZY = (
    Notice("apache", "apache license version 2 0", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "lesser general public license", 3),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("proprietary", "unauthorized copying of this file is prohibited", 5),
    Notice("public-domain", "dedicated to the public domain", 3),
    Notice("reserved", "all rights reserved", 2),
)
NOTICES = BASE + FUZZY

# upper case to lower case; ASCII that is neither digit nor letter to a space
_FOLD = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def pieces(phrase: str, errors: int) -> list[tuple[int, bytes]]:
    """The phrase cut into errors + 1 pieces of nearly equal length, with their offsets."""
    raw, n = phrase.encode(), errors + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def windows(joined: bytes, notice: Notice, parts: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Merged stretches of ``joined`` around the exact pieces."""
    found = []
    for at, piece in parts:
        i = joined.find(piece)
        while i >= 0:
            found.append((max(0, i - at - notice.errors), min(len(joined), i - at + len(notice.phrase) + notice.errors)))
            i = joined.find(piece, i + 1)
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


class Scanner:
    """Finds the notices in one text; built once in each task."""

    def __init__(self, notices: Iterable[Notice]):
        import regex

        self.notices = [(n, pieces(n.phrase, n.errors), regex.compile(b"(?e)(?:%b){e<=%d}" % (regex.escape(n.phrase.encode(), literal_spaces=True), n.errors)) if n.errors else None) for n in notices]

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words; (notice, first word, number of words, errors) of each match."""
        found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        joined = b" " + b" ".join(found) + b" "
        out, blanks = [], None
        for notice, parts, pattern in self.notices:
            for a, b in windows(joined, notice, parts):
                if pattern is None:
                    hits = [(a, b, 0)] if joined[a - 1 : a] == b" " and joined[b : b + 1] == b" " else []
                    if b - a > len(notice.phrase):  # windows of repeats that touch
                        raw = b" " + notice.phrase.encode() + b" "
                        i, hits = joined.find(raw, a - 1, b + 1), []
                        while i >= 0:
                            hits.append((i + 1, i + len(raw) - 1, 0))
                            i = joined.find(raw, i + 1, b + 1)
                else:
                    hits = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(joined, a, b)]
                if hits and blanks is None:  # places of the blanks, once a text
                    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                for x, y, errors in hits:
                    first = int(np.searchsorted(blanks, x + (joined[x : x + 1] == b" "))) - 1
                    out.append((notice, max(first, 0), max(1, len(joined[x:y].split())), errors))
        return len(found), out

    @staticmethod
    def char_spans(text: str) -> list[tuple[int, int]]:
        """Character span of each word, for texts that have matches."""
        import re

        folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        chars = [0]
        raw = text.encode("utf-8", "surrogatepass")
        for byte in raw:
            chars.append(chars[-1] + ((byte & 0xC0) != 0x80))
        return [(chars[m.start()], chars[m.end()]) for m in re.finditer(rb"[^ ]+", folded)]


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Iterable[Notice] = NOTICES) -> DataFrame:
    """One row per match: doc_id, label, phrase, base, first_word, n_words, start, end (characters), errors, matched text.

    A null or empty text has no match. Overlapping notices are reported each on their own.
    """
    notices = tuple(notices)

    def start():
        scanner = Scanner(notices)

        def one(row):
            _, hits = scanner.scan(row["text"])
            if not hits:
                return
            spans = scanner.char_spans(row["text"])
            for n, first, size, errors in hits:
                a, b = spans[first][0], spans[min(first + size, len(spans)) - 1][1]
                yield row["doc_id"], n.label, n.phrase, n.base, first, size, a, b, errors, row["text"][a:b]

        return one

    rows = id_and_text(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return map_rows(rows, f"doc_id {kind}, label string, phrase string, base boolean, first_word bigint, n_words bigint, start bigint, end bigint, errors int, matched string", start)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Iterable[Notice] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase; first_word and last_word are the smallest
    and largest word at which one starts. score is the best match's share of unchanged
    characters, 1 for a base phrase, 0 without a match. Null text: as the empty text.
    Repeated rows give repeated results; a null id stays null.
    """
    notices = tuple(notices)

    def start():
        scanner = Scanner(notices)

        def one(row):
            n, hits = scanner.scan(row["text"])
            base = [h for h in hits if h[0].base]
            starts = [h[1] for h in base]
            score = max((1 - h[3] / len(h[0].phrase) for h in hits), default=0.0)
            named = lambda hs: ",".join(sorted({h[0].label for h in hs}))
            yield row["doc_id"], n, len(base), min(starts, default=None), max(starts, default=None), named(base), named(hits), max(0.0, float(score))

        return one

    rows = id_and_text(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return map_rows(rows, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", start)

