"""Licences of texts: exact phrases, and short notices found with a bounded number of edits.

A notice of ``m`` characters may differ in up to ``k`` (:func:`tolerance`).  Split into k + 1 pieces, it
leaves one of them intact wherever it occurs, so one pass of an automaton over the pieces of all
notices finds every place worth a look; there the regex library's bounded-error matching decides,
counts the edits and gives the span.  Texts are searched as their lower-cased words, parted by one
space, and a match begins and ends with whole words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import keyed_text

#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices by label, as their words.
NOTICES = {
    "agpl": ("under the terms of the gnu affero general public license",),
    "apache": ("licensed under the apache license version 2 0",
               "you may not use this file except in compliance with the license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "released under the bsd 3 clause license", "released under the bsd 2 clause license"),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",
              "licensed under cc by 4 0"),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",
                 "licensed under cc by nc 4 0"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",
                 "licensed under cc by sa 4 0"),
    "gpl": ("this work is licensed under the gnu general public license version 3",
            "it under the terms of the gnu general public license as published by the free software foundation"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee",),
    "lgpl": ("under the terms of the gnu lesser general public license",),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy",
            "the above copyright notice and this permission notice shall be included in all copies"),
    "mpl": ("subject to the terms of the mozilla public license version 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
CHARS_PER_EDIT, MOST_EDITS = 12, 6
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEPT = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_LOWER = bytes((b | 32 if 65 <= b <= 90 else b) if _KEPT[b] else 32 for b in range(256))

Hit = tuple[int, int, int, str, str]  # beginning, end, edits, label, notice


def tolerance(notice: str) -> int:
    """Edits a notice may have: more for longer ones, few enough for the verification to stay quick."""
    return min(MOST_EDITS, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of even length, each with its place."""
    cuts = [i * len(notice) // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Searcher:
    """All notices' seeds in one automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, tuple[str, ...]]) -> None:
        self.listed = [(label, n, tolerance(n), regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={tolerance(n)}}}"))
                       for label, own in sorted(notices.items()) for n in own]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice, edits, _) in enumerate(self.listed):
            for at, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((i, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in seeds.items():
            self.automaton.add_word(piece, found)
        if seeds:
            self.automaton.make_automaton()
        self.empty = not seeds

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """(notice, beginning) of each seed's notice, if all its edits came after the seed."""
        seen: dict[int, int] = {}
        for last, found in () if self.empty else self.automaton.iter(text):
            for i, through in found:
                begin = last + 1 - through
                if seen.get(i) != begin:  # neighbouring seeds of one notice give the same place
                    seen[i] = begin
                    yield i, begin

    def matches(self, text: str) -> set[Hit]:
        """The best match around each candidate of ``text``, which begins and ends with a space.

        Up to k edits before or after the seed move the beginning and the end by up to k.  The borders
        of words in reach are tried as the whole match: with its ends left open the library may settle
        for an end that no space follows and not come back for another.
        """
        found = set()
        for i, begin in self.candidates(text):
            label, notice, edits, pattern = self.listed[i]
            firsts = _spaces(text, begin - 1, edits)
            lasts = _spaces(text, begin + len(notice), edits)
            spans = ((pattern.fullmatch(text, a + 1, b), a + 1, b) for a in firsts for b in lasts if a + 1 < b)
            best = min(((sum(m.fuzzy_counts), a - b, a) for m, a, b in spans if m), default=None)
            if best:
                found.add((best[2], best[2] - best[1], best[0], label, notice))
        return found


def _spaces(text: str, at: int, reach: int) -> list[int]:
    return [i for i in range(max(0, at - reach), min(len(text), at + reach + 1)) if text[i] == " "]


def settled(found: set[Hit]) -> list[Hit]:
    """One match for each place, in order: of overlapping matches that with the fewest edits stays, then the
    longest, the first, and the first label."""
    ends, kept = [], []
    for hit in sorted(found, key=lambda h: (h[2], h[0] - h[1], h)):
        at = bisect_left(ends, (hit[0] + 1,))
        if at == len(ends) or ends[at][1] >= hit[1]:
            insort(ends, (hit[1], hit[0]))
            kept.append(hit)
    return sorted(kept)


@cache
def _searcher(notices: tuple) -> Searcher:
    return Searcher(dict(notices))


def _places(text: str, phrase: str) -> Iterator[int]:
    """First words of the places of a phrase in spaced words; places may overlap by their border."""
    asked, at, word, seen = f" {phrase} ", 0, 0, 0
    while (at := text.find(asked, at)) >= 0:
        word += text.count(" ", seen, at)
        yield word
        seen, at = at, at + len(asked) - 1


def search(text: str, phrases: dict[str, str], searcher: Searcher) -> tuple[int, list[dict], list[dict]]:
    """Words of a text, its phrases (label, first word) and its notices with edits and spans."""
    words = text.encode().translate(_LOWER).split()
    spaced = f" {b' '.join(words).decode()} "
    base = [{"label": label, "word": w} for phrase, label in phrases.items() for w in _places(spaced, phrase)]
    hits = settled(searcher.matches(spaced))
    if not hits:
        return len(words), base, []
    found, seen, word, spans = [], 0, 0, []
    for begin, end, edits, label, notice in hits:
        word, seen = word + spaced.count(" ", seen, begin) - (not seen), begin
        many = spaced.count(" ", begin, end) + 1
        found.append({"label": label, "notice": notice, "word": word, "words": many, "edits": edits})
        spans.append((word, word + many - 1))
    asked, at = sorted({w for s in spans for w in s}), {}
    for k, m in enumerate(WORD.finditer(text)):
        if k == asked[len(at)]:
            at[k] = m.span()
            if len(at) == len(asked):
                break
    for hit, (first, last) in zip(found, spans):
        hit |= {"begin": at[first][0], "end": at[last][1]}
    return len(words), base, found


_BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_HITS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("word", pa.int64()), ("words", pa.int64()),
                            ("edits", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))
_SCHEMA = ("doc_id long, n_words long, base array<struct<label string, word long>>, hits array<struct<label string, "
           "notice string, word long, words long, edits int, begin long, end long>>")


def _scanned(phrases: dict[str, str], notices: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(notices)
        for batch in batches:
            n, base, hits = list(zip(*(search(t, phrases, searcher) for t in batch.column(1).to_pylist()))) or ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, _BASE),
                                              pa.array(hits, _HITS)], names=["doc_id", "n_words", "base", "hits"])

    return run


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, hits) for every row: places of the phrases by first word, and matches of the
    notices with their words, edits, and span in code points of the text.

    Null and empty texts have no words and no finds.  Null ids stay null, repeated rows are searched each
    for itself, other columns are ignored; texts of any length are searched whole.  Every span within a
    notice's edits overlaps a match of it with no more; where matches overlap, one with the fewest is
    reported (:func:`settled`).
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(_scanned(phrases, tuple(sorted(notices.items()))), _SCHEMA)


def certainty() -> Column:
    """1 where a phrase stands, else the best match's share of characters that are as in its notice, else 0."""
    share = F.aggregate("hits", F.lit(0.0), lambda s, h: F.greatest(s, 1 - h["edits"] / F.length(h["notice"])))
    return F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share)


def labelled(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(column, lambda x: x["label"])))
