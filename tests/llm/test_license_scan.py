"""The licence scan against all spans of whole words and their edit distances."""

import random
import re

import pytest

from vellum.llm import license_scan as scan
from vellum.llm import queries
from vellum.llm.shared import table

SF = "/root/testdata/sf0.001"
SHORT = {"mit": ("released under the mit license",), "by": ("licensed under cc by 4 0",),
         "nc": ("licensed under cc by nc 4 0", "no commercial use of this text is allowed")}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    words, found = words_of(text), []
    for phrase, label in scan.PHRASES.items():
        asked = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i: i + len(asked)] == asked]
    return len(words), found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def all_spans(words, notice, edits):
    """(first word, words, edits) of every run of words close enough to the notice."""
    for i in range(len(words)):
        for n in range(1, len(words) - i + 1):
            run = " ".join(words[i: i + n])
            if len(run) > len(notice) + edits:
                break
            if len(run) >= len(notice) - edits and (d := distance(run, notice)) <= edits:
                yield i, n, d


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i, how = rng.randrange(len(text)), rng.randrange(3)
        text[i: i + (how != 2)] = [] if how == 1 else [rng.choice("abc -.Zé")]
    return "".join(text)


def test_against_all_spans():
    rng, searcher = random.Random(7), scan.Searcher(SHORT)
    notices = [n for own in SHORT.values() for n in own]
    hits = 0
    for _ in range(300):
        parts = [edited(rng, rng.choice(notices), rng.randint(0, 4)) if rng.random() < 0.5 else
                 " ".join(rng.choices(["licensed", "under", "the", "mit", "use", "word", "cc", "4", "0"], k=4)) for _ in range(4)]
        text = rng.choice([" ", "\n", ". ", ""]).join(parts)
        words = words_of(text)
        n, _, found = scan.search(text, scan.PHRASES, searcher)
        assert n == len(words)
        spaced = f" {' '.join(words)} "
        matches = searcher.matches(spaced)
        for h in found:  # what is reported is true
            run = " ".join(words[h["word"]: h["word"] + h["words"]])
            assert distance(run, h["notice"]) == h["edits"] <= scan.tolerance(h["notice"])
            assert words_of(text[h["begin"]: h["end"]]) == words[h["word"]: h["word"] + h["words"]]
        hits += len(found)
        for notice in notices:  # and nothing is missed
            for i, many, d in all_spans(words, notice, scan.tolerance(notice)):
                begin, end = len(" ".join(["", *words[:i], ""])), len(" ".join(["", *words[: i + many]]))
                assert any(m[4] == notice and m[0] < end and begin < m[1] and m[2] <= d for m in matches)
        settled = scan.settled(matches)
        assert all(any(s[0] < m[1] and m[0] < s[1] and s[2] <= m[2] for s in settled) for m in matches)
        assert all(a[1] < b[0] for a, b in zip(settled, settled[1:]))
    assert hits > 200


def test_base_columns(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.op13_license_scan(spark, SF).collect():
        n, found = brute_base(docs[r.doc_id])
        places = [w for _, w in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            n, len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for label, _ in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 0) == (r.labels == "")


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT Licence.", "mit"), ("Relesed under te MIT License", "mit"), ("RELEASED UNDER\nTHE  MIT-LICENSE", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC-BY 4.0", "cc-by"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licenced under the Apache Licence, Version 2.0", "apache"), ("We sat under the tree and read the paper.", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this", "mit"),
    ("Redistribution and use in source and binary forms, with or without modifications, are permitted", "bsd"),
    ("", ""), (None, "")])
def test_notices(spark, text, labels):
    found = scan.search(text or "", scan.PHRASES, scan.Searcher(scan.NOTICES))
    assert ",".join(sorted({h["label"] for part in found[1:] for h in part})) == labels


def test_hard(spark):
    rows = [(1, None), (2, ""), (3, "MIT License MIT license mit-license"), (None, "apache license"), (4, "x" * 2_000_000),
            (5, "Released under the MIT License. " * 20_000), (5, "general public license"), (5, "general public license"),
            (6, "日本語 mit license ß"), (7, "released " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS hits", "3 AS n_words")
    got = sorted(scan.scan(docs).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        n, found = brute_base(dict(rows)[r.doc_id] if r.doc_id != 5 else
                              "general public license" if r.n_words == 3 else rows[5][1])
        assert r.n_words == n and sorted((b.label, b.word) for b in r.base) == sorted(found)
    assert next(r for r in got if r.doc_id == 5 and r.n_words > 3).hits[-1].begin == 32 * 19_999
    assert scan.scan(docs.limit(0)).count() == 0
