"""Transducers and the source divergence audit against plain dictionaries."""

import collections
import random
import re

import numpy as np
import pytest

from vellum.llm import divergence
from vellum.llm.transducer import Transducer


def minimal_states(terms):
    """Distinct sets of endings over all prefixes: what a minimal automaton has as states."""
    endings = collections.defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            endings[t[:i]].add(t[i:])
    return len({frozenset(v) for v in endings.values()})


@pytest.mark.parametrize("alphabet", ["ab", "aébcdefß日本", "zyxwvutsrqponmlkjihgfedcba"])
def test_transducer(alphabet):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 6))).encode() for _ in range(500)})
    built = Transducer.build(words)
    assert len(built.final) == minimal_states(words)
    machine = Transducer.load(built.dump())
    asked = [*words, *(w[:-1] or b"q" for w in words), *(w + b"a" for w in words), b"unknown", b"\xff" * 9]
    data = np.frombuffer(b"\0".join(asked) + b"\0", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in asked])[:-1]])
    place = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(data, at).tolist() == [place.get(w, -1) for w in asked]
    assert Transducer.build([]).ordinals(data, at).max() == -1


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(200):
        total, terms = rng.randrange(1, 10 ** rng.randint(1, 15)), rng.randrange(1, 10 ** 6)
        count = rng.randrange(total + 1)
        got = divergence.shares(np.array([[count]]), np.array([[total]]), terms)
        assert int(got[0, 0]) == 1 + 10 ** 9 * (count + 5) // (total + 5 * terms)


def brute(rows, least, top):
    found = collections.defaultdict(list)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        found[lang or ""].append((source or "", terms))
    out = set()
    for lang, docs in found.items():
        df = collections.Counter(t for _, terms in docs for t in set(terms))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter() for s, _ in docs}
        for s, terms in docs:
            counts[s].update(t for t in terms if df[t] >= least)
        whole = sum(counts.values(), collections.Counter())

        def share(c):
            below = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // below for t in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", own)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    terms = [*"abcdefgh", "the", "The", "THE", "über", "ÜBER", "日本語", "x" * 5000, "don't", "a1b", "e-mail", "café"]
    made = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "ß", None]),
             " ".join(rng.choices(terms, k=rng.randint(0, 40)))) for _ in range(400)]
    made += [("fr", "only", "un deux"), ("it", "a", "raro"), ("it", "b", None), ("", "s1", "\x00\x01a\x00b")]
    return made + made[:30] + [("en", "long", "the über " * 60000)]


@pytest.mark.parametrize("options", [{}, {"shard": 3, "sent_bytes": 1000, "cells": 4}])
def test_against_dictionaries(spark, rows, options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    docs = docs.selectExpr("*", *(f"7 AS {c}" for c in ("term", "ordinal", "n", "item", "rank", "total", "slice")))
    got = divergence.audit(docs, least_docs=20, top=7, **options).collect()
    want = brute(rows, 20, 7)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.lang == "it" and r.value == 0 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).count() == 0
