"""The filter audit against a version that walks every order document by document."""

import itertools
import re

import pytest

from vellum.llm import filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        failing = {"A"} if len(words) < 100 else set()
        failing |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failing |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        failing |= {"D"} if re.search("[#$%&*|]", text) else set()
        failing |= {"E"} if i is not None and i > least[text] else set()
        own = [x for x in labels if i is not None and x[0] == i]
        docs.append((lang or "", failing, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone),
                                                   sum(d[1] == {f} for d in failing), sum(d[2] for d in gone),
                                                   sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


TEXTS = [None, "", " \t", "short text", "w " * 120, " ".join(f"word{i}" for i in range(150)),
         " ".join(f"word{i}" for i in range(150)) + " #", "A B C " * 50, "UPPER lower | x",
         " ".join(f"x{i}" for i in range(100)), "\n".join(f"Line{i} & more" for i in range(200)), "é" * 30 + "ABC",
         "long " * 30000]


def test_against_orders(spark):
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(TEXTS * 3)]
    rows += [(3, "short text", "en"), (3, "other", "en"), (None, "short text", "en"), (None, None, None), (50, "", "de")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 40, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (6, 0, 1), (6, 0, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs = docs.selectExpr("*", *(f"7 AS {c}" for c in ("id", "part", "good", "prefix", "bit", "digest")))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string").limit(n)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 600 * n


def test_other_filters(spark):
    members = spark.createDataFrame([(i, "p", 1, 0) for i in range(10)], "id long, part string, good int, toxic int")
    fails = {"x": members.where("id < 4").select("id"), "y": members.where("id >= 2").select("id")}
    from vellum.llm.shared import work_folder

    got = filter_audit.interactions(members, fails, work_folder(spark)).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {
        ("xy", 1): (6, 4, 0, 2, 6), ("xy", 2): (0, 6, 2, 6, 14), ("yx", 1): (2, 8, 0, 6, 14), ("yx", 2): (0, 2, 2, 2, 6)}
