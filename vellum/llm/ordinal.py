"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text becomes a set of hashed features: its distinct words without outer punctuation, and a few
features of form (share of capitals, of symbols, of repeated words).  One weight vector gives a
score s; ordered thresholds t_0 < t_1 < ... give P(grade <= k) = logistic(t_k - s).  All grades
share the weights, so the rare lower grades learn from each other.  Selection uses the tail
probability P(grade >= k); the expected grade ranks texts.

The model is fitted on a bounded sample: at most ``PER_GRADE`` labelled documents of each grade,
those with the least hash of their id.  Scoring runs over every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import keyed_text

#: Labelled documents of each grade that the fit may use: the bound of the sample.
PER_GRADE = 3000
#: Hashed features (a power of two, far above the words of a text so that few share a bucket).
BUCKETS = 1 << 26
#: Features in fewer fitted texts than this have no weight.
LEAST_TEXTS = 5
#: Nor have features whose chi-square statistic against every split of the grades is below this:
#: of the many rare words some would look telling by chance.
LEAST_ASSOCIATION = 20.0
#: And so must their share of that statistic's greatest value, the number of fitted texts.
LEAST_SHARE = 0.02
PENALTY = 0.5
#: Fitted texts of one grade whose so many least buckets agree count once.
SKETCH = 4
STEPS = 300
#: Words a worker remembers the weights of before it starts afresh.
REMEMBERED = 300_000

_EDGE = b".,;:!?\"'()[]{}-"
_SYMBOLS = b"#*$%&|<>"


def form_features(data: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Coarse features of form; the space in their names keeps them apart from words."""
    n = max(1, len(data))
    capitals = sum(1 for w in words if w.isupper())
    symbols = sum(data.count(bytes([c])) for c in _SYMBOLS)
    return [b" capitals %d" % min(4, 10 * capitals // max(1, len(words))),
            b" symbols %d" % min(5, 100 * symbols // n),
            b" shouts %d" % min(3, 50 * data.count(b"!") // n),
            b" variety %d" % (10 * distinct // max(1, len(words))),
            b" length %d" % min(6, len(words).bit_length() // 2)]


def features(text: str) -> set[bytes]:
    data = text.encode()
    words = data.split()
    found = {w.strip(_EDGE) for w in set(data.lower().split())}
    found.update(form_features(data, words, len(found)))
    found.discard(b"")
    return found


def bucket(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) & (BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """``weights`` of buckets and the ordered ``thresholds``; a model without thresholds knows one grade."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def telling(flat: np.ndarray, grade_of: np.ndarray, grades: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` features are clearly more frequent below some split of the grades than above.

    Only evidence against a text counts: with evidence for it as well, a short sound text, which
    holds little of either, would fall behind.
    """
    often, total = np.bincount(flat, minlength=n).astype(float), len(grades)
    best = np.zeros(n)
    for k in range(1, int(grades.max()) + 1):
        above = np.bincount(flat[grade_of >= k], minlength=n)
        side = int((grades >= k).sum())
        expected = often * side / total
        spread = expected * (1 - side / total) * (1 - often / total)
        best = np.maximum(best, np.minimum(above - expected, 0) ** 2 / np.maximum(spread, 1e-9))
    return (often >= LEAST_TEXTS) & (best >= max(LEAST_ASSOCIATION, LEAST_SHARE * total))


def fit(rows: list[np.ndarray], grades: np.ndarray, totals: dict[int, int] | None = None) -> Model:
    """Weights and thresholds by gradient steps on the penalised likelihood.

    ``rows`` are arrays of distinct buckets; ``totals`` says how many labelled documents of each
    grade there are in all (absent: as in the sample), so that a grade's bound changes no odds.  With fewer than two grades nothing can be told apart:
    weights are zero and no threshold rejects.
    """
    # copies of a text say nothing new: one of those with the same least buckets and grade stays
    alike = {(*np.sort(r)[:SKETCH].tolist(), g): i for i, (r, g) in enumerate(zip(rows, grades.tolist()))}
    rows, grades = [rows[i] for i in alike.values()], grades[list(alike.values())]
    top = int(grades.max(initial=0))
    if len(np.unique(grades)) < 2:
        return Model({}, np.zeros(0))
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows)
    of_row = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
    found, flat = np.unique(flat, return_inverse=True)
    kept = telling(flat, grades[of_row], grades, len(found))
    used, place = found[kept], np.cumsum(kept) - 1
    flat, of_row = place[flat][kept[flat]], of_row[kept[flat]]
    fitted = np.bincount(grades, minlength=top + 1)
    whole = np.array([(totals or {}).get(k, fitted[k]) for k in range(top + 1)], float)
    share = (whole / np.maximum(fitted, 1) / whole.sum())[grades]
    # parameters: weights, first threshold, logarithms of the gaps between thresholds
    w, t0, gaps = np.zeros(len(used)), -1.0, np.zeros(top - 1)
    moments = [[np.zeros(len(used)), np.zeros(len(used))], [0.0, 0.0], [np.zeros(top - 1), np.zeros(top - 1)]]
    rows_n = np.arange(len(rows))
    for step in range(1, STEPS + 1):
        cuts = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(of_row, w[flat], minlength=len(rows))
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -30, 30)))
        edge = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], 1)
        mass = np.maximum(edge[rows_n, grades + 1] - edge[rows_n, grades], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], 1)
        upper, lower = slope[rows_n, grades + 1] / mass * share, slope[rows_n, grades] / mass * share
        by_score = upper - lower  # of the negative log likelihood
        by_cut = np.zeros(top)
        np.add.at(by_cut, np.minimum(grades, top - 1), np.where(grades < top, -upper, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, lower, 0))
        by_w = np.bincount(flat, by_score[of_row], minlength=len(used)) + PENALTY * w / len(rows)
        by_gap = np.array([by_cut[k + 1:].sum() for k in range(top - 1)]) * np.exp(gaps)
        now = []
        for value, slope_of, moment in zip((w, t0, gaps), (by_w, by_cut.sum(), by_gap), moments):
            moment[0] = 0.9 * moment[0] + 0.1 * slope_of
            moment[1] = 0.99 * moment[1] + 0.01 * slope_of**2
            mean, spread = moment[0] / (1 - 0.9**step), moment[1] / (1 - 0.99**step)
            now.append(value - 0.05 * mean / (np.sqrt(spread) + 1e-8))
        w, t0, gaps = now
    return Model(dict(zip(used.tolist(), w.tolist())), t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sorted({bucket(f) for f in features(t)}) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "grade", "row"])


def train(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fit on ``ratings`` (doc_id, grade: 0, 1, ...); null ids or grades take no part
    and repeated ratings count once."""
    known = (ratings.where("doc_id IS NOT NULL AND grade >= 0").select("doc_id", F.col("grade").cast("int")).distinct()
             .withColumn("hash", F.xxhash64("doc_id")))
    # the least hashes of a grade lie in its first slots of the hash range: only rows of those meet in a window
    slot = F.shiftright("hash", 52)
    totals, cuts = {}, {}
    for grade, at, n in sorted(map(tuple, known.groupBy("grade", slot.alias("slot")).count().collect())):
        if totals.get(grade, 0) < per_grade:
            cuts[grade] = at
        totals[grade] = totals.get(grade, 0) + n
    within = F.lit(False)
    for grade, at in cuts.items():
        within |= (F.col("grade") == grade) & (slot <= at)
    order = Window.partitionBy("grade").orderBy("hash", "doc_id")
    sample = (known.where(within).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_grade)
              .select("doc_id", "grade"))
    # the sample is bounded by its parameter, so it goes to the texts and no text is shuffled
    rows = (keyed_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")
            .mapInArrow(_bucket_rows, "doc_id long, grade int, row array<int>").toArrow())
    rows = rows.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    column = rows["row"].combine_chunks()
    values, at = column.flatten().to_numpy(), np.cumsum([0, *(len(r) for r in column)])
    return fit([values[a:b] for a, b in zip(at[:-1], at[1:])], rows["grade"].to_numpy().astype(np.int64), totals)


class Scorer:
    """Scores of texts; the weights of words are remembered."""

    def __init__(self, model: Model) -> None:
        self._model, self._weights = model, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        known, weights, totals = self._weights, self._model.weights, []
        for text in texts:
            if len(known) > REMEMBERED:
                known.clear()
            found = []
            for f in features(text):
                w = known.get(f)
                if w is None:
                    w = known[f] = weights.get(bucket(f), 0.0)
                if w:
                    found.append(w)
            totals.append(math.fsum(found))  # exact, so the order of a set does not show
        return np.array(totals, np.float64)


SCHEMA = "doc_id long, score double, expected_grade double, tails array<double>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, tails) of every row; ``tails[k]`` is P(grade > k).

    Null and empty texts are scored by their form alone; a null id stays null; repeated rows give
    repeated rows; an empty table gives an empty table; other columns are ignored.  Where there
    were no two grades to learn from, ``tails`` is empty and the expected grade 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(tails.sum(1)),
                 pa.array(list(tails), pa.list_(pa.float64()))],
                names=["doc_id", "score", "expected_grade", "tails"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from two marks: 0 toxic, 1 harmless but poor, 2 sound; a missing mark gives none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def selected(least_tail: float = 0.5) -> Column:
    """Whether P(highest grade) reaches ``least_tail``; true where nothing was learnt."""
    return F.coalesce(F.try_element_at("tails", F.lit(-1)) >= least_tail, F.lit(True))


def keep_selected(docs: DataFrame, model: Model, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose P(highest grade) reaches ``least_tail``.

    Nulls, empty texts, ties, repeated rows and empty tables as in :func:`score`.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            tails = model.tails(scorer.scores([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(tails[:, -1] >= least_tail)) if tails.shape[1] else batch

    return docs.mapInArrow(run, docs.schema)
