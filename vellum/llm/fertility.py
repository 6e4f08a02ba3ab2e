"""Quality rules by tokeniser fertility.

A public SentencePiece vocabulary measures how well a text fits what vocabularies are made for:
characters per token (fertility turned over), the share of tokens that are single bytes because no
piece covers the character, and the entropy of the text's tokens in bits.  Each has a rejection
band for the text's language, or for its script where the language has none.  Base counts of words,
symbols, repeated lines and repeated five-word windows come from the same pass.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import vocabulary_path, worker_memory

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Words a worker remembers the pieces of before it starts afresh.
REMEMBERED = 500_000
#: Documents whose words are looked up together.
TOGETHER = 250


@dataclass(frozen=True)
class Band:
    """Kept texts lie inside: characters per token, byte share, and entropy (bits) of their tokens.

    A text of n tokens cannot have more than log2(n) bits, so a short one needs only
    ``entropy_share`` of that.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    entropy_share: float = 0.4


#: By language code where known, else by script.
BANDS = {
    "en": Band(1.4, 8.0, 0.05, 4.0), "de": Band(1.3, 8.0, 0.05, 4.0),
    "fr": Band(1.3, 8.0, 0.05, 4.0), "es": Band(1.3, 8.0, 0.05, 4.0),
    "Latin": Band(1.2, 9.0, 0.10, 4.0), "Greek": Band(0.7, 6.0, 0.20, 4.0), "Cyrillic": Band(1.0, 7.0, 0.10, 4.0),
    "Hebrew": Band(0.5, 6.0, 0.30, 4.0), "Arabic": Band(0.5, 6.0, 0.30, 4.0), "Indic": Band(0.3, 6.0, 0.60, 4.0),
    "Thai": Band(0.3, 6.0, 0.60, 4.0), "Hangul": Band(0.3, 4.0, 0.60, 4.0), "Kana": Band(0.3, 4.0, 0.50, 4.0),
    "Han": Band(0.3, 4.0, 0.50, 4.0), "other": Band(0.2, 9.0, 0.90, 3.0),
}
#: Ranges of code points that tell a script (first, last, script).
SCRIPTS = ((0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xC0, 0x24F, "Latin"), (0x370, 0x3FF, "Greek"),
           (0x400, 0x52F, "Cyrillic"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x6FF, "Arabic"), (0x900, 0xDFF, "Indic"),
           (0xE00, 0xE7F, "Thai"), (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x30FF, "Kana"), (0x4E00, 0x9FFF, "Han"),
           (0xAC00, 0xD7A3, "Hangul"))
_EDGES = np.array([e for a, b, _ in SCRIPTS for e in (a, b + 1)], np.uint32)


def script_of(text: str) -> str:
    """The script of most of the letters ("other" where there are none of a known one)."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    slots = np.bincount(np.searchsorted(_EDGES, points, "right"), minlength=len(_EDGES) + 1)
    totals = Counter()
    for i, (_, _, name) in enumerate(SCRIPTS):
        totals[name] += int(slots[2 * i + 1])
    name, n = totals.most_common(1)[0]
    return name if n else "other"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts, n, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            n += i + window - max(end, i)
            end = i + window
    return n


class Fertility:
    """Measures of a text's tokens; the pieces of a word are found once per worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._is_byte = np.array([self._library.is_byte(i) for i in range(self._library.vocab_size())])
        self._pieces: dict[bytes, bytes] = {}

    def learn(self, bags: list[Counter]) -> None:
        """Find the pieces of every word of some bags in one call of the library."""
        if len(self._pieces) > REMEMBERED:
            self._pieces.clear()
        new = list(set().union(*bags) - self._pieces.keys())
        texts = [w.decode("utf-8", "replace") for w in new]
        for word, ids in zip(new, self._library.encode(texts, num_threads=1) if new else ()):
            self._pieces[word] = array("I", ids).tobytes()

    def measure(self, words: Counter) -> tuple[int, int, float]:
        """(tokens, byte tokens, entropy in bits) of a bag of words that were learnt."""
        if not words:
            return 0, 0, 0.0
        found = [self._pieces[w] for w in words]
        ids = np.frombuffer(b"".join(found), "<u4")
        often = np.repeat(np.fromiter(words.values(), np.int64, len(words)),
                          np.fromiter(map(len, found), np.int64, len(found)) // 4)
        order = np.argsort(ids, kind="stable")
        ids, often = ids[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        counts = np.add.reduceat(often, first)
        n = int(counts.sum())
        share = counts / n
        return n, int(counts[self._is_byte[ids[first]]].sum()), float(-(share * np.log2(share)).sum())


def verdict(band: Band, chars: int, tokens: int, byte_tokens: int, entropy: float) -> str:
    """Name of the first band the text lies outside of, or the empty string."""
    if not tokens:
        return "no tokens"
    per_token = chars / tokens
    if per_token < band.least_chars or per_token > band.most_chars:
        return "characters per token"
    if byte_tokens > band.most_bytes * tokens:
        return "byte share"
    if entropy < min(band.least_entropy, band.entropy_share * np.log2(tokens)):
        return "entropy"
    return ""


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, "
          "byte_share double, entropy double, reason string")
_FIELDS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "script", "chars_per_token", "byte_share", "entropy", "reason")
_TYPES = (pa.int64(),) * 6 + (pa.bool_(),) * 2 + (pa.string(),) + (pa.float64(),) * 3 + (pa.string(),)
_ARROW = pa.schema(list(zip(_FIELDS, _TYPES)))


def assess(text: str, lang: str | None, words: list[bytes], bag: Counter, fertility: Fertility,
           bands: dict[str, Band]) -> tuple:
    """One text's row, without its id; ``bag`` counts ``words``, which the vocabulary has learnt."""
    data = text.encode()
    n_words = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(data.count(c) for c in (bytes([b]) for b in SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = repeated_words(words)
    failed = n_words < 10 or 100 * repeated > 20 * n_words
    tokens, byte_tokens, entropy = fertility.measure(bag)
    script = script_of(text)
    reason = "base" if failed else verdict(bands.get(lang) or bands[script], chars, tokens, byte_tokens, entropy)
    return (n_words, chars, symbols, len(lines) - len(set(lines)), repeated, failed, not reason, script,
            chars / tokens if tokens else None, byte_tokens / tokens if tokens else None, entropy, reason)


def quality_rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base counts, fertility measures, ``kept`` and ``reason`` of every row of ``docs``.

    A null or empty text has no words and fails the base rules.  A null or unknown language, and
    ``lang_col`` None, fall back to the script's band.  Null ids stay null, repeated rows give
    repeated rows, an empty table an empty table; other columns are ignored.
    """
    path, used = vocabulary_path(vocabulary), bands or BANDS
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = worker_memory(Fertility, path)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                ids, texts, langs = (c.to_pylist() for c in batch.slice(i, TOGETHER).columns)
                found = [(doc, *x) for doc, x in zip(ids, assess_all(texts, langs, fertility, used))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)],
                                                 schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


def assess_all(texts: list[str], langs: list, fertility: Fertility, bands: dict[str, Band]) -> list[tuple]:
    words = [t.encode().split() for t in texts]
    bags = [Counter(w) for w in words]
    fertility.learn(bags)
    return [assess(t, lang, w, bag, fertility, bands) for t, lang, w, bag in zip(texts, langs, words, bags)]


def keep_sound(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] | None = None,
               text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`quality_rules` keeps."""
    path, used = vocabulary_path(vocabulary), bands or BANDS
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = worker_memory(Fertility, path)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                langs = [None] * len(texts) if lang_at is None else part.column(lang_at).to_pylist()
                kept = [x[_FIELDS.index("kept") - 1] for x in assess_all(texts, langs, fertility, used)]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
