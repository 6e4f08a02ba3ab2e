"""Pre-tokens and ids of a word-end BPE vocabulary file.

The library's normaliser and splitter run token by token with offsets; here plain texts go
through one regular expression instead, and each distinct pre-token is encoded once per worker.
The rules are read from the vocabulary file.  A text whose characters lie outside the range in
which Python's lower-casing and the library's are known to agree goes through the library.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import regex

from vellum.llm.shared import worker_memory

#: Below U+0250 lower-casing is by character, so Python and the library agree.
_BEYOND = regex.compile("[^\x00-ɏ]")
#: The byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next character from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 400_000


def _narrow(pattern: str) -> re.Pattern:
    """The same splits for texts below U+0250 by the faster standard library: each class of the pattern is
    spelled out as the characters that the regex library finds in it."""

    def spelled(found: re.Match) -> str:
        held = [c for c in map(chr, range(0x250)) if regex.fullmatch(found[0], c)]
        return "[" + "".join(map(re.escape, held)) + "]"

    return re.compile(re.sub(r"\[[^]]*\]", spelled, pattern))


class PreTokenizer:
    """``split(text)`` gives the pre-tokens of a text, ``ids(pre_tokens)`` their vocabulary ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        steps = [n["type"] for n in rules["normalizer"]["normalizers"]]
        splits = rules["pre_tokenizer"]["pretokenizers"]
        special = rules["added_tokens"]
        if (steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]
                or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special)):
            raise ValueError(f"{path}: not a lower-casing word-end vocabulary")
        self._pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self._fast = _narrow(splits[0]["pattern"]["Regex"])
        self._bare = not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        self._special = {t["content"]: t["id"] for t in special}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")") if special else None
        self._marks = {s[:2] for s in self._special}
        self._ids: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string stands for itself, as in the library."""
        if self._cut and any(m in text for m in self._marks):
            parts = self._cut.split(text)
            if len(parts) > 1:
                return [t for i, part in enumerate(parts) for t in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _BEYOND.search(text):
                text = self._library.normalizer.normalize_str(text)
                return self._pattern.findall(text)
            text = unicodedata.normalize("NFC", text).lower()
            return (self._pattern if _BEYOND.search(text) else self._fast).findall(text)  # a few lie beyond in lower case
        return self._fast.findall(text.lower())

    def ids(self, tokens: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit numbers, one after another."""
        known = self._ids
        try:
            return b"".join([known[t] for t in tokens])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = struct.pack(f"<{len(ids := self.encode(t))}I", *ids)
            return b"".join([known[t] for t in tokens])

    def encode(self, token: str) -> tuple[int, ...]:
        """Ids of one pre-token, by the library's own model."""
        if token in self._special:
            return (self._special[token],)
        if self._bare:  # a pre-token is not split again, so its bytes go to the model as they are
            return tuple(t.id for t in self._library.model.tokenize(token.encode().decode("latin-1").translate(_ALPHABET)))
        return tuple(t.id for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(token)
                     for t in self._library.model.tokenize(piece))


def pre_tokenizer(path: str) -> PreTokenizer:
    return worker_memory(PreTokenizer, path)
