"""Text to vectors through pandas UDFs; the offline default hashes tokens deterministically."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as ST

from vellum.functions import text as T

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
BATCH = 16          # texts per model call
RETRIES = 4


def token_slots(dimension: int, salt: str):
    """token -> (index, sign): the 8-byte digest modulo the dimension, sign from its second bit."""
    @lru_cache(maxsize=1 << 16)
    def slot(token: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(f"{salt}:{token}".encode(), digest_size=8).digest(), "big")
        return h % dimension, -1.0 if (h >> 1) & 1 else 1.0

    return slot


# Fixed value: the salt the deterministic vectors are defined with.
SALT = "rag-hash-v1"


def hash_embedding(text: Column, dimension: int = 256, salt: str = SALT) -> Column:
    """L2-normalised signed token counts.  Tokens are cut in the JVM; tasks only hash distinct ones."""

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        slot = token_slots(dimension, salt)
        out = []
        for toks in tokens:
            v = np.zeros(dimension)
            for i, s in map(slot, toks):
                v[i] += s
            n = np.sqrt(v @ v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed(T.search_tokens(F.lower(T.text_or_empty(text))))


def model_embedding(text: Column, make_encoder: Callable[[], Encoder], batch: int = BATCH, retries: int = RETRIES) -> Column:
    """Vectors from an external model: built once per task, called in small batches, retried with back-off."""

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        import time
        encode, out = make_encoder(), []
        values = texts.fillna("").tolist()
        for i in range(0, len(values), batch):
            for attempt in range(retries + 1):
                try:
                    out.extend(encode(values[i:i + batch]))
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(0.1 * 2 ** attempt)
        return pd.Series([[float(x) for x in v] for v in out])

    return embed(text)
