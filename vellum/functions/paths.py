"""How stored document paths are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import text as T


def display_path(path: Column, mode: str = "full", root: str | None = None) -> Column:
    """full, redact, basename or relative (to ``root``; outside it, the base name)."""
    base = F.element_at(F.split(path, "/"), -1)
    if mode == "redact":
        shown = F.lit("<redacted>")
    elif mode == "basename":
        shown = base
    elif mode == "relative":
        prefix = (root or "").rstrip("/") + "/"
        shown = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(base)
    else:
        shown = path
    return F.when(T.none_if_empty(path).isNull(), path).otherwise(shown)

