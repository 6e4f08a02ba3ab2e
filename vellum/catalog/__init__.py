"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from vellum.catalog.registry import ENTRIES, Entry


def load_all() -> dict[str, Entry]:
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod != "registry":
            importlib.import_module(f"{__name__}.{mod}")
    return ENTRIES
