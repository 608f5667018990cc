"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package so that its queries register themselves."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
