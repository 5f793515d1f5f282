"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = ["quality", "leakage", "drift", "performance", "fairness", "forensics", "models", "experiments", "temporal", "rules", "operations", "streams", "joins"]


def registry():
    from .common import Registry

    out = Registry()
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}").register(out)
    return out
