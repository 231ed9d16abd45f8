"""Collects the queries of the core and, where it is there, of the training-data subpackage."""

from __future__ import annotations

import importlib


def modules() -> list:
    found = []
    for name in ("pixelgrove.plans.load_queries", "pixelgrove.plans.core_queries"):
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError as e:
            if e.name != name:
                raise
    return found
