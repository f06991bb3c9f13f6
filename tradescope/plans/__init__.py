"""Domain views and the registered queries over them."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import the modules of queries, which register themselves."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
