"""Named queries over the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib
import pkgutil

from sensorloom.catalogue.registry import ORACLES, QUERIES


def load():
    """Import every catalogue module once and return (queries, oracles)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
