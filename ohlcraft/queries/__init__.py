"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

MODULES = ["averages", "momentum", "volatility", "candles", "core", "trading", "structure", "research", "more"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
