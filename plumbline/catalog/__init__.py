"""Named queries over the test tables, one per operator or group of operators."""

import importlib

from plumbline.catalog.registry import ORACLES, QUERIES

for _module in ("profiling", "joining", "scalars", "ranking", "evaluation", "modeling", "files"):
    importlib.import_module(f"plumbline.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
