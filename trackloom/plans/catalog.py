"""All queries of the trajectory engine: importing the modules registers them."""

from __future__ import annotations

import importlib
import pkgutil

from trackloom import plans
from trackloom.plans.registry import QUERIES, SQL

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m.startswith("catalog_"):
        importlib.import_module(f"trackloom.plans.{_m}")

__all__ = ["QUERIES", "SQL"]
