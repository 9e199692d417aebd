"""All queries of the engine, gathered from its query modules."""

from __future__ import annotations

import importlib
import pkgutil

from sensorloom import plans
from sensorloom.plans.registry import ORACLES, QUERIES, Query

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"sensorloom.plans.{_m}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
