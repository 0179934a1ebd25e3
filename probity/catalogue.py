"""Every query of the core library by name, with its SQL."""

from __future__ import annotations

from .operators import bootstrap, design, metrics, ranking, registry, screening, splits
from .sources import drift, files
from .streaming import sums

FLAGSHIP = "point_metrics"
MODULES = (metrics, bootstrap, ranking, splits, screening, design, registry, drift, files, sums)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES if hasattr(m, "oracle_sql") for name, sql in m.oracle_sql().items()}
