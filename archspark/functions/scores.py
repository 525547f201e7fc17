"""Integer-exact score helpers shared by operators and oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(n: str, t: str) -> Column:
    """round(100*n/t) half-up in integers: (200n + t) div 2t, as BIGINT.

    Python's ``round(x, 2)`` and the engines' decimal rounding disagree at ties,
    so percentages are kept as exact integers (``n``, ``t`` are SQL names).
    """
    return F.expr(f"(200 * CAST({n} AS BIGINT) + {t}) div (2 * CAST({t} AS BIGINT))")


def density_bucket(commits) -> Column:
    """C11: >20 High, >5 Medium, else Low."""
    c = _c(commits)
    return F.when(c > 20, "High").when(c > 5, "Medium").otherwise("Low")


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))
