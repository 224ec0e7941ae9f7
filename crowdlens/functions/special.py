"""Digamma and log-gamma as pure Column expressions.

Spark has neither function built in.  Both are evaluated for arguments
>= 1 here (Dirichlet pseudo-counts), using a shift by 8 and the asymptotic
series, accurate to ~1e-12.  Being plain arithmetic on Columns they stay
in whole-stage codegen; no UDF.  ``*_sql`` return the same formulas as SQL
text for the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8  # fixed value: recurrence shift before the asymptotic series
HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)


def digamma(x: Column) -> Column:
    """psi(x) = psi(x+8) - sum_{i<8} 1/(x+i); psi(y) ~ ln y - 1/2y - 1/12y^2 + ..."""
    y = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    series = (F.log(y) - F.lit(0.5) * inv
              - inv2 * (F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 120) - inv2 * (
                  F.lit(1.0 / 252) - inv2 * (F.lit(1.0 / 240) - inv2 * F.lit(1.0 / 132))))))
    shift = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(1, SHIFT)),
                F.lit(1.0) / x)
    return series - shift


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: ln Gamma(x+8) - sum_{i<8} ln(x+i), Stirling series."""
    y = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    stirling = ((y - F.lit(0.5)) * F.log(y) - y + F.lit(HALF_LN_2PI)
                + inv * (F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 360) - inv2 * (
                    F.lit(1.0 / 1260) - inv2 * F.lit(1.0 / 1680)))))
    logs = sum((F.log(x + F.lit(float(i))) for i in range(1, SHIFT)), F.log(x))
    return stirling - logs


def digamma_sql(x: str) -> str:
    """Same series as ``digamma`` in SQL text (DuckDB has no digamma)."""
    y = f"(({x}) + {float(SHIFT)})"
    inv2 = f"(1.0/({y}*{y}))"
    series = (f"(ln({y}) - 0.5/{y} - {inv2}*(1.0/12 - {inv2}*(1.0/120 - {inv2}*"
              f"(1.0/252 - {inv2}*(1.0/240 - {inv2}*(1.0/132))))))")
    shift = " + ".join(f"1.0/(({x}) + {float(i)})" for i in range(SHIFT))
    return f"({series} - ({shift}))"


def lgamma_sql(x: str) -> str:
    return f"lgamma({x})"
