"""Decimal rounding with Python's meaning: half to even on the exact value.

``2.675`` is stored a little below 2.675, so it rounds to 2.67.  Spark's
``round`` works on the shortest decimal text and gives 2.68.  Here the product
``v * 10**n`` is split into a rounded part and its exact error (a two-product
in plain double arithmetic), which tells on which side of the half-way point
the value really lies.  Everything is ordinary column arithmetic and stays in
generated code.
"""

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def py_round(v: Column, digits: int) -> Column:
    """``round(v, digits)`` as Python computes it; null and NaN pass through."""
    m = float(10 ** digits)
    p = v * m
    k = F.floor(p).cast("double")
    hi = v * _SPLIT - (v * _SPLIT - v)
    err = (hi * m - p) + (v - hi) * m
    d = (p - k - 0.5) + err
    up = (d > 0) | ((d == 0) & (k % 2.0 != 0))
    return F.when(F.isnan(v), v).otherwise((k + F.when(up, 1.0).otherwise(0.0)) / m)


def round_sql(v: str, digits: int) -> str:
    """The same rule as SQL text for any engine with IEEE doubles.

    ``v`` must be a DOUBLE expression; pass a column name to keep it short.
    """
    m = f"1e{digits}"
    p = f"({v}*{m})"
    k = f"floor({p})"
    hi = f"({v}*134217729e0-({v}*134217729e0-{v}))"
    d = f"(({p}-{k}-5e-1)+(({hi}*{m}-{p})+({v}-{hi})*{m}))"
    return (f"(({k}+CASE WHEN {d}>0 OR ({d}=0 AND {k}%2<>0) THEN 1e0 ELSE 0e0 END)/{m})")
