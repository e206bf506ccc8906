"""Numbers as reports print and rank them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounded to an integer, halves toward positive infinity."""
    return F.floor(x + 0.5)


def nearest_rank(name: str, q: float) -> Column:
    """Aggregate over column name: its value of rank ceil(n q), 0 where there is none."""
    return F.coalesce(F.expr(f"percentile_disc({q!r}) within group (order by `{name}`)"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / max(1, b)."""
    return a / F.greatest(F.lit(1), b)


def estimated_tokens(size: Column, bytes_per_token: int = 4) -> Column:
    """Tokens that a request of so many bytes has, about; null for no or a negative size."""
    return F.when(size >= 0, F.ceil(size / bytes_per_token))
