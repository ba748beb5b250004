"""Exact money and stable rounding.

Money is summed as DECIMAL, so a total does not depend on how rows were spread
over tasks or on which task was run again after an executor was lost. Rounding
is half-up on a decimal, never on the binary double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The column that says how many slips or legs a row stands for, where rows are folded.
ROWS = "rows_folded"
MONEY = "decimal(18,6)"
FRACTION = "decimal(18,12)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def total(name: str | Column) -> Column:
    """Sum of a money column; 0 over no rows, like an empty sum."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0).cast("decimal(28,6)"))


def count_rows(df: DataFrame) -> Column:
    """How many slips or legs there are, whether rows are folded or not."""
    return F.coalesce(F.sum(ROWS), F.lit(0)).cast("long") if ROWS in df.columns else F.count("*")


def total_where(name: str, condition: Column) -> Column:
    return total(F.when(condition, F.col(name)))


def rounded(c: Column, places: int) -> Column:
    """Half-up to ``places`` decimals, as a double.

    Values too large for the decimal have no such decimals in a double; they, infinity
    and NaN stay as they are.
    """
    number = c.cast("double")
    return F.coalesce(F.round(number.try_cast("decimal(28,9)"), places).cast("double"), number)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in double; null where bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def percent(top: Column, bottom: Column) -> Column:
    return ratio_or_zero(top, bottom) * 100


def grouped_int(c: Column) -> Column:
    """1234567.8 -> '1,234,568'."""
    return F.format_number(F.round(c.cast("decimal(28,9)"), 0), 0)


def fixed(c: Column, places: int) -> Column:
    """3.456 -> '3.46' at two places."""
    exact = F.round(c.try_cast("decimal(28,9)"), places).try_cast(f"decimal(28,{places})")
    return F.coalesce(exact.cast("string"), c.cast("string"))


def trimmed_number(c: Column, places: int) -> Column:
    """At most ``places`` decimals and no trailing zeros: 5.0 -> '5', 2.5 -> '2.5'."""
    return F.regexp_replace(fixed(c, places), r"\.?0+$", "") if places else fixed(c, 0)


def euro(c: Column, places: int = 0) -> Column:
    """'€1,235', with the sign before the currency mark."""
    size = F.round(F.abs(c.cast("decimal(28,9)")), places)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("€"), F.format_number(size, places))
