"""Column expressions shared by the operators.

All of these are built-in Spark expressions, so they stay inside
whole-stage code generation; nothing here calls back into Python.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.constants import MONTH_NAMES

EXACT_TYPE = "decimal(28,6)"

# A numeric literal as text: optional sign, digits with an optional fraction,
# optional exponent, or an infinity word.  Java-style suffixes ("1d", "2f"),
# thousands separators and NaN are not numbers here.
NUMERIC_TEXT = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def exact_sum(col) -> Column:
    """SUM as double over every value: the part of six decimals is added up in a wide decimal, so
    that the result does not depend on partition order; what is finer, and values beyond the
    decimal (1e22 and more, infinity), is added up as doubles.  A remainder within the last bits
    of its own value is rounding of a product, not a finer amount, and counts as nothing."""
    return sum_of_parts(*exact_parts(col))


def exact_parts(col) -> tuple[Column, Column]:
    """The two columns that ``exact_sum`` adds up: the part in the wide decimal, and what is finer or beyond it."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    part = c.try_cast(EXACT_TYPE)
    finer = c - part.cast("double")
    finer = F.when(F.abs(finer) > F.abs(c) * F.lit(1e-15), finer).otherwise(F.lit(0.0))
    return part, F.when(part.isNull(), c).otherwise(finer)


def sum_of_parts(part, rest) -> Column:
    """``exact_sum`` of a value whose ``exact_parts`` are given."""
    fits, rest = F.sum(part).cast("double"), F.sum(rest)
    return F.when(rest.isNull(), fits).otherwise(F.coalesce(fits, F.lit(0.0)) + rest)


def exact_avg(col) -> Column:
    """AVG as double: ``exact_sum`` over the count of the values summed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))


def pct(part: Column, whole: Column) -> Column:
    """``part * 100 / whole`` in double; null when ``whole`` is 0."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1))).cast("long")


def month_number(month_name: Column) -> Column:
    """English month name -> 1..12, null for anything else."""
    lookup = F.create_map(*chain.from_iterable(
        (F.lit(name), F.lit(i + 1)) for i, name in enumerate(MONTH_NAMES)))
    return F.try_element_at(lookup, month_name).cast("int")


def coerce_numeric(text: Column) -> Column:
    """Text -> double; anything that is not a plain number (or is NaN) -> 0."""
    t = F.trim(text)
    parsed = F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))
    return F.coalesce(F.nanvl(parsed, F.lit(None).cast("double")), F.lit(0.0))


def round_half_up(col: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in plain IEEE double arithmetic.

    Written out instead of ``round`` so every engine computes the same bits:
    the result is never a decimal tie, so printing it is unambiguous.
    """
    scale = float(10 ** digits)
    return F.floor(col.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fixed(col: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals, like ``f'{x:.Nf}'``."""
    return F.format_string(f"%.{digits}f", round_half_up(col, digits))

