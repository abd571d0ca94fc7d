"""Rates. Division by zero gives null, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage (T4)."""
    return fraction(part, whole) * F.lit(100.0)


def round4(x: Column) -> Column:
    """Half-even to four decimals by scaling, as numpy does, so results agree to the last bit."""
    return F.rint(x * F.lit(10000.0)) / F.lit(10000.0)


def percent_of_rounded(part: Column, whole: Column) -> Column:
    """Round the fraction to four decimals first, then times 100."""
    return round4(fraction(part, whole)) * F.lit(100.0)

