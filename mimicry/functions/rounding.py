"""Rounding that agrees with IEEE round-half-even on the binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(value: Column, digits: int) -> Column:
    """Round the double itself, not its shortest decimal form.

    ``F.round`` rounds half up on the printed digits, so 0.9 * 0.8335 becomes 0.7502;
    the exact binary value lies below the tie and must become 0.7501. ``format_number``
    rounds the exact value; its thousands separators are removed again. It misjudges the
    tie of a value whose first digit is the one rounded away, so values below one unit are
    compared with the tie itself.
    """
    unit, tie = float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    size = F.abs(value)
    up = size >= tie if round(tie, digits) > 0 else size > tie
    tiny = F.when(up, F.signum(value) * F.lit(unit)).otherwise(F.lit(0.0))
    text = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.when(size < unit, tiny).otherwise(text.cast("double"))


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded share, zero where the denominator is zero."""
    safe = F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
    return round_binary(safe, digits)
