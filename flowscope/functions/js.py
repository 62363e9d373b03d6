"""Arithmetic as the recorded sessions' own tools do it."""

from pyspark.sql import functions as F


def js_round(c):
    """Halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def div(a, b, default=0.0):
    """a / b, or ``default`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))
