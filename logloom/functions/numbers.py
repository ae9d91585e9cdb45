"""Sums and roundings that don't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of doubles are kept to ten decimals.
_EXACT = "decimal(28,10)"


def _kept(decimals: Column, n: Column, plain: Column) -> Column:
    return F.when(n == 0, decimals.cast("double")).otherwise(plain)


def exact_sum(c: Column) -> Column:
    """The sum of doubles, the same in whatever order they come: of decimals, or of doubles if one of them is too large or not finite."""
    d = c.cast("double").try_cast(_EXACT)
    return _kept(F.try_sum(d), F.count_if(c.isNotNull() & d.isNull()), F.sum(c))


def exact_sum_over(c: Column, w) -> Column:
    """exact_sum over a window."""
    d = c.cast("double").try_cast(_EXACT)
    return _kept(F.try_sum(d).over(w), F.count_if(c.isNotNull() & d.isNull()).over(w), F.sum(c).over(w))


def half_up(c: Column, places: int) -> Column:
    """c rounded as SQL has it: c times a power of ten, its halves away from zero. (F.round looks at the shortest decimal that reads as c: 0.87285 is a half there, times 10,000 it is less.)"""
    return F.round(c.cast("double") * 10.0**places) / 10.0**places
