"""Ratios used by the indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_of_ratios(part: Column, whole: Column, reference_part: Column, reference_whole: Column) -> Column:
    """(part / whole) / (reference_part / reference_whole); null instead of a division by zero."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    reference = F.try_divide(reference_part.cast("double"), reference_whole.cast("double"))
    return F.try_divide(share, reference)
