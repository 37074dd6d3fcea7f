"""Equal date intervals between two dates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds
_EPOCH = datetime(1970, 1, 1)


def parse_date(text: str) -> datetime:
    """``YYYY-MM-DD`` or ``"today"`` (which keeps its time of day)."""
    return datetime.today() if text == "today" else datetime.strptime(text, "%Y-%m-%d")


def interval_count(start: datetime, end: datetime, per_year: int) -> int:
    return (abs(start.year - end.year) + 1) * per_year


def boundary(start: datetime, end: datetime, count: int, index: Column) -> Column:
    """Day on which interval ``index`` starts; index ``count`` is the end date."""
    step = _micros((end - start) / count)
    first = _micros(start - _EPOCH)
    last = _micros(end - _EPOCH)
    moment = F.when(index == count, F.lit(last)).otherwise(F.lit(first) + index * F.lit(step))
    # Whole days since the epoch: no time zone is involved.
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(moment / F.lit(DAY)).cast("int"))


def candidate_indexes(day: Column, start: datetime, end: datetime, count: int) -> Column:
    """The at most three interval numbers that a day can fall in, by arithmetic instead of a join."""
    step = _micros((end - start) / count)
    if step == 0:
        return F.sequence(F.lit(0), F.lit(count - 1))
    guess = F.floor((F.unix_date(day).cast("long") * DAY - F.lit(_micros(start - _EPOCH))) / F.lit(step))
    reach = max(1, -(-timedelta(days=1) // timedelta(microseconds=abs(step))) + 1)
    low, high = F.greatest(guess - reach, F.lit(0)), F.least(guess + reach, F.lit(count - 1))
    return F.when(low <= high, F.sequence(low, high))


def _micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)
