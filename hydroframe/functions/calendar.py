"""Periods of the year: months, or days of a year of 366 days in which 29 February always has its place."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroframe.errors import PeriodicityError


class Periodicity(Enum):
    monthly = 12
    daily = 366

    @property
    def steps(self) -> int:
        return self.value

    @classmethod
    def of(cls, name: str | Periodicity) -> Periodicity:
        if isinstance(name, cls):
            return name
        try:
            return cls[str(name).lower()]
        except KeyError:
            raise PeriodicityError(f"unknown periodicity {name}", "periodicity", name, "monthly, daily") from None


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def period_of(time: Column, periodicity: Periodicity) -> Column:
    """Month 1..12, or place 1..366 in the year of 366 days: from 1 March on a common year skips one."""
    if periodicity is Periodicity.monthly:
        return F.month(time)
    day = F.dayofyear(time)
    return day + F.when(~is_leap(F.year(time)) & (day >= 60), 1).otherwise(0)


def date_of(year: Column, period: Column, periodicity: Periodicity) -> Column:
    """The inverse; null for 29 February of a common year."""
    if periodicity is Periodicity.monthly:
        return F.make_date(year, period, F.lit(1))
    leap = is_leap(year)
    day = period - F.when(~leap & (period > 60), 1).otherwise(0)
    return F.when(leap | (period != 60), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int")))
