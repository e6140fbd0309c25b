"""Potential evapotranspiration by Thornthwaite and Hargreaves (Penman-Monteith is in functions.expr)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.errors import ShapeError
from hydroframe.functions.calendar import Periodicity, is_leap, period_of
from hydroframe.functions.expr import daylight_hours, extraterrestrial_radiation, hargreaves, missing_as_null, solar_declination, sunset_angle
from hydroframe.operators.series import align, by_keys, densify, trim


def check_latitude(latitude: float) -> None:
    if math.isnan(latitude) or not -90.0 < latitude < 90.0:
        raise ShapeError(f"latitude {latitude} is not between -90 and 90, both excluded")


def month_daylight(latitude: Column, month: Column, leap: Column) -> Column:
    """Mean hours of daylight of a month: the mean over its days, latitude in radians."""
    year = F.when(leap, 2000).otherwise(2001)
    first = F.dayofyear(F.make_date(year, month, F.lit(1)))
    days = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    hours = F.transform(F.sequence(first, first + days - 1), lambda d: daylight_hours(sunset_angle(latitude, solar_declination(d))))
    return F.aggregate(hours, F.lit(0.0), lambda a, x: a + x) / days


def thornthwaite(df: DataFrame, keys: list[str], latitude: str | float, time: str = "time", tmean: str = "tavg", out: str = "pet") -> DataFrame:
    """mm a month: keys, time, `out`.  `latitude` is a column (one value for each cell) or a number, in degrees."""
    if not isinstance(latitude, str):
        check_latitude(latitude)
    column = F.col(latitude) if isinstance(latitude, str) else F.lit(float(latitude))
    rows = df.withColumn("_lat", F.when((column > -90) & (column < 90), column))
    lat = rows.groupBy(*keys).agg(F.first("_lat", True).alias("_lat"))
    dense = densify(rows, keys, time, (tmean,)).withColumn(tmean, F.when(F.col(tmean) < 0, 0.0).otherwise(F.col(tmean)))
    dense = dense.withColumn("_mean", F.avg(tmean).over(by_keys(keys, "period")))
    # Every month's mean counts once for each year, so the sum over the cell is the heat index times the years.
    w = by_keys(keys)
    dense = dense.withColumn("_heat", F.sum(F.pow(F.col("_mean") / 5.0, F.lit(1.514))).over(w) / (F.count(F.lit(1)).over(w) / 12))
    dense = dense.withColumn("_heat", F.when(F.count("_mean").over(w) == F.count(F.lit(1)).over(w), F.col("_heat"))).join(lat, keys, "left") if keys else dense.crossJoin(lat)
    i = F.col("_heat")
    power = 6.75e-07 * i * i * i - 7.71e-05 * i * i + 1.792e-02 * i + 0.49239
    leap = is_leap(F.col("year"))
    days = F.dayofmonth(F.last_day(F.make_date("year", "period", F.lit(1))))
    light = month_daylight(F.radians("_lat"), F.col("period"), leap)
    value = 16.0 * (light / 12.0) * (days / 30.0) * F.pow(F.try_divide(10.0 * F.col(tmean), i), power)
    return trim(dense.withColumn(out, value), time).select(*keys, time, out)


def hargreaves_pet(tmin: DataFrame, tmax: DataFrame, keys: list[str], latitude: str | float, time: str = "time", tmin_col: str = "tmin", tmax_col: str = "tmax", out: str = "pet") -> DataFrame:
    """mm a day from the days that both have; the day of the year is its place in a year of 366 days."""
    if not isinstance(latitude, str):
        check_latitude(latitude)
    both = align(tmin, tmax, keys, time)
    lat = F.radians(F.col(latitude)) if isinstance(latitude, str) else F.lit(math.radians(latitude))
    low, high = missing_as_null(F.col(tmin_col)), missing_as_null(F.col(tmax_col))
    day = period_of(F.col(time), Periodicity.daily)
    return both.select(*keys, time, hargreaves(low, high, (low + high) / 2.0, extraterrestrial_radiation(day, lat)).alias(out))
