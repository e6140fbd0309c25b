"""SPI, SPEI, EDDI, percent of normal and the precipitation concentration index over many cells."""

from __future__ import annotations

import warnings
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydroframe.errors import InvalidArgument, OldNameWarning
from hydroframe.functions.calendar import Periodicity
from hydroframe.functions.expr import bounded, hastings
from hydroframe.operators import fitting
from hydroframe.operators.extend import require
from hydroframe.operators.series import by_keys, calibration_years, check_frame, check_scale, clip_negative, densify, trailing_sum, trim


class Distribution(Enum):
    gamma = "gamma"
    pearson = "pearson"


#: Names of parameter columns that older tables have.
OLD_NAMES = {"alphas": "alpha", "betas": "beta", "probabilities_of_zero": "prob_zero", "locs": "loc", "scales": "scale", "skews": "skew"}


def _distribution(name: str | Distribution) -> Distribution:
    try:
        return name if isinstance(name, Distribution) else Distribution(str(name).lower())
    except ValueError:
        raise InvalidArgument(f"unknown distribution {name}", "distribution", name, "gamma, pearson") from None


def current_names(params: DataFrame) -> DataFrame:
    old = {k: v for k, v in OLD_NAMES.items() if k in params.columns and v not in params.columns}
    if old:
        warnings.warn(f"parameter columns {sorted(old)} have old names", OldNameWarning, stacklevel=2)
    return params.withColumnsRenamed(old)


def standardise(dense: DataFrame, keys: list[str], value: str, distribution: str | Distribution, calibration: tuple[int, int] | None = None, params: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """Adds z, clipped to [-3.09, 3.09].  Parameters are fitted here, or come as a table by keys and period.

    With `fallback`, a cell more than half of whose Pearson values are missing gets gamma values fitted to its own data.
    """
    kind, on = _distribution(distribution), [*keys, "period"]
    given = current_names(params) if params is not None else None

    def gamma(df: DataFrame, fitted: DataFrame | None) -> DataFrame:
        if fitted is None:
            return _gamma_by_windows(df, keys, value, calibration)
        if "prob_zero_gamma" not in fitted.columns:
            whole = by_keys(keys, "period")
            p0 = F.count_if(F.col(value) == 0).over(whole) / F.count(F.lit(1)).over(whole)
            df = df.withColumn("prob_zero_gamma", F.when(p0 < 1, p0).otherwise(0.0))
            fitted = fitted.select(*on, "alpha", "beta")
        else:
            fitted = fitted.select(*on, "alpha", "beta", "prob_zero_gamma")
        return df.join(fitted, on, "left")

    if kind is Distribution.gamma:
        rows = gamma(dense, given)
        return fitting.with_gamma_z(rows, value, "z").drop("alpha", "beta", "prob_zero_gamma")
    rows = fitting.with_pearson_fit(dense, keys, value, calibration) if given is None else dense.join(given.select(*on, "prob_zero", "loc", "scale", "skew"), on, "left")
    rows = fitting.with_pearson_z(rows, value, "z").drop("prob_zero", "loc", "scale", "skew")
    if not fallback:
        return rows
    # Only the values of failed cells are evaluated; the fit itself is two windows.
    rows = gamma(rows.withColumn("_bad", F.avg(F.col("z").isNull().cast("int")).over(by_keys(keys)) > 0.5), None)
    rows = fitting.with_gamma_z(rows.withColumn("_left", F.when(F.col("_bad"), F.col(value))), "_left", "_other")
    return rows.withColumn("z", F.when(F.col("_bad"), F.col("_other")).otherwise(F.col("z"))).drop("_bad", "_left", "_other", "alpha", "beta", "prob_zero_gamma")


def _gamma_by_windows(df: DataFrame, keys: list[str], value: str, calibration: tuple[int, int] | None) -> DataFrame:
    """gamma_fit as windows by keys and period, which share the exchange of the trailing sum."""
    inside = F.lit(True) if calibration is None else calibration_years(df, keys, *calibration)
    w = by_keys(keys, "period")
    df = df.withColumn("_wet", F.when(inside & (F.col(value) > 0), F.col(value)))
    df = df.withColumns({"_m": F.avg("_wet").over(w), "_ml": F.avg(F.log("_wet")).over(w), "_p0": F.count_if(F.col(value) == 0).over(w) / F.count(F.lit(1)).over(w)})
    alpha, beta = fitting.thom(F.col("_m"), F.col("_ml"))
    return df.withColumns({"alpha": alpha, "beta": beta, "prob_zero_gamma": F.when(F.col("_p0") < 1, F.col("_p0")).otherwise(0.0)}).drop("_wet", "_m", "_ml", "_p0")


def _finish(df: DataFrame, keys: list[str], time: str, keep: list[str], periodicity: str | Periodicity) -> DataFrame:
    return trim(df, time, periodicity).select(*keys, time, *keep)


def spi(df: DataFrame, keys: list[str], scale: int, distribution: str | Distribution = "gamma", time: str = "time", value: str = "value", periodicity: str | Periodicity = "monthly", calibration: tuple[int, int] | None = None, params: DataFrame | None = None, out: str = "spi", check: bool = False) -> DataFrame:
    """Standardised precipitation index: keys, time, `out`.  `check` raises for too short series and repeated times first."""
    check_scale(scale)
    if check:
        check_series(df, keys, scale, time)
    dense = clip_negative(densify(df, keys, time, (value,), periodicity), keys, value)
    summed = trailing_sum(dense, keys, value, scale)
    return _finish(standardise(summed, keys, value, distribution, calibration, params).withColumnRenamed("z", out), keys, time, [out], periodicity)


def spei(df: DataFrame, keys: list[str], scale: int, distribution: str | Distribution = "gamma", time: str = "time", precip: str = "prcp", pet: str = "pet", periodicity: str | Periodicity = "monthly", calibration: tuple[int, int] | None = None, params: DataFrame | None = None, out: str = "spei", check: bool = False) -> DataFrame:
    """Standardised precipitation minus evapotranspiration index; 1000 is added to each step's difference."""
    check_scale(scale)
    if check:
        check_series(df, keys, scale, time)
    dense = clip_negative(densify(df, keys, time, (precip, pet), periodicity), keys, precip)
    dense = dense.withColumn("_d", F.col(precip) - F.col(pet) + 1000.0)
    summed = trailing_sum(dense, keys, "_d", scale)
    return _finish(standardise(summed, keys, "_d", distribution, calibration, params, fallback=False).withColumnRenamed("z", out), keys, time, [out], periodicity)


def climatology_rank(df: DataFrame, keys: list[str], value: str, inside: Column) -> DataFrame:
    """Adds _rank, one more than the values below a row's among those `inside` of its cell and period, and their number _n.

    Two running counts: those up to the value, less those equal to it.
    """
    v, w = F.when(inside, F.col(value)), by_keys(keys, "period")
    upto = F.count(v).over(w.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumns({"_rank": upto - F.count(v).over(by_keys(keys, "period", value)) + 1, "_n": F.count(v).over(w)})


def eddi(df: DataFrame, keys: list[str], scale: int, time: str = "time", value: str = "value", periodicity: str | Periodicity = "monthly", calibration: tuple[int, int] | None = None, out: str = "eddi", check: bool = False) -> DataFrame:
    """Evaporative demand drought index: the rank among the calibration years of the period, as a normal value.

    A calibration period outside the data is an error with `check`; otherwise its missing years are no part of the ranks.
    """
    check_scale(scale)
    if check:
        check_series(df, keys, scale, time, calibration)
    dense = clip_negative(densify(df, keys, time, (value,), periodicity), keys, value)
    summed = trailing_sum(dense, keys, value, scale)
    summed = climatology_rank(summed, keys, value, F.lit(True) if calibration is None else F.col("year").between(*calibration))
    p = (F.col("_rank") - 0.33) / (F.col("_n") + 0.33)
    z = F.when(F.col(value).isNotNull() & (F.col("_n") >= 2), bounded(hastings(p)))
    return _finish(summed.withColumn(out, z), keys, time, [out], periodicity)


def check_series(df: DataFrame, keys: list[str], scale: int, time: str, calibration: tuple[int, int] | None = None) -> None:
    """What `check=True` asks for: enough steps, no time twice, a calibration period within the data; two small aggregates."""
    check_frame(df, *keys, time)
    require(df, keys, scale, time)
    if calibration is not None:
        check_calibration(df, time, *calibration)


def check_calibration(df: DataFrame, time: str, first: int, last: int) -> None:
    """Raises unless the calibration period lies in the data; runs one small aggregate."""
    low, high = df.agg(F.min(F.year(time)), F.max(F.year(time))).first()
    if low is None or first < low or last > high or first > last:
        raise InvalidArgument(f"calibration {first}-{last} is not within the data {low}-{high}", "calibration", (first, last))


def check_normals(df: DataFrame, keys: list[str], time: str, first: int, last: int) -> None:
    """Raises if the calibration starts before the data, or a cell has fewer steps than it has months; one aggregate."""
    low, steps = df.groupBy(*keys).agg(F.min(F.year(time)).alias("low"), F.count("*").alias("n")).agg(F.min("low"), F.min("n")).first()
    if low is None or first < low:
        raise InvalidArgument(f"calibration starts in {first}, before the data ({low})", "calibration", (first, last), f"from {low} on")
    if (last - first + 1) * 12 > steps:
        raise InvalidArgument(f"calibration {first}-{last} has more months than a cell has steps ({steps})", "calibration", (first, last))


def pnp(df: DataFrame, keys: list[str], scale: int, time: str = "time", value: str = "value", periodicity: str | Periodicity = "monthly", calibration: tuple[int, int] | None = None, mode: str = "ratio", out: str = "pnp", check: bool = False) -> DataFrame:
    """Trailing sum over its mean in the calibration years: 1 is normal (100 with mode="percent").

    `check` raises for too short series, repeated times, and a calibration that starts before the data or is longer than it.
    """
    check_scale(scale)
    if check:
        check_series(df, keys, scale, time)
        if calibration is not None:
            check_normals(df, keys, time, *calibration)
    summed = trailing_sum(densify(df, keys, time, (value,), periodicity), keys, value, scale)
    inside = F.lit(True) if calibration is None else F.col("year").between(*calibration)
    normal = F.avg(F.when(inside, F.col(value))).over(by_keys(keys, "period"))
    summed = summed.withColumn("_n", normal)
    ratio = F.when(F.col("_n") > 0, F.col(value) / F.col("_n")) * (100.0 if mode == "percent" else 1.0)
    return _finish(summed.withColumn(out, ratio), keys, time, [out], periodicity)


def pci(df: DataFrame, keys: list[str], time: str = "time", value: str = "value", mode: str = "reference", out: str = "pci") -> DataFrame:
    """keys, year and the concentration index of each year whose days are all there: 100 * sum of squares over square of sum.

    "calendar" takes the twelve months.  "reference", the default, takes the slices of an established program: January, then
    nothing, then from the end of a January cut short by the length of February (day 29 or 30) up to the end of March.
    """
    rows = df.select(*keys, F.year(time).alias("year"), F.dayofyear(time).alias("day"), F.month(time).alias("month"), F.col(value).alias("v"))
    rows = rows.withColumn("leap", F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))) == 366)
    whole = (F.count(F.when(~F.isnan("v"), F.col("v"))) == F.when(F.first("leap"), 366).otherwise(365)) & (F.count("*") == F.count(F.when(~F.isnan("v"), F.col("v"))))
    if mode == "calendar":
        parts = [F.sum(F.when(F.col("month") == m, F.col("v")).otherwise(0.0)) for m in range(1, 13)]
    elif mode == "reference":
        from_ = F.when(F.col("leap"), 29).otherwise(28)
        parts = [F.sum(F.when(F.col("month") == 1, F.col("v")).otherwise(0.0)), F.sum(F.when((F.col("day") > from_) & (F.col("month") <= 3), F.col("v")).otherwise(0.0))]
        parts += [F.sum(F.when(F.col("month") == m, F.col("v")).otherwise(0.0)) for m in range(4, 13)]
    else:
        raise InvalidArgument(f"unknown mode {mode}", "mode", mode, "reference, calendar")
    sums = rows.groupBy(*keys, "year").agg(whole.alias("whole"), *[p.alias(f"m{k}") for k, p in enumerate(parts)])
    total = sum((F.col(f"m{k}") for k in range(1, len(parts))), F.col("m0"))
    squares = sum((F.col(f"m{k}") * F.col(f"m{k}") for k in range(1, len(parts))), F.col("m0") * F.col("m0"))
    return sums.select(*keys, "year", F.when(F.col("whole"), F.try_divide(squares, total * total) * 100.0).alias(out))
