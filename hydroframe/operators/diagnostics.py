"""Questions about the data behind an index, as queries of their own: no index runs them by itself."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe import errors
from hydroframe.functions.special import gamma_cdf, pearson3_cdf
from hydroframe.operators.fitting import failed_share, gamma_fit, pearson_fit
from hydroframe.operators.series import by_keys, dropped


def calibration_quality(dense: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, n_years, n_present, missing_share, is_short (under 30 years), has_gaps (over 20 % missing)."""
    rows = dense if calibration is None else dense.where(F.col("year").between(*calibration))
    out = rows.groupBy(*keys).agg(F.countDistinct("year").alias("n_years"), F.count(value).alias("n_present"), F.avg(F.col(value).isNull().cast("int")).alias("missing_share"))
    return out.withColumns({"is_short": F.col("n_years") < 30, "has_gaps": F.col("missing_share") > 0.2})


def effective_years(dense: DataFrame, keys: list[str], value: str = "value", per_year: int = 12) -> DataFrame:
    """keys, years of present values, and whether 30 are reached (asked only of cells with missing values)."""
    out = dense.where("not pad").groupBy(*keys).agg((F.count(value) / per_year).alias("years"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"))
    return out.withColumn("enough", (F.col("n_missing") == 0) | (F.col("years") >= 30))


def missing_kept(before: DataFrame, after: DataFrame, on: list[str], value: str, index: str) -> DataFrame:
    """Cells and times whose input is missing but whose index is not; empty if missing values propagate."""
    return before.where(F.col(value).isNull()).join(after.where(F.col(index).isNotNull()), on, "left_semi")


def goodness_of_fit(dense: DataFrame, keys: list[str], value: str = "value", distribution: str = "gamma", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, period, n, statistic, critical (5 %), poor: Kolmogorov-Smirnov distance of the fit from its own data."""
    fit = gamma_fit(dense, keys, value, calibration) if distribution == "gamma" else pearson_fit(dense, keys, value, calibration)
    rows = dense if calibration is None else dense.where(F.col("year").between(*calibration))
    rows = rows.where(F.col(value) > 0).select(*keys, "period", F.col(value).alias("_v")).join(fit, [*keys, "period"])
    v, w = F.col("_v"), by_keys(keys, "period")
    cdf = gamma_cdf(v, F.col("alpha"), F.col("beta")) if distribution == "gamma" else pearson3_cdf(v, F.col("loc"), F.col("scale"), F.col("skew"))
    rows = rows.withColumn("_f", cdf).withColumns({"_i": F.row_number().over(w.orderBy("_v")), "_n": F.count("*").over(w)})
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n"))
    out = rows.groupBy(*keys, "period").agg(F.count("*").cast("int").alias("n"), F.max(gap).alias("statistic"))
    out = out.withColumn("critical", 1.358 / F.sqrt("n"))
    return out.withColumn("poor", F.coalesce(F.col("statistic") > F.col("critical"), F.lit(False)))


def warn_of_fits(params: DataFrame, keys: list[str]) -> None:
    """Warns where over 80 % of a cell's periods have no Pearson fit; runs one aggregate."""
    poor, n = failed_share(params, keys).agg(F.count_if(F.col("share") > 0.8), F.count("*")).first()
    if poor:
        warnings.warn(f"{poor} of {n} cells have no Pearson fit in over 80 % of their periods", errors.PoorFitWarning, stacklevel=2)


def warn_of_alignment(a: DataFrame, b: DataFrame, keys: list[str], time: str = "time") -> None:
    """Warns of rows without a partner, and raises if no row has one; runs two anti-joins and, at need, a count."""
    left, right = dropped(a, b, keys, time).first()
    if left and a.count() == left:
        raise errors.CoordinateError("the two series have no cell and time in common")
    if left or right:
        warnings.warn(f"{left} rows of the first and {right} of the second series have no partner", errors.AlignmentWarning, stacklevel=2)


def require_effective_years(dense: DataFrame, keys: list[str], value: str = "value", per_year: int = 12) -> None:
    """Raises where a cell with missing values has under 30 years of present ones; runs one aggregate."""
    short, n = effective_years(dense, keys, value, per_year).agg(F.count_if(~F.col("enough")), F.count("*")).first()
    if short:
        raise errors.NotEnoughData(f"{short} of {n} cells have under 30 years of values", short, 30)


def warn(quality: DataFrame) -> None:
    """Turns calibration_quality into at most two warnings; runs one aggregate."""
    short, gaps, n = quality.agg(F.count_if("is_short"), F.count_if("has_gaps"), F.count("*")).first()
    if short:
        warnings.warn(f"{short} of {n} cells have under 30 years of calibration", errors.ShortCalibrationWarning, stacklevel=2)
    if gaps:
        warnings.warn(f"{gaps} of {n} cells miss over 20 % of their calibration", errors.MissingDataWarning, stacklevel=2)
