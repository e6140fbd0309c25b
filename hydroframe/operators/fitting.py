"""Fitted distributions by cell and period, as tables that can be kept and joined to new data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.expr import lgamma, pearson_bound, pearson_from_lmoments, pearson_shape, with_norm_ppf
from hydroframe.functions.special import gamma_cdf, pearson3_cdf
from hydroframe.operators.series import by_keys, calibration_years


def _mark(df: DataFrame, keys: list[str], calibration: tuple[int, int] | None) -> DataFrame:
    return df.withColumn("_calib", F.lit(True) if calibration is None else calibration_years(df, keys, *calibration))


def thom(mean: Column, mean_log: Column) -> tuple[Column, Column]:
    """Gamma shape and scale from the mean and the mean logarithm (Thom 1958); null where they don't differ."""
    a = F.log(mean) - mean_log
    shape = F.when(a > 0, (F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(4.0) * a / 3.0)) / (F.lit(4.0) * a))
    return shape, F.try_divide(mean, shape)


def gamma_fit(df: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, period, alpha, beta, prob_zero_gamma from a dense series; zeros are no part of the fit.

    The chance of zero is that of the whole record, padding and missing years counted; 1 becomes 0.
    """
    rows = _mark(df, keys, calibration)
    wet = F.when(F.col("_calib") & (F.col(value) > 0), F.col(value))
    sums = rows.groupBy(*keys, "period").agg(F.avg(wet).alias("m"), F.avg(F.log(wet)).alias("ml"), (F.count_if(F.col(value) == 0) / F.count("*")).alias("p0"))
    alpha, beta = thom(F.col("m"), F.col("ml"))
    return sums.select(*keys, "period", alpha.alias("alpha"), beta.alias("beta"), F.when(F.col("p0") < 1, F.col("p0")).otherwise(0.0).alias("prob_zero_gamma"))


def _rank_sums(v: Column, r: Column) -> dict[str, Column]:
    """What sample L-moments need of values and their ranks (from 0), as aggregates or windows."""
    return {"_n": F.count(v), "_nz": F.count_if(v == 0), "_s0": F.sum(v), "_s1": F.sum(v * r), "_s2": F.sum(v * r * (r - 1))}


def _with_lmoments(df: DataFrame) -> DataFrame:
    """Adds _l1, _l2, _t3 from the sums of _rank_sums."""
    n = F.col("_n").cast("double")
    b0, b1, b2 = F.try_divide(F.col("_s0"), n), F.try_divide(F.col("_s1"), n * (n - 1)), F.try_divide(F.col("_s2"), n * (n - 1) * (n - 2))
    l2 = 2 * b1 - b0
    return df.withColumns({"_l1": b0, "_l2": l2, "_t3": F.try_divide(6 * b2 - 6 * b1 + b0, l2)})


def _with_pearson(df: DataFrame) -> DataFrame:
    """Adds prob_zero, loc, scale, skew from the L-moments; all 0 with fewer than four values besides zeros, or no fit."""
    m = df.withColumn("_shape", pearson_shape(F.col("_t3")))
    m = m.withColumn("_log", lgamma(F.col("_shape")) - lgamma(F.col("_shape") + 0.5))
    loc, scale, skew = pearson_from_lmoments(F.col("_l1"), F.col("_l2"), F.col("_t3"), F.col("_shape"), F.col("_log"))
    m = m.withColumns({"_loc": loc, "_scale": scale, "_skew": skew})
    enough = (F.col("_n") - F.col("_nz") >= 4) & F.col("_scale").isNotNull() & F.col("_skew").isNotNull()
    or_zero = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    return m.withColumns({"prob_zero": or_zero(F.try_divide(F.col("_nz"), F.col("_n"))), "loc": or_zero(F.col("_loc")), "scale": or_zero(F.col("_scale")), "skew": or_zero(F.col("_skew"))})


def lmoments(df: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, period, n, n_zero, l1, l2, t3: sample L-moments of the calibration years, by ranks and sums."""
    m = _with_lmoments(_rank_table(df, keys, value, calibration))
    return m.select(*keys, "period", F.col("_n").alias("n"), F.col("_nz").alias("n_zero"), F.col("_l1").alias("l1"), F.col("_l2").alias("l2"), F.col("_t3").alias("t3"))


def _rank_table(df: DataFrame, keys: list[str], value: str, calibration: tuple[int, int] | None) -> DataFrame:
    rows = _mark(df, keys, calibration).where(F.col("_calib"))
    rank = F.row_number().over(by_keys(keys, "period").orderBy(F.col(value).asc_nulls_last()))
    sums = _rank_sums(F.col(value), F.col("_r"))
    return rows.withColumn("_r", (rank - 1).cast("double")).groupBy(*keys, "period").agg(*[c.alias(name) for name, c in sums.items()])


def pearson_fit(df: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, period, prob_zero, loc, scale, skew; all 0 for a period with fewer than four values besides zeros, or no fit."""
    return _with_pearson(_with_lmoments(_rank_table(df, keys, value, calibration))).select(*keys, "period", "prob_zero", "loc", "scale", "skew")


def with_pearson_fit(df: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """Adds the columns of pearson_fit to each row, by windows that share the exchange of the trailing sum."""
    w, own = by_keys(keys, "period"), df.columns
    rows = _mark(df, keys, calibration).withColumn("_v", F.when(F.col("_calib"), F.col(value)))
    rows = rows.withColumn("_r", (F.row_number().over(w.orderBy(F.col("_v").asc_nulls_last())) - 1).cast("double"))
    rows = rows.withColumns({name: c.over(w) for name, c in _rank_sums(F.col("_v"), F.col("_r")).items()})
    return _with_pearson(_with_lmoments(rows)).select(*own, "prob_zero", "loc", "scale", "skew")


def failed_share(params: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failed, periods, share: how many periods of each cell have no Pearson fit; a diagnostic query."""
    out = params.groupBy(*keys).agg(F.count_if((F.col("scale") == 0) & (F.col("skew") == 0)).alias("failed"), F.count("*").alias("periods"))
    return out.withColumn("share", F.col("failed") / F.col("periods"))


def with_gamma_z(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the standard normal value under the fit in alpha, beta and prob_zero_gamma, clipped to the index's bounds."""
    df = df.withColumn("_f", gamma_cdf(F.col(value), F.col("alpha"), F.col("beta")))
    share = F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col("_f"))
    p0 = F.col("prob_zero_gamma")
    return with_norm_ppf(df, F.when(share.isNotNull(), F.least(p0 + (F.lit(1.0) - p0) * share, F.lit(1.0))), out).drop("_f")


def with_pearson_z(df: DataFrame, value: str, out: str) -> DataFrame:
    """As with_gamma_z, from prob_zero, loc, scale, skew.

    Values outside the distribution's range and traces below 0.0005 get fixed shares.
    """
    v, p0, scale, skew = F.col(value), F.col("prob_zero"), F.col("scale"), F.col("skew")
    df = df.withColumn("_f", pearson3_cdf(v, F.col("loc"), scale, skew)).withColumn("_bound", pearson_bound(F.col("loc"), scale, skew))
    share = (
        F.when((v >= F.col("_bound")) & (skew < 0), F.lit(0.9995))
        .when((v <= F.col("_bound")) & (skew > 0), F.lit(0.0005))
        .when((v < 0.0005) & (p0 <= 0), F.lit(0.0005))
        .when((v < 0.0005) & (p0 > 0), F.lit(0.0))
        .otherwise(F.when(scale > 0, F.col("_f")))
    )
    df = df.withColumn("_f", F.when(v.isNotNull(), share))
    p = F.when(F.col("_f").isNotNull(), F.least(F.greatest(p0 + (F.lit(1.0) - p0) * F.col("_f"), F.lit(0.0)), F.lit(1.0)))
    return with_norm_ppf(df, p, out).drop("_f", "_bound")


def zero_share(df: DataFrame, keys: list[str], value: str = "value", calibration: tuple[int, int] | None = None) -> DataFrame:
    """keys, period and the share of zeros among the values of the calibration years; null where there is no zero."""
    rows = _mark(df, keys, calibration).where(F.col("_calib"))
    n = F.count_if(F.col(value) == 0)
    return rows.groupBy(*keys, "period").agg(F.when(n > 0, n / F.count(value)).alias("prob_zero"))
