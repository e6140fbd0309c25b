"""Scalar functions as column expressions: normal quantiles, L-moment fits, solar geometry, FAO-56 physics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of every standardised index.
LOW, HIGH = -3.09, 3.09

# Wichura's AS 241 (PPND16), numerator and denominator of the three ranges, lowest power first.
CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
MIDDLE = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])
# Abramowitz and Stegun 26.2.23.
HASTINGS = ([2.515517, 0.802853, 0.010328], [1.0, 1.432788, 0.189269, 0.001308])
# Hosking's rational fits of the Pearson type III shape to L-skewness.
PEARSON_NEAR = (0.2906, 0.1882, 0.0442)
PEARSON_FAR = (0.36067, -0.59567, 0.25361, -2.78861, 2.56096, -0.77045)
# Lanczos' approximation of the gamma function, g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
    return poly(x, parts[0]) / poly(x, parts[1])


def norm_ppf(p: Column, tail: Column | None = None) -> Column:
    """Quantile of the standard normal; -inf and +inf at 0 and 1, null outside.  `tail` is tail_of(p), if at hand."""
    q = p - F.lit(0.5)
    tail = tail_of(p) if tail is None else tail
    size = F.when(tail <= 5.0, _ratio(tail - 1.6, MIDDLE)).otherwise(_ratio(tail - 5.0, FAR))
    return (
        F.when(p == 0.0, F.lit(float("-inf")))
        .when(p == 1.0, F.lit(float("inf")))
        .when((p > 0.0) & (p < 1.0), F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, CENTRE)).otherwise(F.signum(q) * size))
    )


def tail_of(p: Column) -> Column:
    return F.sqrt(-F.log(F.when(p < 0.5, p).otherwise(F.lit(1.0) - p)))


def with_norm_ppf(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Adds the bounded quantile of p.  Steps are columns of their own, since an expression is repeated wherever it is named."""
    df = df.withColumn("_p", p).withColumn("_tail", tail_of(F.col("_p")))
    return df.withColumn(out, bounded(norm_ppf(F.col("_p"), F.col("_tail")))).drop("_p", "_tail")


def hastings(p: Column) -> Column:
    """Approximate normal quantile, good to 4.5e-4; probabilities are clipped to 1e-10 from either end."""
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0 - 1e-10)))
    t = F.sqrt(F.lit(-2.0) * F.log(F.when(p <= 0.5, p).otherwise(F.lit(1.0) - p)))
    return F.when(p <= 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) * (t - _ratio(t, HASTINGS))


def bounded(z: Column) -> Column:
    """Clips an index to its bounds; missing stays missing."""
    return F.when(z.isNotNull() & ~F.isnan(z), F.least(F.greatest(z, F.lit(LOW)), F.lit(HIGH)))


def missing_as_null(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive x."""
    y = x - F.lit(1.0)
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + F.lit(float(k)))
    t = y + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(total)


def pearson_shape(t3: Column) -> Column:
    """Shape of the gamma distribution behind a Pearson type III one with this L-skewness."""
    size = F.abs(t3)
    c1, c2, c3 = PEARSON_NEAR
    d1, d2, d3, d4, d5, d6 = PEARSON_FAR
    near, far = F.lit(3 * math.pi) * size * size, F.lit(1.0) - size
    close = F.try_divide(F.lit(1.0) + c1 * near, near * poly(near, [1.0, c2, c3]))
    return F.when(size < 0.333333333, close).otherwise(far * poly(far, [d1, d2, d3]) / poly(far, [1.0, d4, d5, d6]))


def pearson_from_lmoments(l1: Column, l2: Column, t3: Column, shape: Column | None = None, log_ratio: Column | None = None) -> tuple[Column, Column, Column]:
    """loc, scale, skew; null where no distribution has these L-moments (l2 <= 0 or |t3| >= 1).

    `shape` and `log_ratio` are pearson_shape(t3) and lgamma(shape) - lgamma(shape + 0.5) where these are columns already.
    """
    size = F.abs(t3)
    shape = pearson_shape(t3) if shape is None else shape
    log_ratio = lgamma(shape) - lgamma(shape + 0.5) if log_ratio is None else log_ratio
    flat, valid = size <= 1e-6, (l2 > 0) & (size < 1)
    root = F.sqrt(shape)
    scale = F.when(flat, l2 * math.sqrt(math.pi)).otherwise(F.lit(math.sqrt(math.pi)) * l2 * F.exp(log_ratio) * root)
    skew = F.when(flat, F.lit(0.0)).otherwise(F.signum(t3) * F.try_divide(F.lit(2.0), root))
    return F.when(valid, l1), F.when(valid, scale), F.when(valid, skew)


def pearson_bound(loc: Column, scale: Column, skew: Column) -> Column:
    """The end of the distribution's range: the lower one for positive skew, the upper one for negative."""
    return loc - F.try_divide(F.lit(2.0) * scale, skew)


# Sun -------------------------------------------------------------------------------------------------------------


def solar_declination(day: Column) -> Column:
    return F.lit(0.409) * F.sin(F.lit(2 * math.pi / 365) * day - F.lit(1.39))


def sunset_angle(latitude: Column, declination: Column) -> Column:
    """Radians, for a latitude in radians; 0 and pi in polar night and day."""
    return F.acos(F.least(F.greatest(-F.tan(latitude) * F.tan(declination), F.lit(-1.0)), F.lit(1.0)))


def daylight_hours(angle: Column) -> Column:
    return F.lit(24.0 / math.pi) * angle


def extraterrestrial_radiation(day: Column, latitude: Column) -> Column:
    """MJ per square metre and day (FAO-56 equation 21), latitude in radians."""
    dec = solar_declination(day)
    angle = sunset_angle(latitude, dec)
    near = F.lit(1.0) + F.lit(0.033) * F.cos(F.lit(2 * math.pi / 365) * day)
    return F.lit(24.0 * 60.0 / math.pi * 0.0820) * near * (angle * F.sin(latitude) * F.sin(dec) + F.cos(latitude) * F.cos(dec) * F.sin(angle))


def hargreaves(tmin: Column, tmax: Column, tmean: Column, radiation: Column) -> Column:
    """mm per day; null where tmin exceeds tmax."""
    return F.lit(0.0023) * (tmean + 17.8) * F.when(tmax >= tmin, F.sqrt(tmax - tmin)) * 0.408 * radiation


# FAO-56 ----------------------------------------------------------------------------------------------------------


def atmospheric_pressure(elevation: Column) -> Column:
    return F.lit(101.3) * F.pow((F.lit(293.0) - 0.0065 * elevation) / 293.0, F.lit(5.26))


def latent_heat(t: Column) -> Column:
    return F.lit(2.501) - 0.002361 * t


def psychrometric_constant(pressure: Column) -> Column:
    return F.lit(0.665e-3) * pressure


def saturation_vp(t: Column) -> Column:
    return F.lit(0.6108) * F.exp(17.27 * t / (t + 237.3))


def vp_slope(t: Column) -> Column:
    return F.lit(4098.0) * saturation_vp(t) / F.pow(t + 237.3, F.lit(2.0))


def mean_saturation_vp(tmin: Column, tmax: Column) -> Column:
    return (saturation_vp(tmin) + saturation_vp(tmax)) / 2.0


def vp_from_dewpoint(tdew: Column) -> Column:
    return saturation_vp(tdew)


def vp_from_rh_range(tmin: Column, tmax: Column, rh_min: Column, rh_max: Column) -> Column:
    return (saturation_vp(tmin) * rh_max / 100.0 + saturation_vp(tmax) * rh_min / 100.0) / 2.0


def vp_from_rh_max(tmin: Column, rh_max: Column) -> Column:
    return saturation_vp(tmin) * rh_max / 100.0


def vp_from_rh_mean(tmin: Column, tmax: Column, rh_mean: Column) -> Column:
    return mean_saturation_vp(tmin, tmax) * rh_mean / 100.0


def vp_from_tmin(tmin: Column) -> Column:
    """Arid places: the dewpoint is taken two degrees below the minimum."""
    return saturation_vp(tmin - 2.0)


def penman_monteith(rn: Column, g: Column, t: Column, u2: Column, es: Column, ea: Column, slope: Column, gamma: Column) -> Column:
    """Reference evapotranspiration, mm per day (equation 6)."""
    return (0.408 * slope * (rn - g) + gamma * (F.lit(900.0) / (t + 273.0)) * u2 * (es - ea)) / (slope + gamma * (F.lit(1.0) + 0.34 * u2))


# Small things ----------------------------------------------------------------------------------------------------


def rmse(predicted: Column, true: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - true, F.lit(2.0))))


def sign_change(a: Column, b: Column) -> Column:
    return F.signum(a) != F.signum(b)


def days_since(epoch: str, start: Column, months: Column) -> Column:
    """Days from `epoch` to the start moved on by whole months."""
    return F.datediff(F.add_months(start, months), F.to_date(F.lit(epoch)))


def kth_smallest(values: Column, k: Column) -> Column:
    return F.get(F.sort_array(F.filter(values, lambda v: v.isNotNull())), k - 1)


def truncated_percentile(values: Column, fraction: float) -> Column:
    """The k-th smallest of the values present, k the whole part of fraction times their number; null for k = 0."""
    present = F.filter(values, lambda v: v.isNotNull())
    k = F.floor(F.lit(fraction) * F.size(present)).cast("int")
    return F.when(k >= 1, F.get(F.sort_array(present), k - 1))


UNITS = {
    "mm": lambda v: v, "millimeter": lambda v: v, "inch": lambda v: v * 25.4, "inches": lambda v: v * 25.4,
    "celsius": lambda v: v, "c": lambda v: v, "fahrenheit": lambda v: (v - 32.0) * (5.0 / 9.0), "f": lambda v: (v - 32.0) * (5.0 / 9.0),
    "kelvin": lambda v: v - 273.15, "k": lambda v: v - 273.15,
}


def in_units(v: Column, unit: str) -> Column:
    """Millimetres or degrees Celsius."""
    from hydroframe.errors import InvalidArgument

    if unit.lower() not in UNITS:
        raise InvalidArgument(f"unknown unit {unit}", "unit", unit, ", ".join(UNITS))
    return UNITS[unit.lower()](v)
