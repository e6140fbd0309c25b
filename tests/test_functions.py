import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydroframe.errors import InvalidArgument, PeriodicityError
from hydroframe.functions import calendar, expr, special


def values(spark, columns, *rows):
    df = spark.range(1)
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


@given(st.floats(0.05, 400), st.floats(0, 900))
@settings(max_examples=200, deadline=None)
def test_incomplete_gamma_is_a_share(a, x):
    low, top = special.np_gammainc(np.array([a]), np.array([x]))[0], special.np_gammainc(np.array([a]), np.array([x]), upper=True)[0]
    assert 0 <= low <= 1 and low + top == pytest.approx(1)


@given(st.integers(1, 40), st.floats(0.001, 120))
@settings(max_examples=200, deadline=None)
def test_incomplete_gamma_of_whole_shapes(n, x):
    """With a whole shape it is a Poisson tail."""
    want = 1 - sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(n))
    assert special.np_gammainc(np.array([float(n)]), np.array([x]))[0] == pytest.approx(want, abs=1e-12)


def test_incomplete_gamma_edges():
    a, x = np.array([0.5, 2.0, -1.0, np.nan, 2.0, 2.0]), np.array([1.0, 0.0, 1.0, 1.0, np.inf, np.nan])
    got = special.np_gammainc(a, x)
    assert got[0] == pytest.approx(math.erf(1.0)) and got[1] == 0 and got[4] == 1 and np.isnan(got[[2, 3, 5]]).all()
    assert np.allclose(special.np_lgamma(np.array([0.3, 1.0, 7.7, 300.0])), [math.lgamma(v) for v in (0.3, 1.0, 7.7, 300.0)])


@pytest.mark.parametrize("skew", [-1.2, -0.4, 0.0, 1e-7, 0.4, 1.2])
def test_pearson_cdf(skew):
    """Against a numerical integral of the density, and for skew 0 the normal distribution."""
    x = np.linspace(-1.5, 1.5, 7) * 2 + 5
    got = special.np_pearson3_cdf(x, np.full(7, 5.0), np.full(7, 2.0), np.full(7, skew))
    if abs(skew) < 1e-5:
        assert np.allclose(got, [NormalDist(5, 2).cdf(v) for v in x])
        return
    shape, rng = 4 / skew**2, np.random.default_rng(0)
    sample = 5 + 2 * np.sign(skew) * (rng.gamma(shape, 1, 400_000) - shape) / math.sqrt(shape)
    assert np.allclose(got, [(sample <= v).mean() for v in x], atol=3e-3)
    assert np.isnan(special.np_pearson3_cdf(x, x, np.zeros(7), np.zeros(7))).all()


def test_normal_quantiles(spark):
    ps = [1e-12, 1e-5, 0.0005, 0.02, 0.1, 0.4, 0.5, 0.6, 0.93, 0.9995, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(expr.norm_ppf(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-9)
    near = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(expr.hastings(F.col("p"))).collect()]
    assert np.allclose(near, [NormalDist().inv_cdf(min(max(p, 1e-10), 1 - 1e-10)) for p in ps], atol=4.6e-4)
    row = values(spark, [expr.norm_ppf(F.lit(0.0)), expr.norm_ppf(F.lit(1.0)), expr.norm_ppf(F.lit(None).cast("double")), expr.bounded(expr.norm_ppf(F.lit(0.0))), expr.bounded(F.lit(float("nan"))), expr.bounded(F.lit(None).cast("double"))])
    assert row[0] == -math.inf and row[1] == math.inf and row[2] is None and row[3] == -3.09 and row[4] is None and row[5] is None


def test_fao_worked_examples(spark):
    """Published examples of FAO-56: equations 7, 8, 11, 12, 13, 17 and the daily example of equation 6."""
    t, c = lit, expr
    row = values(spark, [
        c.atmospheric_pressure(*t(1800)), c.psychrometric_constant(*t(81.8)), c.saturation_vp(*t(24.5)), c.saturation_vp(*t(15)), c.mean_saturation_vp(*t(15, 24.5)),
        c.vp_from_rh_range(*t(18, 25, 54, 82)), c.vp_from_dewpoint(*t(17)), c.vp_slope(*t(16.9)),
        c.penman_monteith(*t(13.28, 0, 16.9, 2.078, 1.997, 1.409, 0.122, 0.0666)), c.latent_heat(*t(20)),
        c.extraterrestrial_radiation(F.lit(246), F.radians(F.lit(-20.0))), c.daylight_hours(c.sunset_angle(F.radians(F.lit(-20.0)), c.solar_declination(F.lit(246)))),
    ])
    want = [81.8, 0.054, 3.075, 1.705, 2.39, 1.70, 1.938, 0.122, 3.88, 2.454, 32.2, 11.67]
    assert np.allclose([float(v) for v in row], want, atol=0.06)
    poles = values(spark, [c.daylight_hours(c.sunset_angle(F.radians(F.lit(89.0)), c.solar_declination(F.lit(d)))) for d in (172, 355)])
    assert [round(v, 6) for v in poles] == [24.0, 0.0]


def test_units(spark):
    row = values(spark, [expr.in_units(F.lit(2.0), "inch"), expr.in_units(F.lit(212.0), "F"), expr.in_units(F.lit(0.0), "kelvin"), expr.missing_as_null(F.lit(float("nan")))])
    assert [row[0], round(row[1], 6), row[2], row[3]] == [50.8, 100.0, -273.15, None]
    with pytest.raises(InvalidArgument):
        expr.in_units(F.lit(1.0), "furlong")


def test_calendar(spark):
    days = spark.sql("select explode(sequence(date '1999-01-01', date '2001-12-31')) as d")
    period = calendar.period_of(F.col("d"), calendar.Periodicity.daily)
    got = {str(r[0]): (r[1], r[2]) for r in days.select("d", period, calendar.date_of(F.year("d"), period, calendar.Periodicity.daily)).collect()}
    assert got["1999-02-28"][0] == 59 and got["1999-03-01"][0] == 61 and got["2000-02-29"][0] == 60 and got["1999-12-31"][0] == got["2000-12-31"][0] == 366
    assert all(str(back) == day for day, (_, back) in got.items())
    assert calendar.Periodicity.of("DAILY").steps == 366
    with pytest.raises(PeriodicityError):
        calendar.Periodicity.of("weekly")


def test_pearson_parameters(spark):
    """L-moments of known distributions: exponential (skew 2) and symmetric (skew 0); impossible ones have none."""
    row = values(spark, [x for t in ((1.0, 0.5, 1 / 3), (0.0, 0.5, 0.0), (0.0, -1.0, 0.1), (0.0, 1.0, 1.0)) for x in expr.pearson_from_lmoments(*lit(*t))])
    assert row[1] == pytest.approx(1.0, abs=2e-3) and row[2] == pytest.approx(2.0, abs=5e-3)
    assert row[4] == pytest.approx(0.5 * math.sqrt(math.pi)) and row[5] == 0.0
    assert list(row[6:]) == [None] * 6
