import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydroframe.errors import InvalidArgument
from hydroframe.operators import calibration, palmer

K = ["cell"]
D = palmer.default_factors()


@pytest.fixture(scope="module")
def climate():
    rng = np.random.default_rng(7)
    season = 2 + 2 * np.sin(np.arange(12 * 60) / 12 * 2 * np.pi)
    wet = np.repeat(rng.choice([0.4, 1.0, 1.8], 60), 12)
    return rng.gamma(2, 1.2, 720) * wet, season + 0.3


def test_balance_keeps_water(climate):
    """What falls is used, runs off or is stored, and stores stay within their size."""
    p, e = climate
    for awc in (0.6, 1.0, 6.0):
        f = palmer.balance(p, e, awc)
        stored = np.concatenate((f["sp"], [np.nan]))[1:] - f["sp"]
        assert np.allclose((p - f["et"] - f["ro"] - stored)[:-1], 0, atol=1e-9)
        assert (f["sp"] >= -1e-12).all() and (f["sp"] <= max(awc, 1.0) + 1e-12).all()
        assert all((f[k] >= -1e-12).all() for k in palmer.FLOWS)


def test_missing_month_empties_the_soil():
    p, e = np.full(24, 3.0), np.full(24, 2.0)
    p[5] = np.nan
    assert palmer.balance(p, e, 5.0)["sp"][6] == 0.0


def test_every_month_gets_a_value(climate):
    p, e = climate
    f = palmer.balance(p, e, 6.0)
    years = slice(10, 50)
    c = palmer.coefficients(f, e, years)
    z = palmer.z_index(p, e, f, c, years)
    s = palmer.Spells(z, D, D)
    assert not np.isnan(s.pdsi).any() and np.abs(s.pdsi).max() < 15
    assert (np.sign(s.phdi) == np.sign(s.pdsi))[s.x3 != 0].mean() > 0.8
    dep = np.abs(z.reshape(-1, 12))[years]
    assert dep.mean(axis=0).sum() == pytest.approx(17.67, rel=1e-6)  # the weights' own normalisation


def test_established_drought_decays():
    """With Z at zero a spell shrinks by the carry-over each month and keeps its sign until it may end."""
    z = np.concatenate((np.full(6, -6.0), np.zeros(6)))
    s = palmer.Spells(z, D, D)
    c = palmer.carry(*D)
    assert s.pdsi[0] == pytest.approx(-2.0) and (s.pdsi[:6] < -1.9).all()
    assert s.x3[6] == pytest.approx(c * s.x3[5])
    assert s.pdsi[5] < s.pdsi[4] < s.pdsi[3]


@given(st.lists(st.floats(-12, 12), min_size=24, max_size=240))
@settings(max_examples=60, deadline=None)
def test_spells_are_symmetric(z):
    """The mirror image of a series has the mirror image of its index, but for ties."""
    z = np.round(np.array(z[: len(z) // 12 * 12]), 3) + 0.00037
    a, b = palmer.Spells(z, D, D), palmer.Spells(-z, D, D)
    assert np.allclose(a.x3, -b.x3) and np.allclose(a.chance, b.chance)


def test_long_undecided_run():
    """More months than forty may wait for a decision."""
    z = np.concatenate((np.full(8, -5.0), np.tile([0.9, -0.55], 60), np.full(4, 6.0)))
    s = palmer.Spells(z, D, D)
    assert s.pdsi.shape == (132,) and not np.isnan(s.pdsi).any()


def frame(spark, climate, cells=(1, 2)):
    p, e = climate
    rows = [(c, dt.date(1950 + k // 12, k % 12 + 1, 1), float(p[k]) * c, float(e[k]), 3.0 * c) for c in cells for k in range(p.size - 5)]
    return spark.createDataFrame(rows, "cell int, time date, prcp double, pet double, awc double")


def test_frames(spark, climate):
    df = frame(spark, climate)
    out = palmer.palmer(df, K, (1960, 1990))
    assert out.count() == df.count() and out.columns == ["cell", "time", "pdsi", "phdi", "pmdi", "z"]
    # A partial last year lies outside the calibration, so nothing but itself is touched.
    assert out.where("z is null").count() == 0
    flows = palmer.water_balance(df, K)
    again = palmer.palmer(df, K, (1960, 1990), given=palmer.cafec(flows, K, (1960, 1990)))
    a, b = (np.array([list(r)[2:] for r in x.orderBy("cell", "time").collect()], dtype=float) for x in (out, again))
    assert np.allclose(a, b)
    mm = df.selectExpr("cell", "time", "prcp * 25.4 as prcp", "pet * 25.4 as pet", "awc")
    c = np.array([list(r)[2:] for r in palmer.palmer(mm, K, (1960, 1990), units="mm").orderBy("cell", "time").collect()], dtype=float)
    assert np.allclose(a, c, atol=1e-6)
    gone = palmer.palmer(df.selectExpr("cell", "time", "cast(null as double) as prcp", "pet", "awc"), K, (1960, 1990))
    assert gone.where("pdsi is not null or z is not null").count() == 0
    with pytest.raises(InvalidArgument):
        palmer.water_balance(df, K, units="cubits")


def plain_extreme(z, n, sign):
    sums = [sum(z[i : i + n]) for i in range(len(z) - n + 1)]
    if sign < 0:
        return min(sums)
    top = sorted(sums)[int(0.98 * len(sums)) - 1] if int(0.98 * len(sums)) else None
    return max((s for s in sums if s > 0 and (top is None or (top and s / top < 1.25))), default=0.0)


def plain_factors(z, sign):
    x, y = np.array(calibration.LENGTHS, dtype=float), np.array([plain_extreme(z, n, sign) for n in calibration.LENGTHS])
    n = next((n for n in range(10, 4, -1) if sign * np.corrcoef(x[:n], y[:n])[0, 1] >= 0.85), 4)
    slope = np.polyfit(x[:n], y[:n], 1)[0]
    rest = sign * (y[:n] - slope * x[:n])
    return slope / (4 * sign), (sign * rest.max() if rest.max() > 0 else -slope * x[0]) / (4 * sign)


def test_duration_factors(spark):
    rng = np.random.default_rng(0)
    cells = {1: rng.normal(0, 2, 480), 2: rng.normal(0, 2, 30), 3: rng.normal(0, 2, 200).cumsum() / 5, 4: rng.normal(3, 1, 90), 5: np.zeros(90)}
    rows = [(c, dt.date(1950 + k // 12, k % 12 + 1, 1), float(v) if k != 7 else None) for c, z in cells.items() for k, v in enumerate(z)]
    df = spark.createDataFrame(rows, "cell int, time date, z double")
    got = {r["cell"]: r for r in calibration.duration_factors(df, K).collect()}
    assert list(got[2])[1:] == list(got[5])[1:] == [None] * 4
    for c in (1, 3, 4):
        z = [float(v) for k, v in enumerate(cells[c]) if k != 7]
        assert list(got[c])[1:] == pytest.approx([*plain_factors(z, 1), *plain_factors(z, -1)])
    sums = {(r["cell"], r["length"]): (r["wet"], r["dry"]) for r in calibration.extreme_sums(df, K, (2, 12)).collect()}
    z = [float(v) for k, v in enumerate(cells[3]) if k != 7]
    assert sums[3, 12] == pytest.approx((plain_extreme(z, 12, 1), plain_extreme(z, 12, -1))) and sums[5, 2] == (0.0, 0.0)
    assert calibration.duration_factors(df.where("cell = 1").drop("cell"), []).first()["wet_m"] == pytest.approx(got[1]["wet_m"])
    for bad in (0, 1.5, True):
        with pytest.raises(InvalidArgument):
            calibration.extreme_sums(df, K, (bad,))


def test_factors_of_each_cell(spark, climate):
    """A cell's own duration factors change its series only; unusable ones leave the default."""
    df = frame(spark, climate, (1, 2, 3))
    fits = spark.createDataFrame([(1, 0.2, 2.0, 0.4, 2.5), (3, 0.1, -0.4, None, 1.0)], "cell int, wet_m double, wet_b double, dry_m double, dry_b double")
    own = {c: [tuple(r)[2:] for r in palmer.palmer(df, K, (1960, 1990), factors=fits).where(f"cell = {c}").orderBy("time").collect()] for c in (1, 2, 3)}
    plain = {c: [tuple(r)[2:] for r in palmer.palmer(df, K, (1960, 1990)).where(f"cell = {c}").orderBy("time").collect()] for c in (1, 2, 3)}
    given = [tuple(r)[2:] for r in palmer.palmer(df, K, (1960, 1990), wet=(0.2, 2.0), dry=(0.4, 2.5)).where("cell = 1").orderBy("time").collect()]
    assert own[1] == given != plain[1] and own[2] == plain[2] and own[3] == plain[3]


def test_sum_at_the_freak_bound(spark):
    """5.35 is 1.25 of 4.28, and no less of it, though its binary quotient is."""
    assert 5.35 / 4.28 < 1.25
    rows = [(c, dt.date(1990, 1, 1) + dt.timedelta(k), z) for c, top in ((1, 5.35), (2, 5.34)) for k, z in enumerate([1.0] * 48 + [4.28, top])]
    df = spark.createDataFrame(rows, "cell int, time date, z double")
    assert {r["cell"]: r["wet"] for r in calibration.extreme_sums(df, K, (1,)).collect()} == {1: 4.28, 2: 5.34}
