import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe import errors
from hydroframe.operators import diagnostics, extend, fitting, indices, metadata, pet, series
from hydroframe.plans import batch
from hydroframe.sources import tables

K = ["cell"]


def months(n, start=1980):
    return [dt.date(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def frame(spark, cells, start=1980, columns=("value",)):
    rows = [(c, t, *[float(v[k]) for v in vs]) for c, vs in cells.items() for k, t in enumerate(months(len(vs[0]), start))]
    return spark.createDataFrame(rows, "cell int, time date, " + ", ".join(f"{c} double" for c in columns))


def column(df, name, cell=1):
    return [r[name] for r in df.where(f"cell = {cell}").orderBy("time").collect()]


@pytest.fixture(scope="module")
def rain():
    rng = np.random.default_rng(42)
    return {c: [rng.gamma(2, 50, 480)] for c in (1, 2)}


def test_trailing_sum(spark):
    df = frame(spark, {1: [[1, 2, float("nan"), 4, 5, 6, 7]]})
    dense = series.densify(df, K)
    got = series.trailing_sum(dense, K, "value", 3).orderBy("idx").collect()
    assert [r["value"] for r in got] == [None, None, None, None, None, 15.0, 18.0, None, None, None, None, None]
    assert [r["pad"] for r in got] == [False] * 7 + [True] * 5
    for bad in (0, 73, 2.0, True):
        with pytest.raises(errors.InvalidArgument):
            series.trailing_sum(dense, K, "value", bad)


def test_negative_values_stay_where_a_month_is_missing(spark):
    both = frame(spark, {1: [[-1, 2, 3]], 2: [[-1, float("nan"), 3]]})
    got = series.clip_negative(series.densify(both, K), K, "value").where("not pad").orderBy("cell", "idx").collect()
    assert [r["value"] for r in got] == [0, 2, 3, -1, None, 3]


@pytest.mark.parametrize("kind", ["gamma", "pearson"])
def test_spi_is_standard(spark, rain, kind):
    df = frame(spark, rain)
    z = column(indices.spi(df, K, 6, kind), "spi")
    assert z[:5] == [None] * 5 and len(z) == 480
    z = np.array(z[5:], dtype=float)
    assert abs(z.mean()) < 0.05 and 0.9 < z.std() < 1.1 and np.abs(z).max() <= 3.09
    sums = np.convolve(rain[1][0], np.ones(6), "valid")
    order = [np.corrcoef(sums[m::12].argsort().argsort(), z[m::12].argsort().argsort())[0, 1] for m in range(12)]
    assert min(order) > 0.999


def test_spi_gamma_by_hand(spark, rain):
    """One month's values from the definition: Thom's fit, the incomplete gamma function by a sum, the normal quantile."""
    from statistics import NormalDist

    z = column(indices.spi(frame(spark, rain), K, 1, calibration=(1985, 2010)), "spi")
    v = rain[1][0][2::12]
    fit = v[5:31]
    a = math.log(fit.mean()) - np.log(fit).mean()
    alpha = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)
    for x, got in zip(v[:8], z[2::12][:8], strict=True):
        y = x / (fit.mean() / alpha)
        p = sum(math.exp(-y + (alpha + n) * math.log(y) - math.lgamma(alpha + n + 1)) for n in range(400))
        assert got == pytest.approx(NormalDist().inv_cdf(p), abs=1e-6)


def test_zeros(spark):
    """Half the months dry: their value is the quantile of half; a month that is always dry is at the lower bound."""
    v = np.tile([5.0, 0.0], 120)
    v = np.where(np.arange(240) % 24 < 12, v + np.arange(240) % 7, 0.0)
    got = indices.spi(frame(spark, {1: [v]}), K, 1)
    z = np.array(column(got, "spi"))
    always = [m for m in range(12) if not v[m::12].any()]
    assert all((z[m::12] == -3.09).all() for m in always)
    half = next(m for m in range(12) if 0 < (v[m::12] == 0).sum() < 20)
    assert np.allclose(z[half::12][v[half::12] == 0], 0.0, atol=1e-9)


def test_all_missing_and_single_series(spark):
    df = frame(spark, {1: [[float("nan")] * 48]})
    assert column(indices.spi(df, K, 3), "spi") == [None] * 48
    alone = frame(spark, {1: [np.random.default_rng(0).gamma(2, 50, 60)]}).drop("cell")
    assert indices.spi(alone, [], 2).count() == 60


def test_pearson_falls_back(spark):
    rng = np.random.default_rng(1)
    v = np.where(np.arange(480) % 12 < 5, rng.gamma(2, 50, 480), np.nan)
    df = frame(spark, {1: [v]})
    a, b = (np.array(column(indices.spi(df, K, 1, kind), "spi"), dtype=float) for kind in ("pearson", "gamma"))
    assert np.allclose(a, b, atol=1e-12, equal_nan=True) and not np.isnan(a).all()  # the sums behind both run in different orders


def test_saved_parameters(spark, rain, tmp_path):
    df = frame(spark, rain)
    params = batch.fit(df, K, [3, 6])
    path = f"file://{tmp_path}/p"
    tables.save_params(params, path)
    with pytest.raises(Exception, match="exist"):
        tables.save_params(params, path)
    for kind in ("gamma", "pearson"):
        loaded = tables.load_params(spark, path, kind).where("accumulation = 6")
        a, b = column(indices.spi(df, K, 6, kind), "spi"), column(indices.spi(df, K, 6, kind, params=loaded), "spi")
        assert np.allclose(a[5:], b[5:], atol=1e-9)
    with pytest.raises(errors.CoordinateError):
        tables.save_params(params.drop("loc"), path, overwrite=True) or tables.load_params(spark, path, "pearson")


def test_spei(spark, rain):
    rng = np.random.default_rng(2)
    both = frame(spark, {1: [rain[1][0], rng.uniform(20, 120, 480)]}, columns=("prcp", "pet"))
    for kind in ("gamma", "pearson"):
        z = np.array(column(indices.spei(both, K, 3, kind), "spei")[2:], dtype=float)
        assert abs(z.mean()) < 0.06 and np.abs(z).max() <= 3.09


def test_eddi(spark, rain):
    z = column(indices.eddi(frame(spark, rain), K, 1, calibration=(1980, 2009)), "eddi")
    v = rain[1][0][::12]
    for x, got in zip(v, z[::12], strict=True):
        p = (1 + (v[:30] < x).sum() - 0.33) / 30.33
        assert (got == 3.09) if p >= 1 else abs(got) < 3.1
    assert np.argmax(v) == np.argmax(z[::12])
    with pytest.raises(errors.InvalidArgument):
        indices.check_calibration(frame(spark, rain), "time", 1970, 2000)
    with pytest.raises(errors.InvalidArgument):
        indices.eddi(frame(spark, rain), K, 1, calibration=(1970, 2000), check=True)


def test_checks_on_request(spark, rain):
    df = frame(spark, rain)
    assert indices.pnp(df, K, 3, calibration=(1981, 2010), check=True).count() == indices.spi(df, K, 3, check=True).count() == 960
    for calibration in ((1970, 1990), (1980, 2030)):
        with pytest.raises(errors.InvalidArgument):
            indices.pnp(df, K, 3, calibration=calibration, check=True)
    with pytest.raises(errors.ShapeError):
        indices.spi(df.where("year(time) = 1980"), K, 24, check=True)
    with pytest.raises(errors.CoordinateError):
        indices.spei(df.union(df).withColumn("pet", F.lit(1.0)), K, 3, precip="value", check=True)


def test_alignment_and_joining(spark, rain):
    a, b = frame(spark, {1: [rain[1][0][:60]]}), frame(spark, {1: [rain[1][0][:60]]}, start=1982, columns=("other",))
    with pytest.warns(errors.AlignmentWarning):
        diagnostics.warn_of_alignment(a, b, K)
    with pytest.raises(errors.CoordinateError):
        diagnostics.warn_of_alignment(a, b.withColumn("cell", F.lit(9)), K)
    both = tables.join_series([a, b], K)
    assert both.count() == 84 and both.where("value is null").count() == both.where("other is null").count() == 24
    low, high = a.where("year(time) < 1983").withColumnRenamed("value", "tmin"), b.withColumn("tmax", F.lit(1000.0)).drop("other")
    assert pet.hargreaves_pet(low, high, K, 35.0).count() == 12  # only the year that both have


def test_pnp(spark):
    got = column(indices.pnp(frame(spark, {1: [[2.0] * 36]}), K, 3), "pnp")
    assert got[:2] == [None, None] and got[2:] == [1.0] * 34
    assert column(indices.pnp(frame(spark, {1: [[0.0] * 24]}), K, 1), "pnp") == [None] * 24


def test_pci(spark):
    days = spark.sql("select 1 as cell, explode(sequence(date '1999-01-01', date '2000-12-31')) as time").withColumn("value", F.lit(1.0))
    assert [round(r["pci"], 4) for r in indices.pci(days, K).orderBy("year").collect()] == [9.7545, 9.7545]
    even = indices.pci(days, K, mode="calendar").orderBy("year").collect()
    assert all(8.33 < r["pci"] < 8.35 for r in even)
    assert indices.pci(days.where("time <> '1999-05-05'"), K).where("pci is null").count() == 1
    with pytest.raises(errors.InvalidArgument):
        indices.pci(days, K, mode="lunar")


def test_thornthwaite(spark):
    t = [5, 6, 9, 12, 17, 21, 24, 23, 19, 13, 8, -2] * 3
    df = frame(spark, {1: [t]}, columns=("tavg",))
    got = column(pet.thornthwaite(df, K, 35.0), "pet")
    assert got[11] == 0 and got[6] == max(got[:12]) and 120 < got[6] < 180
    assert got[12] == pytest.approx(got[0], rel=0.05) and got[13] != got[1]  # 1981 has a shorter February
    for bad in (90.0, -90.0, 95.0, float("nan")):
        with pytest.raises(ValueError):
            pet.thornthwaite(df, K, bad)
    assert column(pet.thornthwaite(frame(spark, {1: [[-5.0] * 24]}, columns=("tavg",)), K, 35.0), "pet") == [None] * 24


def test_hargreaves(spark):
    day = dt.date(2015, 7, 15)
    low = spark.createDataFrame([(1, day, 14.8), (1, day + dt.timedelta(1), 20.0)], "cell int, time date, tmin double")
    high = spark.createDataFrame([(1, day, 26.6), (1, day + dt.timedelta(1), 10.0), (1, day + dt.timedelta(9), 30.0)], "cell int, time date, tmax double")
    got = column(pet.hargreaves_pet(low, high, K, 45.72), "pet")
    assert got[0] == pytest.approx(5.0, abs=0.1) and got[1] is None and len(got) == 2


def test_daily_spi(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(1998, 1, 1) + dt.timedelta(d) for d in range(365 * 4 + 1)]
    df = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, rng.gamma(2, 3, len(days)), strict=True)], "cell int, time date, value double")
    got = indices.spi(df, K, 30, periodicity="daily")
    assert got.count() == len(days) and got.where("spi is not null").count() == len(days) - 29


def test_lifted_functions(spark, rain):
    @extend.series_index("total", inputs=("value", "other"))
    def total(a, b, start_year, factor=1.0):
        assert start_year == 1980
        return (a + b) * factor

    df = frame(spark, rain).withColumn("other", F.col("value") * 2)
    assert np.allclose(column(total(df, K, factor=2.0), "total"), rain[1][0] * 6)
    assert np.allclose(column(total(df, K, other="value"), "total"), rain[1][0] * 2)
    with pytest.raises(NotImplementedError):
        extend.series_index("x", skipna=True)
    with pytest.raises(errors.CoordinateError):
        total(df.drop("other"), K)
    with pytest.raises(errors.InputTypeError, match="createDataFrame"):
        total(df.toPandas(), K)
    found = extend.infer(df, K).where("cell = 1").first()
    assert (found["first_year"], found["last_year"], found["periodicity"]) == (1980, 2019, "monthly")
    extend.require(df, K, 6)
    with pytest.raises(errors.ShapeError):
        extend.require(df.limit(3), K, 6)
    with pytest.raises(errors.CoordinateError):
        extend.require(df.union(df), K, 6)


def test_diagnostics(spark, rain):
    dense = series.densify(frame(spark, {**rain, 3: [[float("nan")] * 200 + [1.0] * 40]}), K)
    quality = {r["cell"]: r for r in diagnostics.calibration_quality(dense, K).collect()}
    assert not quality[1]["is_short"] and quality[3]["is_short"] and quality[3]["has_gaps"]
    with pytest.warns(errors.MissingDataWarning):
        diagnostics.warn(diagnostics.calibration_quality(dense, K))
    assert {r["cell"]: r["enough"] for r in diagnostics.effective_years(dense, K).collect()} == {1: True, 2: True, 3: False}
    for kind in ("gamma", "pearson"):
        fit = diagnostics.goodness_of_fit(series.densify(frame(spark, rain), K), K, distribution=kind)
        assert fit.count() == 24 and fit.where("poor").count() <= 3
    poor = fitting.pearson_fit(series.densify(frame(spark, {1: [[0.0] * 48], 2: rain[2]}), K), K)
    assert {r["cell"]: r["share"] for r in fitting.failed_share(poor, K).collect()} == {1: 1.0, 2: 0.0}
    with pytest.warns(errors.PoorFitWarning):
        diagnostics.warn_of_fits(poor, K)
    diagnostics.require_effective_years(dense.where("cell < 3"), K)
    with pytest.raises(errors.NotEnoughData):
        diagnostics.require_effective_years(dense, K)
    assert diagnostics.missing_kept(dense, dense.withColumn("spi", F.coalesce("value", F.lit(0.0))), ["cell", "idx"], "value", "spi").count() == 200
    described = metadata.describe(indices.spi(frame(spark, rain), K, 3), "spi", "spi", "scale 3")
    assert described.schema["spi"].metadata["units"] == "1" and "scale 3" in described.schema["spi"].metadata["history"]


def test_zero_share_and_lmoments(spark, rain):
    dense = series.densify(frame(spark, rain), K)
    assert fitting.zero_share(dense, K).where("prob_zero is not null").count() == 0
    got = fitting.lmoments(dense, K).where("cell = 1 and period = 1").first()
    v = np.sort(rain[1][0][::12])
    pairs = np.abs(v[:, None] - v[None, :]).sum() / (40 * 39)
    assert got["l1"] == pytest.approx(v.mean()) and got["l2"] == pytest.approx(pairs / 2)


def test_batch(spark, rain, tmp_path):
    t = months(480)
    rows = [(1.0 * c, 10.0, d, float(v)) for c in (1, 2) for d, v in zip(t, rain[c][0], strict=True)]
    spark.createDataFrame(rows, "lat double, lon double, time date, prcp double").write.parquet(f"file://{tmp_path}/prcp")
    spark.createDataFrame([(a, b, d, 10 + 10 * math.sin(d.month / 2)) for a, b, d, _ in rows], "lat double, lon double, time date, tavg double").write.parquet(f"file://{tmp_path}/temp")
    spark.createDataFrame([(1.0, 10.0, 4.0), (2.0, 10.0, 6.0)], "lat double, lon double, awc double").write.parquet(f"file://{tmp_path}/awc")
    base = ["--precip", f"file://{tmp_path}/prcp", "--temp", f"file://{tmp_path}/temp", "--awc", f"file://{tmp_path}/awc", "--calibration", "1985", "2010", "--out", f"file://{tmp_path}/out"]
    made = batch.run(spark, batch.parser().parse_args(["--index", "all", "--scales", "3", "--save_params", f"file://{tmp_path}/fit", *base]))
    assert set(made) == {"spi_gamma_03", "spi_pearson_03", "spei_gamma_03", "spei_pearson_03", "pnp_03", "palmer"}
    again = batch.run(spark, batch.parser().parse_args(["--index", "spi", "--scales", "3", "--load_params", f"file://{tmp_path}/fit", "--overwrite", *base]))
    assert spark.read.parquet(f"file://{tmp_path}/out/spi_gamma_03").schema["spi"].metadata["units"] == "1"
    named = batch.run(spark, batch.parser().parse_args(["--index", "all", "--scales", "3", "--names", "month", "--separate", "--files", "2", "--partition_by", "lat", "--check", *base[:-1], f"file://{tmp_path}/own"]))
    assert "spi_gamma_3_month" in named and spark.read.parquet(f"file://{tmp_path}/own/zindex").columns == ["lon", "time", "z", "lat"]
    with pytest.raises(errors.InvalidArgument):
        tables.variable_name("spi", "gamma", 3, "weekly")
    assert again["spi_gamma_03"].count() == 960 and spark.read.parquet(f"file://{tmp_path}/out/palmer").count() == 960
    with pytest.raises(errors.InvalidArgument):
        batch.run(spark, batch.parser().parse_args(["--index", "spei", "--scales", "3", "--precip", f"file://{tmp_path}/prcp", "--out", "x"]))


def test_streaming(spark, rain, tmp_path):
    """Months that arrive one batch after another give the index that a table gives."""
    from hydroframe.streaming.apply import apply_params, trailing_sums

    df = frame(spark, rain)
    params = batch.fit(df, K, [3]).drop("accumulation")
    for k in range(3):
        df.where(f"year(time) = {2000 + k}").coalesce(1).write.parquet(f"file://{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    out = apply_params(trailing_sums(stream, K, 3), params, K)
    q = out.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    live = {(r["cell"], r["time"]): r["spi"] for r in spark.table("live").collect()}
    want = {(r["cell"], r["time"]): r["spi"] for r in indices.spi(df, K, 3).where("year(time) between 2000 and 2002").collect()}
    assert set(live) == set(want)
    late = [k for k in want if k[1] >= dt.date(2000, 3, 1) and live[k] is not None]
    assert len(late) >= 60 and all(live[k] == pytest.approx(want[k], abs=1e-9) for k in late)


def test_match_within_deals_a_crowded_place(spark, monkeypatch):
    """All pairs come out, and a place where most rows lie is the work of many tasks."""
    monkeypatch.setattr(series, "BLOCK", 20, raising=False)
    monkeypatch.setattr(series, "PAIRS", 5000, raising=False)
    rng = np.random.default_rng(3)

    def places(n, crowd):
        far = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (n, 2)).round(1))]
        return far + [(n + i, 1.0, -1.0) for i in range(crowd)] + [(n + crowd, None, 0.0), (n + crowd + 1, 0.0, float("nan"))]

    left, right = places(80, 200), places(100, 300)
    a, b = (spark.createDataFrame(rows, "k long, lat double, lon double").coalesce(1) for rows in (left, right))
    near = series.match_within(a, b, ["lat", "lon"], {"lat": 0.5, "lon": 0.25})
    assert near.columns == ["k", "lat", "lon", "k_other", "lat_other", "lon_other"]
    got = sorted((r["k"], r["k_other"]) for r in near.collect())
    assert got == sorted((i, j) for i, x, y in left for j, u, v in right if None not in (x, u) and abs(x - u) <= 0.5 and abs(y - v) <= 0.25)
    assert max(r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()) < len(got) / 4
    assert series.match_within(a.limit(0), b, ["lat"], {"lat": 0.5}).count() == 0


def test_infer_with_missing_steps(spark):
    """Gaps don't change the periodicity; weeks, months that come twice, hours and under three steps have none."""
    day = dt.date(1995, 1, 1)
    made = {
        1: ("monthly", [t for k, t in enumerate(months(48, 1995)) if k not in (7, 20, 21, 22, 30)]),
        2: ("monthly", [t.replace(day=15) for t in months(30, 1995)[::5] + months(30, 1995)[1:3]]),
        3: ("monthly", [m - dt.timedelta(1) for m in months(13, 1995)[1:]]),
        4: ("daily", [day + dt.timedelta(k) for k in range(100) if k % 9]),
        5: (None, [day + dt.timedelta(7 * k) for k in range(30)]),
        6: (None, [dt.date(1995, 1, 1), dt.date(1995, 1, 30), dt.date(1995, 5, 1)]),
        7: (None, [t for t in months(36, 1995) if t.month in (1, 7)]),
        8: (None, months(12, 1995) * 2),
        9: (None, months(2, 1995)),
    }
    df = spark.createDataFrame([(c, t) for c, (_, ts) in made.items() for t in ts], "cell int, time date")
    got = {r["cell"]: r for r in extend.infer(df, K).collect()}
    assert {c: r["periodicity"] for c, r in got.items()} == {c: kind for c, (kind, _) in made.items()}
    assert {c: (r["first_year"], r["last_year"], r["steps"]) for c, r in got.items()} == {c: (min(ts).year, max(ts).year, len(ts)) for c, (_, ts) in made.items()}
    hours = spark.sql("select 1 cell, timestamp '1995-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) time from range(10)")
    assert extend.infer(hours, K).first()["periodicity"] is None
