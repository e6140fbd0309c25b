"""Every operator as a query over the driver's tables, with the SQL that gives the same rows.

There are no climate tables there, so others stand in: the monthly sum of l_quantity for precipitation, by supplier, or by
l_linenumber where cells need a place or a water balance; a linear form of it for temperature, and the monthly sum of
o_totalprice for evaporative demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions import calendar, expr, special
from hydroframe.operators import calibration, diagnostics, extend, fitting, indices, palmer, pet, series

K = ["cell"]
YEARS = (1996, 2000)
#: Rounding of results, for comparison by value.
DIGITS = 4

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Stand-in tables ---------------------------------------------------------------------------------------------------


def rain(spark: SparkSession, sf: str, by: str = "l_suppkey") -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col(by).alias("cell"), F.trunc("l_shipdate", "month").alias("time"), "l_quantity")
    return rows.groupBy("cell", "time").agg(F.sum("l_quantity").alias("value"))


def rain_by_line(spark: SparkSession, sf: str) -> DataFrame:
    return rain(spark, sf, "l_linenumber")


def demand(spark: SparkSession, sf: str) -> DataFrame:
    """One series for all cells, of about the size of the rain."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.trunc("o_orderdate", "month").alias("time"), "o_totalprice")
    return rows.groupBy("time").agg(F.floor(F.sum(F.floor("o_totalprice")) / 10000).cast("double").alias("pet"))


def water(spark: SparkSession, sf: str) -> DataFrame:
    return rain_by_line(spark, sf).withColumnRenamed("value", "prcp").join(F.broadcast(demand(spark, sf)), "time")  # a row for each month


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Rain of every day of each cell's years, from its first to its last, 0 on days without rows."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("cell"), F.to_date("l_shipdate").alias("time"), "l_quantity")
    sums = rows.groupBy("cell", "time").agg(F.sum("l_quantity").alias("value"))
    spans = sums.groupBy("cell").agg(F.min(F.year("time")).alias("y0"), F.max(F.year("time")).alias("y1"))
    days = spans.select("cell", F.explode(F.expr("sequence(make_date(y0, 1, 1), make_date(y1, 12, 31))")).alias("time"))
    return days.join(sums, ["cell", "time"], "left").fillna(0.0, ["value"])


def site(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.col("cell") * 8.0 - 20.0, "awc": F.col("cell") * 0.5 + 2.0})


def inches(spark: SparkSession, sf: str) -> DataFrame:
    """Rain and demand as a few inches a month, with seasons and lasting swings so that spells come and go."""
    rows = site(rain_by_line(spark, sf).withColumn("n", F.sum("value").over(series.by_keys(["cell"])) / F.count("value").over(series.by_keys(["cell"]))))
    month, year = F.month("time"), F.year("time")
    prcp = F.col("value") / F.col("n") * 2.0 + F.when((year * 7 + F.col("cell")) % 3 == 0, -0.9).when((year + F.col("cell")) % 3 == 1, 0.8).otherwise(0.0)
    return rows.select("cell", "time", "lat", "awc", F.greatest(prcp, F.lit(0.0)).alias("prcp"), (F.lit(3.2) - F.abs(month - 7) * 0.45).alias("pet"))


def days_of(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with made-up physical columns, from lineitem."""
    q, d, t, k = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_suppkey"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", (q / 2.0 - 5.0).alias("tmin"), (q / 2.0 + d * 100.0).alias("tmax"), (q / 2.0 + d * 50.0).alias("t"),
        (k % 30 * 100.0).alias("elev"), (t * 500.0 + 30.0).alias("rh_min"), (t * 500.0 + 55.0).alias("rh_max"), (q / 4.0).alias("rn"), (d * 2.0).alias("g"), (t * 50.0 + 0.5).alias("u2"),
        (k % 120 - 59.5).alias("lat"), (F.dayofyear("l_shipdate")).alias("day"),
    )


DAYS = """(SELECT l_orderkey, l_linenumber, l_quantity / 2 - 5 AS tmin, l_quantity / 2 + l_discount * 100 AS tmax, l_quantity / 2 + l_discount * 50 AS t,
 l_suppkey % 30 * 100.0 AS elev, l_tax * 500 + 30 AS rh_min, l_tax * 500 + 55 AS rh_max, l_quantity / 4 AS rn, l_discount * 2 AS g, l_tax * 50 + 0.5 AS u2,
 l_suppkey % 120 - 59.5 AS lat, dayofyear(l_shipdate) AS day FROM lineitem)"""

RAIN = """raw AS (SELECT l_suppkey AS cell, year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
span AS (SELECT cell, min(y) AS y0, max(y) AS y1, max(y * 12 + m) AS fin FROM raw GROUP BY cell),
grid AS (SELECT cell, y0, fin, unnest(range(y0 * 12, y1 * 12 + 12)) AS s FROM span),
slots AS (SELECT cell, (s // 12)::INT AS y, (s % 12 + 1)::INT AS m, (s - y0 * 12)::INT AS idx, s + 1 > fin AS pad FROM grid),
d AS (SELECT slots.*, raw.v FROM slots LEFT JOIN raw USING (cell, y, m))"""
RAIN_BY_LINE = RAIN.replace("l_suppkey", "l_linenumber")
DEMAND = "e AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, floor(sum(floor(o_totalprice)) / 10000) AS pet FROM orders GROUP BY ALL)"
TIME = "make_date(y, m, 1) AS time"


def sums_sql(k: int, value: str = "v", source: str = "d", name: str = "s", out: str = "v") -> str:
    w = f"PARTITION BY cell ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    return f"{name} AS (SELECT cell, y, m, idx, pad, CASE WHEN count({value}) OVER ({w}) = {k} THEN sum({value}) OVER ({w}) END AS {out} FROM {source})"


CALIB = f"y BETWEEN {YEARS[0]} AND {YEARS[1]}"
GAMMA_PARAMS = f"""ga AS (SELECT cell, m, avg(CASE WHEN v > 0 AND {CALIB} THEN v END) AS mean, avg(CASE WHEN v > 0 AND {CALIB} THEN ln(v) END) AS ml, count(CASE WHEN v = 0 THEN 1 END) / count(*) AS p0 FROM s GROUP BY cell, m),
gb AS (SELECT cell, m, mean, ln(mean) - ml AS a, CASE WHEN p0 < 1 THEN p0 ELSE 0 END AS p0 FROM ga),
gp AS (SELECT cell, m, p0, mean, CASE WHEN a > 0 THEN (1 + sqrt(1 + 4 * a / 3)) / (4 * a) END AS alpha FROM gb),
g AS (SELECT cell, m, p0, alpha, mean / alpha AS beta FROM gp)"""


def horner(x: str, cs: list[float]) -> str:
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    ratio = lambda x, t: f"{horner(x, t[0])} / {horner(x, t[1])}"
    return f"""CASE WHEN {p} = 0 THEN -1e308 WHEN {p} = 1 THEN 1e308 WHEN {p} > 0 AND {p} < 1 THEN
 CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", expr.CENTRE)}
 WHEN {r} <= 5 THEN sign({p} - 0.5) * {ratio(f"({r} - 1.6)", expr.MIDDLE)} ELSE sign({p} - 0.5) * {ratio(f"({r} - 5.0)", expr.FAR)} END END"""


def clip_sql(z: str, digits: int = DIGITS) -> str:
    return f"CASE WHEN ({z}) IS NOT NULL THEN round(least(greatest({z}, -3.09), 3.09), {digits}) END"


def lower_gamma_sql(a: str, x: str, terms: int = 1500) -> str:
    return f"(SELECT sum(exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))) FROM range({terms}) AS r(n))"


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Series ------------------------------------------------------------------------------------------------------------


@query(f"WITH {RAIN} SELECT cell, y AS year, m AS period, idx, pad, v AS value FROM d")
def densify_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return series.densify(rain(spark, sf), K).select("cell", "year", "period", "idx", "pad", "value")


@query(f"WITH {RAIN}, {sums_sql(3)} SELECT cell, {TIME}, v AS value FROM s WHERE NOT pad")
def trailing_sum(spark: SparkSession, sf: str) -> DataFrame:
    return series.trim(series.trailing_sum(series.densify(rain(spark, sf), K), K, "value", 3)).select("cell", "time", "value")


@query(f"WITH {RAIN}, x AS (SELECT *, v - 60 AS u FROM d) SELECT cell, {TIME}, CASE WHEN count(CASE WHEN u IS NULL AND NOT pad THEN 1 END) OVER (PARTITION BY cell) = 0 AND u < 0 THEN 0 ELSE u END AS value FROM x WHERE NOT pad")
def clip_negative(spark: SparkSession, sf: str) -> DataFrame:
    dense = series.densify(rain(spark, sf).withColumn("value", F.col("value") - 60), K)
    return series.trim(series.clip_negative(dense, K, "value")).select("cell", "time", "value")


@query(f"WITH {RAIN} SELECT cell, m AS period, round(avg(v), 6) AS normal FROM d WHERE {CALIB} GROUP BY cell, m")
def period_normals(spark: SparkSession, sf: str) -> DataFrame:
    dense = series.densify(rain(spark, sf), K).where(F.col("year").between(*YEARS))
    return dense.groupBy("cell", "period").agg(F.round(F.avg("value"), 6).alias("normal"))


@query(f"WITH {RAIN}, {DEMAND} SELECT cell, {TIME}, v AS prcp, pet FROM raw JOIN e USING (y, m)")
def align_inner(spark: SparkSession, sf: str) -> DataFrame:
    """One series for all cells, so that the time alone is what both have."""
    return series.align(rain(spark, sf).withColumnRenamed("value", "prcp"), demand(spark, sf), []).select("cell", "time", "prcp", "pet")


@query(f"WITH {RAIN}, {DEMAND} SELECT (SELECT count(*) FROM raw ANTI JOIN e USING (y, m)) AS only_left, (SELECT count(*) FROM e ANTI JOIN raw USING (y, m)) AS only_right")
def align_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return series.dropped(rain(spark, sf), demand(spark, sf), [])


@query("SELECT s_suppkey, round(s_acctbal / 0.05)::BIGINT AS s_acctbal_snap FROM supplier")
def snap_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_acctbal")
    return series.snap(s, ["s_acctbal"], {"s_acctbal": 0.5}).select("s_suppkey", "s_acctbal_snap")


@query("SELECT s_suppkey AS k, s_acctbal AS v, c_custkey AS k_other, c_acctbal AS v_other FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 25")
def match_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(k).alias("k"), F.col(v).alias("v")) for t, k, v in (("supplier", "s_suppkey", "s_acctbal"), ("customer", "c_custkey", "c_acctbal")))
    return series.match_within(a, b, ["v"], {"v": 25.0}).select("k", "v", "k_other", "v_other")


@query("SELECT DISTINCT c_custkey AS k, 'a' AS only_in FROM customer ANTI JOIN events ON c_custkey = user_id UNION SELECT DISTINCT user_id, 'b' FROM events ANTI JOIN customer ON c_custkey = user_id")
def same_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("events", "user_id")))
    return series.same_coordinates(a, b, ["k"])


@query("""SELECT DISTINCT l_shipdate::DATE AS time, (dayofyear(l_shipdate) + CASE WHEN dayofyear(l_shipdate) >= 60 AND NOT (year(l_shipdate) % 4 = 0 AND (year(l_shipdate) % 100 <> 0 OR year(l_shipdate) % 400 = 0)) THEN 1 ELSE 0 END)::INT AS period, l_shipdate::DATE AS back FROM lineitem""")
def calendar_366(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.to_date("l_shipdate").alias("time")).distinct()
    period = calendar.period_of(F.col("time"), calendar.Periodicity.daily)
    return t.select("time", period.cast("int").alias("period"), calendar.date_of(F.year("time"), period, calendar.Periodicity.daily).alias("back"))


#: Rain of every day of each cell's years, from its first to its last, 0 on days without rows.
DAILY = """q AS (SELECT l_linenumber AS cell, l_shipdate::DATE AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT cell, unnest(range(make_date(y0, 1, 1), make_date(y1 + 1, 1, 1), INTERVAL 1 DAY))::DATE AS t FROM (SELECT cell, min(year(t))::INT AS y0, max(year(t))::INT AS y1 FROM q GROUP BY cell)),
f AS (SELECT cell, t, coalesce(v, 0) AS v, dayofyear(make_date(year(t), 12, 31)) AS n FROM g LEFT JOIN q USING (cell, t))"""


@query(f"WITH {DAILY} SELECT a.cell, year(a.t)::INT AS year, (a.v + b.v) / 2 AS value FROM f a JOIN f b ON a.cell = b.cell AND b.t = a.t + 1 WHERE month(a.t) = 2 AND day(a.t) = 28 AND month(b.t) = 3")
def invented_leap_days(spark: SparkSession, sf: str) -> DataFrame:
    dense = series.densify(daily(spark, sf), K, periodicity="daily")
    return dense.where((F.col("period") == 60) & ~calendar.is_leap(F.col("year"))).select("cell", "year", "value")


# Indices -----------------------------------------------------------------------------------------------------------


@query(f"WITH {RAIN}, {sums_sql(3)}, n AS (SELECT *, avg(CASE WHEN {CALIB} THEN v END) OVER (PARTITION BY cell, m) AS a FROM s) SELECT cell, {TIME}, round(CASE WHEN a > 0 THEN v / a END, 6) AS pnp FROM n WHERE NOT pad")
def pnp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.pnp(rain(spark, sf), K, 3, calibration=YEARS), "pnp", digits=6)


HASTINGS_SQL = lambda p: f"CASE WHEN {p} <= 0.5 THEN -1 ELSE 1 END * (sqrt(-2 * ln(least({p}, 1 - {p}))) - {horner(f'sqrt(-2 * ln(least({p}, 1 - {p})))', expr.HASTINGS[0])} / {horner(f'sqrt(-2 * ln(least({p}, 1 - {p})))', expr.HASTINGS[1])})"


@query(f"""WITH {RAIN}, {sums_sql(2)},
r AS (SELECT a.*, (SELECT count(*) FROM s b WHERE b.cell = a.cell AND b.m = a.m AND b.v < a.v AND b.{CALIB}) AS k, (SELECT count(b.v) FROM s b WHERE b.cell = a.cell AND b.m = a.m AND b.{CALIB}) AS n FROM s a),
p AS (SELECT *, least(greatest((1 + k - 0.33) / (n + 0.33), 1e-10), 1 - 1e-10) AS p FROM r)
SELECT cell, {TIME}, CASE WHEN v IS NOT NULL AND n >= 2 THEN {clip_sql(HASTINGS_SQL("p"))} END AS eddi FROM p WHERE NOT pad""")
def eddi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.eddi(rain(spark, sf), K, 2, calibration=YEARS), "eddi")


def _pci_sql(reference: bool) -> str:
    months = "".join(f", sum(CASE WHEN month(t) = {k} THEN v ELSE 0 END) AS m{k}" for k in range(1, 13))
    lead = ", sum(CASE WHEN dayofyear(t) > (CASE WHEN n = 366 THEN 29 ELSE 28 END) AND month(t) <= 3 THEN v ELSE 0 END) AS x" if reference else ""
    terms = ["m1", "x", *[f"m{k}" for k in range(4, 13)]] if reference else [f"m{k}" for k in range(1, 13)]
    return f"""WITH {DAILY},
s AS (SELECT cell, year(t)::INT AS year{months}{lead} FROM f GROUP BY ALL)
SELECT cell, year, round(({' + '.join(f'{a} * {a}' for a in terms)}) / (({' + '.join(terms)}) * ({' + '.join(terms)})) * 100, {DIGITS}) AS pci FROM s"""


@query(_pci_sql(True))
def pci_reference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.pci(daily(spark, sf), K), "pci")


@query(_pci_sql(False))
def pci_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.pci(daily(spark, sf), K, mode="calendar"), "pci")


def _summed(spark: SparkSession, sf: str, scale: int = 3, less: float = 0.0) -> DataFrame:
    df = rain(spark, sf).withColumn("value", F.greatest(F.col("value") - less, F.lit(0.0)))
    return series.trailing_sum(series.densify(df, K), K, "value", scale)


def _less(sql: float) -> str:
    return f"dz AS (SELECT cell, y, m, idx, pad, CASE WHEN v IS NOT NULL THEN greatest(v - {sql}, 0) END AS v FROM d)"


@query(f"WITH {RAIN}, {sums_sql(3)}, {GAMMA_PARAMS} SELECT cell, m AS period, round(alpha, 3) AS alpha, round(beta, 5) AS beta, round(p0, 6) AS prob_zero_gamma FROM g")
def gamma_params(spark: SparkSession, sf: str) -> DataFrame:
    p = fitting.gamma_fit(_summed(spark, sf), K, calibration=YEARS)
    return p.select("cell", "period", F.round("alpha", 3).alias("alpha"), F.round("beta", 5).alias("beta"), F.round("prob_zero_gamma", 6).alias("prob_zero_gamma"))


@query(f"WITH {RAIN}, {_less(150)}, {sums_sql(1, source='dz')}, {GAMMA_PARAMS} SELECT cell, m AS period, round(p0, 6) AS prob_zero FROM g")
def prob_zero_gamma(spark: SparkSession, sf: str) -> DataFrame:
    return fitting.gamma_fit(_summed(spark, sf, 1, 150.0), K, calibration=YEARS).select("cell", "period", F.round("prob_zero_gamma", 6).alias("prob_zero"))


@query(f"WITH {RAIN}, {_less(150)} SELECT cell, m AS period, round(CASE WHEN count(CASE WHEN v = 0 THEN 1 END) > 0 THEN count(CASE WHEN v = 0 THEN 1 END) / count(v) END, 6) AS prob_zero FROM dz WHERE {CALIB} GROUP BY cell, m")
def prob_zero_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fitting.zero_share(_summed(spark, sf, 1, 150.0), K, calibration=YEARS), "prob_zero", digits=6)


def _gamma_sql(sum_steps: str, out: str) -> str:
    f = f"CASE WHEN v = 0 THEN 0 WHEN alpha IS NULL THEN NULL ELSE {lower_gamma_sql('alpha', '(v / beta)')} END"
    return f"""WITH {sum_steps}, {GAMMA_PARAMS}, j AS (SELECT s.*, alpha, beta, p0 FROM s JOIN g USING (cell, m)),
f AS (SELECT *, {f} AS f FROM j), p AS (SELECT *, CASE WHEN f IS NOT NULL AND v IS NOT NULL THEN least(p0 + (1 - p0) * f, 1) END AS p FROM f)
SELECT cell, {TIME}, {clip_sql(ppf_sql("p"))} AS {out} FROM p WHERE NOT pad"""


@query(_gamma_sql(f"{RAIN}, {sums_sql(3)}", "spi"))
def spi_gamma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.spi(rain(spark, sf), K, 3, calibration=YEARS), "spi")


@query(_gamma_sql(f"{RAIN}, {sums_sql(3)}", "spi").replace(CALIB, "true"))
def spi_whole_record(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration period outside the data stands for the whole record."""
    return rounded(indices.spi(rain(spark, sf), K, 3, calibration=(1900, 1950)), "spi")


@query(_gamma_sql(f"{RAIN}, {sums_sql(3)}", "spi").replace("SELECT cell, make_date", "SELECT cell % 3 AS area, cell, make_date"))
def spi_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under two keys."""
    return rounded(indices.spi(rain(spark, sf).withColumn("area", F.col("cell") % 3), ["area", "cell"], 3, calibration=YEARS), "spi")


SPEI_STEPS = f"{RAIN_BY_LINE}, {DEMAND}, w AS (SELECT raw.cell, raw.y, raw.m, raw.v, pet FROM raw JOIN e USING (y, m)), sp2 AS (SELECT cell, min(y) AS y0, max(y) AS y1, max(y * 12 + m) AS fin FROM w GROUP BY cell), gr2 AS (SELECT cell, y0, fin, unnest(range(y0 * 12, y1 * 12 + 12)) AS s FROM sp2), sl2 AS (SELECT cell, (s // 12)::INT AS y, (s % 12 + 1)::INT AS m, (s - y0 * 12)::INT AS idx, s + 1 > fin AS pad FROM gr2), dw AS (SELECT sl2.*, w.v - w.pet + 1000.0 AS v FROM sl2 LEFT JOIN w USING (cell, y, m)), {sums_sql(3, source='dw')}"


@query(_gamma_sql(SPEI_STEPS, "spei"))
def spei_gamma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.spei(water(spark, sf), K, 3, calibration=YEARS), "spei")


LMOMENTS = f"""r AS (SELECT cell, m, v, row_number() OVER (PARTITION BY cell, m ORDER BY v NULLS LAST) - 1 AS i FROM s WHERE {CALIB}),
b AS (SELECT cell, m, count(v) AS n, count(CASE WHEN v = 0 THEN 1 END) AS n_zero, sum(v) AS s0, sum(v * i) AS s1, sum(v * i * (i - 1)) AS s2 FROM r GROUP BY cell, m),
c AS (SELECT cell, m, n, n_zero, s0 / nullif(n, 0) AS b0, s1 / nullif(n * (n - 1), 0) AS b1, s2 / nullif(n * (n - 1) * (n - 2), 0) AS b2 FROM b),
l AS (SELECT cell, m, n, n_zero, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / nullif(2 * b1 - b0, 0) AS t3 FROM c)"""
_C, _D = expr.PEARSON_NEAR, expr.PEARSON_FAR
PEARSON = f"""{LMOMENTS}, h AS (SELECT *, abs(t3) AS q, 3 * pi() * t3 * t3 AS u, 1 - abs(t3) AS w FROM l),
k AS (SELECT *, CASE WHEN q < 0.333333333 THEN (1 + {_C[0]} * u) / (u * (1 + u * ({_C[1]} + u * {_C[2]}))) ELSE w * ({_D[0]} + w * ({_D[1]} + w * {_D[2]})) / (1 + w * ({_D[3]} + w * ({_D[4]} + w * {_D[5]}))) END AS a FROM h),
pf AS (SELECT cell, m, CASE WHEN n - n_zero >= 4 AND l2 > 0 AND q < 1 THEN 1 ELSE 0 END AS ok, n_zero / n AS p0, l1, CASE WHEN q <= 1e-6 THEN sqrt(pi()) * l2 ELSE sqrt(pi()) * l2 * exp(lgamma(a) - lgamma(a + 0.5)) * sqrt(a) END AS sc, CASE WHEN q <= 1e-6 THEN 0 ELSE sign(t3) * 2 / sqrt(a) END AS sk FROM k),
pp AS (SELECT cell, m, CASE WHEN ok = 1 THEN p0 ELSE 0 END AS prob_zero, CASE WHEN ok = 1 THEN l1 ELSE 0 END AS loc, CASE WHEN ok = 1 THEN sc ELSE 0 END AS scale, CASE WHEN ok = 1 THEN sk ELSE 0 END AS skew FROM pf)"""


@query(f"WITH {RAIN}, {sums_sql(3)}, {LMOMENTS} SELECT cell, m AS period, n, n_zero, round(l1, 4) AS l1, round(l2, 4) AS l2, round(t3, 5) AS t3 FROM l")
def lmoments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(fitting.lmoments(_summed(spark, sf), K, calibration=YEARS), "l1", "l2"), "t3", digits=5)


@query(f"WITH {RAIN}, {sums_sql(3)}, {PEARSON} SELECT cell, m AS period, round(prob_zero, 6) AS prob_zero, round(loc, 4) AS loc, round(scale, 3) AS scale, round(skew, 4) AS skew FROM pp")
def pearson_params(spark: SparkSession, sf: str) -> DataFrame:
    p = fitting.pearson_fit(_summed(spark, sf), K, calibration=YEARS)
    return p.select("cell", "period", F.round("prob_zero", 6).alias("prob_zero"), F.round("loc", 4).alias("loc"), F.round("scale", 3).alias("scale"), F.round("skew", 4).alias("skew"))


def _pearson_sql(steps: str, out: str) -> str:
    low = lower_gamma_sql("(4 / (skew * skew))", "(4 / (skew * skew) + 2 * (v - loc) / scale / skew)", 4000)
    f = f"CASE WHEN v >= bound AND skew < 0 THEN 0.9995 WHEN v <= bound AND skew > 0 THEN 0.0005 WHEN v < 0.0005 AND prob_zero <= 0 THEN 0.0005 WHEN v < 0.0005 THEN 0 WHEN scale > 0 AND v IS NOT NULL THEN CASE WHEN skew > 0 THEN {low} ELSE 1 - {low} END END"
    return f"""WITH {steps}, {PEARSON}, j AS (SELECT s.*, prob_zero, loc, scale, skew, loc - 2 * scale / nullif(skew, 0) AS bound FROM s JOIN pp USING (cell, m)),
f AS (SELECT *, {f} AS f FROM j), p AS (SELECT *, CASE WHEN f IS NOT NULL AND v IS NOT NULL THEN greatest(least(prob_zero + (1 - prob_zero) * f, 1), 0) END AS p FROM f)
SELECT cell, {TIME}, {clip_sql(ppf_sql("p"), 3)} AS {out} FROM p WHERE NOT pad"""


@query(_pearson_sql(f"{RAIN_BY_LINE}, {sums_sql(3)}", "spi"))
def spi_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.spi(rain_by_line(spark, sf), K, 3, "pearson", calibration=YEARS), "spi", digits=3)


@query(_pearson_sql(SPEI_STEPS, "spei"))
def spei_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.spei(water(spark, sf), K, 3, "pearson", calibration=YEARS), "spei", digits=3)


FEW = "dq AS (SELECT cell, y, m, idx, pad, CASE WHEN m <= 5 THEN v END AS v FROM d)"


@query(_gamma_sql(f"{RAIN}, {FEW}, {sums_sql(1, source='dq')}", "spi"))
def spi_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Most months are missing, so the Pearson series is given up for a gamma one."""
    few = rain(spark, sf).withColumn("value", F.when(F.month("time") <= 5, F.col("value")))
    return rounded(indices.spi(few, K, 1, "pearson", calibration=YEARS), "spi")


@query(_gamma_sql(f"{RAIN}, {sums_sql(6)}", "spi"))
def fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters fitted first, as a table, then applied."""
    params = fitting.gamma_fit(_summed(spark, sf, 6), K, calibration=YEARS)
    return rounded(indices.spi(rain(spark, sf), K, 6, calibration=YEARS, params=params), "spi")


@query(_gamma_sql(f"{RAIN}, {sums_sql(1)}", "spi"))
def stream_apply_static(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming join on a table: accumulated values against saved parameters."""
    from hydroframe.streaming.apply import apply_params

    dense = _summed(spark, sf, 1)
    return rounded(apply_params(series.trim(dense), fitting.gamma_fit(dense, K, calibration=YEARS), K), "spi")


# Scalar functions --------------------------------------------------------------------------------------------------

P = "(l_orderkey % 9973 * 7 + l_linenumber) / 70000.0"


@query(f"SELECT l_orderkey, l_linenumber, round({ppf_sql(P)}, 8) AS z FROM lineitem WHERE {P} > 0")
def norm_ppf(spark: SparkSession, sf: str) -> DataFrame:
    p = F.expr(P.replace("70000.0", "70000D"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").where(p > 0).select("l_orderkey", "l_linenumber", F.round(expr.norm_ppf(p), 8).alias("z"))


@query(f"SELECT l_orderkey, l_linenumber, round({HASTINGS_SQL(P)}, 8) AS z FROM lineitem WHERE {P} > 0")
def hastings(spark: SparkSession, sf: str) -> DataFrame:
    p = F.expr(P.replace("70000.0", "70000D"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").where(p > 0).select("l_orderkey", "l_linenumber", F.round(expr.hastings(p), 8).alias("z"))


@query(f"SELECT l_orderkey, l_linenumber, round({lower_gamma_sql('(l_quantity / 5)', '(l_linenumber * 2.5)', 300)}, 8) AS p, round(lgamma(l_quantity / 5), 8) AS lg FROM lineitem")
def incomplete_gamma(spark: SparkSession, sf: str) -> DataFrame:
    a, x = F.col("l_quantity") / 5.0, F.col("l_linenumber") * 2.5
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(special.gamma_cdf(x, a, F.lit(1.0)), 8).alias("p"), F.round(expr.lgamma(a), 8).alias("lg"))


def scalar(name: str, sql: str, make, digits: int = 6) -> None:
    """A query of one expression over the made-up columns."""

    QUERIES[name] = lambda spark, sf: days_of(spark, sf).select("l_orderkey", "l_linenumber", F.round(make(), digits).alias("value"))
    ORACLES[name] = f"SELECT l_orderkey, l_linenumber, round({sql}, {digits}) AS value FROM {DAYS}"


def svp(t: str) -> str:
    return f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"


_DEC = "(0.409 * sin(2 * pi() / 365 * day - 1.39))"
_ANGLE = f"acos(least(greatest(-tan(radians(lat)) * tan({_DEC}), -1.0), 1.0))"
_RA = f"(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() / 365 * day)) * ({_ANGLE} * sin(radians(lat)) * sin({_DEC}) + cos(radians(lat)) * cos({_DEC}) * sin({_ANGLE})))"
C = F.col


def _define_scalars() -> None:
    lat = lambda: F.radians("lat")
    scalar("solar_declination", _DEC, lambda: expr.solar_declination(C("day")))
    scalar("sunset_angle", _ANGLE, lambda: expr.sunset_angle(lat(), expr.solar_declination(C("day"))))
    scalar("daylight_hours", f"24 / pi() * {_ANGLE}", lambda: expr.daylight_hours(expr.sunset_angle(lat(), expr.solar_declination(C("day")))))
    scalar("extraterrestrial_radiation", _RA, lambda: expr.extraterrestrial_radiation(C("day"), lat()))
    scalar("pet_hargreaves_formula", f"0.0023 * (t + 17.8) * sqrt(tmax - tmin) * 0.408 * {_RA}", lambda: expr.hargreaves(C("tmin"), C("tmax"), C("t"), expr.extraterrestrial_radiation(C("day"), lat())))
    scalar("fao_pressure", "101.3 * pow((293 - 0.0065 * elev) / 293, 5.26)", lambda: expr.atmospheric_pressure(C("elev")))
    scalar("fao_latent_heat", "2.501 - 0.002361 * t", lambda: expr.latent_heat(C("t")))
    scalar("fao_psychrometric", "0.000665 * 101.3 * pow((293 - 0.0065 * elev) / 293, 5.26)", lambda: expr.psychrometric_constant(expr.atmospheric_pressure(C("elev"))), 8)
    scalar("fao_vapor", svp("t"), lambda: expr.saturation_vp(C("t")))
    scalar("fao_vapor_slope", f"4098 * {svp('t')} / pow(t + 237.3, 2)", lambda: expr.vp_slope(C("t")))
    scalar("fao_vapor_mean", f"({svp('tmin')} + {svp('tmax')}) / 2", lambda: expr.mean_saturation_vp(C("tmin"), C("tmax")))
    scalar("fao_humidity_dewpoint", svp("tmin"), lambda: expr.vp_from_dewpoint(C("tmin")))
    scalar("fao_humidity_range", f"({svp('tmin')} * rh_max / 100 + {svp('tmax')} * rh_min / 100) / 2", lambda: expr.vp_from_rh_range(C("tmin"), C("tmax"), C("rh_min"), C("rh_max")))
    scalar("fao_humidity_max", f"{svp('tmin')} * rh_max / 100", lambda: expr.vp_from_rh_max(C("tmin"), C("rh_max")))
    scalar("fao_humidity_mean", f"({svp('tmin')} + {svp('tmax')}) / 2 * rh_max / 100", lambda: expr.vp_from_rh_mean(C("tmin"), C("tmax"), C("rh_max")))
    scalar("fao_humidity_arid", svp("tmin - 2"), lambda: expr.vp_from_tmin(C("tmin")))
    gamma = "(0.000665 * 101.3 * pow((293 - 0.0065 * elev) / 293, 5.26))"
    slope = f"(4098 * {svp('t')} / pow(t + 237.3, 2))"
    es, ea = f"(({svp('tmin')} + {svp('tmax')}) / 2)", f"({svp('tmin')} * rh_max / 100)"
    scalar("pm_eto", f"(0.408 * {slope} * (rn - g) + {gamma} * (900 / (t + 273)) * u2 * ({es} - {ea})) / ({slope} + {gamma} * (1 + 0.34 * u2))", lambda: expr.penman_monteith(C("rn"), C("g"), C("t"), C("u2"), expr.mean_saturation_vp(C("tmin"), C("tmax")), expr.vp_from_rh_max(C("tmin"), C("rh_max")), expr.vp_slope(C("t")), expr.psychrometric_constant(expr.atmospheric_pressure(C("elev")))))
    scalar("unit_conversion", "rn * 25.4 + (t - 32) * 5 / 9 + (elev - 273.15)", lambda: expr.in_units(C("rn"), "inch") + expr.in_units(C("t"), "fahrenheit") + expr.in_units(C("elev"), "kelvin"))


_define_scalars()


@query("SELECT o_orderkey, date_diff('day', DATE '1900-01-01', (DATE '1995-01-01' + to_months((o_orderkey % 240)::INT))::DATE)::INT AS days FROM orders")
def days_since_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", expr.days_since("1900-01-01", F.to_date(F.lit("1995-01-01")), (F.col("o_orderkey") % 240).cast("int")).alias("days"))


@query("SELECT l_linenumber, round(sqrt(avg(pow(l_discount - l_tax, 2))), 10) AS rmse FROM lineitem GROUP BY 1")
def rmse(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_linenumber").agg(F.round(expr.rmse(F.col("l_discount"), F.col("l_tax")), 10).alias("rmse"))


@query("SELECT l_orderkey, l_linenumber, sign(l_quantity - 25) <> sign(l_discount - 0.05) AS changed FROM lineitem")
def sign_change(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", expr.sign_change(F.col("l_quantity") - 25, F.col("l_discount") - 0.05).alias("changed"))


@query(f"WITH {RAIN}, a AS (SELECT cell, list_sort(list(v)) AS l FROM raw GROUP BY cell) SELECT cell, l[7] AS seventh, l[floor(0.98 * len(l))::INT] AS top FROM a")
def kth_percentile(spark: SparkSession, sf: str) -> DataFrame:
    all_ = rain(spark, sf).groupBy("cell").agg(F.collect_list("value").alias("l"))  # the months of one cell
    return all_.select("cell", expr.kth_smallest(F.col("l"), F.lit(7)).alias("seventh"), expr.truncated_percentile(F.col("l"), 0.98).alias("top"))


# Evapotranspiration ------------------------------------------------------------------------------------------------


@query(f"""WITH {RAIN}, {sums_sql(3)}, {GAMMA_PARAMS}, j AS (SELECT cell, m, v, alpha, beta, row_number() OVER (PARTITION BY cell, m ORDER BY v) AS i, count(*) OVER (PARTITION BY cell, m) AS n FROM s JOIN g USING (cell, m) WHERE v > 0 AND {CALIB}),
f AS (SELECT cell, m, n, i, CASE WHEN alpha IS NOT NULL THEN {lower_gamma_sql('alpha', '(v / beta)')} END AS f FROM j),
k AS (SELECT cell, m, n, max(greatest(i / n - f, f - (i - 1) / n)) AS d FROM f GROUP BY ALL)
SELECT cell, m AS period, n::INT AS n, round(d, 6) AS statistic, round(1.358 / sqrt(n), 6) AS critical, coalesce(d > 1.358 / sqrt(n), false) AS poor FROM k""")
def goodness_of_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.goodness_of_fit(_summed(spark, sf), K, calibration=YEARS), "statistic", "critical", digits=6)


@query(f"""WITH {RAIN_BY_LINE}, x AS (SELECT cell, y, m, idx, pad, greatest((v - 1000) / 100, 0) AS t FROM d),
c AS (SELECT cell, m, avg(t) AS a FROM x GROUP BY cell, m), h AS (SELECT cell, sum(pow(a / 5, 1.514)) AS i FROM c GROUP BY cell),
dl AS (SELECT cell, yr, month(t) AS m, avg(24 / pi() * acos(least(greatest(-tan(radians(cell * 8.0 - 20)) * tan(0.409 * sin(2 * pi() / 365 * dayofyear(t) - 1.39)), -1.0), 1.0))) AS light, count(*) AS days
 FROM (SELECT cell FROM span) CROSS JOIN (SELECT yr, unnest(range(make_date(yr, 1, 1), make_date(yr + 1, 1, 1), INTERVAL 1 DAY))::DATE AS t FROM (VALUES (2000), (2001)) AS v(yr)) GROUP BY ALL)
SELECT x.cell, make_date(x.y, x.m, 1) AS time, round(16 * light / 12 * days / 30 * pow(10 * t / i, 6.75e-07 * i * i * i - 7.71e-05 * i * i + 1.792e-02 * i + 0.49239), {DIGITS}) AS pet
FROM x JOIN h USING (cell) JOIN dl ON dl.cell = x.cell AND dl.m = x.m AND dl.yr = CASE WHEN x.y % 4 = 0 THEN 2000 ELSE 2001 END WHERE NOT pad""".replace("greatest((v - 1000) / 100, 0)", "CASE WHEN v IS NOT NULL THEN greatest((v - 1000) / 100, 0) END"))
def pet_thornthwaite(spark: SparkSession, sf: str) -> DataFrame:
    rows = site(rain_by_line(spark, sf).withColumn("tavg", (F.col("value") - 1000) / 100))
    return rounded(pet.thornthwaite(rows, K, "lat"), "pet")


_PLACE = "(dayofyear(t) + CASE WHEN dayofyear(t) >= 60 AND year(t) % 4 <> 0 THEN 1 ELSE 0 END)"


@query(f"""WITH a AS (SELECT l_linenumber AS cell, l_shipdate::DATE AS t, avg(l_quantity) - 20 AS tmin, avg(l_quantity) + 10 AS tmax FROM lineitem GROUP BY ALL)
SELECT cell, t AS time, round(0.0023 * ((tmin + tmax) / 2 + 17.8) * sqrt(tmax - tmin) * 0.408 * {_RA.replace("radians(lat)", "radians(35.0)").replace("day", _PLACE).replace(_PLACE + "ofyear", "dayofyear")}, {DIGITS}) AS pet FROM a""")
def pet_hargreaves(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("cell"), F.to_date("l_shipdate").alias("time")).agg(F.avg("l_quantity").alias("q"))
    low, high = rows.select("cell", "time", (F.col("q") - 20).alias("tmin")), rows.select("cell", "time", (F.col("q") + 10).alias("tmax"))
    return rounded(pet.hargreaves_pet(low, high, K, 35.0), "pet")


# Palmer ------------------------------------------------------------------------------------------------------------

INCHES = f"""{RAIN_BY_LINE}, mn AS (SELECT cell, sum(v) / count(v) AS n FROM raw GROUP BY cell),
inch AS (SELECT d.cell, y, m, idx, pad, cell * 0.5 + 2 AS awc,
 CASE WHEN v IS NOT NULL THEN greatest(v / n * 2 + CASE WHEN (y * 7 + cell) % 3 = 0 THEN -0.9 WHEN (y + cell) % 3 = 1 THEN 0.8 ELSE 0 END, 0) END AS p,
 CASE WHEN v IS NOT NULL THEN 3.2 - abs(m - 7) * 0.45 END AS e FROM d JOIN mn USING (cell))"""
BALANCE = """bal AS (
 SELECT cell, -1 AS idx, awc, 1.0::DOUBLE AS ss, greatest(awc - 1, 0)::DOUBLE AS su, 0::DOUBLE AS p, 0::DOUBLE AS e, 0::DOUBLE AS sp, 0::DOUBLE AS pl, 0::DOUBLE AS pr, 0::DOUBLE AS r, 0::DOUBLE AS tl, 0::DOUBLE AS et, 0::DOUBLE AS ro, 0 AS y, 0 AS m FROM (SELECT DISTINCT cell, awc FROM inch)
 UNION ALL
 SELECT i.cell, i.idx, i.awc,
  CASE WHEN i.p >= i.e THEN CASE WHEN i.p - i.e > 1 - ss THEN 1 ELSE ss + i.p - i.e END ELSE CASE WHEN ss >= i.e - i.p THEN ss - (i.e - i.p) ELSE 0 END END,
  CASE WHEN i.p >= i.e THEN CASE WHEN i.p - i.e > 1 - ss THEN su + least(i.p - i.e - (1 - ss), i.awc - 1 - su) ELSE su END ELSE CASE WHEN ss >= i.e - i.p THEN su ELSE su - least(su, (i.e - i.p - ss) * su / i.awc) END END,
  i.p, i.e, ss + su, CASE WHEN ss >= i.e THEN i.e ELSE least(ss + su, (i.e - ss) * su / i.awc + ss) END, i.awc - ss - su,
  CASE WHEN i.p >= i.e THEN CASE WHEN i.p - i.e > 1 - ss THEN 1 - ss + least(i.p - i.e - (1 - ss), i.awc - 1 - su) ELSE i.p - i.e END ELSE 0 END,
  CASE WHEN i.p >= i.e THEN 0 WHEN ss >= i.e - i.p THEN i.e - i.p ELSE ss + least(su, (i.e - i.p - ss) * su / i.awc) END,
  CASE WHEN i.p >= i.e THEN i.e WHEN ss >= i.e - i.p THEN i.e ELSE i.p + ss + least(su, (i.e - i.p - ss) * su / i.awc) END,
  CASE WHEN i.p >= i.e AND i.p - i.e > 1 - ss THEN greatest(i.p - i.e - (1 - ss) - (i.awc - 1 - su), 0) ELSE 0 END, i.y, i.m
 FROM bal JOIN inch i ON i.cell = bal.cell AND i.idx = bal.idx + 1 AND NOT i.pad)"""
CAFEC = f"""cs AS (SELECT cell, m, sum(p) AS p, sum(e) AS e, sum(sp) AS sp, sum(pl) AS pl, sum(pr) AS pr, sum(r) AS r, sum(tl) AS tl, sum(et) AS et, sum(ro) AS ro FROM bal WHERE idx >= 0 AND {CALIB} GROUP BY cell, m),
cc AS (SELECT *, CASE WHEN e <> 0 THEN et / e WHEN et = 0 THEN 1 ELSE 0 END AS alpha, CASE WHEN pr <> 0 THEN r / pr WHEN r = 0 THEN 1 ELSE 0 END AS beta, CASE WHEN sp <> 0 THEN ro / sp WHEN ro = 0 THEN 1 ELSE 0 END AS gamma, CASE WHEN pl <> 0 THEN tl / pl ELSE 0 END AS delta FROM cs)"""
ZED = f"""dep AS (SELECT b.cell, b.y, b.m, b.idx, b.p - (alpha * b.e + beta * b.pr + gamma * b.sp - delta * b.pl) AS d FROM bal b JOIN cc ON cc.cell = b.cell AND cc.m = b.m WHERE b.idx >= 0),
db AS (SELECT cell, m, sum(abs(d)) / {YEARS[1] - YEARS[0] + 1} AS dbar FROM dep WHERE {CALIB} GROUP BY cell, m),
kk AS (SELECT db.cell, db.m, dbar, 1.5 * log10(((e + r + ro) / (p + tl) + 2.8) / dbar) + 0.5 AS k FROM db JOIN cc USING (cell, m)),
kn AS (SELECT cell, sum(dbar * k) AS n FROM kk GROUP BY cell)"""


@query(f"WITH RECURSIVE {INCHES}, {BALANCE} SELECT cell, y AS year, m AS period, " + ", ".join(f"round({c}, 6) AS {c}" for c in palmer.FLOWS) + " FROM bal WHERE idx >= 0")
def water_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(palmer.water_balance(inches(spark, sf), K).where("not pad").select("cell", "year", "period", *palmer.FLOWS), *palmer.FLOWS, digits=6)


@query(f"WITH RECURSIVE {INCHES}, {BALANCE}, {CAFEC} SELECT cell, m AS period, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(gamma, 6) AS gamma, round(delta, 6) AS delta FROM cc")
def cafec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(palmer.cafec(palmer.water_balance(inches(spark, sf), K), K, YEARS), "alpha", "beta", "gamma", "delta", digits=6)


@query(f"WITH RECURSIVE {INCHES}, {BALANCE}, {CAFEC}, {ZED} SELECT dep.cell, {TIME.replace('(y', '(dep.y').replace('m, 1', 'dep.m, 1')}, round(17.67 * k / n * d, {DIGITS}) AS z FROM dep JOIN kk ON kk.cell = dep.cell AND kk.m = dep.m JOIN kn ON kn.cell = dep.cell")
def palmer_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(palmer.palmer(inches(spark, sf), K, YEARS).select("cell", "time", "z"), "z")


_M, _B = palmer.default_factors()
#: The spell recursion month by month (st), then backwards what the open months became (bk), then the last queue (sl).
#: `ev` says how a month ends: g the spell goes on, W1 and D1 one begins, W and D only one side is left, o it stays open.
SPELLS = f"""zz AS MATERIALIZED (SELECT i.cell, i.y, i.m, i.idx, i.pad, 17.67 * kk.k / kn.n * dep.d AS z FROM inch i LEFT JOIN dep ON dep.cell = i.cell AND dep.idx = i.idx LEFT JOIN kk ON kk.cell = i.cell AND kk.m = i.m LEFT JOIN kn ON kn.cell = i.cell),
st AS (
 SELECT cell, -1 AS idx, 0::DOUBLE AS v, 0::DOUBLE AS ch, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS x3, 0::DOUBLE AS x, 0 AS q0, 0 AS q, '' AS ev FROM (SELECT DISTINCT cell FROM zz)
 UNION ALL
 SELECT cell, idx, nv, nch, CASE WHEN ev IN ('g', 'W1') THEN 0 ELSE g1 END, CASE WHEN ev IN ('g', 'W1', 'D1') THEN 0 ELSE g2 END,
  CASE ev WHEN 'W1' THEN g1 WHEN 'D1' THEN g2 ELSE n3 END, CASE ev WHEN 'W1' THEN g1 WHEN 'W' THEN g1 WHEN 'D1' THEN g2 WHEN 'D' THEN g2 ELSE n3 END, q, CASE WHEN ev = 'o' THEN q + 1 ELSE 0 END, ev
 FROM (SELECT *, CASE WHEN how = 'g' THEN 'g' WHEN n3 = 0 AND g1 >= 1 THEN 'W1' WHEN n3 = 0 AND g2 <= -1 THEN 'D1' WHEN n3 = 0 AND g1 <> 0 AND g2 = 0 THEN 'W' WHEN n3 = 0 AND g1 = 0 THEN 'D' ELSE 'o' END AS ev
 FROM (SELECT *, CASE WHEN how = 'w' THEN w ELSE 0 END AS nv, CASE WHEN how = 'g' THEN sp WHEN how = 'w' THEN CASE WHEN nch >= 100 THEN 0 ELSE sp END ELSE 0 END AS n3, greatest(0, coalesce(up1, 0)) AS g1, least(0, coalesce(up2, 0)) AS g2
 FROM (SELECT *, CASE WHEN how <> 'w' THEN 0 WHEN w / (need + CASE WHEN ch = 100 THEN 0 ELSE v END) * 100 >= 100 THEN 100 ELSE w / (need + CASE WHEN ch = 100 THEN 0 ELSE v END) * 100 END AS nch
 FROM (SELECT *, CASE WHEN first = 'w' AND ((dry AND w <= 0) OR (NOT dry AND w >= 0)) THEN 'g' ELSE first END AS how, CASE WHEN dry THEN -{_B!r} * x3 - 0.5 * {_M + _B!r} ELSE -{_B!r} * x3 + 0.5 * {_M + _B!r} END AS need,
  {_B!r} / {_M + _B!r} * x3 + z / {_M + _B!r} AS sp, {_B!r} / {_M + _B!r} * x1 + z / {_M + _B!r} AS up1, {_B!r} / {_M + _B!r} * x2 + z / {_M + _B!r} AS up2
 FROM (SELECT *, CASE WHEN dry THEN z + 0.15 + greatest(v, 0) ELSE z - 0.15 + least(v, 0) END AS w
 FROM (SELECT zz.cell, zz.idx, zz.z, v, ch, x1, x2, x3, q, CASE WHEN ch IN (0, 100) AND x3 BETWEEN -0.5 AND 0.5 THEN 'b' WHEN ch IN (0, 100) AND ((x3 > 0.5 AND z >= 0.15) OR (x3 < -0.5 AND z <= -0.15)) THEN 'g' ELSE 'w' END AS first,
  coalesce(CASE WHEN ch IN (0, 100) THEN x3 < -0.5 ELSE x3 <= 0 END, false) AS dry FROM st JOIN zz ON zz.cell = st.cell AND zz.idx = st.idx + 1)))))) AS months),
se AS MATERIALIZED (SELECT * FROM st WHERE idx >= 0),
bk AS (
 SELECT cell, max(idx) + 1 AS idx, 'N' AS md, NULL::DOUBLE AS val FROM se GROUP BY cell
 UNION ALL
 SELECT cell, idx, nmd, CASE WHEN ev <> 'o' THEN x WHEN nmd = 'S' THEN x3 WHEN nmd = 'W' THEN x1 WHEN nmd = 'D' THEN x2 END
 FROM (SELECT se.*, CASE WHEN ev = 'g' THEN 'S' WHEN ev IN ('W1', 'W') THEN 'W' WHEN ev IN ('D1', 'D') THEN 'D' WHEN md = 'W' AND x1 = 0 THEN 'D' WHEN md = 'D' AND x2 = 0 THEN 'W' ELSE md END AS nmd FROM bk JOIN se ON se.cell = bk.cell AND se.idx = bk.idx - 1)),
lq AS (SELECT cell, max(idx) AS fin, coalesce(max_by(q, idx) FILTER (WHERE ev = 'o'), 0) AS longest FROM se GROUP BY cell),
sl AS (SELECT se.cell, se.q0, max(se.idx) AS idx FROM se JOIN lq ON lq.cell = se.cell WHERE se.q0 < lq.longest GROUP BY se.cell, se.q0),
pv AS (SELECT se.cell, se.idx, se.x3 AS own, CASE WHEN sl.idx IS NULL THEN bk.val ELSE se.x END AS val, n.ch, n.x1, n.x2, n.x3 FROM se JOIN bk ON bk.cell = se.cell AND bk.idx = se.idx JOIN lq ON lq.cell = se.cell LEFT JOIN sl ON sl.cell = se.cell AND sl.idx = se.idx JOIN se n ON n.cell = se.cell AND n.idx = CASE WHEN sl.idx IS NULL THEN se.idx ELSE lq.fin END),
pf AS (SELECT zz.cell, zz.y, zz.m, zz.z, val AS pdsi, CASE WHEN own = 0 THEN val ELSE own END AS phdi,
 CASE WHEN x3 = 0 THEN CASE WHEN abs(x1) > abs(x2) THEN x1 ELSE x2 END WHEN ch <= 0 OR ch >= 100 THEN x3 ELSE (1 - ch / 100) * x3 + ch / 100 * CASE WHEN x3 <= 0 THEN x1 ELSE x2 END END AS pmdi
 FROM pv JOIN zz ON zz.cell = pv.cell AND zz.idx = pv.idx WHERE NOT zz.pad)"""


def _palmer_sql(*columns: str) -> str:
    return f"WITH RECURSIVE {INCHES}, {BALANCE}, {CAFEC}, {ZED}, {SPELLS} SELECT cell, {TIME}, {', '.join(f'round({c}, {DIGITS}) AS {c}' for c in columns)} FROM pf"


def _palmer(column: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(palmer.palmer(inches(spark, sf), K, YEARS).select("cell", "time", column), column)

    return run


for _name in ("pdsi", "phdi", "pmdi"):
    QUERIES[_name], ORACLES[_name] = _palmer(_name), _palmer_sql(_name)


@query(_palmer_sql("pdsi", "phdi", "pmdi", "z"))
def pdsi_given(spark: SparkSession, sf: str) -> DataFrame:
    """The Palmer indices with coefficients of an earlier run."""
    df = inches(spark, sf)
    return rounded(palmer.palmer(df, K, YEARS, given=palmer.cafec(palmer.water_balance(df, K), K, YEARS)), "pdsi", "phdi", "pmdi", "z")


def zed(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for Z: how far a month's rain is from the cell's mean.

    A hundredth is rounded as the SQL does it, by its binary value; `round` to two digits goes by the decimal one, which says
    otherwise of halves.
    """
    away = F.col("value") - F.avg("value").over(series.by_keys(K))
    return rain(spark, sf).select("cell", "time", (F.round(away * 100) / 100).alias("z"))


@query(f"""WITH {RAIN}, q AS (SELECT cell, y * 12 + m AS t, round(v - avg(v) OVER (PARTITION BY cell), 2) AS z FROM raw),
w AS (SELECT cell, CASE WHEN count(z) OVER k = 6 THEN sum(z) OVER k END AS s FROM q WINDOW k AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
a AS (SELECT cell, min(s) AS dry, list_sort(list(s)) AS l FROM w WHERE s IS NOT NULL GROUP BY cell)
SELECT cell, round(coalesce(list_max(list_filter(l, lambda x: x > 0 AND x / l[floor(0.98 * len(l))::INT] < 1.25)), 0), 4) AS wet, round(dry, 4) AS dry FROM a""")
def extreme_z_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.extreme_sums(zed(spark, sf), K, (6,)).drop("length"), "wet", "dry")


_SPELL_LENGTHS = ", ".join(f"({n})" for n in calibration.LENGTHS)


@query(f"""WITH {RAIN}, q AS (SELECT cell, y * 12 + m AS t, round(v - avg(v) OVER (PARTITION BY cell), 2) AS z FROM raw),
c AS (SELECT cell, row_number() OVER k AS i, sum(z) OVER k AS c FROM q WINDOW k AS (PARTITION BY cell ORDER BY t)),
w AS (SELECT a.cell, n.n, a.c - coalesce(b.c, 0) AS s FROM c a CROSS JOIN (VALUES {_SPELL_LENGTHS}) AS n(n) LEFT JOIN c b ON b.cell = a.cell AND b.i = a.i - n.n WHERE a.i >= n.n),
l AS (SELECT cell, n, min(s) AS dry, list_sort(list(s)) AS l FROM w GROUP BY cell, n),
e AS (SELECT cell, n, dry, coalesce(list_max(list_filter(l, lambda x: x > 0 AND x / l[floor(0.98 * len(l))::INT] < 1.25)), 0) AS wet FROM l),
p AS (SELECT cell, 1 AS sign, n AS x, wet AS y, row_number() OVER (PARTITION BY cell ORDER BY n) AS i FROM e UNION ALL SELECT cell, -1, n, dry, row_number() OVER (PARTITION BY cell ORDER BY n) FROM e),
r AS (SELECT cell, sign, k.k, regr_slope(y, x) AS slope, corr(y, x) AS r FROM p JOIN range(4, 11) AS k(k) ON i <= k.k GROUP BY ALL),
b AS (SELECT cell, sign, coalesce(max(k) FILTER (WHERE sign * r >= 0.85), 4) AS k FROM r GROUP BY cell, sign),
f AS (SELECT b.cell, b.sign, r.slope, max(b.sign * (y - slope * x)) AS far FROM b JOIN r ON r.cell = b.cell AND r.sign = b.sign AND r.k = b.k JOIN p ON p.cell = b.cell AND p.sign = b.sign AND p.i <= b.k GROUP BY ALL),
o AS (SELECT cell, sign, slope / (4 * sign) AS m, CASE WHEN far > 0 THEN sign * far ELSE -slope * {calibration.LENGTHS[0]} END / (4 * sign) AS b FROM f)
SELECT cell, round(max(m) FILTER (WHERE sign = 1), 4) AS wet_m, round(max(b) FILTER (WHERE sign = 1), 4) AS wet_b, round(max(m) FILTER (WHERE sign = -1), 4) AS dry_m, round(max(b) FILTER (WHERE sign = -1), 4) AS dry_b FROM o GROUP BY cell""")
def duration_factors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.duration_factors(zed(spark, sf), K), "wet_m", "wet_b", "dry_m", "dry_b")


# Diagnostics and extension -----------------------------------------------------------------------------------------


@query(f"WITH {RAIN} SELECT cell, count(DISTINCT y) AS n_years, count(v) AS n_present, round(avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END), 6) AS missing_share, count(DISTINCT y) < 30 AS is_short, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) > 0.2 AS has_gaps FROM d WHERE {CALIB} GROUP BY cell")
def calibration_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.calibration_quality(series.densify(rain(spark, sf), K), K, calibration=YEARS), "missing_share", digits=6)


@query(f"WITH {RAIN} SELECT cell, round(count(v) / 12, 6) AS years, count(CASE WHEN v IS NULL THEN 1 END) AS n_missing, count(CASE WHEN v IS NULL THEN 1 END) = 0 OR count(v) / 12 >= 30 AS enough FROM d WHERE NOT pad GROUP BY cell")
def effective_years(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.effective_years(series.densify(rain(spark, sf), K), K), "years", digits=6)


@query(f"WITH {RAIN}, {_less(150)}, {sums_sql(1, source='dz')}, {PEARSON} SELECT cell, count(CASE WHEN scale = 0 AND skew = 0 THEN 1 END) AS failed, count(*) AS periods, round(count(CASE WHEN scale = 0 AND skew = 0 THEN 1 END) / count(*), 6) AS share FROM pp GROUP BY cell")
def failed_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The share of periods without a Pearson fit, in series that are mostly 0."""
    return rounded(fitting.failed_share(fitting.pearson_fit(_summed(spark, sf, 1, 150.0), K, calibration=YEARS), K), "share", digits=6)


@query(f"WITH {RAIN}, {sums_sql(3)} SELECT cell, {TIME} FROM s WHERE v IS NULL AND y < 1996 AND NOT pad")
def missing_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Missing input whose result isn't missing: here sums whose gaps before 1996 were filled."""
    summed = series.trim(series.trailing_sum(series.densify(rain(spark, sf), K), K, "value", 3))
    filled = summed.withColumn("filled", F.when(F.year("time") < 1996, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
    return diagnostics.missing_kept(summed, filled, ["cell", "time"], "value", "filled").select("cell", "time")


@query(f"WITH {RAIN} SELECT cell, min(y) AS first_year, max(y) AS last_year, count(*) AS steps, 'monthly' AS periodicity FROM raw GROUP BY cell")
def infer_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return extend.infer(rain(spark, sf), K)


@extend.series_index("anomaly")
def _anomaly(values):
    return values - values.mean()


@query(f"WITH {RAIN} SELECT cell, {TIME}, round(v - avg(v) OVER (PARTITION BY cell), 4) AS anomaly FROM raw")
def lifted_function(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_anomaly(rain(spark, sf), K), "anomaly")
