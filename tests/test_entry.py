"""The registered queries against their SQL, at the smallest scale factor."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def own(name):
    return not name.startswith("op") and name != "pipeline"


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if own(n)))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).sort_values(columns, ignore_index=True, key=lambda s: s.astype(str)) for x in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f":
            assert a[c].astype(float).sub(b[c].astype(float)).abs().max() < 2e-3 or a[c].equals(b[c])


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if own(n) and n not in entry.oracle_sql()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_cell_and_year(spark, duck):
    """The daily queries cover all cells and years."""
    got = entry.queries()["pet_hargreaves"](spark, SF).groupBy("cell").count().collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute("SELECT l_linenumber, count(DISTINCT l_shipdate::DATE) FROM lineitem GROUP BY 1").fetchall())
    for name, where in (("pci_reference", "true"), ("pci_calendar", "true"), ("invented_leap_days", "year % 4 <> 0")):
        want = duck.execute(f"SELECT cell, year FROM (SELECT DISTINCT l_linenumber AS cell, year(l_shipdate) AS year FROM lineitem) WHERE {where}").fetchall()
        got = entry.queries()[name](spark, SF).toPandas()
        assert sorted(zip(got["cell"], got["year"], strict=True)) == sorted(want) and got.notna().all(axis=None)


def test_align_of_many_cells(spark, tmp_path):
    spark.sql("select id l_suppkey, timestamp '1996-01-05' l_shipdate, 2D l_quantity from range(1200)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select timestamp '1996-01-07' o_orderdate, 50000D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert entry.queries()["align_inner"](spark, str(tmp_path)).count() == 1200


def test_entry(spark):
    assert entry.entry(spark).columns == ["cell", "time", "spi"]


def test_halves_of_a_hundredth(spark, tmp_path):
    """Z of series whose mean leaves each month with half a hundredth."""
    rng, rows = random.Random(11), []
    for cell in range(1, 13):
        rain = [rng.randrange(300) for _ in range(79)]
        rain.append(302 - sum(rain) % 80)  # the mean is a whole number and 1/40
        rows += [(cell, dt.datetime(1995 + m // 12, m % 12 + 1, 1), float(v)) for m, v in enumerate(rain)]
    path = f"{tmp_path}/lineitem.parquet"
    pd.DataFrame(rows, columns=["l_suppkey", "l_shipdate", "l_quantity"]).astype({"l_shipdate": "datetime64[us]"}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}'")
    for name, least in (("extreme_z_sum", 1e-9), ("duration_factors", 1.1e-4)):  # a fifth digit of 5 may be rounded either way
        got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        a, b = (x[sorted(got.columns)].sort_values("cell", ignore_index=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=least)
