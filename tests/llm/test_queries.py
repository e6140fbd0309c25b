"""The registered queries at the smallest scale factor: against their SQL, or for what SQL can't say against the contract."""

import duckdb
import numpy as np
import pytest

from hydroframe.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want) > 0
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).sort_values(columns, ignore_index=True, key=lambda s: s.astype(str)) for x in (got, want))
    assert a.equals(b)


def test_language_of_held_out_rows(spark):
    """Learned on two thirds of the rows, right on nearly all others."""
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op5_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and 250 < len(held) < 420
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_quality_keeps_good_rows(spark):
    """No row labelled good that passes the base rules goes, and some labelled bad do."""
    sf = "/root/testdata/sf0.1"
    got = catalog.QUERIES["op4_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    rest = got[~got.base_failed]
    assert rest[rest.quality == 1].kept.all() and (~rest[rest.quality == 0].kept).sum() > 50


def test_packing_leaves_little_padding(spark):
    got = catalog.QUERIES["op10_packing"](spark, "/root/testdata/sf0.1").toPandas()
    windows = got.groupby("sequence_id").agg(length=("length", "sum"), end=("offset", "max"))
    assert windows.length.max() <= 4096
    assert windows.length.sum() / (4096 * len(windows)) > 0.97
    per_doc = got.groupby("doc_id").agg(length=("length", "sum"), total=("doc_tokens", "first"))
    assert np.array_equal(per_doc.length, per_doc.total)
