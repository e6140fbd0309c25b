"""Classic netCDF files, written here byte by byte."""

import datetime as dt
import json
import struct

import numpy as np
import pytest

from hydroframe.sources import tables

CODES = {"i2": 3, "i4": 4, "f4": 5, "f8": 6, "S1": 2}


def pad(data):
    return data + b"\0" * (-len(data) % 4)


def write(path, dims, variables, version=1):
    """dims: name to length, None for the record dimension; variables: (name, dims, type, values, attributes)."""
    wide = ">q" if version == 5 else ">i"
    number = lambda n: struct.pack(wide, n)
    text = lambda s: number(len(s)) + pad(s.encode())
    records = max((len(v) for _, d, _, v, _ in variables if d and dims[d[0]] is None), default=0)

    def attribute(name, value):
        kind = "S1" if isinstance(value, str) else "f8" if isinstance(value, float) else "i2"
        data = value.encode() if kind == "S1" else np.array([value], ">" + kind).tobytes()
        return text(name) + struct.pack(">i", CODES[kind]) + number(len(value) if kind == "S1" else 1) + pad(data)

    def listed(tag, items):
        return struct.pack(">i", tag if items else 0) + number(len(items)) + b"".join(items)

    def header(begins):
        out = b"CDF" + bytes([version]) + number(records) + listed(10, [text(n) + number(size or 0) for n, size in dims.items()]) + listed(12, [attribute("title", "made up")])
        made = []
        for (name, d, kind, values, attributes), begin in zip(variables, begins, strict=True):
            size = len(pad(np.asarray(values[:1] if dims[d[0]] is None else values).astype(">" + kind if kind != "S1" else kind).tobytes()))
            made.append(text(name) + number(len(d)) + b"".join(number(list(dims).index(x)) for x in d) + listed(12, [attribute(*a) for a in attributes.items()]) + struct.pack(">i", CODES[kind]) + number(size) + struct.pack(">i" if version == 1 else ">q", begin))
        return out + listed(11, made)

    raw = [np.asarray(v).astype(">" + k if k != "S1" else k) for _, _, k, v, _ in variables]
    fixed = [dims[d[0]] is not None for _, d, _, _, _ in variables]
    begins, at = [0] * len(variables), len(header([0] * len(variables)))
    for turn in (True, False):
        for i, r in enumerate(raw):
            if fixed[i] == turn:
                begins[i], at = at, at + len(pad((r if turn else r[:1]).tobytes()))
    body = b"".join(pad(r.tobytes()) for r, f in zip(raw, fixed, strict=True) if f)
    rolling = [r for r, f in zip(raw, fixed, strict=True) if not f]
    body += b"".join((pad if len(rolling) > 1 else bytes)(r[k : k + 1].tobytes()) for k in range(records) for r in rolling)
    with open(path, "wb") as f:
        f.write(header(begins) + body)


@pytest.mark.parametrize(("version", "rolling"), [(1, True), (2, False), (5, True)])
def test_grid(spark, tmp_path, version, rolling):
    """Packed values with fill values over time, latitude and longitude; inches become millimetres."""
    rng = np.random.default_rng(version)
    packed = rng.integers(0, 500, (7, 2, 3))
    packed[3, 1, 2] = -99
    files = []
    for part, first in ((0, 0), (1, 7)):
        days = [(dt.date(1999, 1, 1) + dt.timedelta(31 * (k + first)) - dt.date(1990, 1, 1)).days for k in range(7)]
        path = f"{tmp_path}/{version}-{part}.nc"
        write(path, {"time": None if rolling else 7, "lat": 2, "lon": 3}, [
            ("time", ["time"], "i4", days, {"units": "days since 1990-01-01"}), ("lat", ["lat"], "f4", [10.5, 20.25], {}), ("lon", ["lon"], "f8", [1.0, 2.0, 3.0], {}),
            ("prcp", ["time", "lat", "lon"], "i2", packed + part, {"_FillValue": -99 + part, "scale_factor": 0.5}),
        ], version)
        files.append(path)
    df = tables.read_series(spark, [*files, files[0]], {"rain": "prcp"}, ["lat", "lon"], units={"rain": "inch"})
    assert df.columns == ["lat", "lon", "time", "rain"]
    options = {"paths": json.dumps(files), "keys": '["lat", "lon"]', "time": "time", "variables": '["prcp"]', "cells": "10"}
    slices = spark.read.format("netcdf").options(**options).load()
    assert slices.rdd.getNumPartitions() == 14 and sorted(r["prcp"] * 25.4 for r in slices.collect() if r["prcp"]) == sorted(r["rain"] for r in df.collect() if r["rain"])
    got = {(r["time"], r["lat"], r["lon"]): r["rain"] for r in df.collect()}
    for part in (0, 1):
        for t, i, j in np.ndindex(packed.shape):
            value = got.pop((dt.date(1999, 1, 1) + dt.timedelta(31 * (t + 7 * part)), [10.5, 20.25][i], j + 1.0))
            assert value is None if (t, i, j) == (3, 1, 2) else value == pytest.approx((packed[t, i, j] + part) * 0.5 * 25.4)
    assert not got


def test_divisions(spark, tmp_path):
    """Divisions by name, time last, in months."""
    path = f"{tmp_path}/d.nc"
    values = np.arange(8.0).reshape(2, 4)
    write(path, {"division": 2, "chars": 4, "time": 4}, [("division", ["division", "chars"], "S1", [list("0101"), list("0102")], {}), ("time", ["time"], "f8", [0, 1, 2, 3], {"units": "months since 1895-01-01"}), ("pet", ["division", "time"], "f8", values, {})])
    rows = tables.read_series(spark, path, {"pet": "pet"}, ["division"]).orderBy("division", "time").collect()
    assert [tuple(r) for r in rows] == [(f"010{d + 1}", dt.date(1895, m + 1, 1), values[d, m]) for d in range(2) for m in range(4)]
    with pytest.raises(Exception, match="chars"):
        tables.read_series(spark, path, {"pet": "pet"}, ["chars"]).collect()
    with open(f"{tmp_path}/h.nc", "wb") as f:
        f.write(b"\x89HDF\r\n")
    with pytest.raises(Exception, match="HDF5"):
        tables.read_series(spark, f"{tmp_path}/h.nc", {"pet": "pet"}, ["division"]).collect()
