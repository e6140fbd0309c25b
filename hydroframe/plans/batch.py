"""Command line: python -m hydroframe.plans.batch --index spi --scales 3 6 --precip in.parquet --out out ..."""

from __future__ import annotations

import argparse
import logging
import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.errors import InvalidArgument
from hydroframe.operators import fitting, indices, palmer, pet, series
from hydroframe.sources import tables

LOG = logging.getLogger(__name__)
CHOICES = ["spi", "spei", "pnp", "eddi", "scaled", "pet", "palmers", "all"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--index", choices=CHOICES, required=True)
    p.add_argument("--scales", type=int, nargs="*", default=[])
    p.add_argument("--distributions", nargs="*", default=["gamma", "pearson"], choices=["gamma", "pearson"])
    p.add_argument("--periodicity", default="monthly", choices=["monthly", "daily"])
    p.add_argument("--calibration", type=int, nargs=2)
    p.add_argument("--keys", nargs="*", default=["lat", "lon"])
    p.add_argument("--time", default="time")
    for name, column in (("precip", "prcp"), ("temp", "tavg"), ("pet", "pet"), ("awc", "awc")):
        p.add_argument(f"--{name}", nargs="*", help=f"tables with the column --{name}_column")
        p.add_argument(f"--{name}_column", default=column)
        p.add_argument(f"--{name}_units", default="celsius" if name == "temp" else "mm")
    p.add_argument("--latitude_column", default="lat")
    p.add_argument("--out", required=True)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--save_params")
    p.add_argument("--load_params")
    p.add_argument("--names", default="padded", choices=["padded", "month"], help="spi_gamma_03 or spi_gamma_3_month")
    p.add_argument("--separate", action="store_true", help="the four Palmer variables as tables of their own")
    p.add_argument("--files", type=int, help="files to write for each table")
    p.add_argument("--partition_by", nargs="*", help="columns to partition the tables by")
    p.add_argument("--check", action="store_true", help="look for short series, repeated times and calibrations outside the data first")
    return p


def needs(index: str) -> list[str]:
    return {"spi": ["precip"], "pnp": ["precip"], "spei": ["precip", "pet"], "eddi": ["pet"], "scaled": ["precip", "pet"], "pet": ["temp"], "palmers": ["precip", "pet", "awc"], "all": ["precip", "pet", "awc"]}[index]


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Writes one table for each variable and returns them by name; evapotranspiration is derived where only temperature is given."""
    keys, time = args.keys, args.time
    calibration = tuple(args.calibration) if args.calibration else None
    for scale in args.scales:
        series.check_scale(scale)

    def load(name: str) -> DataFrame | None:
        paths = getattr(args, name)
        if not paths:
            return None
        column, unit = getattr(args, f"{name}_column"), getattr(args, f"{name}_units")
        if name == "awc":
            return spark.read.parquet(*paths).select(*keys, F.col(column).alias("awc"))
        return tables.read_series(spark, paths, {name: column}, keys, time, units={name: unit})

    have = {n: load(n) for n in ("precip", "temp", "pet", "awc")}
    if have["pet"] is None and have["temp"] is not None:
        lat = args.latitude_column
        with_lat = have["temp"] if lat in keys else have["temp"].join(spark.read.parquet(*args.temp).select(*keys, lat).distinct(), keys)
        have["pet"] = pet.thornthwaite(with_lat.withColumn("_latitude", F.col(lat).cast("double")), keys, "_latitude", time, "temp")
    if missing := [n for n in needs(args.index) if n != "temp" and have[n] is None] + (["temp"] if args.index == "pet" and have["temp"] is None else []):
        raise InvalidArgument(f"--index {args.index} needs {', '.join('--' + m for m in missing)}", "index", args.index)
    if args.index not in ("pet", "palmers") and not args.scales:
        raise InvalidArgument("--scales are needed", "scales")
    every = args.index == "all"
    named = lambda *x: tables.variable_name(*x, style=args.names)
    water = have["precip"].join(have["pet"], [*keys, time]) if have["precip"] is not None and have["pet"] is not None else None
    out: dict[str, DataFrame] = {}
    for scale in args.scales:
        for kind in args.distributions:
            if args.index in ("spi", "scaled") or every:
                params = tables.load_params(spark, args.load_params, kind).where(F.col("accumulation") == scale) if args.load_params else None
                out[named("spi", kind, scale)] = indices.spi(have["precip"], keys, scale, kind, time, "precip", args.periodicity, calibration, params, check=args.check)
            if args.index in ("spei", "scaled") or every:
                out[named("spei", kind, scale)] = indices.spei(water, keys, scale, kind, time, "precip", "pet", args.periodicity, calibration, check=args.check)
        if args.index in ("pnp", "scaled") or every:
            out[named("pnp", None, scale)] = indices.pnp(have["precip"], keys, scale, time, "precip", args.periodicity, calibration, check=args.check)
        if args.index == "eddi":
            out[named("eddi", None, scale)] = indices.eddi(have["pet"], keys, scale, time, "pet", args.periodicity, calibration, check=args.check)
    if args.index == "pet":
        out["pet_thornthwaite"] = have["pet"]
    if args.index == "palmers" or every:
        if calibration is None:
            raise InvalidArgument("--calibration is needed for the Palmer indices", "calibration")
        out["palmer"] = palmer.palmer(water.join(have["awc"], keys), keys, calibration, time, "precip", "pet", "awc", "mm")
    if args.save_params and args.index in ("spi", "scaled", "all"):
        tables.save_params(fit(have["precip"], keys, args.scales, time, "precip", args.periodicity, calibration), args.save_params, args.overwrite)
    for name, df in out.items():
        four = {"pdsi": "pdsi", "phdi": "phdi", "pmdi": "pmdi", "z": "zindex"} if name == "palmer" and args.separate else {}
        for part, table in {c: df.select(*keys, time, c) for c in four}.items() if four else [(name, df)]:
            _write(table, four.get(part, name), args)
    return out


def _write(df: DataFrame, name: str, args: argparse.Namespace) -> None:
    """One line in the log when a table is begun, and one when it is done or has failed."""
    began = clock.time()
    LOG.info("%s: begun", name)
    try:
        tables.write_index(df, f"{args.out}/{name}", args.partition_by, args.overwrite, args.files, name)
    except Exception:
        LOG.exception("%s: failed after %.1f s", name, clock.time() - began)
        raise
    LOG.info("%s: done in %.1f s", name, clock.time() - began)


def fit(df: DataFrame, keys: list[str], scales: list[int], time: str = "time", value: str = "value", periodicity: str = "monthly", calibration: tuple[int, int] | None = None) -> DataFrame:
    """All parameters of all scales in one table, by keys, period and `accumulation`."""
    dense = series.clip_negative(series.densify(df, keys, time, (value,), periodicity), keys, value)
    out = None
    for scale in scales:
        summed = series.trailing_sum(dense, keys, value, scale)
        one = fitting.gamma_fit(summed, keys, value, calibration).join(fitting.pearson_fit(summed, keys, value, calibration), [*keys, "period"], "full_outer").withColumn("accumulation", F.lit(scale))
        out = one if out is None else out.unionByName(one)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("indices").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
