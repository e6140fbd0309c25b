"""Reading series and writing indices and parameters as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.errors import CoordinateError, InvalidArgument
from hydroframe.functions.expr import in_units, missing_as_null
from hydroframe.operators.indices import current_names
from hydroframe.operators.metadata import KNOWN, describe
from hydroframe.sources.netcdf import NetcdfSource

GAMMA, PEARSON = ["alpha", "beta"], ["prob_zero", "loc", "scale", "skew"]


def read_series(spark: SparkSession, paths: str | list[str], columns: dict[str, str], keys: list[str], time: str = "time", file_format: str | None = None, units: dict[str, str] | None = None) -> DataFrame:
    """keys, time and one column for each of `columns` (name to source column); only these are read.

    Paths may repeat.  The format follows from the first path's ending unless given.  Values come in mm or degrees Celsius.
    """
    several = sorted({paths} if isinstance(paths, str) else set(paths))
    file_format = file_format or ("csv" if several[0].endswith((".csv", ".csv.gz")) else "orc" if several[0].endswith(".orc") else "netcdf" if several[0].endswith(".nc") else "parquet")
    if file_format == "netcdf":
        df = _netcdf(spark, several, columns, keys, time)
        return df.select(*keys, F.to_date(time).alias(time), *[in_units(missing_as_null(F.col(n)), (units or {}).get(n, "mm")).alias(n) for n in columns])
    df = spark.read.options(header=True, inferSchema=True).csv(several) if file_format == "csv" else spark.read.format(file_format).load(several)
    if absent := [c for c in (*keys, time, *columns.values()) if c not in df.columns]:
        raise CoordinateError(f"columns {absent} are missing; there are {df.columns}")
    return df.select(*keys, F.to_date(time).alias(time), *[in_units(missing_as_null(F.col(c)), (units or {}).get(n, "mm")).alias(n) for n, c in columns.items()])


def _netcdf(spark: SparkSession, paths: list[str], columns: dict[str, str], keys: list[str], time: str) -> DataFrame:
    """Classic files by the data source of this package, one task for each slice of a file."""
    spark.dataSource.register(NetcdfSource)
    options = {"paths": json.dumps(paths), "keys": json.dumps(keys), "variables": json.dumps(list(columns.values())), "time": time}
    df = spark.read.format("netcdf").options(**options).load()
    return df.select(*keys, time, *[F.col(c).alias(n) for n, c in columns.items()])


def join_series(parts: list[DataFrame], keys: list[str], time: str = "time") -> DataFrame:
    """Several variables side by side; a step that one lacks is missing there."""
    out = parts[0]
    for other in parts[1:]:
        out = out.join(other, [*keys, time], "full_outer")
    return out


def save_params(params: DataFrame, path: str, overwrite: bool = False) -> None:
    params.write.mode("overwrite" if overwrite else "error").parquet(path)


def load_params(spark: SparkSession, path: str, distribution: str) -> DataFrame:
    """A parameter table; raises where it lacks what the distribution needs."""
    params = current_names(spark.read.parquet(path))
    if absent := [c for c in ["period", *(GAMMA if distribution == "gamma" else PEARSON)] if c not in params.columns]:
        raise CoordinateError(f"parameters {absent} are missing in {path}; there are {params.columns}")
    return params


def variable_name(index: str, distribution: str | None, scale: int | None, style: str = "padded") -> str:
    """Names of result variables: spi_gamma_03, pnp_03, pet_thornthwaite; with the style "month", spi_gamma_3_month."""
    if style not in ("padded", "month"):
        raise InvalidArgument(f"unknown style {style}", "style", style, "padded, month")
    step = None if not scale else f"{scale:02d}" if style == "padded" else f"{scale}_month"
    return "_".join(x for x in (index, distribution, step) if x)


def write_index(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False, files: int | None = None, note: str = "") -> None:
    """Writes a table whose result columns carry their names, units, references and history as metadata."""
    for column in df.columns:
        if column in KNOWN:
            df = describe(df, column, column, note)
    out = df if files is None else df.repartition(files)
    out = out.write.mode("overwrite" if overwrite else "error")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
