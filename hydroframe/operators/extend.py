"""Lifts a function of NumPy series to DataFrames of many cells."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.errors import CoordinateError, ShapeError
from hydroframe.operators.series import by_keys, check_frame


def series_index(name: str, inputs: tuple[str, ...] = ("value",), skipna: bool = False) -> Callable:
    """Decorator: f(array, ..., **options) -> array becomes g(df, keys, time="time", **options) -> keys, time, `name`.

    `inputs` names the columns that f takes, in order; each may be given another column by its name, e.g. pet="pet_mm".
    Options `start_year` and `calibration` are filled in from each cell's data where f takes them and they are not given.
    """
    if skipna:
        raise NotImplementedError("missing values are part of a series; drop them before or handle them in the function")

    def lift(f: Callable) -> Callable:
        takes = f.__code__.co_varnames[: f.__code__.co_argcount + f.__code__.co_kwonlyargcount]

        @functools.wraps(f)
        def over(df: DataFrame, keys: list[str], time: str = "time", **options: object) -> DataFrame:
            columns = [str(options.pop(i, i)) for i in inputs]
            check_frame(df, *keys, time, *columns)

            def work(data: pd.DataFrame) -> pd.DataFrame:
                data = data.sort_values(time, ignore_index=True)
                years, own = pd.to_datetime(data[time]).dt.year, dict(options)
                if "start_year" in takes:
                    own.setdefault("start_year", int(years.iloc[0]))
                if "calibration" in takes:
                    own.setdefault("calibration", (int(years.iloc[0]), int(years.iloc[-1])))
                got = np.asarray(f(*(data[c].to_numpy(float) for c in columns), **own), dtype=float)
                if got.shape != (len(data),):
                    raise ShapeError(f"{f.__name__} gave {got.shape} for {len(data)} steps")
                return data[[*keys, time]].assign(**{name: got})

            schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.select(*keys, time).schema)
            done = df.select(*keys, time, *dict.fromkeys(columns)).groupBy(*keys).applyInPandas(work, f"{schema}, `{name}` double")
            return done.withColumn(name, F.when(~F.isnan(name), F.col(name)))

        return over

    return lift


def infer(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """keys, first and last year, steps and periodicity (monthly, daily or null) of each cell; three steps are needed.

    The shortest step decides, so that missing ones don't matter: a day, or a month with no month twice.
    """
    months, w = F.year(time) * 12 + F.month(time), by_keys(keys).orderBy(time)
    rows = df.select(*keys, F.col(time).alias("_t"), F.datediff(time, F.lag(time).over(w)).alias("_days"), (months - F.lag(months).over(w)).alias("_months"))
    days = F.min("_days")
    kind = F.when(F.count("*") < 3, None).when(days == 1, "daily").when(days.between(28, 31) & (F.min("_months") >= 1), "monthly")
    return rows.groupBy(*keys).agg(F.year(F.min("_t")).alias("first_year"), F.year(F.max("_t")).alias("last_year"), F.count("*").alias("steps"), kind.alias("periodicity"))


def require(df: DataFrame, keys: list[str], scale: int, time: str = "time") -> None:
    """Raises where a cell has fewer steps than `scale`, or the same time twice; runs one aggregate."""
    short, twice = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(time).alias("d")).agg(F.count_if(F.col("n") < scale), F.count_if(F.col("d") < F.col("n"))).first()
    if short:
        raise ShapeError(f"{short} cells have fewer than {scale} steps")
    if twice:
        raise CoordinateError(f"{twice} cells have a time more than once")
