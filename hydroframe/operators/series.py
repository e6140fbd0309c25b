"""Long-format series: cleaning, densifying, aligning, trailing sums.

A series is rows of (location keys, time, value); a missing value is NULL, and NaN is turned into it on the way in.  All
operators keep keys and time and add columns.  Everything that looks along a series partitions by the keys, so a plan has
one exchange on them, which also serves the windows by keys and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydroframe.errors import CoordinateError, InputTypeError, InvalidArgument
from hydroframe.functions.calendar import Periodicity, date_of, is_leap, period_of
from hydroframe.functions.expr import missing_as_null

MIN_SCALE, MAX_SCALE = 1, 72
#: Rows of each side that meet in a block of match_within, and how many pairs a task looks at, about.
BLOCK, PAIRS = 2000, 20_000_000


def check_frame(df: DataFrame, *columns: str) -> None:
    """Raises where the input is no DataFrame or lacks columns; says what other libraries' frames need."""
    if not hasattr(df, "sparkSession"):
        hint = {"pandas": "spark.createDataFrame(frame)", "polars": "spark.createDataFrame(frame.to_pandas())", "xarray": "spark.createDataFrame(data.to_dataframe().reset_index())", "numpy": "a frame of time and value"}
        root = type(df).__module__.split(".")[0]
        raise InputTypeError(f"expected a Spark DataFrame, got {type(df).__name__}" + (f"; use {hint[root]}" if root in hint else ""))
    if absent := [c for c in columns if c not in df.columns]:
        raise CoordinateError(f"columns {absent} are missing; there are {df.columns}")


def check_scale(scale: int) -> int:
    if isinstance(scale, bool) or not isinstance(scale, int) or not MIN_SCALE <= scale <= MAX_SCALE:
        raise InvalidArgument(f"scale {scale!r} is not a whole number from {MIN_SCALE} to {MAX_SCALE}", "scale", scale, f"{MIN_SCALE}..{MAX_SCALE}")
    return scale


def by_keys(keys: list[str], *more: str):
    return W.partitionBy(*[F.col(k) for k in keys], *[F.col(m) for m in more])


def densify(df: DataFrame, keys: list[str], time: str = "time", values: tuple[str, ...] = ("value",), periodicity: str | Periodicity = "monthly") -> DataFrame:
    """Whole years of periods for each cell, from January of its first year; adds year, period, idx and pad.

    Steps between the first January and the last row that have no row are missing; those after the last row are padding
    (`pad`), which counts where whole years count, and `trim` removes it.  Rows with the same step are not combined.
    Daily series use years of 366 days; where there are no such days, 29 February is the mean of its neighbours.
    """
    check_frame(df, *keys, time, *values)
    periodicity = Periodicity.of(periodicity)
    n = periodicity.steps
    slot = F.year(time) * n + period_of(F.col(time), periodicity).cast("int")
    rows = df.select(*keys, slot.alias("_slot"), *[missing_as_null(F.col(v)).alias(v) for v in values]).where("_slot is not null")
    # Each row also makes the steps up to the next one, the first row those before it and the last those after it.  All that
    # needs is the order within a cell, so there is one exchange by the keys, and the windows of an index reuse it.
    w = by_keys(keys).orderBy("_slot")
    rows = rows.withColumns({"_before": F.lag("_slot").over(w), "_after": F.lead("_slot").over(w), "_origin": F.min(F.floor((F.col("_slot") - 1) / n)).over(by_keys(keys)).cast("int")})
    own_year = F.floor((F.col("_slot") - 1) / n).cast("int")
    first = F.when(F.col("_before").isNull(), own_year * n + 1).otherwise(F.col("_slot"))
    last = F.when(F.col("_after").isNull(), own_year * n + n).otherwise(F.greatest(F.col("_after") - 1, F.col("_slot")))
    full = rows.withColumn("_s", F.explode(F.sequence(first, last)))
    year = F.floor((F.col("_s") - 1) / n).cast("int")
    full = full.withColumns({v: F.when(F.col("_s") == F.col("_slot"), F.col(v)) for v in values})
    full = full.select(*keys, year.alias("year"), (F.col("_s") - year * n).alias("period"), (F.col("_after").isNull() & (F.col("_s") > F.col("_slot"))).alias("pad"), (F.col("_s") - F.col("_origin") * n - 1).alias("idx"), *values)
    if periodicity is Periodicity.daily:
        w = by_keys(keys).orderBy("idx")
        invented = (F.col("period") == 60) & ~is_leap(F.col("year"))
        full = full.withColumns({v: F.when(invented, (F.lag(v).over(w) + F.lead(v).over(w)) / 2).otherwise(F.col(v)) for v in values})
    return full


def trim(df: DataFrame, time: str = "time", periodicity: str | Periodicity = "monthly") -> DataFrame:
    """Removes padding and invented days, and puts the time back."""
    periodicity = Periodicity.of(periodicity)
    return df.where("not pad").withColumn(time, date_of(F.col("year"), F.col("period"), periodicity)).where(F.col(time).isNotNull()).drop("pad", "idx")


def clip_negative(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Negative values become 0 in series without missing steps (padding aside); others stay as they are."""
    w = by_keys(keys)
    whole = F.count(F.when(F.col(value).isNull() & ~F.col("pad"), 1)).over(w) == 0
    return df.withColumn(value, F.when(whole & (F.col(value) < 0), F.lit(0.0)).otherwise(F.col(value)))


def trailing_sum(df: DataFrame, keys: list[str], value: str, scale: int, out: str | None = None) -> DataFrame:
    """The sum of the last `scale` steps; missing where any of them is missing or before the first of them."""
    check_scale(scale)
    if scale == 1:
        return df.withColumn(out or value, F.col(value))
    w = by_keys(keys).orderBy("idx").rowsBetween(-(scale - 1), 0)
    return df.withColumn(out or value, F.when(F.count(value).over(w) == scale, F.sum(value).over(w)))


def align(a: DataFrame, b: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Rows of both at the same cell and time (inner join)."""
    check_frame(a, *keys, time)
    check_frame(b, *keys, time)
    return a.join(b, [*keys, time], "inner")


def dropped(a: DataFrame, b: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """How many rows of each side have no partner: a diagnostic query."""
    on = [*keys, time]
    left = a.join(b, on, "left_anti").agg(F.count("*").alias("only_left"))
    right = b.join(a, on, "left_anti").agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)


def snap(df: DataFrame, columns: list[str], steps: dict[str, float]) -> DataFrame:
    """Coordinates as whole numbers of a tenth of the grid step, so that nearly equal ones join by equality."""
    return df.withColumns({f"{c}_snap": F.round(F.col(c) / (steps[c] / 10)).cast("long") for c in columns})


def match_within(a: DataFrame, b: DataFrame, columns: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Rows of both whose coordinates differ by at most the tolerance each; those of `b` are named with `_other`.

    Coordinates are dealt to cells of the tolerance's size; a row of `b` goes to its own cell and those beside it.  The pairs of
    a cell grow as a product, so its rows are dealt to blocks by their hash, each of which meets each block of the other side,
    and there are as many tasks as the pairs ask for: counting them is a job of its own.  Rows equal in all columns share a block.
    """
    x, y = a, b.select(*[F.col(c).alias(f"{c}_other") for c in b.columns])
    for c in columns:
        x = x.withColumn(f"_{c}", F.floor(F.col(c) / tolerance[c]))
        y = y.withColumn(f"_{c}", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> floor(`{c}_other` / {tolerance[c]!r}D) + d)")))
    cells = [f"_{c}" for c in columns]
    size = x.groupBy(*cells).agg(F.count("*").alias("_m")).join(y.groupBy(*cells).agg(F.count("*").alias("_n")), cells)
    tasks = 1 + int((size.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0) // PAIRS)
    size = size.withColumns({n: F.ceil(F.col(n) / BLOCK) for n in ("_m", "_n")})

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and c not in cells])
        df = df.withColumn("_row", row).join(size, cells).withColumn(i, F.pmod("_row", own)).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.drop("_row", "_m", "_n").repartition(tasks, *cells, "_i", "_j")

    near = dealt(x, "_m", "_n", "_i", "_j").join(dealt(y, "_n", "_m", "_j", "_i"), [*cells, "_i", "_j"]).drop("_i", "_j")
    for c in columns:
        near = near.where(F.abs(F.col(c) - F.col(f"{c}_other")) <= tolerance[c]).drop(f"_{c}")
    return near


def same_coordinates(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Coordinates that only one of the two has; empty if they agree."""
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    return x.exceptAll(y).withColumn("only_in", F.lit("a")).union(y.exceptAll(x).withColumn("only_in", F.lit("b")))


def calibration_years(df: DataFrame, keys: list[str], first: int, last: int) -> Column:
    """True in calibration years; a period that starts before the data or ends over a year after it means all years."""
    w = by_keys(keys)
    low, high = F.min("year").over(w), F.max("year").over(w)
    silly = (F.lit(first) < low) | (F.lit(last) > high + 1)
    return silly | F.col("year").between(first, last)
