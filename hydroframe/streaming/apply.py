"""New months against parameters that were fitted before: the incremental use of a standardised index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydroframe.functions.calendar import Periodicity, period_of
from hydroframe.functions.expr import missing_as_null
from hydroframe.operators.fitting import with_gamma_z, with_pearson_z
from hydroframe.operators.indices import current_names
from hydroframe.operators.series import check_scale


def trailing_sums(stream: DataFrame, keys: list[str], scale: int, time: str = "time", value: str = "value") -> DataFrame:
    """The stream with each value replaced by the sum of its cell's last `scale` monthly steps.

    Each cell's state is its last steps.  Rows of a batch are put in order; a step that comes after a later one is dropped.
    Steps that were left out count as missing.
    """
    check_scale(scale)
    rows = stream.select(*keys, F.col(time).cast("date").alias(time), missing_as_null(F.col(value)).alias(value))

    def work(_: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        data = pd.concat(list(parts)).sort_values(time)
        out = []
        for row in data.itertuples(index=False):
            day = pd.Timestamp(getattr(row, time))
            month, v = day.year * 12 + day.month, getattr(row, value)
            if last is not None and month <= last:
                continue
            values = (values + [float("nan")] * (min(scale, month - last - 1) if last is not None else 0) + [float(v) if v is not None else float("nan")])[-scale:]
            last = month
            total = sum(values) if len(values) == scale else float("nan")
            out.append([*(getattr(row, k) for k in keys), getattr(row, time), None if total != total else total])
        state.update((last, values))
        yield pd.DataFrame(out, columns=[*keys, time, value])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*keys).applyInPandasWithState(work, schema, "last long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def apply_params(sums: DataFrame, params: DataFrame, keys: list[str], distribution: str = "gamma", time: str = "time", value: str = "value", out: str = "spi") -> DataFrame:
    """keys, time, `out` for each row of accumulated values (a stream or a table), by a join with the static parameters."""
    params = current_names(params)
    rows = sums.withColumn("period", period_of(F.col(time), Periodicity.monthly)).join(params, [*keys, "period"], "left")
    return (with_gamma_z if distribution == "gamma" else with_pearson_z)(rows, value, out).select(*keys, time, out)
