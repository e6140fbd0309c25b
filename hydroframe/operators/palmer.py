"""The Palmer indices: soil water balance, CAFEC coefficients, Z, and the spell recursion.

Both folds go month by month through one cell, so they run grouped by the keys, one cell's series at a time in a worker;
what lies between them (coefficients, weights) is a few numbers for each month of the year.  Depths are in inches inside.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.errors import InvalidArgument, ShapeError
from hydroframe.operators.series import densify, trim

SURFACE = 1.0  #: inches that the upper layer holds
FLOWS = ["sp", "pl", "pr", "r", "tl", "et", "ro"]


def default_factors() -> tuple[float, float]:
    """Slope and intercept of Palmer's duration factors, from p = 0.897 and q = 1/3."""
    return (1.0 - 0.897) * 3.0, 0.897 * 3.0


def carry(m: float, b: float) -> float:
    if m + b == 0:
        raise ShapeError("slope and intercept of the duration factors must not sum to zero")
    return b / (m + b)


def drawn(need: float, upper: float, under: float, capacity: float) -> tuple[float, float]:
    """What a need takes from the layers: the upper one gives all it can, the lower one as the `capacity` is full by it."""
    first = min(upper, need)
    return first, min(under, (need - first) * under / capacity) if under else 0.0


def balance(p: np.ndarray, pet: np.ndarray, awc: float) -> dict[str, np.ndarray]:
    """Flows of the two-layer balance for consecutive months, both layers full at first.

    A month whose rain or demand is missing empties both layers.
    """
    below = max(awc - SURFACE, 0.0)
    size = SURFACE + below
    upper, under, rows = SURFACE, below, []
    for rain, demand in zip(p.tolist(), pet.tolist(), strict=True):
        held = upper + under
        can_lose = held if math.isnan(demand) else sum(drawn(demand, upper, under, size))
        if math.isnan(rain - demand):
            rows.append((held, can_lose, size - held, 0.0, held, rain + held, 0.0))
            upper = under = 0.0
            continue
        surplus, short = max(rain - demand, 0.0), max(demand - rain, 0.0)
        to_upper = min(surplus, SURFACE - upper)
        to_under = min(surplus - to_upper, below - under)
        from_upper, from_under = drawn(short, upper, under, awc)
        rows.append((held, can_lose, size - held, to_upper + to_under, from_upper + from_under, min(rain, demand) + from_upper + from_under, surplus - to_upper - to_under))
        upper, under = upper + to_upper - from_upper, under + to_under - from_under
    return dict(zip(FLOWS, np.array(rows).reshape(-1, len(FLOWS)).T, strict=True))


def share(part: np.ndarray, whole: np.ndarray, both_zero: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(whole != 0, part / np.where(whole != 0, whole, 1.0), np.where(part == 0, both_zero, 0.0))


def by_month(x: np.ndarray, pick: slice) -> np.ndarray:
    return x.reshape(-1, 12)[pick].sum(axis=0)


def coefficients(flows: dict[str, np.ndarray], pet: np.ndarray, years: slice) -> dict[str, np.ndarray]:
    s = {k: by_month(v, years) for k, v in flows.items()}
    demand = by_month(pet, years)
    return {"alpha": share(s["et"], demand, 1.0), "beta": share(s["r"], s["pr"], 1.0), "gamma": share(s["ro"], s["sp"], 1.0), "delta": share(s["tl"], s["pl"], 0.0)}


def z_index(p: np.ndarray, pet: np.ndarray, flows: dict[str, np.ndarray], c: dict[str, np.ndarray], years: slice) -> np.ndarray:
    n = p.size // 12
    of = lambda k: np.tile(c[k], n)
    expected = of("alpha") * pet + of("beta") * flows["pr"] + of("gamma") * flows["sp"] - of("delta") * flows["pl"]
    departure = p - expected
    s = {k: by_month(v, years) for k, v in flows.items()}
    with np.errstate(all="ignore"):
        ratio = (by_month(pet, years) + s["r"] + s["ro"]) / (by_month(p, years) + s["tl"])
        mean = by_month(np.abs(departure), years) / (years.stop - years.start)
        weight = 1.5 * np.log10((ratio + 2.8) / mean) + 0.5
        weight = 17.67 * weight / np.sum(mean * weight)
    return np.tile(weight, n) * departure


def blend(chance: float, wet: float, dry: float, spell: float) -> float:
    """The value for a month in near-real time: the spell's, weighted with that of its possible successor."""
    if spell == 0:
        return wet if abs(wet) > abs(dry) else dry
    if chance <= 0 or chance >= 100:
        return spell
    return (1.0 - chance / 100) * spell + chance / 100 * (wet if spell <= 0 else dry)


class Spells:
    """The month-by-month recursion.  Months whose spell is not decided yet wait in `open` and are settled backwards."""

    def __init__(self, z: np.ndarray, wet: tuple[float, float], dry: tuple[float, float]):
        self.z, self.wet, self.dry = z, wet, dry
        n = z.size
        self.x, self.x1, self.x2, self.x3, self.chance = (np.zeros(n) for _ in range(5))
        self.pdsi, self.phdi, self.pmdi = (np.full(n, np.nan) for _ in range(3))
        self.open: list[int] = []
        self.slots: dict[int, int] = {}  # the last month that was met while so many months were open
        self.longest = 0  # months that were open when one was last added
        self.was = (0.0, 0.0, 0.0, 0.0, 0.0)  # moisture towards an end, its chance, and the three values of the month before
        for t in range(n):
            self.slots[len(self.open)] = t
            self.moisture = 0.0
            self.month(t)
            self.was = (self.moisture, self.chance[t], self.x1[t], self.x2[t], self.x3[t])
        self.close()

    def grown(self, t: int, value: float, factors: tuple[float, float]) -> float:
        return carry(*factors) * value + self.z[t] / sum(factors)

    def of_spell(self, t: int) -> float:
        spell = self.was[4]
        return self.grown(t, spell, self.wet if spell >= 0 else self.dry)

    def month(self, t: int) -> None:
        _, chance, _, _, spell = self.was
        z = self.z[t]
        if chance in (0, 100):
            if -0.5 <= spell <= 0.5:
                return self.begin(t)
            if (spell > 0.5 and z >= 0.15) or (spell < -0.5 and z <= -0.15):
                return self.go_on(t)
            dry = spell < -0.5
        else:
            dry = spell <= 0
        self.weaken(t, dry)

    def weaken(self, t: int, dry: bool) -> None:
        before, chance, _, _, spell = self.was
        m, b = self.dry if dry else self.wet
        if dry:
            self.moisture = self.z[t] + 0.15 + max(before, 0.0)
            goes_on, needed = self.moisture <= 0, -b * spell - 0.5 * (m + b)
        else:
            self.moisture = self.z[t] - 0.15 + min(before, 0.0)
            goes_on, needed = self.moisture >= 0, -b * spell + 0.5 * (m + b)
        if goes_on:
            return self.go_on(t)
        with np.errstate(all="ignore"):
            self.chance[t] = np.float64(self.moisture) / np.float64(needed if chance == 100 else needed + before) * 100
        if self.chance[t] >= 100:
            self.chance[t] = 100
        else:
            self.x3[t] = self.of_spell(t)
        self.begin(t)

    def go_on(self, t: int) -> None:
        self.moisture = 0.0
        self.x3[t] = self.x[t] = self.of_spell(t)
        self.settle(t, [self.x3[k] for k in self.open])

    def begin(self, t: int) -> None:
        """New spells of either kind; the first to reach 1 becomes the spell if there is none."""
        _, _, wet, dry, _ = self.was
        none = self.x3[t] == 0
        self.x1[t] = max(0, self.grown(t, wet, self.wet))
        if none and self.x1[t] >= 1:
            self.x[t] = self.x3[t] = self.x1[t]
            self.x1[t] = 0.0
            return self.settle(t, self.back(True))
        self.x2[t] = min(0.0, self.grown(t, dry, self.dry))
        if none and self.x2[t] <= -1:
            self.x[t] = self.x3[t] = self.x2[t]
            self.x2[t] = 0.0
            return self.settle(t, self.back(False))
        if none and (self.x1[t] == 0 or self.x2[t] == 0):
            is_wet = self.x1[t] != 0
            self.x[t] = self.x1[t] if is_wet else self.x2[t]
            return self.settle(t, self.back(is_wet))
        self.x[t] = self.x3[t]
        self.open.append(t)
        self.longest = len(self.open)
        return None

    def back(self, is_wet: bool) -> list[float]:
        """Values of the open months, from the last to the first: of one kind until it is 0, then of the other."""
        out = []
        for k in reversed(self.open):
            if (self.x1 if is_wet else self.x2)[k] == 0:
                is_wet = not is_wet
            out.append((self.x1 if is_wet else self.x2)[k])
        return out[::-1]

    def settle(self, t: int, values: list[float]) -> None:
        for k, value in zip([*self.open, t], [*values, self.x[t]], strict=True):
            self.put(k, value, k)
        self.open = []

    def put(self, t: int, value: float, now: int) -> None:
        self.pdsi[t] = value
        self.phdi[t] = value if self.x3[t] == 0 else self.x3[t]
        self.pmdi[t] = blend(self.chance[now], self.x1[now], self.x2[now], self.x3[now])

    def close(self) -> None:
        """The months in the slots of the last queue take their own value, and the last month's blend."""
        for k in range(self.longest):
            t = self.slots[k]
            self.put(t, self.x[t], self.z.size - 1)


def _years(data: pd.DataFrame, calibration: tuple[int, int]) -> slice:
    first = int(data["year"].iloc[0])
    return slice(max(0, calibration[0] - first), calibration[1] - first + 1)


def _inches(units: str) -> float:
    if units not in ("inch", "mm"):
        raise InvalidArgument(f"unknown unit {units}", "units", units, "inch, mm")
    return 1.0 if units == "inch" else 1 / 25.4


def _dense(df: DataFrame, keys: list[str], time: str, precip: str, pet: str, awc: str, units: str) -> DataFrame:
    site = df.groupBy(*keys).agg(F.first(awc, True).cast("double").alias("_awc"))
    dense = densify(df, keys, time, (precip, pet))
    by = _inches(units)
    w = dense.withColumns({"_p": F.col(precip) * by, "_e": F.col(pet) * by}).select(*keys, "year", "period", "idx", "pad", "_p", "_e")
    return w.join(site, keys, "inner") if keys else w.crossJoin(site)


def _arrays(data: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    p, pet = data["_p"].to_numpy(float).copy(), data["_e"].to_numpy(float)
    real = p[~data["pad"].to_numpy(bool)]
    if not np.isnan(real).any() and (real < 0).any():
        p = np.clip(p, 0.0, None)
    return p, pet


def water_balance(df: DataFrame, keys: list[str], time: str = "time", precip: str = "prcp", pet: str = "pet", awc: str = "awc", units: str = "inch") -> DataFrame:
    """keys, time and the seven flows of each month (inches); `awc` is a column with one value for each cell."""
    dense = _dense(df, keys, time, precip, pet, awc, units)

    def work(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("idx", ignore_index=True)
        p, e = _arrays(data)
        return data[[*keys, "year", "period", "idx", "pad"]].assign(p=p, e=e, **balance(p, e, float(data["_awc"].iloc[0])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dense.schema if f.name in [*keys, "year", "period", "idx", "pad"])
    return dense.groupBy(*keys).applyInPandas(work, schema + ", p double, e double, " + ", ".join(f"{c} double" for c in FLOWS))


def cafec(flows: DataFrame, keys: list[str], calibration: tuple[int, int]) -> DataFrame:
    """keys, period, alpha, beta, gamma, delta from a water balance, as sums over the calibration years."""
    s = flows.where(F.col("year").between(*calibration)).groupBy(*keys, "period").agg(*[F.sum(c).alias(c) for c in ("e", *FLOWS)])
    ratio = lambda a, b, zero: F.when(F.col(b) != 0, F.col(a) / F.col(b)).when(F.col(a) == 0, F.lit(zero)).otherwise(F.lit(0.0))
    return s.select(*keys, "period", ratio("et", "e", 1.0).alias("alpha"), ratio("r", "pr", 1.0).alias("beta"), ratio("ro", "sp", 1.0).alias("gamma"), ratio("tl", "pl", 0.0).alias("delta"))


def palmer(df: DataFrame, keys: list[str], calibration: tuple[int, int], time: str = "time", precip: str = "prcp", pet: str = "pet", awc: str = "awc", units: str = "inch", given: DataFrame | None = None, wet: tuple[float, float] | None = None, dry: tuple[float, float] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """keys, time, pdsi, phdi, pmdi, z for each month.

    `given` holds CAFEC coefficients (keys, period, alpha, beta, gamma, delta) of an earlier run; a cell uses its own if
    it has not all twelve there.  `factors` holds duration factors of the cells (keys, wet_m, wet_b, dry_m, dry_b); where a
    cell has none there, or where they don't sum to more than 0, `wet` and `dry` hold, by default Palmer's own.  A cell
    without any precipitation is missing throughout.
    """
    dense = _dense(df, keys, time, precip, pet, awc, units)
    if given is not None:
        lists = given.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", "alpha", "beta", "gamma", "delta"))).alias("_c"))
        dense = dense.join(lists, keys, "left") if keys else dense.crossJoin(lists)
    if factors is not None:
        own = factors.select(*keys, *[F.when(F.col(f"{x}_m") + F.col(f"{x}_b") > 0, F.array(f"{x}_m", f"{x}_b")).alias(f"_{x}") for x in ("wet", "dry")])
        dense = dense.join(own, keys, "left") if keys else dense.crossJoin(own)
    wet, dry, has_factors = wet or default_factors(), dry or default_factors(), factors is not None
    names = [f.name for f in dense.schema if f.name in keys]
    has_given = given is not None

    def work(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("idx", ignore_index=True)
        p, e = _arrays(data)
        out = data[[*names, "year", "period", "idx", "pad"]]
        if np.isnan(p).all():
            return out.assign(pdsi=np.nan, phdi=np.nan, pmdi=np.nan, z=np.nan)
        flows = balance(p, e, float(data["_awc"].iloc[0]))
        years, c = _years(data, calibration), None
        if has_given:
            found = data["_c"].iloc[0]
            if found is not None and len(found) == 12:
                c = {k: np.array([row[k] for row in found], dtype=float) for k in ("alpha", "beta", "gamma", "delta")}
        z = z_index(p, e, flows, c or coefficients(flows, e, years), years)
        own = {x: data[f"_{x}"].iloc[0] if has_factors else None for x in ("wet", "dry")}
        s = Spells(z, *(tuple(own[x]) if own[x] is not None else fixed for x, fixed in (("wet", wet), ("dry", dry))))
        return out.assign(pdsi=s.pdsi, phdi=s.phdi, pmdi=s.pmdi, z=z)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dense.schema if f.name in [*keys, "year", "period", "idx", "pad"])
    done = dense.groupBy(*keys).applyInPandas(work, schema + ", pdsi double, phdi double, pmdi double, z double")
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("pdsi", "phdi", "pmdi", "z")}
    return trim(done.withColumns(clean), time).select(*keys, time, "pdsi", "phdi", "pmdi", "z")
