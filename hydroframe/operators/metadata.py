"""Names, units and sources of the results, kept as column metadata."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame

#: long_name, units, reference.
KNOWN = {
    "spi": ("Standardized Precipitation Index", "1", "McKee et al. 1993"),
    "spei": ("Standardized Precipitation Evapotranspiration Index", "1", "Vicente-Serrano et al. 2010"),
    "eddi": ("Evaporative Demand Drought Index", "1", "Hobbins et al. 2016"),
    "pnp": ("Percent of Normal Precipitation, as a ratio", "1", "Willeke et al. 1994"),
    "pci": ("Precipitation Concentration Index", "1", "Oliver 1980"),
    "pet": ("Potential Evapotranspiration", "mm", "Thornthwaite 1948"),
    "pet_hargreaves": ("Potential Evapotranspiration", "mm day-1", "Hargreaves and Samani 1985"),
    "eto": ("Reference Evapotranspiration", "mm day-1", "Allen et al. 1998"),
    "pdsi": ("Palmer Drought Severity Index", "1", "Palmer 1965"),
    "phdi": ("Palmer Hydrological Drought Index", "1", "Palmer 1965"),
    "pmdi": ("Palmer Modified Drought Index", "1", "Heddinghaus and Sabol 1991"),
    "z": ("Palmer Z-Index", "1", "Palmer 1965"),
}


def describe(df: DataFrame, column: str, index: str, note: str = "") -> DataFrame:
    """The frame with what is known about `index` attached to `column`, and a dated line added to its history."""
    old = df.schema[column].metadata or {}
    name, units, source = KNOWN[index]
    line = f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}: {index} {note}".strip()
    history = "\n".join(filter(None, [old.get("history"), line]))
    return df.withMetadata(column, {**old, "long_name": name, "units": units, "references": source, "history": history})
