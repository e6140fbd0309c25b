"""A data source for netCDF files of the classic formats (CDF-1, CDF-2, CDF-5), without any library for them.

`spark.read.format("netcdf")` with the options `paths` (a JSON list), `variables` and `keys` (JSON lists of names) and `time`
gives rows of keys, time and one double for each variable.  Every variable has the same dimensions, each with a coordinate
variable of its name.  A file is read in slices along the variables' first dimension, one task for each.  Files of the
HDF5-based format are told apart by their first bytes; they are an error here.  `cells` is how many values of a variable a
task takes (a million unless given).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

#: Fixed values of the format: type codes with their big-endian NumPy types.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: np.dtype
    begin: int
    stride: int  #: bytes from one index of the first dimension to the next
    attributes: dict


def opened(path: str):
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


class Header:
    """The dimensions, attributes and variables of a file."""

    def __init__(self, file):
        self.file = file
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a netCDF file of a classic format" + ("; it is an HDF5 file" if magic == b"\x89HDF" else ""))
        self.wide = magic[3] == 5
        self.offset = ">i" if magic[3] == 1 else ">q"
        records = self.number()
        dims = self.listed(lambda: (self.name(), self.number()))
        self.attributes = dict(self.listed(self.attribute))
        found = self.listed(lambda: (self.name(), [self.number() for _ in range(self.number())], dict(self.listed(self.attribute)), self.plain(">i"), self.number(), self.plain(self.offset)))
        rolling = {i for i, (_, n) in enumerate(dims) if n == 0}
        in_records = [v for v in found if v[1] and v[1][0] in rolling]
        self.variables: dict[str, Variable] = {}
        for name, ids, attributes, code, _, begin in found:
            shape = tuple(records if i in rolling else dims[i][1] for i in ids)
            kind = np.dtype(TYPES[code])
            stride = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
            if ids and ids[0] in rolling and len(in_records) > 1:  # the slabs of all record variables follow each other
                stride = sum(self.padded(np.dtype(TYPES[c]).itemsize * int(np.prod([dims[i][1] for i in d[1:]], dtype=np.int64))) for _, d, _, c, _, _ in in_records)
            self.variables[name] = Variable(tuple(dims[i][0] for i in ids), shape, kind, begin, stride, attributes)

    @staticmethod
    def padded(n: int) -> int:
        return -(-n // 4) * 4

    def plain(self, kind: str) -> int:
        return struct.unpack(kind, self.file.read(struct.calcsize(kind)))[0]

    def number(self) -> int:
        return self.plain(">q" if self.wide else ">i")

    def name(self) -> str:
        n = self.number()
        return self.file.read(self.padded(n))[:n].decode()

    def listed(self, item) -> list:
        self.plain(">i")  # the kind of the list, 0 if it is absent
        return [item() for _ in range(self.number())]

    def attribute(self) -> tuple[str, object]:
        name, code, n = self.name(), self.plain(">i"), self.number()
        kind = np.dtype(TYPES[code])
        data = self.file.read(self.padded(n * kind.itemsize))[: n * kind.itemsize]
        values = np.frombuffer(data, kind)
        return name, data.decode("utf-8", "replace") if code == 2 else values[0].item() if n == 1 else values.tolist()

    def values(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """A variable from `start` to `stop` along its first dimension; fill values are NaN, packed values are unpacked."""
        v = self.variables[name]
        stop = v.shape[0] if stop is None else stop
        width = v.kind.itemsize * int(np.prod(v.shape[1:], dtype=np.int64))
        if v.stride == width:
            raw = np.frombuffer(self.file.read_at((stop - start) * width, v.begin + start * width), v.kind)
        else:
            raw = np.frombuffer(b"".join(self.file.read_at(width, v.begin + i * v.stride) for i in range(start, stop)), v.kind)
        raw = raw.reshape(stop - start, *v.shape[1:])
        if v.kind.kind == "S":
            return np.array([b"".join(row.ravel().tolist()).decode().strip("\0 ") for row in raw], dtype=object)
        out = raw.astype(float)
        for fill in ("_FillValue", "missing_value"):
            if fill in v.attributes:
                out[raw == v.attributes[fill]] = np.nan
        return out * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)

    def times(self, name: str) -> pa.Array:
        """A time coordinate by its units, such as "days since 1900-01-01"; months are whole ones."""
        steps, units = self.values(name), str(self.variables[name].attributes.get("units", ""))
        found = re.match(r"(\w+?)s? since (\d+)-(\d+)-(\d+)", units)
        if not found or found[1] not in (*UNITS, "month"):
            raise ValueError(f"the time units {units!r} are not understood")
        year, month, day = map(int, found.groups()[1:])
        if found[1] == "month":
            whole = [(year * 12 + month - 1 + int(s)) for s in steps]
            return pa.array([dt.datetime(w // 12, w % 12 + 1, day, tzinfo=dt.UTC) for w in whole], pa.timestamp("us", "UTC"))
        start = dt.datetime(year, month, day, tzinfo=dt.UTC)
        return pa.array([start + dt.timedelta(seconds=round(s * UNITS[found[1]])) for s in steps.tolist()], pa.timestamp("us", "UTC"))


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _of(self, option: str) -> list[str]:
        return json.loads(self.options.get(option, "[]"))

    def schema(self) -> StructType:
        with opened(self._of("paths")[0]) as file:
            header = Header(file)
        text = {k for k in self._of("keys") if header.variables[k].kind.kind == "S"}
        keys = [StructField(k, StringType() if k in text else DoubleType()) for k in self._of("keys")]
        return StructType([*keys, StructField(self.options["time"], TimestampType()), *(StructField(v, DoubleType()) for v in self._of("variables"))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NetcdfReader(self._of("paths"), self._of("keys"), self.options["time"], self._of("variables"), schema, int(self.options.get("cells", 1 << 20)))


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    stop: int


class NetcdfReader(DataSourceReader):
    def __init__(self, paths: list[str], keys: list[str], time: str, variables: list[str], schema: StructType, cells: int):
        self.paths, self.keys, self.time, self.variables, self.names, self.cells = paths, keys, time, variables, schema.names, cells

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            with opened(path) as file:
                header = Header(file)
            several = {header.variables[v].dims for v in self.variables}
            if len(several) != 1 or set(next(iter(several))) != {*self.keys, self.time}:
                raise ValueError(f"the variables of {path} have the dimensions {sorted(several)}; needed are {[*self.keys, self.time]}")
            shape = header.variables[self.variables[0]].shape
            step = max(1, self.cells // max(1, int(np.prod(shape[1:], dtype=np.int64))))
            out += [Slice(path, at, min(shape[0], at + step)) for at in range(0, shape[0], step)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as file:
            header = Header(file)
            dims = header.variables[self.variables[0]].dims
            data = [header.values(v, partition.start, partition.stop) for v in self.variables]
            places = np.indices(data[0].shape)
            places[0] += partition.start
            columns = []
            for name in (*self.keys, self.time):
                at = places[dims.index(name)].ravel()
                known = header.times(name) if name == self.time else pa.array(header.values(name))
                columns.append(known.take(pa.array(at)))
            columns += [pa.array(d.ravel(), from_pandas=True) for d in data]
        table = pa.Table.from_arrays(columns, names=self.names)
        yield from table.to_batches(max_chunksize=100_000)
