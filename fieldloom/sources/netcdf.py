"""NetCDF classic files (CDF-1, CDF-2, CDF-5) as a Spark data source and sink, without a third package.

The header of a file says where each variable's values of a time begin, so a scan is split by times and
rows of the grid, and filters on those reach it: only the bytes of times and rows that may pass are read.
The driver reads headers and axes alone. Files are opened by pyarrow, which knows local and mounted
folders and the usual object stores; any other store needs a mount.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Values that a task of a scan reads, in bytes of the file, and values that a task of a sink writes.
PARTITION_BYTES, WRITTEN_VALUES = 8 << 20, 4 << 20
#: Rows of a batch that a scan hands to Spark.
BATCH = 1 << 16

# Fixed values of the format: types by number, tags of the header's lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
CHAR, INT, DOUBLE = 2, 4, 6

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- header ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Variable:
    """Where values of a variable are: those of index i of the first dimension begin at begin + i * stride."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    begin: int
    stride: int
    attributes: dict

    def read(self, file: pa.NativeFile, first: int = 0, skip: int = 0, count: int | None = None) -> np.ndarray:
        """`count` values (all by default) of index `first` of the first dimension, `skip` values left out."""
        size = np.dtype(self.dtype).itemsize
        if count is None:
            count = int(np.prod(self.shape[1:], dtype=np.int64))
        found = file.read_at(count * size, self.begin + first * self.stride + skip * size)
        if len(found) < count * size:
            raise ValueError("the file ends before its values do")
        return np.frombuffer(found, self.dtype)

    def axis(self, file: pa.NativeFile) -> np.ndarray:
        """All values of a variable of one dimension."""
        return np.concatenate([self.decoded(self.read(file, i)) for i in range(self.shape[0])]) if self.stride != np.dtype(self.dtype).itemsize else self.decoded(self.read(file, count=self.shape[0]))

    def decoded(self, raw: np.ndarray) -> np.ndarray:
        """Doubles: unpacked by scale_factor and add_offset; _FillValue and missing_value are NaN."""
        gone = np.zeros(len(raw), bool)
        for name in ("_FillValue", "missing_value"):
            for mark in np.atleast_1d(self.attributes.get(name, ())):
                gone |= raw == mark
        values = raw.astype(np.float64)
        if {"scale_factor", "add_offset"} & self.attributes.keys():
            values = values * float(np.ravel(self.attributes.get("scale_factor", 1.0))[0]) + float(np.ravel(self.attributes.get("add_offset", 0.0))[0])
        return np.where(gone, np.nan, values)


class _Header:
    """The fields of a header in order; bytes are read as they are needed."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.held, self.at = file, b"", 0
        magic = self.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file (CDF-1, CDF-2 or CDF-5)")
        self.version = magic[3]

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.held):
            more = self.file.read_at(max(8192, self.at + n - len(self.held)), len(self.held))
            if not more:
                raise ValueError("the file ends within its header")
            self.held += more
        self.at += n
        return self.held[self.at - n : self.at]

    def tag(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.version == 5 else struct.unpack(">i", self.take(4))[0]

    def offset(self) -> int:
        return self.tag() if self.version == 1 else struct.unpack(">q", self.take(8))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self, tag: int) -> range:
        found, n = self.tag(), self.count()
        if found not in (0, tag) or (not found and n):
            raise ValueError("a list of the header has an unknown tag")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTES):
            name, kind, n = self.name(), self.tag(), self.count()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace") if kind == CHAR else np.frombuffer(raw, TYPES[kind])
        return out


def header(file: pa.NativeFile) -> dict[str, Variable]:
    """The variables of an open file by name."""
    h = _Header(file)
    records = h.count()
    dims = [(h.name(), h.count()) for _ in h.items(DIMENSIONS)]
    h.attributes()
    found = []
    for _ in h.items(VARIABLES):
        name = h.name()
        of = [dims[h.count()] for _ in range(h.count())]
        attributes, kind = h.attributes(), TYPES[h.tag()]
        h.count()  # the size as written, which may overflow
        found.append((name, of, attributes, kind, h.offset()))
    inner = {name: int(np.prod([n for _, n in of[1:] if n], dtype=np.int64)) * np.dtype(kind).itemsize for name, of, _, kind, _ in found}
    of_records = [(name, begin) for name, of, _, _, begin in found if of and of[0][1] == 0]
    # a lone record variable isn't padded
    record = inner[of_records[0][0]] if len(of_records) == 1 else sum(inner[n] + -inner[n] % 4 for n, _ in of_records)
    if records == -1 and of_records:
        records = (file.size() - min(begin for _, begin in of_records)) // record
    out = {}
    for name, of, attributes, kind, begin in found:
        recorded = bool(of) and of[0][1] == 0
        shape = tuple(records if i == 0 and recorded else n for i, (_, n) in enumerate(of))
        out[name] = Variable(tuple(d for d, _ in of), shape, kind, begin, record if recorded else inner[name], attributes)
    return out


def timestamps(time: np.ndarray, attributes: dict) -> np.ndarray | None:
    """Microseconds since 1970 of times in seconds to days since a date; None for other units and calendars."""
    found = re.fullmatch(r"(second|minute|hour|day)s? since (\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{1,2}(?::\d{1,2})?)(?:\.0*)?)?(?: ?(?:Z|UTC|\+?0?0:?00))?", str(attributes.get("units", "")).strip().rstrip("\0"))
    if not found or str(attributes.get("calendar", "standard")).lower().rstrip("\0") not in ("standard", "gregorian", "proleptic_gregorian"):
        return None
    day = [int(x) for x in found[2].split("-")]
    clock = [int(x) for x in (found[3] or "0:0").split(":")]
    start = datetime(*day, *clock, tzinfo=timezone.utc).timestamp()
    return np.round((start + np.nan_to_num(time) * _SECONDS[found[1]]) * 1e6).astype(np.int64)


# --- scan ------------------------------------------------------------------------------------------


@dataclass
class _File:
    path: str
    variables: list[Variable]
    time: np.ndarray
    ts: np.ndarray | None
    latitude: np.ndarray
    longitude: np.ndarray


@dataclass
class Part(InputPartition):
    """Times (indices in the file, order over all files, value, timestamp) and rows of a file."""

    path: str
    variables: list[Variable]
    steps: list[tuple[int, int, float, int | None]]
    first: int
    latitude: np.ndarray
    longitude: np.ndarray

    def n_bytes(self) -> int:
        values = len(self.steps) * len(self.latitude) * len(self.longitude)
        return values * sum(np.dtype(v.dtype).itemsize for v in self.variables)


_COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: lambda x, y: np.isin(x, list(y))}


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], axes: tuple[str, str, str], size: int):
        self.path, self.names, self.axes, self.size = path, names, axes, size
        self.asked: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:  # noqa: N802
        """Filters on times and rows choose what is read. Spark still applies all."""
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("time",), ("t",), ("ts",), ("lat_idx",), ("latitude",)):
                self.asked.append((f.attribute[0], f))
        return filters

    def _passing(self, column: str, values: np.ndarray) -> np.ndarray:
        """Which values of an axis may pass the filters on it."""
        passing = np.ones(len(values), bool)
        for name, f in self.asked:
            if name != column:
                continue
            wanted = f.value
            if column == "ts":
                if not isinstance(wanted, datetime) or wanted.tzinfo is None:
                    continue
                wanted = round((wanted - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6)
            passing &= _COMPARED[type(f)](values, wanted) | np.isnan(values.astype(np.float64))
        return passing

    def _file(self, path: str) -> _File:
        store, name = _place(path)
        with store.open_input_file(name) as file:
            found = header(file)
            missing = [n for n in (*self.names, *self.axes) if n not in found]
            if missing:
                raise ValueError(f"{path} has no variable {missing[0]!r}")
            chosen = [found[n] for n in self.names]
            for n, v in zip(self.names, chosen, strict=True):
                if v.dims != self.axes:
                    raise ValueError(f"{n!r} in {path} has the dimensions {v.dims}, not {self.axes}")
            time, latitude, longitude = (found[n].axis(file) for n in self.axes)
            return _File(path, chosen, time, timestamps(time, found[self.axes[0]].attributes), latitude, longitude)

    def _files(self) -> list[_File]:
        store, name = _place(self.path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        paths = [self.path]
        if info.type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(name))
            paths = [f"{self.path.rstrip('/')}/{n}" for n in sorted(i.base_name for i in inside if i.is_file and i.base_name.endswith(".nc"))]
        with ThreadPoolExecutor(16) as pool:
            files = list(pool.map(self._file, paths))
        for f in files[1:]:
            if not (np.array_equal(f.latitude, files[0].latitude, equal_nan=True) and np.array_equal(f.longitude, files[0].longitude, equal_nan=True)):
                raise ValueError(f"{f.path} has another grid than {files[0].path}")
        return files

    def partitions(self) -> Sequence[InputPartition]:
        files = self._files()
        if not files:
            return [Part(self.path, [], [], 0, np.empty(0), np.empty(0))]
        dated = all(f.ts is not None for f in files)
        order = np.unique(np.concatenate([f.ts if dated else f.time for f in files]))
        rows = np.flatnonzero(self._passing("lat_idx", np.arange(len(files[0].latitude))) & self._passing("latitude", files[0].latitude))
        out = []
        for f in files:
            t = np.searchsorted(order, f.ts if dated else f.time)
            passing = self._passing("time", f.time) & self._passing("t", t)
            passing &= self._passing("ts", f.ts) if f.ts is not None else True
            steps = [(int(i), int(t[i]), float(f.time[i]), None if f.ts is None else int(f.ts[i])) for i in np.flatnonzero(passing)]
            if not steps or not len(rows) or not len(f.longitude):
                continue
            a_row = len(f.longitude) * sum(np.dtype(v.dtype).itemsize for v in f.variables)
            first, end = int(rows[0]), int(rows[-1]) + 1
            height = min(end - first, max(1, self.size // a_row))
            times = max(1, self.size // (a_row * (end - first)))
            out += [Part(f.path, f.variables, steps[i : i + times], r, f.latitude[r : min(r + height, end)], f.longitude) for i in range(0, len(steps), times) for r in range(first, end, height)]
        return out or [Part(self.path, [], [], 0, np.empty(0), np.empty(0))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.steps:
            return
        width, height = len(part.longitude), len(part.latitude)
        columns = ["cell_id", "lat_idx", "lon_idx", "t", "time", "ts", "latitude", "longitude", *self.names]
        store, name = _place(part.path)
        with store.open_input_file(name) as file:
            for step, t, time, ts in part.steps:
                values = [v.decoded(v.read(file, step, part.first * width, height * width)) for v in part.variables]
                for at in range(0, height * width, BATCH):
                    i, j = np.divmod(np.arange(at, min(at + BATCH, height * width)), width)
                    n, lat, lon = len(i), part.latitude[i], part.longitude[j]
                    fixed = [pa.array((part.first + i) * width + j, pa.int64()), pa.array(part.first + i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(np.full(n, time), mask=np.full(n, np.isnan(time)))]
                    stamp = pa.array(np.full(n, ts or 0), pa.timestamp("us", "UTC"), mask=np.full(n, ts is None or np.isnan(time)))
                    doubles = [pa.array(x, mask=np.isnan(x)) for x in (lat, lon, *(v[at : at + BATCH] for v in values))]
                    yield pa.RecordBatch.from_arrays([*fixed, stamp, *doubles], columns)


class NetcdfClassic(DataSource):
    """Options: path (a file, or a folder whose .nc files are read), variables, time, latitude, longitude (names of the axes), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _names(self) -> list[str]:
        return [v.strip() for v in self.options.get("variables", "sla").split(",")]

    def schema(self) -> str:
        return ", ".join(["cell_id long, lat_idx int, lon_idx int, t int, time double, ts timestamp, latitude double, longitude double", *(f"`{v}` double" for v in self._names())])

    def reader(self, schema) -> Reader:  # noqa: ANN001
        axes = tuple(self.options.get(a, a) for a in ("time", "latitude", "longitude"))
        return Reader(self.options["path"], self._names(), axes, int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_netcdf(spark: SparkSession, path: str, *variables: str, **options: str) -> DataFrame:
    """The long field of a file or of all .nc files of a folder, a column for each variable (`sla` by default).

    t numbers the distinct times of all files from 0; a time that two files have comes twice. time is as
    written, ts its timestamp where units and calendar allow. Marked and NaN values are null. All files must
    have one grid, variables the dimensions time, latitude, longitude in that order. A folder without files is
    an empty field. Turns on the session's push-down of filters to Python data sources.
    """
    spark.dataSource.register(NetcdfClassic)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NetcdfClassic.name()).options(variables=",".join(variables or ("sla",)), **options).load(path)


# --- sink ------------------------------------------------------------------------------------------


def _text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(values: dict[str, str | int | float]) -> bytes:
    out = struct.pack(">ii", ATTRIBUTES if values else 0, len(values))
    for name, value in values.items():
        if isinstance(value, str):
            out += _text(name) + struct.pack(">i", CHAR) + _text(value)
        else:
            out += _text(name) + (struct.pack(">iii", INT, 1, value) if isinstance(value, int) else struct.pack(">iid", DOUBLE, 1, value))
    return out


def encoded(times: np.ndarray, latitude: np.ndarray, longitude: np.ndarray, values: np.ndarray, variable: str, units: str | None, step: float | None) -> bytes:
    """A CDF-2 file of values (time, latitude, longitude), times as records. With a step, values are whole multiples of it in 32 bits."""
    dims = struct.pack(">ii", DIMENSIONS, 3) + b"".join(_text(n) + struct.pack(">i", k) for n, k in (("time", 0), ("latitude", len(latitude)), ("longitude", len(longitude))))
    gap = -(1 << 31)
    marks = {"_FillValue": gap, "scale_factor": float(step)} if step else {}
    written = np.where(np.isnan(values), gap, np.rint(values / step)).astype(">i4") if step else values.astype(">f8")
    axes = [("latitude", [1], {}, DOUBLE, 8 * len(latitude)), ("longitude", [2], {}, DOUBLE, 8 * len(longitude))]
    of_records = [("time", [0], {"units": units} if units else {}, DOUBLE, 8), (variable, [0, 1, 2], marks, INT if step else DOUBLE, written.itemsize * len(latitude) * len(longitude))]

    def head(begins: list[int]) -> bytes:
        out = b"CDF\2" + struct.pack(">i", len(times)) + dims + _attributes({}) + struct.pack(">ii", VARIABLES, 4)
        for (name, of, marks, kind, size), begin in zip(axes + of_records, begins, strict=True):
            out += _text(name) + struct.pack(f">i{len(of)}i", len(of), *of) + _attributes(marks) + struct.pack(">iIq", kind, min(size, 0xFFFFFFFF), begin)
        return out

    at = len(head([0] * 4))
    begins = [at + sum(v[4] for v in (axes + of_records)[:i]) for i in range(4)]
    records = b"".join(struct.pack(">d", t) + slab.tobytes() for t, slab in zip(times, written, strict=True))
    return head(begins) + latitude.astype(">f8").tobytes() + longitude.astype(">f8").tobytes() + records


def write_netcdf(field: DataFrame, path: str, variable: str = "sla", units: str | None = None, step: float | None = None, values: int = WRITTEN_VALUES) -> int:
    """A long field (lat_idx, lon_idx, t, latitude, longitude, the variable) as NetCDF files of consecutive times; returns how many.

    t becomes the time, in `units` if given. Each file is written by one task, of at most `values` values
    unless a single time has more; a task that is run again replaces its file. Cells without a row have a gap,
    an index of the grid without any row no coordinate. A cell that has a time twice raises. An empty field
    writes no file.
    """
    axis = lambda i, x: field.groupBy(i).agg(F.max(x).alias("x")).toPandas()
    axes = []
    for found in (axis("lat_idx", "latitude"), axis("lon_idx", "longitude")):
        whole = np.full(int(found.iloc[:, 0].max()) + 1 if len(found) else 0, np.nan)
        whole[found.iloc[:, 0].to_numpy(int)] = found["x"].to_numpy(float)
        axes.append(whole)
    latitude, longitude = axes
    store, folder = _place(path)
    store.create_dir(folder, recursive=True)
    times = max(1, values // max(1, len(latitude) * len(longitude)))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, folder = _place(path)
        t, at = np.unique(rows["t"].to_numpy(np.int64), return_inverse=True)
        cells = np.full((len(t), len(latitude), len(longitude)), np.nan)
        index = np.ravel_multi_index((at, rows["lat_idx"].to_numpy(int), rows["lon_idx"].to_numpy(int)), cells.shape)
        if len(np.unique(index)) < len(index):
            raise ValueError("a cell has a time twice")
        cells.ravel()[index] = rows["x"].to_numpy(float)
        name = f"{folder}/{variable}{int(key[0]):+011d}.nc"
        part = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as file:
            file.write(encoded(t.astype(float), latitude, longitude, cells, variable, units, step))
        store.move(part, name)
        return pd.DataFrame({"name": [name]})

    rows = field.select("lat_idx", "lon_idx", "t", F.col(variable).cast("double").alias("x"), F.floor(F.col("t") / times).alias("block"))
    return rows.groupBy("block").applyInPandas(write, "name string").agg(F.count("name")).first()[0]
