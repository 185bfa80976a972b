"""Classic NetCDF files, written byte by byte here, through the scan; the sink through the scan."""

import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from fieldloom.sources import netcdf

LAT, LON = np.array([-10.0, 0.0, 10.0]), np.array([0.0, 90.0, 180.0, 270.0])


def classic(path, times, slabs, version=1, kind=3, records=None, fixed=False, units="days since 2000-01-01", marks=(), lone=False):
    """A file with one variable sla. slabs: (time, lat, lon) as stored. lone: time isn't a record variable, sla alone is."""
    count, wide = (">q", 8) if version == 5 else (">i", 4)
    n = lambda x: struct.pack(count, x)
    name = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    offset = lambda x: struct.pack(">i" if version == 1 else ">q", x)
    dtype = netcdf.TYPES[kind]
    dims = struct.pack(">i", 10) + n(3 + lone) + name("time") + n(len(times) if fixed else 0) + name("latitude") + n(3) + name("longitude") + n(4)
    if lone:
        dims += name("k") + n(len(times))
    text = lambda k, s: name(k) + struct.pack(">i", 2) + name(s)
    sla_marks = b"".join(name(k) + struct.pack(">i", code) + n(1) + raw + b"\0" * (-len(raw) % 4) for k, code, raw in marks)
    stored = slabs.astype(dtype)
    size = stored[0].nbytes if len(stored) else 12 * stored.itemsize
    padded = size if lone else size + -size % 4
    variables = [("latitude", [1], b"", 0, 6, 24), ("longitude", [2], b"", 0, 6, 32), ("time", [3 if lone else 0], text("units", units), 1, 6, 8), ("sla", [0, 1, 2], sla_marks, len(marks), kind, padded)]

    def head(begins):
        out = b"CDF" + bytes([version]) + (b"\xff" * wide if records == "streaming" else n(0 if fixed else len(times))) + dims + struct.pack(">i", 12) + n(1) + text("title", "odd") + struct.pack(">i", 11) + n(4)
        for (v, of, attributes, many, code, nbytes), begin in zip(variables, begins, strict=True):
            out += name(v) + n(len(of)) + b"".join(n(d) for d in of) + struct.pack(">i", 12 if many else 0) + n(many) + attributes + struct.pack(">i", code) + n(nbytes) + offset(begin)
        return out

    at = len(head([0] * 4))
    clock = np.asarray(times, ">f8")
    body = LAT.astype(">f8").tobytes() + LON.astype(">f8").tobytes()
    if fixed or lone:
        begins = [at, at + 24, at + 56, at + 56 + 8 * len(times)]
        body += clock.tobytes() + stored.tobytes()
    else:
        begins = [at, at + 24, at + 56, at + 64]
        body += b"".join(struct.pack(">d", t) + s.tobytes() + b"\0" * (padded - size) for t, s in zip(clock, stored, strict=True))
    path.write_bytes(head(begins) + body)


def reader(path, size=1 << 20, **names):
    return netcdf.NetcdfClassic({"path": str(path), "partitionBytes": str(size)} | names).reader(None)


def scanned(found):
    rows = [r for p in found.partitions() for b in found.read(p) for r in b.to_pylist()]
    return {(r["time"], r["lat_idx"], r["lon_idx"]): r["sla"] for r in rows}


def expected(times, values):
    return {(t, i, j): None if np.isnan(values[k, i, j]) else values[k, i, j] for k, t in enumerate(times) for i in range(3) for j in range(4)}


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("layout", [{}, {"fixed": True}, {"lone": True}, {"records": "streaming"}])
@pytest.mark.parametrize("kind", [1, 3, 4, 5, 6])
def test_values_of_each_layout(tmp_path, version, layout, kind):
    slabs = np.random.default_rng(kind).integers(-100, 100, (5, 3, 4)).astype(float)
    times = [0.0, 1.0, 2.5, 7.0, 9.0]
    classic(tmp_path / "a.nc", times, slabs, version, kind, **layout)
    for size in (1, 40, 1 << 20):
        assert scanned(reader(tmp_path, size)) == expected(times, slabs)


def test_odd_sizes_of_records_are_padded_unless_alone(tmp_path):
    # 12 bytes a record of bytes need no padding; the first 3 x 3 cells of a wider file would
    slabs = np.arange(24).reshape(2, 3, 4)
    classic(tmp_path / "a.nc", [0.0, 1.0], slabs, 1, 1)
    with netcdf.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.nc")) as f:
        found = netcdf.header(f)
    assert found["sla"].stride == 8 + 12 and found["latitude"].shape == (3,)


def test_packed_values_and_marks(tmp_path):
    slabs = np.arange(12).reshape(1, 3, 4)
    marks = [("scale_factor", 6, struct.pack(">d", 0.5)), ("add_offset", 6, struct.pack(">d", 10.0)), ("_FillValue", 3, struct.pack(">h", 3)), ("missing_value", 3, struct.pack(">h", 5))]
    classic(tmp_path / "a.nc", [4.0], slabs, marks=marks)
    values = slabs * 0.5 + 10.0
    values[(slabs == 3) | (slabs == 5)] = np.nan
    assert scanned(reader(tmp_path)) == expected([4.0], values)


def test_filters_on_times_and_rows_read_fewer_bytes(tmp_path):
    slabs = np.random.default_rng(0).integers(-9, 9, (6, 3, 4)).astype(float)
    classic(tmp_path / "a.nc", range(6), slabs)
    whole = reader(tmp_path, 24)
    assert len(whole.partitions()) == 6 and sum(p.n_bytes() for p in whole.partitions()) == 6 * 24
    wanted = [LessThan(("time",), 4.0), GreaterThanOrEqual(("t",), 1), In(("lat_idx",), (1,))]
    part = reader(tmp_path, 24)
    assert part.pushFilters(wanted) == wanted
    assert sum(p.n_bytes() for p in part.partitions()) == 3 * 8
    assert scanned(part) == {k: v for k, v in expected(range(6), slabs).items() if 1 <= k[0] < 4 and k[1] == 1}
    none = reader(tmp_path)
    none.pushFilters([EqualTo(("latitude",), 3.0)])
    assert scanned(none) == {} and sum(p.n_bytes() for p in none.partitions()) == 0


def test_faults_are_named(tmp_path):
    with pytest.raises(FileNotFoundError):
        reader(tmp_path / "none").partitions()
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(ValueError, match="classic"):
        reader(tmp_path).partitions()
    classic(tmp_path / "x.nc", [0.0], np.zeros((1, 3, 4)))
    with pytest.raises(ValueError, match="no variable 'adt'"):
        reader(tmp_path, variables="adt").partitions()
    with pytest.raises(ValueError, match="dimensions"):
        reader(tmp_path, variables="latitude").partitions()
    whole = (tmp_path / "x.nc").read_bytes()
    (tmp_path / "x.nc").write_bytes(whole[:-5])
    with pytest.raises(ValueError, match="ends before"):
        scanned(reader(tmp_path))
    (tmp_path / "x.nc").write_bytes(whole[:60])
    with pytest.raises(ValueError, match="header"):
        reader(tmp_path).partitions()


@pytest.mark.parametrize(("units", "first"), [("days since 1950-01-01", "1950-01-02"), ("hours since 1970-1-1 12:00:00", "1970-01-01T13:00"), ("seconds since 2000-01-01T00:00:00Z", "2000-01-01T00:00:01"), ("months since 2000-01-01", None), ("", None)])
def test_units_of_time(units, first):
    found = netcdf.timestamps(np.array([1.0]), {"units": units})
    assert (found is None) if first is None else found[0] == np.datetime64(first, "us").astype(int)
    assert netcdf.timestamps(np.array([1.0]), {"units": "days since 1950-01-01", "calendar": "noleap"}) is None


def test_scan_of_a_folder_in_spark(spark, tmp_path):
    """Files in any order of names, one grid; times are numbered over all of them; filters reach the scan."""
    slabs = np.random.default_rng(1).normal(size=(6, 3, 4)).astype(">f4").astype(float)
    slabs[2, 1, 1] = np.nan
    classic(tmp_path / "b.nc", range(3), slabs[:3], 2, 5, units="days since 2000-01-01")
    classic(tmp_path / "a.nc", range(3), slabs[3:], 2, 5, units="days since 2000-01-04")
    (tmp_path / "notes.txt").write_text("none of it")
    field = netcdf.read_netcdf(spark, str(tmp_path), partitionBytes="48")
    rows = field.collect()
    assert field.rdd.getNumPartitions() == 6
    assert {(r.t, r.lat_idx, r.lon_idx): r.sla for r in rows} == expected(range(6), slabs)
    assert all(r.cell_id == 4 * r.lat_idx + r.lon_idx and r.latitude == LAT[r.lat_idx] and r.longitude == LON[r.lon_idx] for r in rows)
    assert {(r.t, r.ts.replace(tzinfo=timezone.utc)) for r in field.select("t", F.col("ts")).distinct().collect()} == {(t, datetime(2000, 1, 1 + t, tzinfo=timezone.utc)) for t in range(6)}
    some = field.where("t >= 4 and lat_idx = 2")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 8
    late = field.where(F.col("ts") >= F.lit("2000-01-06 00:00:00").cast("timestamp"))
    assert late.count() == 12 and late.rdd.getNumPartitions() == 1
    classic(tmp_path / "c.nc", [0.0], slabs[:1], 2, 5)
    raw = bytearray((tmp_path / "c.nc").read_bytes())
    at = bytes(raw).index(LAT.astype(">f8").tobytes())
    raw[at : at + 8] = struct.pack(">d", -11.0)
    (tmp_path / "c.nc").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="another grid"):
        netcdf.read_netcdf(spark, str(tmp_path)).count()


def test_sink_and_scan(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = [(i, j, t, float(LAT[i]), float(LON[j]), None if rng.random() < 0.1 else float(rng.normal())) for i in range(3) for j in range(4) for t in range(-3, 4) if rng.random() < 0.8]
    field = spark.createDataFrame(cells, "lat_idx int, lon_idx int, t int, latitude double, longitude double, sla double")
    folder = f"file:{tmp_path}/out"
    assert netcdf.write_netcdf(field, folder, units="days since 2020-01-10", values=24) == 4
    assert netcdf.write_netcdf(field, folder, units="days since 2020-01-10", values=24) == 4
    assert len(list((tmp_path / "out").iterdir())) == 4
    back = netcdf.read_netcdf(spark, folder)
    assert {(r.lat_idx, r.lon_idx, int(r.time)): r.sla for r in back.where("sla is not null").collect()} == {c[:3]: c[5] for c in cells if c[5] is not None}
    assert back.agg(F.min("ts").cast("date").cast("string")).first()[0] == "2020-01-07"
    netcdf.write_netcdf(field, f"{tmp_path}/packed", step=1e-4)
    packed = {(r.lat_idx, r.lon_idx, int(r.time)): r.sla for r in netcdf.read_netcdf(spark, f"{tmp_path}/packed").where("sla is not null").collect()}
    assert packed.keys() == {c[:3] for c in cells if c[5] is not None}
    assert all(abs(packed[c[:3]] - c[5]) <= 0.5e-4 + 1e-12 for c in cells if c[5] is not None)
    assert netcdf.write_netcdf(field.limit(0), f"{tmp_path}/none") == 0
    assert netcdf.read_netcdf(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="a time twice"):
        netcdf.write_netcdf(field.unionByName(field), f"{tmp_path}/twice")
