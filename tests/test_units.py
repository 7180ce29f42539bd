import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.core.exists import bin_index, divide, exists, lt, wrap_cast
from loomgrid.core.grid import Axis, Grid, from_table
from loomgrid.functions.kernels import parse
from loomgrid.operators import elementwise, histograms, maps, measures, shape, stencil
from loomgrid.plans import pipe
from loomgrid.sources import arrays

NAN, INF = float("nan"), float("inf")


def line(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i0 long, v double")
    return Grid(df, (Axis(len(values)),))


def values(g):
    df = g.df.orderBy(*reversed(g.names)) if g.names else g.df
    return [r["v"] for r in df.collect()]


def same(a, b):
    return all(x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


def test_exists_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-2.0, 0.0), (NAN, 1.0), (INF, 2.0)], "a double, b double")
    r = df.select(exists(F.col("a")), divide(F.col("a"), F.col("b")), lt(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [True, True, True, False, False]
    assert same([x[1] for x in r], [INF, NAN, -INF, NAN, INF])
    assert [x[2] for x in r] == [False, False, True, False, False]


def test_bins_and_casts(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "v double")
    assert [r[0] for r in df.select(bin_index(F.col("v"), F.lit(0.0), F.lit(1.0), 4)).collect()] == [0, 1, 2, 3, 3]
    assert [r[0] for r in spark.createDataFrame([(256.7,), (-1.5,)], "v double").select(wrap_cast(F.col("v"), "uchar")).collect()] == [0.0, 255.0]


def test_all_missing_lines(spark):
    g = line(spark, [NAN, INF, NAN])
    for m in ("min", "max", "mean", "sum", "median"):
        assert math.isnan(values(measures.project(g, 0, m))[0])


def test_empty_grid(spark):
    g = Grid(spark.createDataFrame([], "i0 long, v double"), (Axis(4),))
    assert elementwise.unary(g, "abs").df.count() == 0
    assert sum(values(histograms.histogram(g, 4, (0, 1)))) == 0


def test_shape_errors(spark):
    g = line(spark, range(6))
    for bad in (lambda: shape.slice_at(g, 0, 9), lambda: shape.crop(g, [2], [9]), lambda: shape.split_axis(g, 0, 4, 2), lambda: shape.permute(g, [1]), lambda: shape.reshape(g, [5])):
        with pytest.raises(ValueError):
            bad()
    assert shape.invert_permutation([2, 0, 1]) == [1, 2, 0]
    assert values(shape.auto_crop(line(spark, [0, 0, 5, 5, 0]), "sum", 0.1)) == [5, 5]


@pytest.mark.parametrize("name", ["tent", "ctmr", "bspl3", "bspl5", "bspl7", "cubic:1,0", "gauss:1,6", "hermite", "box"])
def test_kernels_integrate_to_one(name):
    k = parse(name)
    x = np.linspace(-k.support - 1, k.support + 1, 400_001)
    assert abs(np.trapezoid(k.f(x), x) - 1) < 1e-4


def test_kernel_derivatives():
    k, d = parse("bspl3"), parse("bspl3d")
    x = np.linspace(-1.9, 1.9, 37)
    assert np.allclose((k.f(x + 1e-6) - k.f(x - 1e-6)) / 2e-6, d.f(x), atol=1e-5)


def test_resample_keeps_constants(spark):
    for rule in ("bleed", "wrap", "mirror"):
        assert same(values(stencil.resample(line(spark, [3.0] * 7), 0, 11, "ctmr", rule)), [3.0] * 11)


def test_components_2d(spark):
    rows = [(x, y, float(v)) for y, r in enumerate(["110", "010", "101"]) for x, v in enumerate(r)]
    g = Grid(spark.createDataFrame(rows, "i0 long, i1 long, v double"), (Axis(3), Axis(3)))
    assert len(set(values(stencil.components(g, 1)))) == 6
    assert len(set(values(stencil.components(g, 2)))) == 2


def test_substitution_is_sequential_and_maps_pass_missing(spark):
    assert values(maps.substitute(line(spark, [1, 2, 5]), [(1, 2), (2, 9)])) == [9, 9, 5]
    assert same(values(maps.lut(line(spark, [NAN, -4, 9]), [1, 2], 0, 1)), [NAN, 1, 2])


def test_pipe_positions(spark):
    assert pipe.position("M-2", 10) == 7 and pipe.position("m+3", 10, 2) == 5
    assert values(pipe.run(line(spark, range(8)), "crop -min 2 -max m+3 | 1op - | flip -a 0")) == [-5, -4, -3, -2]


@pytest.mark.parametrize("encoding", ["raw", "gzip", "bzip2", "hex", "ascii"])
def test_array_file_round_trip(spark, tmp_path, encoding):
    g = shape.reshape(line(spark, [x / 4 for x in range(24)]), [2, 3, 4])
    path = str(tmp_path / "a.arr")
    arrays.write_array(g, path, "double", encoding)
    back = arrays.read(spark, path)
    assert [a.size for a in back.axes] == [2, 3, 4]
    assert arrays.compare(g, back).count() == 0
    assert arrays.checksum(g) == arrays.checksum(back)


def test_byte_skips_and_lists(spark, tmp_path):
    want = [float(x) for x in range(6)]
    raw = struct.pack("<6I", *range(6))
    (tmp_path / "a.raw").write_bytes(b"B" * 66 + raw[:12])
    (tmp_path / "b.raw").write_bytes(b"B" * 66 + raw[12:])
    head = "NRRD0004\ntype: uint\ndimension: 1\nsizes: 6\nencoding: raw\nendian: little\nbyte skip: {}\ndata file: {}\n"
    (tmp_path / "l.nhdr").write_text(head.format(66, "LIST") + "a.raw\nb.raw\n")
    assert values(arrays.read(spark, str(tmp_path / "l.nhdr"))) == want
    (tmp_path / "c.raw").write_bytes(b"x" * 7 + raw)
    (tmp_path / "c.nhdr").write_text(head.format(-1, "c.raw"))
    assert values(arrays.read(spark, str(tmp_path / "c.nhdr"))) == want


def test_pnm_and_text(spark, tmp_path):
    g = shape.reshape(line(spark, range(12)), [4, 3])
    arrays.write_pnm(g, str(tmp_path / "a.pgm"))
    assert values(arrays.read(spark, str(tmp_path / "a.pgm"))) == [float(x) for x in range(12)]
    (tmp_path / "t.txt").write_text("1 2 3\n4 5 6\n")
    assert values(arrays.read(spark, str(tmp_path / "t.txt"))) == [1, 2, 3, 4, 5, 6]


def test_stream_of_events(spark, tmp_path):
    from loomgrid.streaming import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), events.schema)
    q = windows.windowed(stream, ["event_type"], ["sum"]).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    got = {(r["start"], r["event_type"]): round(r["sum"], 4) for r in spark.table("sums").collect()}
    q.stop()
    want = {(r["start"], r["event_type"]): round(r["sum"], 4) for r in windows.windowed(events, ["event_type"], ["sum"]).collect()}
    assert got == want


def test_from_table_axis_positions(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "k long, x double")
    g = from_table(df, ["k"], "x", (Axis(4, 0.0, 8.0),))
    assert [r[0] for r in g.df.select(g.axes[0].position(F.col("i0"))).collect()] == [1.0, 3.0, 5.0, 7.0]


def test_pipe_files_and_reports(spark, tmp_path):
    from loomgrid.pipe_queries import numbers

    g = numbers(spark, range(24), 4, 6)
    names = pipe.run(g, f"dice -a 1 -o {tmp_path}/part- -ff %02d.nrrd")
    assert len(names) == 6 and [r.v for r in arrays.read(spark, names[2]).df.orderBy("i0").collect()] == [8, 9, 10, 11]
    pipe.run(g, f"save -o {tmp_path}/all.nrrd -t float -e ascii")
    assert "float" in pipe.run(g, f"head {tmp_path}/all.nrrd")
    back = arrays.read(spark, f"{tmp_path}/all.nrrd")
    assert pipe.run(g, "diff - other", {"other": back}).count() == 0
    assert pipe.run(g, "cksum -t float") == pipe.run(back, "cksum -t float")
    again = pipe.unblock(pipe.run(g, "block"), [4, 6])
    assert pipe.run(g, "diff - other", {"other": again}).count() == 0
    assert pipe.run(g, "env").filter("key = 'spark.sql.shuffle.partitions'").count() == 1
    with pytest.raises(ValueError):
        pipe.run(g, "minmax | flip -a 0")
    with pytest.raises(ValueError):
        pipe.run(g, "nothing")


def test_smoothed_bounds_and_casts(spark):
    from loomgrid.operators import elementwise as E
    from loomgrid.pipe_queries import numbers

    g = numbers(spark, [-300.5, 0.5, 3.5, 4, 40, 254.6])
    low = [r.v for r in E.ternary("min_sm", g, 2.0, 5.0).df.orderBy("i0").collect()]
    assert low[:2] == [-300.5, 0.5] and 3.4 < low[2] < 3.5 and low[2] < low[3] < low[4] <= 5
    high = [r.v for r in E.ternary("max_sm", 1.0, 2.0, g).df.orderBy("i0").collect()]
    assert high[3:] == [4, 40, 254.6] and 1 <= high[0] <= high[1] < 3
    assert [r.v for r in E.cast_clamp_round(g, "uchar", True, 1).df.orderBy("i0").collect()] == [0, 1, 4, 4, 40, 255]
    assert [r.v for r in E.cast_clamp_round(g, "uchar", True, 0).df.orderBy("i0").collect()] == [0, 0, 3, 4, 40, 254]


def test_other_file_formats(spark, tmp_path):
    rng = np.random.default_rng(1)
    cube = rng.integers(0, 200, size=(4, 3, 5)).astype(float)
    g = arrays.from_numpy(spark, cube)
    assert [a.size for a in g.axes] == [5, 3, 4] and (arrays.to_numpy(g) == cube).all()
    for kind in ("float", "uchar", "double"):
        pipe.run(g, f"save -f vtk -o {tmp_path}/a.vtk -t {kind}")
        assert (arrays.to_numpy(arrays.read(spark, f"{tmp_path}/a.vtk")) == cube).all()
    field = rng.normal(size=(2, 2, 2, 3)).astype(np.float32)
    arrays.write_vtk(arrays.from_numpy(spark, field), f"{tmp_path}/v.vtk")
    assert (arrays.to_numpy(arrays.read(spark, f"{tmp_path}/v.vtk")) == field).all()
    pipe.run(shape.slice_at(g, 2, 1), f"save -f text -o {tmp_path}/a.txt")
    assert (arrays.to_numpy(arrays.read(spark, f"{tmp_path}/a.txt")) == cube[1]).all()
    names = arrays.write_many([shape.slice_at(g, 2, k) for k in range(4)], f"{tmp_path}/s%02d.nrrd", 3)
    assert (arrays.to_numpy(arrays.read(spark, names[2])) == cube[2]).all() and names[0].endswith("s03.nrrd")
    with pytest.raises(ValueError):
        arrays.write_text(g, f"{tmp_path}/b.txt")


def test_smoothed_bounds_without_width(spark):
    """A width of 0, or below, leaves the plain least or greatest value, beside rows that have a width."""
    from loomgrid.operators import elementwise as E
    from loomgrid.pipe_queries import numbers

    nan, c = math.nan, math.sqrt(math.pi) / 2
    x, w, m = [1.0, 9.0, 4.5, 9.0, nan, nan, 7.0, 1.0], [0.0, 0.0, 2.0, -1.0, 0.0, 2.0, 0.0, 2.0], [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, nan, nan]
    grids = [numbers(spark, v) for v in (x, w, m)]
    low = [r.v for r in E.ternary("min_sm", *grids).df.orderBy("i0").collect()]
    assert low == pytest.approx([1, 5, 3 + 2 * math.erf(1.5 * c / 2), 5, 5, nan, nan, nan], nan_ok=True)
    high = [r.v for r in E.ternary("max_sm", *grids[::-1]).df.orderBy("i0").collect()]
    assert high == pytest.approx([5, 9, 7 - 2 * math.erf(2.5 * c / 2), 9, 5, nan, nan, nan], nan_ok=True)


def test_distance_along_long_lines():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        at = np.sort(rng.choice(60, n, replace=False))
        d = np.where(rng.random(n) < 0.4, np.inf, rng.integers(0, 30, n) ** 2.0)
        order = rng.permutation(n)
        line = stencil._least_along("i1")(pa.table({"i1": at[order], "v": d[order]})).sort_by("i1")
        assert (line.column("v").to_numpy() == ((at[:, None] - at[None]) ** 2 + d[None]).min(1)).all()
    n = 150_000  # the square of which would take minutes
    start = time.process_time()
    line = stencil._least_along("i1")(pa.table({"i1": np.arange(n), "v": np.where(np.arange(n) % 1000 == 0, 0.0, 400.0**2)}))
    assert time.process_time() - start < 10
    away = np.minimum(np.arange(n) % 1000, np.where(np.arange(n) < n - 1000, 1000 - np.arange(n) % 1000, n))
    assert (line.column("v").to_numpy() == np.minimum(away, 400) ** 2.0).all()
