"""Probed items that have no SQL, by what defines them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid import probe_queries as Q
from loomgrid.core.grid import Axis, Grid
from loomgrid.functions.kernels import parse
from loomgrid.operators import probing

SF = "/root/testdata/sf0.001"


def columns(df):
    rows = df.orderBy("p").limit(60).collect()
    return {c: np.array([r[c] for r in rows]) for c in df.columns}


def test_directions_of_curvature(spark):
    got = columns(probing.probe_scalar(Q._volume(spark), Q._points(spark, SF), ["gradient", "geomtens", "geomtensten", "k1", "k2", "curvdir1", "curvdir2"], Q.KERNELS))
    g = got["geomtens"].reshape(-1, 3, 3)
    for k, d in ((got["k1"], got["curvdir1"]), (got["k2"], got["curvdir2"])):
        assert np.allclose(np.einsum("nij,nj->ni", g, d), k[:, None] * d, atol=1e-9)
        assert np.allclose((d * got["gradient"]).sum(1), 0, atol=1e-9)
    assert np.allclose(got["geomtensten"][:, 1], -g[:, 0, 0]) and (got["geomtensten"][:, 0] == 1).all()


def test_eigen_items_of_vectors(spark):
    got = columns(probing.probe_vector(Q._field(spark), Q._points(spark, SF), ["jacobian", "somega", "lambda2", "imaginarypart", "multigrad", "mgeval", "mgevec"], Q.KERNELS))
    j, m, e, v = (got[k].reshape(-1, *s) for k, s in (("jacobian", (3, 3)), ("multigrad", (3, 3)), ("mgeval", (3,)), ("mgevec", (3, 3))))
    assert np.allclose(np.einsum("nij,nkj->nki", m, v), e[:, :, None] * v)
    assert (np.diff(e, axis=1) <= 0).all()
    assert np.allclose(np.abs(np.linalg.eigvals(j).imag).max(1), got["imaginarypart"])
    assert np.allclose(np.sort(np.linalg.eigvalsh(got["somega"].reshape(-1, 3, 3)))[:, 1], got["lambda2"])


def test_median_and_spacing(spark):
    rng = np.random.default_rng(2)
    cube = rng.normal(size=(6, 6, 6))
    rows = [(x, y, z, float(cube[z, y, x])) for z in range(6) for y in range(6) for x in range(6)]
    g = Grid(spark.createDataFrame(rows, "i0 long, i1 long, i2 long, v double"), (Axis(6, 0.0, 12.0), Axis(6), Axis(6)))
    at = rng.uniform(1, 4, size=(20, 3))
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(at)], "p long, x0 double, x1 double, x2 double")
    got = columns(probing.probe_scalar(g, points, ["value", "gradient", "median"], ("tent", "tentd", "zero")))
    tent, slope = parse("tent").f, parse("tentd").f
    for k, x in enumerate(at):
        w = [tent(x[d] - np.arange(6)) for d in range(3)]
        weight = w[2][:, None, None] * w[1][:, None] * w[0]
        assert got["value"][k] == pytest.approx((cube * weight).sum())
        assert got["gradient"][k][0] == pytest.approx((cube * w[2][:, None, None] * w[1][:, None] * slope(x[0] - np.arange(6))).sum() / 2)
        order = np.argsort(cube, axis=None)
        cum = np.cumsum(weight.ravel()[order])
        assert got["median"][k] == cube.ravel()[order][np.argmax(cum > weight.sum() / 2)]
    with pytest.raises(ValueError):
        probing.probe_scalar(g, points, ["nothing"])


def test_ridges_and_valleys():
    bright = probing.scalar_items({"value": np.zeros(1), "gradient": np.zeros((1, 3)), "hessian": np.diag([-4.0, -3.0, 0.1])[None]})
    assert bright["hessridgeness"][0] > 0.1 and bright["hessvalleyness"][0] == 0
    dark = probing.scalar_items({"value": np.zeros(1), "gradient": np.zeros((1, 3)), "hessian": -np.diag([-4.0, -3.0, 0.1])[None]})
    assert dark["hessvalleyness"][0] == bright["hessridgeness"][0] and dark["hessridgeness"][0] == 0
    assert dark["curvdir1"].shape == (1, 3) and dark["k1"][0] == 0


def tensors_at(x):
    """Inputs of the tensor items from the polynomials themselves."""
    c = np.array(Q.TENSOR)
    bend = np.stack([Q._bends(tuple(k)) for k in c])
    grad = c[:, 1:4] + np.einsum("kij,nj->nki", bend, x)
    value = c[:, 0] + x @ c[:, 1:4].T + np.einsum("ni,kij,nj->nk", x, bend, x) / 2
    return {"tensor": value, "tensorgrad": grad, "hessian": np.broadcast_to(bend, (len(x), *bend.shape)).copy()}


def test_derivatives_of_invariants_are_those_of_differences():
    from loomgrid.operators.tensor_probing import ITEMS, tensor_items

    rng = np.random.default_rng(6)
    x = rng.uniform(2, 7, size=(40, 3))
    got = tensor_items(tensors_at(x))
    h = 1e-5
    steps = [(tensor_items(tensors_at(x + h * d)), tensor_items(tensors_at(x - h * d))) for d in np.eye(3)]
    for name in ("trace", "norm", "b", "det", "s", "q", "fa", "r", "mode", "theta", "omega", "cl1", "cp1", "ca1"):
        slope = np.stack([(a[name] - b[name]) / (2 * h) for a, b in steps], -1)
        bend = np.stack([(a[name + "gradvec"] - b[name + "gradvec"]) / (2 * h) for a, b in steps], -1)
        assert np.allclose(slope, got[name + "gradvec"], atol=1e-5, rtol=1e-5), name
        assert np.allclose(bend, got[name + "hessian"], atol=1e-4, rtol=1e-4), name
        assert np.allclose(np.trace(bend, axis1=1, axis2=2), got[name + "laplacian"], atol=1e-3, rtol=1e-3)
    for k in range(3):
        assert np.allclose(np.stack([(a[f"eval{k}"] - b[f"eval{k}"]) / (2 * h) for a, b in steps], -1), got["evalgrads"][:, k], atol=1e-5)
    assert ((0 <= got["fadiffusionalign"]) & (got["fadiffusionalign"] <= 1)).all() and (got["faridgesurfacestrength"] >= 0).all()
    with np.errstate(all="ignore"):
        none = tensor_items({"tensor": np.zeros((2, 7)), "tensorgrad": np.zeros((2, 7, 3)), "hessian": np.zeros((2, 7, 3, 3))})
    assert all(np.isfinite(none[i]).all() for i in ITEMS)


def test_probes_gather_once_a_cell(spark):
    """However many points there are in a cell, the samples around it are gathered once, and points are not grouped."""
    rng = np.random.default_rng(5)
    cube = rng.normal(size=(6, 6, 6))
    rows = [(x, y, z, float(cube[z, y, x])) for z in range(6) for y in range(6) for x in range(6) if (x, y, z) != (3, 2, 2)]
    g = Grid(spark.createDataFrame(rows, "i0 long, i1 long, i2 long, v double"), (Axis(6),) * 3)
    at = rng.uniform(-2, 7, size=(300, 3))  # beyond the border too, and one sample missing
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(at)], "p long, x0 double, x1 double, x2 double")
    filled = cube.copy()
    filled[2, 2, 3] = 0
    for rule in ("bleed", "wrap", "mirror", "pad"):
        got = {r.p: (r.value, r.median) for r in probing.probe_scalar(g, points, ["value", "median"], ("ctmr", "ctmrd", "ctmrdd"), rule).collect()}
        f = parse("ctmr").f
        for p, x in enumerate(at):
            i = [np.arange(int(np.floor(c)) - 1, int(np.floor(c)) + 3) for c in x]
            w = [f(c - n) for c, n in zip(x, i)]
            j = [probing.border_index(n, 6, rule) for n in i]
            held = [(cube[c, b, a], u * v * t) for a, u in zip(j[0], w[0]) for b, v in zip(j[1], w[1]) for c, t in zip(j[2], w[2]) if 0 <= min(a, b, c) and max(a, b, c) < 6 and (a, b, c) != (3, 2, 2)]
            assert (p in got) == bool(held)
            if held:
                assert got[p][0] == pytest.approx(sum(v * t for v, t in held), abs=1e-9)
                run, half = 0.0, sum(t for _, t in held) / 2
                least = next((v for v, t in sorted(held) if (run := run + t) > half), np.nan)
                assert np.array_equal(got[p][1], least, equal_nan=True)
    plan = probing._sums(g, points, ("ctmr", "ctmrd", "ctmrdd"), "bleed", 1, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "p#" in plan and not any("Aggregate [p#" in line for line in plan.splitlines())
