"""Probing: values, derivatives and what follows from them, at points between the samples of a volume.

Points are (p, x0, x1, x2) in index space.  Each meets the samples under its kernels as one array, by a join on its
cell, and sums them with separable weights of three kernels (values, first and second derivatives): ten sums a
component, whatever items are asked for.  The items are then numpy expressions over whole batches of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.core.grid import Grid
from loomgrid.functions.kernels import parse
from loomgrid.operators.stencil import border_index

Arrays = dict[str, np.ndarray]
PAIRS = list(combinations_with_replacement(range(3), 2))
#: Fixed values of the ridge and valley measures, and of the least gradient that has a curvature.
ALPHA, BETA, GAMMA, SMOOTH = 0.5, 0.5, 5.0, 1e-6
CURVED = 1e-10


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(-1))


def _unit(v: np.ndarray) -> np.ndarray:
    n = _length(v)[..., None]
    return np.divide(v, n, out=np.zeros_like(v), where=n != 0)


def _trace(m: np.ndarray) -> np.ndarray:
    return np.trace(m, axis1=-2, axis2=-1)


def _frobenius(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum((-2, -1)))


def _eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as rows; a vector's largest component is positive."""
    values, vectors = np.linalg.eigh(m)
    rows = np.swapaxes(vectors, -1, -2)[..., ::-1, :]
    lead = np.take_along_axis(rows, np.abs(rows).argmax(-1)[..., None], -1)
    return values[..., ::-1], rows * np.where(lead < 0, -1.0, 1.0)


def mode(e: np.ndarray) -> np.ndarray:
    """-1 to 1: from two large and one small value to one large and two small ones."""
    d = e - e.mean(-1, keepdims=True)
    size = _length(d)
    return np.clip(np.divide(3 * np.sqrt(6) * d.prod(-1), size**3, out=np.zeros_like(size), where=size > 0), -1, 1)


def _tubeness(e: np.ndarray, sign: float) -> np.ndarray:
    """How far two of the (falling) eigenvalues are large and of ``sign``: valleys 1, ridges -1."""
    big, mid, small = (e[..., 0], e[..., 1], e[..., 2]) if sign > 0 else (e[..., 2], e[..., 1], e[..., 0])
    none = (sign * big < 0) | (sign * mid < 0) | (np.abs(big) < 1e-10) | (np.abs(mid) < 1e-10)
    b, m, s = (np.where(none, 1.0, np.abs(x)) for x in (big, mid, small))
    value = (
        (1 - np.exp(-((m / b) ** 2) / (2 * ALPHA**2))) * np.exp(-(s * s / (m * b)) / (2 * BETA**2))
        * (1 - np.exp(-(e * e).sum(-1) / (2 * GAMMA**2))) * np.exp(-2 * SMOOTH**2 / (m * b * b))
    )
    return np.where(none, 0.0, value)


def _tensor(m: np.ndarray) -> np.ndarray:
    """(confidence 1, xx, xy, xz, yy, yz, zz) of the symmetric part."""
    s = (m + np.swapaxes(m, -1, -2)) / 2
    return np.stack([np.ones(m.shape[:-2]), *(s[..., i, j] for i, j in PAIRS)], -1)


def _curvatures(a: Arrays) -> None:
    g, h = a["gradient"], a["hessian"]
    mag, n = _length(g), _unit(g)
    away = n[..., :, None] * n[..., None, :]
    along = np.eye(3) - away
    shape = np.where((mag > CURVED)[..., None, None], -h / np.where(mag > CURVED, mag, 1.0)[..., None, None], 0.0)
    tensor = along @ shape @ along
    total, trace = _frobenius(tensor), _trace(tensor)
    spread = np.sqrt(np.maximum(2 * total**2 - trace**2, 0))
    k1, k2 = (trace + spread) / 2, (trace - spread) / 2
    a |= {
        "nproj": away, "nperp": along, "geomtens": tensor, "geomtensten": _tensor(-tensor), "totalcurv": total,
        "shapetrace": np.divide(trace, total, out=np.zeros_like(total), where=total != 0), "k1": k1, "k2": k2, "meancurv": (k1 + k2) / 2, "gausscurv": k1 * k2,
        "shapeindex": -(2 / np.pi) * np.arctan2(k1 + k2, k1 - k2), "flowlinecurv": _frobenius(along @ shape @ away),
    }
    for name, k in (("curvdir1", k1), ("curvdir2", k2)):  # the direction that the tensor less k maps nearest to 0
        m = tensor - k[..., None, None] * np.eye(3)
        a[name] = _eigen(np.swapaxes(m, -1, -2) @ m)[1][..., 2, :]


def scalar_items(a: Arrays) -> Arrays:
    """All items of a scalar volume from ``value``, ``gradient`` (3) and ``hessian`` (3 x 3)."""
    g, h = a["gradient"], a["hessian"]
    n = _unit(g)
    values, vectors = _eigen(h)
    size = _length(values)
    a |= {
        "gradmag": _length(g), "normal": n, "hessianten": _tensor(h), "laplacian": _trace(h), "hessfrob": _frobenius(h), "hesseval": values, "hessevec": vectors,
        "seconddd": np.einsum("...i,...ij,...j", n, h, n), "hessvalleyness": _tubeness(values, 1.0), "hessridgeness": _tubeness(values, -1.0),
        "hessdotpeakness": np.where(size > 0, (1 - np.divide(values.sum(-1), size, out=np.zeros_like(size), where=size > 0) / np.sqrt(3)) / 2, 0.0), "hessmode": mode(values),
    }
    for k in range(3):
        a[f"hesseval{k}"], a[f"hessevec{k}"] = values[..., k], vectors[..., k, :]
    _curvatures(a)
    return a


def vector_items(a: Arrays) -> Arrays:
    """All items of a vector volume from ``vector`` (3), ``jacobian`` (component x axis) and ``hessian`` (component x axis x axis)."""
    v, j, h = a["vector"], a["jacobian"], a["hessian"]
    n, t = _unit(v), np.swapaxes(j, -1, -2)
    curl = np.stack([j[..., 2, 1] - j[..., 1, 2], j[..., 0, 2] - j[..., 2, 0], j[..., 1, 0] - j[..., 0, 1]], -1)
    of_curl = np.stack([h[..., 2, 1, :] - h[..., 1, 2, :], h[..., 0, 2, :] - h[..., 2, 0, :], h[..., 1, 0, :] - h[..., 0, 1, :]], -2)
    strain, spin = (j + t) / 2, (j - t) / 2
    both = strain @ strain + spin @ spin
    norm = _length(curl)
    helicity = (v * curl).sum(-1)
    of_norm = np.einsum("...i,...ij", _unit(curl), of_curl)
    of_helicity = np.einsum("...i,...ij", curl, j) + np.einsum("...i,...ij", v, of_curl)
    along = (n * of_helicity).sum(-1)
    gram = np.eye(3) + t @ j
    values, vectors = _eigen(gram)
    a |= {
        "length": _length(v), "normalized": n, "strain": strain, "divergence": _trace(j), "curl": curl, "curlnorm": norm, "helicity": helicity,
        "normhelicity": np.divide((n * curl).sum(-1), norm, out=np.zeros_like(norm), where=norm != 0), "somega": both, "lambda2": _eigen(both)[0][..., 1],
        "imaginarypart": np.abs(np.linalg.eigvals(j).imag).max(-1), "divgradient": np.einsum("...iij", h), "curlgradient": of_curl, "curlnormgrad": of_norm,
        "ncurlnormgrad": _unit(of_norm), "helgradient": of_helicity, "dirhelderiv": along, "projhelgradient": of_helicity - along[..., None] * n,
        "multigrad": gram, "mgfrob": _frobenius(gram), "mgeval": values, "mgevec": vectors,
    }
    for k in range(3):
        a[f"vector{k}"], a[f"gradient{k}"] = v[..., k], j[..., k, :]
    return a


SCALAR_ITEMS = (
    "value gradient gradmag normal nproj nperp hessian hessianten laplacian hessfrob hesseval hesseval0 hesseval1 hesseval2 hessevec hessevec0 hessevec1 hessevec2 seconddd "
    "geomtens geomtensten k1 k2 totalcurv shapetrace shapeindex meancurv gausscurv curvdir1 curvdir2 flowlinecurv median hessvalleyness hessridgeness hessdotpeakness hessmode"
).split()
VECTOR_ITEMS = (
    "vector vector0 vector1 vector2 length normalized jacobian strain divergence curl curlnorm helicity normhelicity somega lambda2 imaginarypart hessian divgradient curlgradient "
    "curlnormgrad ncurlnormgrad helgradient dirhelderiv projhelgradient gradient0 gradient1 gradient2 multigrad mgfrob mgeval mgevec"
).split()


def _sums(g: Grid, points: DataFrame, kernels: tuple[str, str, str], rule: str, components: int, median: bool) -> DataFrame:
    """(p, s: the ten sums of each component, one component after another), and the weighted median as m.

    The samples around a cell are gathered once, into one array, for all the points in that cell; what meets the points
    is one row a cell, so no row is made for a point and a sample, and the points themselves are not grouped.
    """
    made = [parse(k) for k in kernels]
    reach = int(np.ceil(max(k.support for k in made)))
    side = 2 * reach
    axes = g.axes[-3:]
    spacing = [(a.high - a.low) / (a.size - (a.center == "node")) if a.low is not None and a.high is not None else 1.0 for a in axes]
    orders = [(0, 0, 0), *(tuple(int(k == i) for k in range(3)) for i in range(3)), *(tuple((k == i) + (k == j) for k in range(3)) for i, j in PAIRS)]
    steps = np.arange(1 - reach, reach + 1)
    offsets = np.stack(np.meshgrid(steps, steps, steps, indexing="ij"), -1).reshape(-1, 3)
    slots = components * len(offsets)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each cell b the samples around it; ``slot`` is a sample's place in the cell's array."""
        for whole in batches:
            for i in range(0, len(whole), 2048):
                base = whole.iloc[i : i + 2048][["b0", "b1", "b2"]].to_numpy()
                at = np.repeat(base[:, None] + offsets[None], components, 1).reshape(-1, 3)
                cols = {f"b{d}": np.repeat(base[:, d], slots) for d in range(3)} | {f"c{d}": border_index(at[:, d], axes[d].size, rule) for d in range(3)}
                slot = np.tile(np.arange(slots), len(base))
                yield pd.DataFrame(cols | {"k": slot % components, "slot": slot})

    near = ["b0", "b1", "b2"]
    placed = points.select("p", *(F.col(f"x{d}").cast("double") for d in range(3)))
    placed = placed.select("*", *(F.floor(f"x{d}").cast("long").alias(f"b{d}") for d in range(3)))
    first = g.dim - 3
    cells = g.df.select(*(F.col(f"i{first + d}").alias(f"c{d}") for d in range(3)), (F.col("i0") if first else F.lit(0).cast("long")).alias("k"), "v", F.col("v").isNotNull().alias("here"))
    schema = ", ".join(f"{c} long" for c in (*near, "c0", "c1", "c2", "k", "slot"))
    need = placed.select(*near).distinct().mapInPandas(around, schema).join(cells, ["c0", "c1", "c2", "k"], "left")
    held = F.sort_array(F.collect_list(F.struct("slot", "v", "here")))
    blocks = need.groupBy(*near).agg(held.alias("held"), F.count("here").alias("cells"), F.count("v").alias("n")).filter("cells > 0")
    met = placed.join(blocks.select(*near, F.col("held.v").alias("v"), F.col("held.here").alias("here"), "n"), near)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                yield some(whole.slice(i, 1024))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        x = np.stack([batch.column(1 + d).to_numpy() for d in range(3)], 1)
        t = x[:, None] - (np.floor(x)[:, None] + steps[None, :, None])
        w = [[k.f(t[:, :, d]) / spacing[d] ** o for o, k in enumerate(made)] for d in range(3)]
        v = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, -1, components)
        out = {}
        here = None
        if (batch.column(6).to_numpy() < slots).any():  # samples beyond the border or not in the grid add nothing
            here = batch.column(5).flatten().fill_null(False).to_numpy(zero_copy_only=False).reshape(n, -1, components)
            v = np.where(here, v, 0.0)
        box = v.reshape(n, side, side, side, components)
        for o2 in range(3):
            by2 = np.einsum("nxyzk,nz->nxyk", box, w[2][o2])
            for o1 in range(3 - o2):
                by1 = np.einsum("nxyk,ny->nxk", by2, w[1][o1])
                for o0 in range(3 - o2 - o1):
                    out[o0, o1, o2] = np.einsum("nxk,nx->nk", by1, w[0][o0])
        sums = np.stack([out[o] for o in orders], 2).reshape(n, -1)
        cols = [batch.column(0), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * sums.shape[1], sums.ravel())]
        if median:  # the first value, in order, at which the weights so far pass half of all
            share = (w[0][0][:, :, None, None] * w[1][0][:, None, :, None] * w[2][0][:, None, None, :]).reshape(n, -1)
            values = v[:, :, 0]
            if here is not None:
                values, share = np.where(here[:, :, 0], values, np.inf), np.where(here[:, :, 0], share, 0.0)
            by = np.lexsort((share, values), axis=-1)
            run = np.cumsum(np.take_along_axis(share, by, 1), 1)
            past = run > share.sum(1, keepdims=True) / 2
            m = np.take_along_axis(values, np.take_along_axis(by, past.argmax(1)[:, None], 1), 1)[:, 0]
            cols.append(pa.array(m, mask=~past.any(1)))
        return pa.RecordBatch.from_arrays(cols, names=["p", "s", "m"][: len(cols)])

    return met.select("p", "x0", "x1", "x2", "v", "here", "n").mapInArrow(add, "p long, s array<double>" + (", m double" if median else ""))


#: What the values and the first derivatives of a volume are called, by its number of components.
NAMED = {1: ("value", "gradient"), 3: ("vector", "jacobian"), 7: ("tensor", "tensorgrad")}


def _basic(s: np.ndarray) -> Arrays:
    """Values, first and second derivatives from sums (point x component x 10)."""
    second = np.empty((*s.shape[:2], 3, 3))
    for k, (i, j) in enumerate(PAIRS):
        second[..., i, j] = second[..., j, i] = s[..., 4 + k]
    of, grad = NAMED[s.shape[1]]
    each = (lambda x: x[:, 0]) if s.shape[1] == 1 else (lambda x: x)
    return {of: each(s[..., 0]), grad: each(s[..., 1:4]), "hessian": each(second)}


def _answers(sums: DataFrame, items: list[str], components: int, work: Callable[[Arrays], Arrays]) -> DataFrame:
    median = "m" in sums.columns
    with np.errstate(all="ignore"):
        sample = work(_basic(np.zeros((1, components, 10)))) | {"median": np.zeros(1)}
    kinds = ", ".join(f"{i} {'double' if sample[i].ndim == 1 else 'array<double>'}" for i in items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            s = batch.column(1).flatten().to_numpy().reshape(n, components, 10)
            with np.errstate(all="ignore"):
                a = work(_basic(s))
            if median:
                a["median"] = batch.column(2).to_numpy(zero_copy_only=False)
            cols = [pa.array(a[i]) if a[i].ndim == 1 else pa.array(list(a[i].reshape(n, -1))) for i in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["p", *items])

    return sums.mapInArrow(run, f"p long, {kinds}")


def probe_scalar(g: Grid, points: DataFrame, items: list[str], kernels: tuple[str, str, str] = ("tent", "cubicd:1,0", "cubicdd:1,0"), rule: str = "bleed") -> DataFrame:
    """(p, items): arrays of vectors and matrices run row by row."""
    _check(g, 3, items, SCALAR_ITEMS)
    return _answers(_sums(g, points, kernels, rule, 1, "median" in items), items, 1, scalar_items)


def probe_vector(g: Grid, points: DataFrame, items: list[str], kernels: tuple[str, str, str] = ("tent", "cubicd:1,0", "cubicdd:1,0"), rule: str = "bleed") -> DataFrame:
    """(p, items) of a volume whose axis 0 holds three components."""
    _check(g, 4, items, VECTOR_ITEMS)
    if g.axes[0].size != 3:
        raise ValueError("axis 0 must hold three components")
    return _answers(_sums(g, points, kernels, rule, 3, False), items, 3, vector_items)


def _check(g: Grid, dim: int, items: list[str], known: list[str]) -> None:
    if g.dim != dim:
        raise ValueError(f"the volume must have {dim} axes")
    odd = [i for i in items if i not in known]
    if odd:
        raise ValueError(f"no items {odd}")
