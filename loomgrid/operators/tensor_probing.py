"""Probing of tensor volumes: invariants of the interpolated tensor, and their derivatives in space.

An invariant is written once, over :class:`Jet`, which carries value, gradient and Hessian through each operation, so every
derived item (magnitudes, normals, eigenvalues, curvatures) is that of a scalar volume.  Axis 0 of a volume holds
confidence, xx, xy, xz, yy, yz, zz.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from loomgrid.core.grid import Grid
from loomgrid.operators import probing
from loomgrid.operators.probing import Arrays

#: Rows and columns of a matrix by the six numbers of a tensor.
PLACES = np.array([[0, 1, 2], [1, 3, 4], [2, 4, 5]])


@dataclass
class Jet:
    """A scalar with its gradient and Hessian in space, for a batch of points."""

    v: np.ndarray
    g: np.ndarray
    h: np.ndarray

    def through(self, f: np.ndarray, d: np.ndarray, dd: np.ndarray) -> Jet:
        """A function of this scalar by its value and first two derivatives."""
        return Jet(f, d[:, None] * self.g, d[:, None, None] * self.h + dd[:, None, None] * self.g[:, :, None] * self.g[:, None])

    def __add__(self, o: Jet | float) -> Jet:
        return Jet(self.v + o.v, self.g + o.g, self.h + o.h) if isinstance(o, Jet) else Jet(self.v + o, self.g, self.h)

    def __mul__(self, o: Jet | float) -> Jet:
        if not isinstance(o, Jet):
            return Jet(self.v * o, self.g * o, self.h * o)
        cross = self.g[:, :, None] * o.g[:, None]
        return Jet(self.v * o.v, self.v[:, None] * o.g + o.v[:, None] * self.g, self.v[:, None, None] * o.h + o.v[:, None, None] * self.h + cross + np.swapaxes(cross, 1, 2))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Jet:
        return self * -1.0

    def __sub__(self, o: Jet | float) -> Jet:
        return self + (-o)

    def power(self, p: float) -> Jet:
        """0 where the base isn't positive."""
        ok = self.v > 0
        x = np.where(ok, self.v, 1.0)
        return self.through(*(np.where(ok, c * x ** (p - k), 0.0) for k, c in enumerate((1.0, p, p * (p - 1)))))

    def __truediv__(self, o: Jet) -> Jet:
        ok = o.v != 0
        x = np.where(ok, o.v, 1.0)
        return self * o.through(*(np.where(ok, f, 0.0) for f in (1 / x, -1 / x**2, 2 / x**3)))

    def clamped(self, low: float, high: float) -> Jet:
        inside = (self.v >= low) & (self.v <= high)
        return Jet(np.clip(self.v, low, high), self.g * inside[:, None], self.h * inside[:, None, None])

    def acos(self) -> Jet:
        """Without a slope at the ends."""
        ok = np.abs(self.v) < 1 - 1e-12
        x = np.where(ok, self.v, 0.0)
        root = 1 - x * x
        return self.through(np.arccos(np.clip(self.v, -1, 1)), np.where(ok, -1 / np.sqrt(root), 0.0), np.where(ok, -x / root**1.5, 0.0))


def invariants(t: list[Jet]) -> dict[str, Jet]:
    """From the six numbers of a tensor."""
    xx, xy, xz, yy, yz, zz = t
    trace = xx + yy + zz
    minors = xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    square = xx * xx + yy * yy + zz * zz + 2.0 * (xy * xy + xz * xz + yz * yz)
    q = (square - minors) * (1 / 9)
    r = (27.0 * det - 5.0 * (trace * minors) + 2.0 * (trace * square)) * (1 / 54)
    fa = (q / square).power(0.5) * 3.0
    mode = (r * q.power(-1.5)).clamped(-1.0, 1.0)
    return {
        "trace": trace, "norm": square.power(0.5), "b": minors, "det": det, "s": square, "q": q, "fa": fa, "r": r, "mode": mode,
        "theta": (-mode).acos() * (1 / np.pi), "omega": fa * (mode + 1.0) * 0.5,
    }


def eigen_jets(t: list[Jet]) -> tuple[list[Jet], np.ndarray]:
    """Eigenvalues, falling, with their derivatives (those of the second order where no two are equal), and eigenvectors."""
    m = np.stack([x.v for x in t], -1)[:, PLACES]
    dm = np.stack([x.g for x in t], 1)[:, PLACES]  # point, row, column, axis
    ddm = np.stack([x.h for x in t], 1)[:, PLACES]
    values, vectors = probing._eigen(m)
    turned = np.einsum("nri,nija,nsj->nrsa", vectors, dm, vectors)
    out = []
    for r in range(3):
        second = np.einsum("ni,nijab,nj->nab", vectors[:, r], ddm, vectors[:, r])
        for s in range(3):
            gap = values[:, r] - values[:, s]
            if s != r:
                weight = np.where(gap != 0, 2 / np.where(gap != 0, gap, 1.0), 0.0)
                second = second + weight[:, None, None] * turned[:, r, s, :, None] * turned[:, r, s, None]
        out.append(Jet(values[:, r], turned[:, r, r], second))
    return out, vectors


#: Items of a scalar volume that each invariant has, and what they are called after its name.
FIRST = {"gradient": "gradvec", "gradmag": "gradmag", "normal": "normal"}
SECOND = FIRST | {
    "hessian": "hessian", "hesseval": "hessianeval", "hesseval0": "hessianeval0", "hesseval1": "hessianeval1", "hesseval2": "hessianeval2", "hessevec": "hessianevec",
    "hessevec0": "hessianevec0", "hessevec1": "hessianevec1", "hessevec2": "hessianevec2", "hessfrob": "hessianfrob", "laplacian": "laplacian", "seconddd": "seconddd",
    "hessmode": "hessianevalmode", "geomtens": "geomtens", "k1": "kappa1", "k2": "kappa2", "totalcurv": "totalcurv", "shapeindex": "shapeindex", "meancurv": "meancurv",
    "gausscurv": "gausscurv", "curvdir1": "curvdir1", "curvdir2": "curvdir2", "flowlinecurv": "flowlinecurv",
}


def _aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where directions agree, 0 where they are at right angles."""
    return 1 - 2 * np.arccos(np.clip(np.abs((a * b).sum(-1)), 0, 1)) / np.pi


def tensor_items(a: Arrays) -> Arrays:
    """All items from ``tensor`` (7), ``tensorgrad`` (component x axis) and ``hessian`` (component x axis x axis)."""
    jets = [Jet(a["tensor"][:, k], a["tensorgrad"][:, k], a["hessian"][:, k]) for k in range(7)]
    made = invariants(jets[1:])
    values, vectors = eigen_jets(jets[1:])
    total = made["trace"]
    made["cl1"] = (values[0] - values[1]) / total
    made["cp1"] = (values[1] - values[2]) * 2.0 / total
    made["ca1"] = made["cl1"] + made["cp1"]
    for name, jet in made.items():
        a[name] = jet.v
        of = probing.scalar_items({"value": jet.v, "gradient": jet.g, "hessian": jet.h})
        a |= {name + after: of[item] for item, after in SECOND.items()}
    weight = np.array([1, 2, 2, 1, 2, 1])
    slopes = np.sqrt((a["tensorgrad"][:, 1:] ** 2 * weight[None, :, None]).sum(1))
    m = a["tensor"][:, 1:][:, PLACES]
    tr = np.where(total.v != 0, total.v, 1.0)
    e = np.stack([x.v for x in values], -1)
    cl2 = np.divide(e[:, 0] - e[:, 1], e[:, 0], out=np.zeros(len(e)), where=e[:, 0] != 0)
    cp2 = np.divide(e[:, 1] - e[:, 2], e[:, 0], out=np.zeros(len(e)), where=e[:, 0] != 0)
    a |= {
        "confidence": a["tensor"][:, 0], "modewarp": np.cos((1 - a["mode"]) * np.pi / 2), "eval": e, "evec": vectors, "evalgrads": np.stack([x.g for x in values], 1),
        "evalhessian": np.stack([x.h for x in values], 1), "tensorgradmag": slopes, "tensorgradmagmag": probing._length(slopes), "clpmin1": np.minimum(a["cl1"], a["cp1"]),
        "cl2": cl2, "cp2": cp2, "ca2": cl2 + cp2, "clpmin2": np.minimum(cl2, cp2),
        "faridgesurfacestrength": a["tensor"][:, 0] * np.maximum(0, -a["fahessianeval2"]), "favalleysurfacestrength": a["tensor"][:, 0] * np.maximum(0, a["fahessianeval0"]),
        "faridgelinealignment": (1 + a["fahessianevalmode"]) / 2 * (a["fahessianevec0"] * vectors[:, 0]).sum(-1) ** 2,
        "faridgesurfacealignment": (1 - a["fahessianevalmode"]) / 2 * (a["fahessianevec2"] * vectors[:, 0]).sum(-1) ** 2,
    }
    for k in range(3):
        a[f"eval{k}"], a[f"evec{k}"] = e[:, k], vectors[:, k]
        a[f"omegahessiancontrtenevec{k}"] = np.einsum("ni,nij,nj->n", vectors[:, k], made["omega"].h, vectors[:, k])
    for name, g in (("trace", total.g), ("fa", made["fa"].g), ("omega", made["omega"].g), ("conf", a["tensorgrad"][:, 0])):
        n = probing._unit(g)
        a[f"{name}gradvecdotevec0"] = np.abs((g * vectors[:, 0]).sum(-1))
        a[f"{name}diffusionalign"] = _aligned(n, vectors[:, 0])
        a[f"{name}diffusionfraction"] = np.einsum("ni,nij,nj->n", n, m, n) / tr
    return a


with np.errstate(all="ignore"):
    ITEMS = [k for k in tensor_items({"tensor": np.zeros((1, 7)), "tensorgrad": np.zeros((1, 7, 3)), "hessian": np.zeros((1, 7, 3, 3))})]


def probe_tensor(g: Grid, points: DataFrame, items: list[str], kernels: tuple[str, str, str] = ("tent", "cubicd:1,0", "cubicdd:1,0"), rule: str = "bleed") -> DataFrame:
    """(p, items) of a volume whose axis 0 holds a tensor's seven numbers."""
    probing._check(g, 4, items, ITEMS)
    if g.axes[0].size != 7:
        raise ValueError("axis 0 must hold seven numbers")
    return probing._answers(probing._sums(g, points, kernels, rule, 7, False), items, 7, tensor_items)
