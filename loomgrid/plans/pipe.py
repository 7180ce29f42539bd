"""A pipe of array commands as one lazy plan: ``"crop -min 0 0 -max M-1 9 | project -a 1 -m mean"``.

Each command maps a grid to a grid; nothing runs until the result is read, so Catalyst sees the whole pipe
and fuses projections, filters and coordinate arithmetic of neighbouring commands.  ``-`` is the grid of the pipe,
any other name one of ``grids``.  Commands that end a pipe give a DataFrame or a plain value.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.core.grid import Axis, Grid, spine
from loomgrid.operators import elementwise, histograms, maps, shape, stencil
from loomgrid.operators.measures import project
from loomgrid.sources import arrays

Result = Grid | DataFrame | float | int | str | tuple


def position(text: str, size: int, low: int = 0) -> int:
    """``5``, ``M`` (the last), ``M-2``, ``m+3`` (from ``low``)."""
    m = re.fullmatch(r"(M|m)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError(f"no position {text!r}")
    base = {"M": size - 1, "m": low, None: 0}[m.group(1)]
    return base + int(m.group(2) or 0)


@dataclass
class Call:
    """A command's words and the grid that the pipe has so far."""

    g: Grid
    options: dict[str, list[str]]
    free: list[str]
    grids: dict[str, Grid] = field(default_factory=dict)

    def one(self, key: str, default: str | None = None) -> str | None:
        return self.options[key][0] if self.options.get(key) else default

    def many(self, key: str, kind: type = float) -> list:
        return [kind(x) for x in self.options[key]]

    def has(self, key: str) -> bool:
        return key in self.options

    @property
    def axis(self) -> int:
        return int(self.one("a", "0"))

    def grid(self, name: str) -> Grid:
        if name == "-":
            return self.g
        if name not in self.grids:
            raise ValueError(f"no grid {name!r}")
        return self.grids[name]

    def operand(self, word: str) -> Grid | float:
        try:
            return float(word)
        except ValueError:
            return self.grid(word)

    def table(self, key: str) -> list[float]:
        """A small 1-D grid as a list; it is read on the driver, so its size is checked."""
        t = self.grid(self.one(key))
        if t.size > maps.LARGEST:
            raise ValueError(f"a table has at most {maps.LARGEST} entries")
        return [r["v"] for r in t.df.orderBy(*reversed(t.names)).select("v").collect()]

    def positions(self, key: str, low: list[int] | None = None) -> list[int]:
        return [position(w, a.size, (low or [0] * self.g.dim)[k]) for k, (w, a) in enumerate(zip(self.options[key], self.g.axes, strict=True))]

    def bounds(self) -> tuple[float, float]:
        """-min and -max as numbers or percentiles (``3%``), else the range of the values."""
        low, high = self.one("min", "nan"), self.one("max", "nan")
        if low.endswith("%") or high.endswith("%"):
            lo, hi = histograms.percentile_range(self.g, float(low.rstrip("%")) if low.endswith("%") else 0.0, float(high.rstrip("%")) if high.endswith("%") else 0.0)
            return (lo if low.endswith("%") or low == "nan" else float(low)), (hi if high.endswith("%") or high == "nan" else float(high))
        if "nan" in (low, high):
            lo, hi = elementwise.value_range(self.g)
            return (lo if low == "nan" else float(low)), (hi if high == "nan" else float(high))
        return float(low), float(high)


Command = Callable[[Call], Result]
COMMANDS: dict[str, Command] = {}


def command(name: str) -> Callable[[Command], Command]:
    def put(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return put


def _typed(c: Call, g: Grid) -> Grid:
    """The result in the type of -t."""
    return elementwise.convert(g, c.one("t")) if c.has("t") and c.one("t") != "default" else g


# -- places -----------------------------------------------------------------------------------------------------


@command("slice")
def _slice(c: Call) -> Grid:
    g = c.g
    for axis, at in sorted(zip(c.many("a", int), c.options["p"], strict=True), reverse=True):
        g = shape.slice_at(g, axis, position(at, g.axes[axis].size))
    return g


@command("crop")
def _crop(c: Call) -> Grid:
    low = c.positions("min")
    return shape.crop(c.g, low, c.positions("max", low))


@command("acrop")
def _acrop(c: Call) -> Grid:
    return shape.auto_crop(c.g, c.one("m"), float(c.one("f", "0.1")), int(c.one("off", "1")))


@command("pad")
def _pad(c: Call) -> Grid:
    low = c.positions("min")
    return shape.pad(c.g, low, c.positions("max", low), c.one("b", "bleed"), float(c.one("v", "0")))


@command("inset")
def _inset(c: Call) -> Grid:
    return shape.inset(c.g, c.positions("min"), c.grid(c.one("s")))


@command("splice")
def _splice(c: Call) -> Grid:
    return shape.splice(c.g, c.axis, position(c.one("p"), c.g.axes[c.axis].size), c.grid(c.one("s")))


@command("sselect")
def _sselect(c: Call) -> Grid:
    return shape.slice_select(c.g, c.axis, c.grid(c.one("s")), float(c.one("th")), c.one("o", "above") != "below", c.has("strict"))


@command("flip")
def _flip(c: Call) -> Grid:
    return shape.flip(c.g, c.axis)


@command("swap")
def _swap(c: Call) -> Grid:
    return shape.swap(c.g, *c.many("a", int))


@command("permute")
def _permute(c: Call) -> Grid:
    return shape.permute(c.g, c.many("p", int))


@command("shuffle")
def _shuffle(c: Call) -> Grid:
    order = c.many("p", int)
    return shape.shuffle(c.g, c.axis, shape.invert_permutation(order) if c.has("inv") else order)


@command("axinsert")
def _axinsert(c: Call) -> Grid:
    g, size = shape.insert_axis(c.g, c.axis), int(c.one("s", "1"))
    if size > 1:
        low, high = [0] * g.dim, [a.size - 1 for a in g.axes]
        high[c.axis] = size - 1
        g = shape.pad(g, low, high, c.one("b", "bleed"))
    return _axis_set(g, c, (c.axis,))


@command("axdelete")
def _axdelete(c: Call) -> Grid:
    g = c.g
    if c.axis >= 0:
        return shape.delete_axis(g, c.axis)
    for k in reversed([k for k, a in enumerate(g.axes) if a.size == 1]):  # -1: all of size 1, while one stays
        if g.dim > 1:
            g = shape.delete_axis(g, k)
    return g


@command("axsplit")
def _axsplit(c: Call) -> Grid:
    return shape.split_axis(c.g, c.axis, *c.many("s", int))


@command("axmerge")
def _axmerge(c: Call) -> Grid:
    g = c.g
    for axis in sorted(c.many("a", int), reverse=True):
        g = shape.merge_axes(g, axis)
    return g


@command("reshape")
def _reshape(c: Call) -> Grid:
    return shape.reshape(c.g, c.many("s", int))


@command("tile")
def _tile(c: Call) -> Grid:
    split, ax0, ax1 = c.many("a", int)
    return shape.tile(c.g, ax0, ax1, split, *c.many("s", int))


@command("untile")
def _untile(c: Call) -> Grid:
    merge, ax0, ax1 = c.many("a", int)
    return shape.untile(c.g, ax0, ax1, merge, *c.many("s", int))


@command("join")
def _join(c: Call) -> Grid:
    return shape.join([c.grid(x) for x in c.options["i"]], c.axis, c.has("incr"))


@command("block")
def _block(c: Call) -> DataFrame:
    """One row a scanline of axis 0: its values as an array."""
    others = c.g.names[1:]
    line = F.transform(F.sort_array(F.collect_list(F.struct("i0", "v"))), lambda x: x["v"]).alias("block")
    return c.g.df.groupBy(*others).agg(line) if others else c.g.df.agg(line)


def unblock(blocks: DataFrame, sizes: list[int]) -> Grid:
    """The grid whose scanlines ``blocks`` holds."""
    others = [f"i{k}" for k in range(1, len(sizes))]
    return Grid(blocks.select(F.posexplode("block").alias("i0", "v"), *others).select(F.col("i0").cast("long"), *others, "v"), tuple(Axis(n) for n in sizes))


@command("dice")
def _dice(c: Call) -> list[str]:
    """Writes each slice along an axis to a file of its own; the names."""
    start, made = int(c.one("s", "0")), []
    for k in range(min(c.g.axes[c.axis].size, int(c.one("l", "9999")) + 1)):
        path = c.one("o") + c.one("ff", "%05d.nrrd") % (start + k)
        arrays.write_array(shape.slice_at(c.g, c.axis, k), path)
        made.append(path)
    return made


# -- axes and positions -------------------------------------------------------------------------------------------


def _axis_set(g: Grid, c: Call, axes: tuple[int, ...]) -> Grid:
    made = list(g.axes)
    for k in axes:
        a = made[k]
        low, high = (float(x) for x in c.options["mm"]) if c.has("mm") else (a.low, a.high)
        made[k] = replace(a, low=low, high=high, label=c.one("l", a.label), kind=c.one("k", a.kind), center=c.one("c", a.center))
    return replace(g, axes=tuple(made))


@command("axinfo")
def _axinfo(c: Call) -> Grid:
    return _axis_set(c.g, c, tuple(c.many("a", int)))


@command("basinfo")
def _basinfo(c: Call) -> Grid:
    return replace(c.g, notes=c.g.notes | {k: " ".join(c.options[o]) for k, o in (("space", "spc"), ("space origin", "orig")) if c.has(o)})


@command("unorient")
def _unorient(c: Call) -> Grid:
    return replace(c.g, notes={k: v for k, v in c.g.notes.items() if not k.startswith("space")})


def index_to_world(center: str, low: float, high: float, n: float, index: float) -> float:
    return low + (high - low) * ((index / (n - 1)) if center == "node" else (index + 0.5) / n)


def world_to_index(center: str, low: float, high: float, n: float, world: float) -> float:
    return (world - low) / (high - low) * (n - 1) if center == "node" else (world - low) / (high - low) * n - 0.5


@command("i2w")
def _i2w(c: Call) -> float:
    return index_to_world(c.free[0], *map(float, c.free[1:5]))


@command("w2i")
def _w2i(c: Call) -> float:
    return world_to_index(c.free[0], *map(float, c.free[1:5]))


@command("grid")
def _grid(c: Call) -> Grid:
    """World positions of all samples; the new axis 0 runs over the axes."""
    at = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), a.position(F.col(f"i{k}")).alias("v")) for k, a in enumerate(c.g.axes)))).alias("p")
    rows = c.g.df.select(at, *(F.col(n).alias(f"i{k + 1}") for k, n in enumerate(c.g.names)))
    return Grid(rows.select(F.col("p.k").alias("i0"), *(f"i{k + 1}" for k in range(c.g.dim)), F.col("p.v").alias("v")), (Axis(c.g.dim), *c.g.axes))


# -- values ---------------------------------------------------------------------------------------------------------


@command("1op")
def _1op(c: Call) -> Grid:
    return _typed(c, elementwise.unary(c.g, c.free[0]))


@command("2op")
def _2op(c: Call) -> Grid:
    return _typed(c, elementwise.binary(c.free[0], *map(c.operand, c.free[1:3])))


@command("3op")
def _3op(c: Call) -> Grid:
    return _typed(c, elementwise.ternary(c.free[0], *map(c.operand, c.free[1:4])))


@command("affine")
def _affine(c: Call) -> Grid:
    if len(c.free) == 4:
        return _typed(c, elementwise.affine(c.g, *map(float, c.free), c.one("clamp") == "true"))
    low, of, high, out_low, out_high = map(c.operand, c.free)
    return _typed(c, elementwise.affine_of(low, of, high, out_low, out_high, c.one("clamp") == "true"))


@command("gamma")
def _gamma(c: Call) -> Grid:
    return elementwise.gamma(c.g, float(c.one("g")), c.bounds() if c.has("min") or c.has("max") else None)


@command("convert")
def _convert(c: Call) -> Grid:
    return (elementwise.clamp_convert if c.has("clamp") else elementwise.convert)(c.g, c.one("t"))


@command("quantize")
def _quantize(c: Call) -> Grid:
    return elementwise.quantize(c.g, int(c.one("b")), c.bounds() if c.has("min") or c.has("max") else None)


@command("unquantize")
def _unquantize(c: Call) -> Grid:
    return elementwise.unquantize(c.g)


@command("minmax")
def _minmax(c: Call) -> tuple[float, float]:
    return elementwise.value_range(c.g)


@command("project")
def _project(c: Call) -> Grid:
    return _typed(c, project(c.g, c.axis, c.one("m")))


@command("histo")
def _histo(c: Call) -> Grid:
    return histograms.histogram(c.g, int(c.one("b")), c.bounds() if c.has("min") or c.has("max") else None, c.grid(c.one("w")) if c.has("w") else None)


@command("histax")
def _histax(c: Call) -> Grid:
    return histograms.axis_histogram(c.g, c.axis, int(c.one("b")), c.bounds() if c.has("min") or c.has("max") else None)


@command("jhisto")
def _jhisto(c: Call) -> Grid:
    grids = [c.grid(x) for x in c.options["i"]]
    low, high = (c.many(k) if c.has(k) else [float("nan")] * len(grids) for k in ("min", "max"))
    ranges = [elementwise.value_range(g) if a != a or b != b else (a, b) for g, a, b in zip(grids, low, high, strict=True)]
    bounds = [(r[0] if a != a else a, r[1] if b != b else b) for r, a, b in zip(ranges, low, high, strict=True)]
    return histograms.joint_histogram(grids, c.many("b", int), bounds)


@command("heq")
def _heq(c: Call) -> Grid:
    return histograms.equalize(c.g, int(c.one("b")), float(c.one("a", "1")))


@command("dhisto")
def _dhisto(c: Call) -> Grid:
    """A histogram as an image: a bin's column is filled from the bottom in proportion to its count (or its logarithm)."""
    high = int(c.one("h"))
    top = float(c.one("max", "nan"))
    top = elementwise.value_range(c.g)[1] if top != top else top
    count = F.least(F.col("v"), F.lit(top))
    level = count / top if c.has("nolog") else F.log1p(count) / F.log1p(F.lit(top))
    image = spine(c.g.df.sparkSession, (c.g.axes[0], Axis(high))).join(c.g.df.withColumn("filled", F.floor(level * high + 0.5)).select("i0", "filled"), "i0")
    return Grid(image.select("i0", "i1", F.when(F.lit(high) - F.col("i1") <= F.col("filled"), 255.0).otherwise(0.0).alias("v")), (c.g.axes[0], Axis(high)), "uchar")


@command("lut")
def _lut(c: Call) -> Grid:
    return _typed(c, maps.lut(c.g, c.table("m"), *c.bounds()))


@command("rmap")
def _rmap(c: Call) -> Grid:
    return _typed(c, maps.regular_map(c.g, c.table("m"), *c.bounds()))


@command("imap")
def _imap(c: Call) -> Grid:
    t = c.table("m")
    return _typed(c, maps.irregular_map(c.g, list(zip(t[::2], t[1::2], strict=True))))


@command("mlut")
def _mlut(c: Call) -> Grid:
    return _typed(c, maps.lut_each(c.g, c.grid(c.one("m")), *c.bounds()))


@command("mrmap")
def _mrmap(c: Call) -> Grid:
    return _typed(c, maps.map_each(c.g, c.grid(c.one("m")), *c.bounds()))


@command("lut2")
def _lut2(c: Call) -> Grid:
    t, flat = c.grid(c.one("m")), c.table("m")
    n = t.axes[0].size
    low, high = c.many("min"), c.many("max")
    return maps.lut2(c.grid(c.options["i"][0]), c.grid(c.options["i"][1]), [flat[k : k + n] for k in range(0, len(flat), n)], (low[0], high[0]), (low[1], high[1]))


@command("subst")
def _subst(c: Call) -> Grid:
    words = c.options["s"]
    p = c.table("s") if len(words) == 1 else [float(x) for x in words]
    return maps.substitute(c.g, list(zip(p[::2], p[1::2], strict=True)))


# -- neighbourhoods -----------------------------------------------------------------------------------------------


@command("resample")
def _resample(c: Call) -> Grid:
    """-s has a number of samples or ``=`` for each axis (or one, for -a); ``x0.5`` is a factor."""
    kernel, rule, g = c.one("k", "cubic:0,0.5"), c.one("b", "bleed"), c.g
    words = c.options["s"]
    for axis, w in enumerate(words) if len(words) == g.dim and not c.has("a") else [(c.axis, words[0])]:
        if w != "=":
            n = round(g.axes[axis].size * float(w[1:])) if w.startswith("x") else int(w)
            g = stencil.resample(g, axis, n, kernel, rule, float(c.one("v", "0")), not c.has("nrn"))
    return _typed(c, g)


@command("cmedian")
def _cmedian(c: Call) -> Grid:
    return stencil.cheap_median(c.g, c.axis, int(c.one("r")), int(c.one("b", "256")), c.has("mode"))


@command("dist")
def _dist(c: Call) -> Grid:
    return _typed(c, stencil.distance_transform(c.g, float(c.one("th")), not c.has("inv")))


@command("ccfind")
def _ccfind(c: Call) -> Grid:
    return stencil.components(c.g, int(c.one("c")) if c.has("c") else None)


@command("ccadj")
def _ccadj(c: Call) -> DataFrame:
    return stencil.adjacency(c.g)


@command("ccsettle")
def _ccsettle(c: Call) -> Grid:
    return stencil.settle(c.g)


@command("fft")
def _fft(c: Call) -> Grid:
    g = c.g
    for axis in c.many("a", int):
        g = stencil.fft(g, axis, c.free[0] in ("inverse", "i", "b"), c.one("r", "true") == "true")
    return g


# -- files and reports ------------------------------------------------------------------------------------------------


@command("save")
def _save(c: Call) -> str:
    form = c.one("f", "nrrd")
    if form == "pnm":
        arrays.write_pnm(c.g, c.one("o"))
    elif form == "text":
        arrays.write_text(c.g, c.one("o"))
    elif form == "vtk":
        arrays.write_vtk(c.g, c.one("o"), c.one("t", "float"))
    else:
        arrays.write_array(c.g, c.one("o"), c.one("t", c.g.kind), c.one("e", "raw"))
    return c.one("o")


@command("head")
def _head(c: Call) -> str:
    """The header of a file, without its payload."""
    return repr(arrays.read_header(c.free[0]))


@command("cksum")
def _cksum(c: Call) -> int:
    return arrays.checksum(c.g, c.one("t", c.g.kind))


@command("diff")
def _diff(c: Call) -> DataFrame:
    return arrays.compare(c.grid(c.free[0]), c.grid(c.free[1]), float(c.one("eps", "0")))


@command("env")
def _env(c: Call) -> DataFrame:
    """The settings that change how plans run."""
    return c.g.df.sparkSession.sql("SET").filter("key LIKE 'spark.sql.%'")


def _options(words: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """Options and free words; words before the first option are free."""
    opts: dict[str, list[str]] = {}
    free: list[str] = []
    key = None
    for w in words:
        if re.fullmatch(r"-[a-z]+", w):
            key = w[1:]
            opts[key] = []
        elif key is not None:
            opts[key].append(w)
        else:
            free.append(w)
    return opts, free


def run(g: Grid, pipe: str, grids: dict[str, Grid] | None = None) -> Result:
    out: Result = g
    for part in pipe.split("|"):
        name, *words = shlex.split(part.strip())
        if name not in COMMANDS:
            raise ValueError(f"no command {name!r}")
        if not isinstance(out, Grid):
            raise ValueError(f"nothing can follow a command that ends a pipe, as {name!r} does")
        out = COMMANDS[name](Call(out, *_options(words), grids or {}))
    return out
