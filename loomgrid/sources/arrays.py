"""Array files as grids: with a text header (attached or detached, several encodings, multi-file), PNM, VTK structured points, plain text.

The header is read on the driver; payloads are read by a Python data source, one partition per slab of a raw
file and one per compressed or text file.  Paths must be reachable by driver and executors alike.
"""

from __future__ import annotations

import bz2
import gzip
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgrid.core.grid import Axis, Grid

#: Type names of the format and their numpy codes.
TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1",
    "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1",
    "short": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2",
    "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4",
    "longlong": "i8", "long long": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "uint64": "u8", "uint64_t": "u8",
    "float": "f4", "double": "f8",
}
SLAB = 1 << 22


@dataclass
class Header:
    kind: str
    sizes: list[int]
    encoding: str = "raw"
    endian: str = "little"
    files: list[str] = field(default_factory=list)
    skip: int = 0
    line_skip: int = 0
    mins: list[float | None] = field(default_factory=list)
    maxs: list[float | None] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    pairs: dict[str, str] = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(("<" if self.endian == "little" else ">") + TYPES[self.kind])

    @property
    def count(self) -> int:
        return int(np.prod(self.sizes))

    def axes(self) -> tuple[Axis, ...]:
        lows = self.mins or [None] * len(self.sizes)
        highs = self.maxs or [None] * len(self.sizes)
        return tuple(Axis(n, a, b) for n, a, b in zip(self.sizes, lows, highs, strict=True))


def read_header(path: str) -> Header:
    """The header of a file in any of the formats, told by its first bytes."""
    with open(path, "rb") as f:
        magic = f.read(2)
        f.seek(0)
        if magic in (b"P2", b"P3", b"P5", b"P6"):
            return _pnm(path, f.read(4096))
        first = f.readline()
        if first.startswith(b"NRRD000"):
            return _headed(path, f)
        if first.startswith(b"# vtk DataFile"):
            return _vtk(path, f)
    return _plain(path)


def _headed(path: str, f) -> Header:
    fields, pairs, comments, rest = {}, {}, [], []
    while (line := f.readline()) and (text := line.decode().rstrip("\r\n")):
        if text.startswith("#"):
            comments.append(text[1:].strip())
        elif ":=" in text:
            k, v = text.split(":=", 1)
            pairs[k] = v
        else:
            k, v = text.split(":", 1)
            fields[k.strip().lower()] = v.strip()
            if k.strip().lower() in ("data file", "datafile") and v.strip().upper().startswith("LIST"):
                rest = [x.decode().strip() for x in f if x.strip()]
                break
    sizes = [int(x) for x in fields["sizes"].split()]
    if len(sizes) != int(fields["dimension"]):
        raise ValueError("sizes and dimension differ")
    numbers = lambda k: [None if x.lower() == "nan" else float(x) for x in fields[k].split()] if k in fields else []
    h = Header(fields["type"], sizes, fields["encoding"].lower(), fields.get("endian", "little"), mins=numbers("axis mins") or numbers("axismins"), maxs=numbers("axis maxs") or numbers("axismaxs"), fields=fields, pairs=pairs, comments=comments)
    h.encoding = {"gz": "gzip", "bz2": "bzip2", "txt": "ascii", "text": "ascii"}.get(h.encoding, h.encoding)
    data = fields.get("data file", fields.get("datafile"))
    h.skip = int(fields.get("byte skip", fields.get("byteskip", 0)))
    h.line_skip = int(fields.get("line skip", fields.get("lineskip", 0)))
    here = os.path.dirname(path)
    if data is None:
        h.files, h.skip = [path], f.tell()
    elif rest:
        h.files = [os.path.join(here, x) for x in rest]
    elif re.search(r"%\d*d", data):
        pattern, a, b, step = data.split()[:4]
        h.files = [os.path.join(here, pattern % i) for i in range(int(a), int(b) + 1, int(step))]
    else:
        h.files = [os.path.join(here, data)]
    return h


def _pnm(path: str, raw: bytes) -> Header:
    tokens, at = [], 0
    for m in re.finditer(rb"#[^\n]*\n|(\S+)", raw):
        if m.group(1):
            tokens.append(m.group(1))
            at = m.end()
        if len(tokens) == 4:
            break
    kind, w, h, top = tokens
    if int(top) > 255:
        raise ValueError("only 8-bit images are read")
    color = kind in (b"P3", b"P6")
    return Header("uchar", [3, int(w), int(h)] if color else [int(w), int(h)], "ascii" if kind in (b"P2", b"P3") else "raw", files=[path], skip=at + 1)


def _vtk(path: str, f) -> Header:
    f.readline()
    binary = f.readline().strip().upper() == b"BINARY"
    sizes, kind, parts = [], "float", 1
    while line := f.readline():
        word = line.decode().split()
        if not word:
            continue
        if word[0] == "DIMENSIONS":
            sizes = [int(x) for x in word[1:4]]
        elif word[0] in ("SCALARS", "VECTORS"):
            kind = {"unsigned_char": "uchar", "char": "signed char", "unsigned_short": "ushort", "unsigned_int": "uint"}.get(word[2], word[2])
            parts = 3 if word[0] == "VECTORS" else 1
            if word[0] == "VECTORS":
                break
        elif word[0] == "LOOKUP_TABLE":
            break
    return Header(kind, [3, *sizes] if parts == 3 else sizes, "raw" if binary else "ascii", "big", [path], f.tell())


def _plain(path: str) -> Header:
    with open(path) as f:
        rows = [x for x in f if x.strip() and not x.startswith("#")]
    return Header("float", [len(rows[0].replace(",", " ").split()), len(rows)], "plain", files=[path])


def _payload(h: Header, path: str) -> bytes:
    with open(path, "rb") as f:
        for _ in range(h.line_skip):
            f.readline()
        if h.skip > 0:
            f.seek(f.tell() + h.skip)
        elif h.skip < 0:  # from the end of raw data
            f.seek(os.path.getsize(path) - h.count // len(h.files) * h.dtype.itemsize + (h.skip + 1))
        return f.read()


def decode(h: Header, path: str) -> np.ndarray:
    """All values of one payload file."""
    raw = _payload(h, path)
    if h.encoding == "gzip":
        raw = gzip.decompress(raw)
    elif h.encoding == "bzip2":
        raw = bz2.decompress(raw)
    elif h.encoding == "hex":
        raw = bytes.fromhex(re.sub(rb"\s", b"", raw).decode())
    elif h.encoding == "ascii":
        return np.array(raw.replace(b",", b" ").split(), dtype=np.float64)
    elif h.encoding == "plain":
        return np.array([x for line in raw.decode().splitlines() if line.strip() and not line.startswith("#") for x in line.replace(",", " ").split()], dtype=np.float64)
    n = h.count // len(h.files)
    return np.frombuffer(raw, h.dtype, n)


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    count: int
    whole: bool


class ArrayReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.header = read_header(path)

    def partitions(self) -> list[Slab]:
        h, out = self.header, []
        each = h.count // len(h.files)
        for k, f in enumerate(h.files):
            if h.encoding == "raw" and h.skip >= 0 and not h.line_skip:
                out += [Slab(f, k * each + i, min(SLAB, each - i), False) for i in range(0, each, SLAB)]
            else:
                out.append(Slab(f, k * each, each, True))
        return out

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        h = self.header
        each = h.count // len(h.files)
        if part.whole:
            values = decode(h, part.path)
        else:
            with open(part.path, "rb") as f:
                f.seek(h.skip + part.first % each * h.dtype.itemsize)
                values = np.frombuffer(f.read(part.count * h.dtype.itemsize), h.dtype)
        for i in range(0, len(values), 65_536):
            v = values[i : i + 65_536].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + i, part.first + i + len(v))), pa.array(v)], names=["at", "v"])


class ArraySource(DataSource):
    """``spark.read.format("array")``: (at bigint, v double), the linear index with axis 0 fastest."""

    @classmethod
    def name(cls) -> str:
        return "array"

    def schema(self) -> str:
        return "at long, v double"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"])


def read(spark: SparkSession, path: str) -> Grid:
    spark.dataSource.register(ArraySource)
    h = read_header(path)
    df = spark.read.format("array").load(path)
    out, step = [], 1
    for k, n in enumerate(h.sizes):
        out.append((F.floor(F.col("at") / step) % n).cast("long").alias(f"i{k}"))
        step *= n
    return Grid(df.select(*out, "v"), h.axes(), h.kind, notes=h.pairs)


def to_numpy(g: Grid) -> np.ndarray:
    """The values as an array whose last axis is axis 0; for grids that the driver can hold."""
    rows = g.df.select(g.linear().alias("at"), "v").orderBy("at").toLocalIterator(prefetchPartitions=True)
    return np.fromiter((r["v"] for r in rows), np.float64, g.size).reshape([a.size for a in reversed(g.axes)])


def from_numpy(spark: SparkSession, values: np.ndarray) -> Grid:
    """A grid from an array on the driver; axis 0 is the array's last axis."""
    table = pa.table({"at": pa.array(np.arange(values.size)), "v": pa.array(values.ravel().astype(float))})
    out, step = [], 1
    for k, n in enumerate(reversed(values.shape)):
        out.append((F.floor(F.col("at") / step) % n).cast("long").alias(f"i{k}"))
        step *= n
    return Grid(spark.createDataFrame(table).select(*out, "v"), tuple(Axis(n) for n in reversed(values.shape)))


def write_text(g: Grid, path: str) -> None:
    """A line of numbers for each place on axis 1."""
    if g.dim > 2:
        raise ValueError("a text file holds at most 2 axes")
    with open(path, "w") as f:
        f.writelines(" ".join(map(repr, row.tolist())) + "\n" for row in np.atleast_2d(to_numpy(g)))


def write_vtk(g: Grid, path: str, kind: str = "float") -> None:
    """Structured points: scalars of 3 axes, or vectors where axis 0 holds their 3 components before these."""
    vectors = g.dim == 4 and g.axes[0].size == 3
    if g.dim != 3 and not vectors:
        raise ValueError("structured points have 3 axes, or 4 of which the first holds 3 components")
    axes = g.axes[1:] if vectors else g.axes
    name = {"uchar": "unsigned_char", "signed char": "char", "ushort": "unsigned_short", "uint": "unsigned_int"}.get(kind, kind)
    head = ["# vtk DataFile Version 3.0", "grid", "BINARY", "DATASET STRUCTURED_POINTS", "DIMENSIONS " + " ".join(str(a.size) for a in axes), "ORIGIN 0 0 0", "SPACING 1 1 1", f"POINT_DATA {axes[0].size * axes[1].size * axes[2].size}"]
    head += [f"VECTORS vectors {name}"] if vectors else [f"SCALARS scalars {name}", "LOOKUP_TABLE default"]
    with open(path, "wb") as f:
        f.write(("\n".join(head) + "\n").encode() + to_numpy(g).astype(np.dtype(">" + TYPES[kind])).tobytes())


def write_many(grids: list[Grid], pattern: str, first: int = 0, kind: str = "double") -> list[str]:
    """A file for each grid, by a pattern with a number; the names."""
    names = [pattern % (first + k) for k in range(len(grids))]
    for g, name in zip(grids, names, strict=True):
        write_array(g, name, kind)
    return names


def write_array(g: Grid, path: str, kind: str = "double", encoding: str = "raw") -> None:
    """A header and one payload file beside it.  Values are gathered in order, so this is for results that one file can hold."""
    dtype = np.dtype("<" + TYPES[kind])
    data = to_numpy(g).ravel().astype(dtype)
    raw = data.tobytes()
    if encoding == "gzip":
        raw = gzip.compress(raw)
    elif encoding == "bzip2":
        raw = bz2.compress(raw)
    elif encoding == "hex":
        raw = raw.hex().encode()
    elif encoding == "ascii":
        raw = "\n".join(map(repr, data.tolist())).encode()
    lines = ["NRRD0004", f"type: {kind}", f"dimension: {g.dim}", "sizes: " + " ".join(str(a.size) for a in g.axes), f"encoding: {encoding}"]
    if dtype.itemsize > 1 and encoding not in ("ascii",):
        lines.append("endian: little")
    lines += [f"{k}:={v}" for k, v in g.notes.items()]
    with open(path, "wb") as f:
        f.write("\n".join([*lines, "", ""]).encode() + raw)


def write_pnm(g: Grid, path: str) -> None:
    rows = g.df.select(g.linear().alias("at"), "v").orderBy("at").toLocalIterator()
    data = bytes(int(r["v"]) for r in rows)
    color = g.dim == 3
    w, h = (g.axes[1].size, g.axes[2].size) if color else (g.axes[0].size, g.axes[1].size)
    with open(path, "wb") as f:
        f.write(f"{'P6' if color else 'P5'}\n{w} {h}\n255\n".encode() + data)


def checksum(g: Grid, kind: str = "double") -> int:
    """CRC-32 of the values in linear order, little-endian, streamed in order."""
    crc, dtype = 0, np.dtype("<" + TYPES[kind])
    buffer: list[float] = []
    for r in g.df.select(g.linear().alias("at"), "v").orderBy("at").toLocalIterator(prefetchPartitions=True):
        buffer.append(r["v"])
        if len(buffer) == 65_536:
            crc, buffer = zlib.crc32(np.array(buffer).astype(dtype).tobytes(), crc), []
    return zlib.crc32(np.array(buffer).astype(dtype).tobytes(), crc)


def compare(a: Grid, b: Grid, epsilon: float = 0.0) -> DataFrame:
    """Cells that differ by more than ``epsilon`` or that only one grid has: (i..., a, b)."""
    both = a.df.select(*a.names, F.col("v").alias("a")).join(b.df.select(*a.names, F.col("v").alias("b")), a.names, "full_outer")
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | ((F.abs(F.col("a") - F.col("b")) > epsilon) & ~(F.isnan("a") & F.isnan("b"))))
