"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted by k-means on at most ``SAMPLE`` vectors; the
two codes name a cell of the product grid, and every vector is in one cell.  A vector visits cells in rising
order of how far it would have to move to be coded there (per half, the distance to the bisecting plane of
its own code and the other), until the sum of squares passes a bound.  Moving farther than the link distance
is impossible, which bounds the search; inside it the bound is set for ``RECALL`` of the links, assuming that
linked vectors differ in no special direction, and is widened where links within the sample need more.
Candidates are verified by cosine in double precision.

A pair of cells is visited from the lower one only, so a pair of vectors meets in one place.  Equal vectors of one
label form a class first and are counted, not paired.  Cells of many members or visitors
are dealt in blocks of ``BLOCK``, each pair of blocks one group.  A block gives counts, and one edge per
vector to the smallest id it is connected with there, so that n near copies make about n edges.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without a label or
id, link with nothing; vectors link only with those of their own length, each length with an index of its own;
repeated rows are vectors of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import _text
from loomgrid.llm._spark import components, cut, discard, small

SAMPLE = 8192
BLOCK = 2048
#: Of the links, at an isotropic difference: a move of 3.5 standard deviations along a normal.
DEVIATIONS = 3.5
RECALL = 0.999
#: Steps of the histogram of how far links of the sample are apart.
STEPS = 1000
#: The most codes of a half.
CODES = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    if x.shape[1] == 1:  # halves need a component each
        x = np.concatenate([x, np.zeros_like(x)], 1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codebook(half: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(7)
    centers = half[rng.choice(len(half), min(k, len(half)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centers**2).sum(1) - 2 * half @ centers.T).argmin(1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = half[own == c].mean(0)
    return np.unique(centers, axis=0)


class MultiIndex:
    """Two codebooks and the bound of the traversal (a squared distance)."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float) -> None:
        x = unit(sample)
        self.h = x.shape[1] // 2
        self.books = [_codebook(x[:, : self.h], k), _codebook(x[:, self.h :], k)]
        self.gaps = []
        for c in self.books:
            gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
            np.fill_diagonal(gap, np.inf)
            self.gaps.append(gap)
        reach = 2 - 2 * cosine + 1e-9
        self.bound = min(reach, reach * DEVIATIONS**2 / max(1, self.h))
        needed = np.zeros(STEPS + 1, np.int64)
        own, moves = self.cells(x), self.moves(x)
        for i in range(0, len(x), 512):
            a, b = np.nonzero(x[i : i + 512] @ x.T >= cosine)
            keep = a + i != b
            a, b = a[keep] + i, b[keep]
            # a histogram, as a block may have as many links as the sample squared
            needed += np.bincount(np.minimum((moves[0][a, own[b, 0]] + moves[1][a, own[b, 1]]) / reach * STEPS, STEPS).astype(np.int64), minlength=STEPS + 1)
        if needed.sum():
            enough = int(np.searchsorted(np.cumsum(needed), RECALL * needed.sum()))
            self.bound = min(reach, max(self.bound, (enough + 1) / STEPS * reach * 1.1))

    def _squares(self, x: np.ndarray) -> list[np.ndarray]:
        return [(half**2).sum(1)[:, None] + (c**2).sum(1) - 2 * half @ c.T for half, c in zip((x[:, : self.h], x[:, self.h :]), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([d.argmin(1) for d in self._squares(x)], 1)

    def moves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance that each vector must move at least to get each code, for both halves."""
        out = []
        for d, gap in zip(self._squares(x), self.gaps, strict=True):
            m = np.zeros_like(d)
            for c in range(d.shape[1]):
                m[:, c] = np.maximum(0, ((d[:, [c]] - d) / (2 * gap[c])).max(1))
            out.append(m**2)
        return out

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """For each vector the cells (numbered row by row) in the order of traversal: the two sorted lists of moves are
        merged by their sums, which is what stepping along both sequences from the nearest cell gives."""
        a, b = self.moves(x)
        out = []
        width = len(self.books[1])
        for p, q in zip(a, b, strict=True):
            i, j = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
            i, j = i[p[i] <= self.bound], j[q[j] <= self.bound]
            sums = p[i][:, None] + q[j][None]
            r, c = np.nonzero(sums <= self.bound)
            order = np.argsort(sums[r, c], kind="stable")
            out.append((i[r] * width + j[c])[order].astype(np.int32))
        return out


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _links(left: pa.Table, right: pa.Table, cosine: float) -> pa.Table:
    """Counts and edges of one pair of blocks: ``left`` members of a cell, ``right`` its visitors.

    A visitor from another cell is met here alone, so its links count on both sides; one of the cell itself is a
    member too, and counts its own side.
    """
    names = ["node", "other", "n"]
    kinds = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return kinds.empty_table()
    m_id, p_id = left.column("rep").to_numpy(), right.column("v_rep").to_numpy()
    m, p = unit(_stack(left.column("embedding"))), unit(_stack(right.column("v_embedding")))
    m_copies, p_copies, own = left.column("copies").to_numpy(), right.column("v_copies").to_numpy(), right.column("v_own").to_numpy(zero_copy_only=False).astype(bool)
    hit = p @ m.T >= cosine
    hit &= p_id[:, None] != m_id[None]
    rows = np.flatnonzero(hit.any(1))
    if not len(rows):
        return kinds.empty_table()
    hit, p_id, p_copies, own = hit[rows], p_id[rows], p_copies[rows], own[rows]
    cols = np.flatnonzero(hit.any(0))
    hit, m_id, m_copies = hit[:, cols], m_id[cols], m_copies[cols]
    p_counts, m_counts = hit @ m_copies, (p_copies * ~own) @ hit
    top = np.iinfo(np.int64).max
    low_p, low_m = p_id.copy(), m_id.copy()
    while True:  # least id through the links of this block
        new_p = np.minimum(low_p, np.where(hit, low_m[None], top).min(1))
        new_m = np.minimum(low_m, np.where(hit, new_p[:, None], top).min(0))
        if (new_p == low_p).all() and (new_m == low_m).all():
            break
        low_p, low_m = new_p, new_m
    return pa.table([np.concatenate([p_id, m_id]), np.concatenate([low_p, low_m]), np.concatenate([p_counts, m_counts])], names=names)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; links are pairs of one label with at least ``cosine``."""
    e = f"`{vector_col}`"
    base = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
        F.when(
            F.expr(f"`{id_col}` IS NOT NULL AND `{label_col}` IS NOT NULL AND size({e}) > 0 AND forall({e}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists({e}, x -> x <> 0)"),
            F.col(e),
        ).alias("embedding"),
    )
    reps = cut(
        base.filter("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    own = reps.select("label", "embedding", "rep", "copies")
    sized = reps.withColumn("d", F.size("embedding"))
    indexes = {}
    for r in sized.groupBy("d").count().filter("count > 1").collect():  # one row a length
        of_length = sized.filter(F.col("d") == r["d"])
        sample = [x["embedding"] for x in of_length.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(SAMPLE).collect()]
        indexes[r["d"]] = MultiIndex(np.array(sample, np.float64), int(min(CODES, max(4, round(r["count"] ** 0.5 / 8)))), cosine)
    if not indexes:
        alone = base.join(own, ["label", "embedding"], "left")
        return alone.select(
            F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "id").alias("component_id"),
            F.coalesce(F.coalesce("rep", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            for d in np.unique(lengths).tolist():
                index, of_length = indexes[d], batch.filter(pa.array(lengths == d))
                for i in range(0, of_length.num_rows, BLOCK):
                    part = of_length.slice(i, BLOCK)
                    x = unit(_stack(part.column(1)))
                    codes = index.cells(x) @ np.array([len(index.books[1]), 1])
                    # of two cells, vectors of the lower one visit the higher one: a pair meets once
                    visits = [v[v >= c] for v, c in zip(index.visits(x), codes.tolist(), strict=True)]
                    offsets = np.concatenate([[0], np.cumsum([len(v) for v in visits])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(codes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(visits)))],
                        names=["label", "embedding", "rep", "copies", "d", "cell", "visits"],
                    )

    kind = reps.schema["label"].dataType.simpleString()
    element = reps.schema["embedding"].dataType.simpleString()
    placed = cut(
        sized.filter(F.col("d").isin(list(indexes))).select("label", "embedding", "rep", "copies", "d")
        .mapInArrow(_text.releasing(assign), f"label {kind}, embedding {element}, rep long, copies long, d int, cell int, visits array<int>")
    )
    where = ["label", "d", "cell"]
    members = placed.select(*where, "rep", "copies", "embedding")
    visitors = placed.select("label", "d", F.col("cell").alias("from"), F.explode("visits").alias("cell"), "rep", "copies", "embedding")
    blocks = members.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    chunks = visitors.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p"))
    # one row a cell: where few, no cell's vectors meet before they are dealt in blocks
    dealt = cut(blocks.join(chunks, where))
    by = [*where, "block", "chunk"]
    left = members.join(small(dealt), where).select(
        *where, F.expr("int(pmod(xxhash64(rep), m))").alias("block"), F.explode(F.expr("sequence(0, p - 1)")).alias("chunk"), "rep", "copies", "embedding"
    )
    right = visitors.join(small(dealt), where).select(
        *where, F.explode(F.expr("sequence(0, m - 1)")).alias("block"), F.expr("int(pmod(xxhash64(rep), p))").alias("chunk"), "rep", "copies", (F.col("from") == F.col("cell")).alias("own"), "embedding"
    )
    right = right.toDF(*(f"v_{c}" for c in right.columns))
    found = cut(
        left.groupBy(*by).cogroup(right.groupBy(*(f"v_{c}" for c in by))).applyInArrow(lambda a, b: _links(a, b, cosine), "node long, other long, n long")
    )
    discard(placed, dealt)
    counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("n").alias("found"))
    merged = components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = own.join(counts, "rep", "left").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = base.join(classes, ["label", "embedding"], "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
