"""Best-fit packing of tokenized documents by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the search runs on a
histogram whose size has that bound.  Around the largest length left, fillings are enumerated that no other
filling dominates (an item, or several, replaced by one larger item that still fits); the tightest goes
first, as often as the counts allow.  That packing or the best-fit decreasing one, whichever is shorter, is the
incumbent.  Where it needs more sequences than the lower bound, a depth-first branch and bound tries other
fillings, each as often as the counts allow or once, cutting branches whose waste can't beat the incumbent, up
to ``NODES`` nodes.  It runs on the histogram whatever the number of rows: first on the sequences with the most
waste, then with more and more of the others.

The items are then ranked within their length (by a salted count, so that a length which a third of all rows
has is dealt over many tasks) and looked up in the table of slots: rank r of length n has one slot.

Defined cases: a null or empty text is one piece, the end id alone; repeated rows and null ids are packed as
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.llm import _text, bpe
from loomgrid.llm._spark import cut

CAPACITY = 2048
END_ID = 0
#: Nodes of a branch and bound before the incumbent is taken, and of the enumeration of one bin's fillings.
NODES = 20_000
FILL_NODES = 3_000
FILLINGS = 8
#: Sequences that the branch and bound takes up first.
TAKEN = 8
#: Rows that one salt of a length should hold, and the most salts.
ROWS_A_SALT = 100_000
SALTS = 4096

Filling = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the total length, or for some ``t`` large items that can't share with those over ``capacity - t``."""
    c = np.zeros(capacity + 1, np.int64)
    c[list(counts)] = list(counts.values())
    cnt, tot = np.cumsum(c), np.cumsum(c * np.arange(capacity + 1))
    half = capacity // 2
    t = np.concatenate([[0], np.flatnonzero(c[: half + 1])])
    large = cnt[-1] - cnt[half]  # none of them can share with another
    room = (cnt[capacity - t] - cnt[half]) * capacity - (tot[capacity - t] - tot[half])
    low = tot[half] - tot[np.maximum(t - 1, 0)]
    return int(max(-(-tot[-1] // capacity), large + max(0, np.max(-((room - low) // capacity)))))


def _dominated(filling: Filling, slack: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether some item left over could replace a part of the filling that is no longer than it, and still fit."""
    used = Counter(filling)
    bits = 1  # bit s: some part of the filling has the sum s
    for n in filling:
        bits |= bits << n
    for s in (s for s, bit in enumerate(bin(bits)[:1:-1]) if bit == "1"):
        i = bisect_right(lengths, s + slack)
        while i and lengths[i - 1] >= max(s, 1):
            n = lengths[i - 1]
            if n > s and counts[n] > used[n] or n == s and n not in used and counts[n] > 0 and len(filling) > 1:
                return True
            i -= 1
    return False


def _topped_up(space: int, chosen: tuple[tuple[int, int], ...], counts: dict[int, int], lengths: list[int]) -> tuple[int, tuple[tuple[int, int], ...]]:
    """What is left of ``space``, and the (length, how often) chosen, once the longest items that fit are in."""
    times = dict(chosen)
    i = bisect_right(lengths, space)
    while i:
        n = lengths[i - 1]
        more = min(counts[n] - times.get(n, 0), space // n)
        if more > 0:
            times[n] = times.get(n, 0) + more
            space -= n * more
        i = min(i - 1, bisect_right(lengths, space))
    return space, tuple(sorted(times.items(), reverse=True))


def fillings(room: int, counts: dict[int, int], lengths: list[int], limit: int = FILLINGS, nodes: int = FILL_NODES) -> list[Filling]:
    """Maximal undominated multisets of ``lengths`` (ascending) that fit ``room``, the least waste first.

    A node takes a length as often as fits or less, however many items that is; the filling that is open when
    the nodes end is topped up.
    """
    if counts.get(room, 0) > 0:
        return [(room,)]  # one item that leaves nothing dominates every filling
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    left = nodes

    def go(space: int, top: int, chosen: tuple[tuple[int, int], ...], more: bool) -> bool:
        """``more``: another item of the length chosen last would fit."""
        nonlocal left
        i = bisect_right(lengths, min(space, top))
        maximal = not more
        while i:
            n = lengths[i - 1]
            i -= 1
            most = min(counts[n], space // n)
            if most > 0:
                maximal = False
            for times in range(most, 0, -1):
                left -= 1
                if left < 0:
                    found.append(_topped_up(space, chosen, counts, lengths))
                    return True
                if go(space - n * times, n - 1, (*chosen, (n, times)), times < most):
                    return True
        if maximal:
            # a shorter item may still fit where only ``top`` forbade longer ones: those sets come up elsewhere
            found.append((space, chosen))
            return space == 0 and limit == 1
        return False

    go(room, room, (), False)
    if len(found) > 8 * limit:
        edge = sorted(s for s, _ in found)[8 * limit - 1]
        found = [x for x in found if x[0] <= edge]
    found.sort(key=lambda x: (x[0], sum(m for _, m in x[1]), tuple((-n, -m) for n, m in x[1])))
    items = [(s, tuple(n for n, m in f for _ in range(m))) for s, f in found[: 8 * limit]]
    out = [f for s, f in items if not _dominated(f, s, lengths, counts)][:limit]
    return out or [f for _, f in items[:1]] or [()]


def _greedy(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Patterns and how often each is used: the tightest completion of the largest length, as often as counts allow."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out: list[tuple[Filling, int]] = []
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        fill = fillings(capacity - top, left, lengths, 1, 400)[0]
        left[top] += 1
        need = Counter((top, *fill))
        times = min(left[n] // k for n, k in need.items())
        out.append(((top, *fill), times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Each item, the longest first, into the fullest sequence that has room for it; sequences alike are kept as one group."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Filling, int]]] = {}

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((filling, times))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c > 0:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                put(capacity, (), -(-c // (capacity // n)))
            room = rooms[i]
            filling, times = groups[room].pop()
            # a sequence that got the item stays the fullest one with room until it has none
            each = min(room // n, c)
            full = min(times, c // each)
            if full < times:
                groups[room].append((filling, times - full))
            elif not groups[room]:
                del groups[room], rooms[i]
            put(room - n * each, filling + (n,) * each, full)
            c -= full * each
    return [(f, t) for g in groups.values() for f, t in g]


def _search(counts: dict[int, int], capacity: int, most: int, nodes: int) -> tuple[list[tuple[Filling, int]] | None, int]:
    """A packing of fewer than ``most`` sequences by depth-first branch and bound, or None; and the nodes left."""
    left, chosen, used = dict(counts), [], 0

    def options() -> Iterator[tuple[Filling, int]]:
        lengths = sorted(n for n, c in left.items() if c)
        top = lengths[-1]
        left[top] -= 1
        found = fillings(capacity - top, left, lengths)
        left[top] += 1
        for fill in found:
            times = min(left[n] // k for n, k in Counter((top, *fill)).items())
            yield (top, *fill), times
            if times > 1:
                yield (top, *fill), 1

    def take(filling: Filling, times: int) -> None:
        for n in filling:
            left[n] -= times

    if lower_bound(left, capacity) >= most:
        return None, nodes
    stack = [options()]
    while stack and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                filling, times = chosen.pop()
                take(filling, -times)
                used -= times
            continue
        nodes -= 1
        take(*step)
        bound = used + step[1] + lower_bound({n: c for n, c in left.items() if c}, capacity)
        if bound >= most:
            take(step[0], -step[1])
            continue
        chosen.append(step)
        used += step[1]
        if not any(left.values()):
            return list(chosen), nodes
        stack.append(options())
    return None, nodes


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """A packing of ``counts`` (length: how many) as (lengths of one sequence, how many such sequences).

    The branch and bound takes up the sequences of the incumbent with the most waste, with twice as many fuller ones
    each time, until it has taken up all of them, the lower bound is met or the nodes are spent.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    best = min((_greedy(counts, capacity), best_fit_decreasing(counts, capacity)), key=lambda p: sum(t for _, t in p))
    least, most = lower_bound(counts, capacity), sum(t for _, t in best)
    taken = TAKEN
    while most > least and nodes > 0:
        best.sort(key=lambda p: sum(p[0]))
        tail: Counter[int] = Counter()
        kept, n_tail = [], 0
        for filling, times in best:
            k = min(times, taken - n_tail)
            n_tail += k
            for n in filling if k else ():
                tail[n] += k
            if times > k:
                kept.append((filling, times - k))
        share = nodes if n_tail == most else min(nodes, max(1, nodes // 4))
        better, spared = _search(tail, capacity, n_tail, share)
        nodes -= share - spared
        if better:
            best = kept + better
            most = sum(t for _, t in best)
        elif n_tail == most:
            break
        else:
            taken *= 2
    return best


def slots(patterns: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Arrays by (length, first rank): which sequence and offset rank r of a length has."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    rows.sort()
    length, rank, first, offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 4))
    return {"length": length, "rank": rank, "sequence": first, "offset": offset}


def pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and one end id, cut from the end into whole sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(path, pattern, "merges")
        end = np.array([end_id], np.uint32)
        for batch in batches:
            column = batch.column(1)
            for at, _, offs in _text.chunks(column, bpe.CHUNK_BYTES):
                ids, offsets = own.encode(column.slice(at, len(offs) - 1).to_pylist())
                ids = ids.astype(np.uint32)
                which, piece, start, length, crc = [], [], [], [], []
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own_ids = np.concatenate([ids[a:b], end]).astype("<u4")
                    first = (len(own_ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own_ids) + 1, capacity)]
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        which.append(d)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own_ids[x:y].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(offs) - 1).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_text.releasing(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a ``length`` column of 1 to ``capacity``) and the sequence_id and offset of each."""
    items = cut(items)
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(complete_bins(histogram, capacity))
    n_salts = int(min(SALTS, max(16, sum(histogram.values()) // ROWS_A_SALT)))
    order = [c for c in items.columns if c != "length"]
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
    ranked = within.join(bases, ["length", "__salt"]).select(*items.columns, (F.col("__base") + F.col("__row") - 1).alias("__rank"))
    keys = table["length"] * (1 << 40) + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_text.releasing(place), schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes, cuts and packs: one row per piece."""
    return pack(pieces(docs, path, pattern, id_col, text_col, capacity), capacity)
