"""Language-model scores from a hashed maximum-entropy model.

The probability of a word is that of its class given the context, times that of the word in its class.  The
class factor is a softmax over hashed features of the two words before (each alone, the farther one as a skip
feature, both together, and the pair of their classes); the word factor is the smoothed share of the word in its
class.  The ``OWN`` most frequent tokens are classes of their own; the others of the ``HEAD`` most frequent ones are
dealt over ``GROUPS`` groups of words that occur in the same texts, and over ``BANDS`` bands of like weight, from
frequent to rare words, in each; all rarer and unseen words form the last class.

1. Counts of all training tokens: combined in each task, then summed by a shuffle on the word's hash.
2. Groups: the ``SEEDS`` most frequent tokens are clustered by the texts that they share; a text is of the group that
   most of its seeds are of; a word is of the group whose texts it prefers.  Two passes, each of which sums a matrix
   of fixed size over the tasks.
3. Training goes over all training texts, ``ROUNDS`` slices of them one after another.  Each task starts from
   the common weights, takes gradient steps over its own texts, and gives its change; changes are averaged by
   their numbers of tokens, in two levels, so that no task gathers more than a few hundred of them.
4. Scoring is done in sparse batches: weights are gathered by feature, never multiplied as dense matrices.
   Counts of the ``HEAD`` most frequent words (a fixed bound) are broadcast; the rest of a text's words, each
   rare by construction, meet their counts in a shuffle join on the word.

Words are told apart by 64-bit hashes.  Defined cases: null and empty texts are the end token alone; a null
id is hashed as an empty string for the fold; repeated rows are scored (and learned from) each; with no
training row every count is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import _text
from loomgrid.llm._spark import cut

ROWS = 1 << 14
OWN = 7
GROUPS = 6
BANDS = 4
CLASSES = OWN + GROUPS * BANDS + 1
SEEDS = 128
HEAD = 65_536
ROUNDS = 2
STEP = 0.25
BATCH = 2048
#: Distinct words that a task combines before it hands counts on.
COMBINED = 400_000
#: Tasks whose changes are averaged in one group at first.
FAN_IN = 256
PARTS = 16

END = np.uint64(0x7E57E4D0FF1CE001)


@dataclass
class Model:
    """What scoring needs besides the tail of the counts; its size doesn't depend on the corpus."""

    weights: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    head_class: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk, an end after each text, and where each text begins."""
    w = _text.split_words(data, offsets)
    n = len(w.first) - 1
    out = np.empty(len(w.hashes) + n, np.uint64)
    first = w.first + np.arange(n + 1)
    is_end = np.zeros(len(out), bool)
    is_end[first[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = w.hashes
    return out, first


def head_classes(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Classes of the most frequent tokens, whose counts fall: OWN of their own, then in each group bands with like sums of counts."""
    out = np.minimum(np.arange(len(counts)), OWN)
    for g in range(GROUPS):
        own = np.flatnonzero(group[OWN:] == g) + OWN
        before = np.cumsum(counts[own]) - counts[own]
        out[own] = OWN + g * BANDS + before * BANDS // max(1, int(counts[own].sum()))
    return out


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (part, grp, data: doubles) over all tasks by part, in two levels; for few parts of a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("data"))
        return pa.table([table.column("part")[:1], table.column("grp")[:1], pa.array([total.tobytes()], pa.binary())], names=["part", "grp", "data"])

    kind = "part int, grp int, data binary"
    rows = parts.groupBy("part", "grp").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind)
    return {r["part"]: np.frombuffer(r["data"]) for r in cut(rows).collect()}


def _parts(matrix: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    group = TaskContext.get().partitionId() // FAN_IN
    return pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in np.array_split(matrix.ravel(), PARTS)], pa.binary())],
        names=["part", "grp", "data"],
    )


def _whole(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    got = _summed(parts)
    return np.concatenate([got[p] for p in range(PARTS)]).reshape(shape) if got else np.zeros(shape)


def seed_groups(shared: np.ndarray) -> np.ndarray:
    """Groups of the seeds by ``shared`` (texts that hold both): k-means on rows as directions, started from rows far apart."""
    rows = shared / np.maximum(1, np.sqrt((shared**2).sum(1, keepdims=True)))
    rows = rows - rows.mean(0)
    rows /= np.maximum(1e-12, np.sqrt((rows**2).sum(1, keepdims=True)))
    centers = rows[:1]
    while len(centers) < min(GROUPS, len(rows)):
        centers = np.concatenate([centers, rows[[(rows @ centers.T).max(1).argmin()]]])
    for _ in range(20):
        own = (rows @ centers.T).argmax(1)
        made = np.stack([rows[own == g].sum(0) if (own == g).any() else c for g, c in enumerate(centers)])
        centers = made / np.maximum(1e-12, np.sqrt((made**2).sum(1, keepdims=True)))
    return (rows @ centers.T).argmax(1)


def word_groups(docs: DataFrame, head: np.ndarray) -> np.ndarray:
    """The group of each token of ``head`` (the most frequent first), from all rows of (text)."""
    n_seeds = min(SEEDS, len(head))
    order = np.argsort(head)
    known = docs.sparkSession.sparkContext.broadcast((head[order], order))

    def places(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, rank) of the tokens that are in the head."""
        hashes, ranks = known.value
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == h)
        return np.searchsorted(first, hit, "right") - 1, ranks[at[hit]]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_seeds, n_seeds))
        for batch in batches:
            for _, data, offsets in _text.chunks(batch.column(0)):
                h, first = tokens(data, offsets)
                text, rank = places(h, first)
                held = np.zeros((len(first) - 1, n_seeds), np.float32)
                held[text[rank < n_seeds], rank[rank < n_seeds]] = 1
                total += held.T @ held
        yield _parts(total)

    if n_seeds < 2:
        return np.zeros(len(head), np.int64)
    of_seed = seed_groups(_whole(docs.select("text").mapInArrow(_text.releasing(together), "part int, grp int, data binary"), (n_seeds, n_seeds)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(head) * GROUPS)
        for batch in batches:
            for _, data, offsets in _text.chunks(batch.column(0)):
                h, first = tokens(data, offsets)
                text, rank = places(h, first)
                seed = rank < n_seeds
                of_text = np.bincount(text[seed] * GROUPS + of_seed[rank[seed]], minlength=(len(first) - 1) * GROUPS).reshape(-1, GROUPS)
                some = of_text.any(1)[text]
                total += np.bincount(rank[some] * GROUPS + of_text.argmax(1)[text[some]], minlength=len(total))
        yield _parts(total)

    cast = _whole(docs.select("text").mapInArrow(_text.releasing(votes), "part int, grp int, data binary"), (len(head), GROUPS))
    return (cast / np.maximum(1, cast.sum(0))).argmax(1)


def classes(h: np.ndarray, head: np.ndarray, head_class: np.ndarray) -> np.ndarray:
    """The class of each token; ``head`` is sorted."""
    if not len(head):
        return np.full(len(h), CLASSES - 1)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return np.where(head[at] == h, head_class[at], CLASSES - 1)


def features(h: np.ndarray, first: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Weight rows of each token: the classes of the two words before, word before, skip to the word before that, both words."""
    begin = np.uint64(0x1234567)
    one, two = np.full(len(h), begin, np.uint64), np.full(len(h), begin, np.uint64)
    c1, c2 = np.full(len(h), CLASSES), np.full(len(h), CLASSES)
    one[1:], two[2:], c1[1:], c2[2:] = h[:-1], h[:-2], k[:-1], k[:-2]
    starts = first[:-1]
    one[starts] = two[starts] = begin
    c1[starts] = c2[starts] = CLASSES
    second = starts[np.diff(first) > 1] + 1
    two[second], c2[second] = begin, CLASSES
    rows = np.empty((len(h), 4), np.int64)
    pairs = (CLASSES + 1) ** 2
    words = np.uint64(ROWS - pairs)
    rows[:, 0] = c1 * (CLASSES + 1) + c2
    rows[:, 1] = (_text.mix(one + np.uint64(1)) % words).astype(np.int64) + pairs
    rows[:, 2] = (_text.mix(two + np.uint64(2)) % words).astype(np.int64) + pairs
    rows[:, 3] = (_text.mix(one * np.uint64(3) + two) % words).astype(np.int64) + pairs
    return rows


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    for f in range(1, rows.shape[1]):
        z = z + weights[rows[:, f]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def gradient_steps(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """Steps along the gradient of the log-likelihood, in place; a weight row moves by the mean over its tokens in a batch."""
    for i in range(0, len(target), BATCH):
        r, t = rows[i : i + BATCH], target[i : i + BATCH]
        g = -np.exp(log_softmax(weights, r))
        g[np.arange(len(t)), t] += 1
        flat = r.ravel()
        order = np.argsort(flat, kind="stable")
        keys = flat[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(g[order // r.shape[1]], at, axis=0)
        count = np.diff(np.concatenate([at, [len(keys)]]))
        weights[keys[at]] += (STEP * total / np.sqrt(count)[:, None] / r.shape[1]).astype(np.float32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) over all rows of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []

        def fold() -> None:
            nonlocal keys, counts, pending
            new, n = np.unique(np.concatenate(pending), return_counts=True)
            both = np.concatenate([keys, new])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            pending = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for batch in batches:
            for _, data, offsets in _text.chunks(batch.column(0)):
                pending.append(tokens(data, offsets)[0])
                if sum(map(len, pending)) > 1_000_000:
                    fold()
                    if len(keys) > COMBINED:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        if pending:
            fold()
        if len(keys):
            yield out()

    return docs.select("text").mapInArrow(_text.releasing(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, head: np.ndarray, head_class: np.ndarray) -> np.ndarray:
    """Class weights from all rows of (fold, text); ``fold`` deals rows over rounds."""
    context = docs.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES), np.float32)
    size = ROWS // PARTS
    known = context.broadcast((head, head_class))
    for r in range(ROUNDS):
        shared = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, n = shared.value.copy(), 0
            for batch in batches:
                for _, data, offsets in _text.chunks(batch.column(0)):
                    h, first = tokens(data, offsets)
                    k = classes(h, *known.value)
                    gradient_steps(mine, features(h, first, k), k)
                    n += len(h)
            if n:
                from pyspark import TaskContext

                change = (mine - shared.value).reshape(PARTS, -1)
                group = TaskContext.get().partitionId() // FAN_IN
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([n] * PARTS, pa.int64()), pa.array([x.tobytes() for x in change], pa.binary())],
                    names=["part", "grp", "n", "change"],
                )

        def mean(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy().astype(np.float64)
            rows = [np.frombuffer(x.as_py(), np.float32) for x in table.column("change")]
            total = sum(w * x for w, x in zip(n, rows, strict=True)) / n.sum()
            return pa.table([table.column("part")[:1], table.column("grp")[:1], pa.array([int(n.sum())]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "grp", "n", "change"])

        kind = "part int, grp int, n long, change binary"
        changes = docs.filter(F.pmod(F.col("fold"), F.lit(ROUNDS)) == r).select("text").mapInArrow(_text.releasing(run), kind)
        meaned = changes.groupBy("part", "grp").applyInArrow(mean, kind).groupBy("part").applyInArrow(mean, kind)
        for row in meaned.collect():  # PARTS rows of a fixed size
            at = row["part"] * size
            weights[at : at + size] += np.frombuffer(row["change"], np.float32).reshape(size, CLASSES)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    context = docs.sparkSession.sparkContext
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), crc.alias("crc"))
    learned = rows.filter(F.pmod("crc", F.lit(folds)) != held).select("text", F.floor(F.col("crc") / folds).alias("fold"))
    counts = cut(word_counts(learned))
    # written before it is collected: HEAD rows go to the driver, not HEAD of each task
    top = cut(counts.orderBy(F.desc("c"), "h").limit(HEAD))
    head = sorted(top.collect(), key=lambda x: (-x["c"], x["h"]))
    head_h, head_c = np.array([x["h"] for x in head], np.int64).view(np.uint64), np.array([x["c"] for x in head], np.int64)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(whole["n"]), int(whole["v"])
    of_head = head_classes(head_c, word_groups(learned, head_h))
    n_of = np.bincount(of_head, head_c, CLASSES).astype(np.int64)
    v_of = np.bincount(of_head, minlength=CLASSES)
    n_of[-1], v_of[-1] = n_all - n_of.sum(), v_all - v_of.sum()
    by_hash = np.argsort(head_h)
    sorted_h, sorted_class = head_h[by_hash], of_head[by_hash]
    model = context.broadcast(Model(train(learned, sorted_h, sorted_class), sorted_h, head_c[by_hash], sorted_class, n_of, v_of, n_all, v_all))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        smooth = np.log10(m.class_tokens + m.class_words + 1.0)
        for batch in batches:
            for at, data, offsets in _text.chunks(batch.column(3)):
                h, first = tokens(data, offsets)
                k = classes(h, m.head, m.head_class)
                rows = features(h, first, k)
                of_class = np.empty(len(h))
                for i in range(0, len(h), 16 * BATCH):
                    part = log_softmax(m.weights, rows[i : i + 16 * BATCH])
                    of_class[i : i + len(part)] = part[np.arange(len(part)), k[i : i + len(part)]]
                in_head = np.zeros(len(h), bool)
                c = np.zeros(len(h), np.int64)
                if len(m.head):
                    j = np.minimum(np.searchsorted(m.head, h), len(m.head) - 1)
                    in_head = m.head[j] == h
                    c = np.where(in_head, m.head_counts[j], 0)
                up = np.where(in_head, np.log10(c + 1.0), 0)
                total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731, B023  (every text has its end token)
                base = total(up - np.log10(m.tokens + m.words + 1.0))
                scored = total(up - smooth[k] + of_class / np.log(10))
                tail_at = np.flatnonzero(~in_head)
                where = np.searchsorted(tail_at, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(x).slice(at, len(first) - 1) for x in (0, 1, 2)),
                        pa.array(np.diff(first)), pa.array(total(in_head.astype(np.int64))), pa.array(base), pa.array(scored),
                        pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(h[tail_at].view(np.int64))),
                    ],
                    names=["rid", "id", "held_out", "n_tokens", "n_head", "base", "scored", "tail"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "id", (F.pmod("crc", F.lit(folds)) == held).alias("held_out"), "text")
    partial = cut(numbered.mapInArrow(_text.releasing(run), f"rid long, id {kind}, held_out boolean, n_tokens long, n_head long, base double, scored double, tail array<long>"))
    # A tail word's terms are sums of log10(c + 1) in both scores; all else is known in the first pass.
    tail = partial.select("rid", F.explode("tail").alias("h"))
    met = tail.join(counts, "h").groupBy("rid").agg(F.count("*").alias("n_tail"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    return partial.join(met, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("scored") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
