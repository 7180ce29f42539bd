"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are at most ``EXAMPLES`` labelled rows of each label (in the order of a hash of the id), without
repeated texts.  Terms are words and their first four and five bytes; those that one label's examples have
``LIFT`` times as often as the other's, and that a share ``SUPPORT`` of them holds, make the vocabulary.
Document frequencies are counted over all documents.  The index holds, for each term, its examples in order
of their number and the largest weight in each block of ``BLOCK`` numbers.  A text visits blocks in falling
order of the bound that its terms' block maxima give, and stops when the bound can't beat its ``NEAREST``-th
cosine: the neighbours are exact.  They vote with the square of their cosine, against a prior of the share of
toxic examples with the weight ``PRIOR``; what they and the text share is the evidence.

Defined cases: null and empty texts have no neighbours and score the prior, as do texts without a term of the
vocabulary, unless an example has the very same text, which is then the one neighbour, with a cosine of 1; with no labelled rows of both labels the score is the share of toxic ones (0 with none); ties
of cosine go to the example with the smaller number; repeated rows are scored each; labels that are null or
without a document are no examples; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import _text

EXAMPLES = 2000
SUPPORT = 0.01
LEAST = 3
LIFT = 8.0
BLOCK = 64
NEAREST = 16
PRIOR = 0.5
#: Examples whose words are held at once while the vocabulary is selected and the index built.
SELECTED_AT_ONCE = 64
THRESHOLD = 0.7

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every place of a term: words and, of longer ones, their beginnings."""
    w = _text.split_words(data, offsets, _INSIDE)
    of = w.text_of_word()
    kinds = [(of, w.hashes)]
    for size in (4, 5):
        at, h = w.prefixes(size)
        kinds.append((of[at], h))
    return np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def select_terms(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """The vocabulary (sorted hashes) that tells the examples' labels apart."""
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for i in range(0, len(texts), SELECTED_AT_ONCE):
        part = texts[i : i + SELECTED_AT_ONCE]
        of, h = terms(*_encode(part))
        order = np.argsort(of, kind="stable")
        for d, own in enumerate(np.split(h[order], np.searchsorted(of[order], np.arange(1, len(part))))):
            held[int(toxic[i + d])].append(np.unique(own))
    (good_words, n_in_good), (bad_words, n_in_bad) = (np.unique(np.concatenate([np.zeros(0, np.uint64), *x]), return_counts=True) for x in held)
    words = np.union1d(good_words, bad_words)
    good, bad = np.zeros(len(words)), np.zeros(len(words))
    good[np.searchsorted(words, good_words)] = n_in_good
    bad[np.searchsorted(words, bad_words)] = n_in_bad
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    ratio = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
    up = (ratio >= LIFT) & (bad >= max(LEAST, SUPPORT * n_bad))
    down = (ratio <= 1 / LIFT) & (good >= max(LEAST, SUPPORT * n_good))
    return words[up | down]


def _counts(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, how often) of the vocabulary's terms in a chunk, ordered by text."""
    of, h = terms(data, offsets)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    keys, n = np.unique(of[hit] * len(vocabulary) + at[hit], return_counts=True)
    return keys // len(vocabulary), keys % len(vocabulary), n


@dataclass
class Index:
    """The examples' weights by term, with the maxima of their blocks."""

    vocabulary: np.ndarray
    idf: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    prior: float
    starts: np.ndarray  # of a term's postings in each block: term x (blocks + 1)
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # term x block
    same: dict[int, int]  # hash of an example's text: its number

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, texts: list[str], toxic: np.ndarray, ids: np.ndarray) -> Index:
        parts = [(i, _counts(vocabulary, *_encode(texts[i : i + SELECTED_AT_ONCE]))) for i in range(0, len(texts), SELECTED_AT_ONCE)]
        none = np.zeros(0, np.int64)
        of, term, n = (np.concatenate([none, *(p[k] + (i if k == 0 else 0) for i, p in parts)]) for k in range(3))
        w = n * idf[term]
        norm = np.sqrt(np.bincount(of, w * w, len(texts)))
        w = w / norm[of]
        order = np.lexsort((of, term))
        of, term, w = of[order], term[order], w[order]
        blocks = -(-len(texts) // BLOCK)
        grid = np.arange(len(vocabulary))[:, None] * (blocks * BLOCK) + np.arange(blocks + 1) * BLOCK
        starts = np.searchsorted(term * (blocks * BLOCK) + of, grid)
        most = np.zeros((len(vocabulary), blocks))
        np.maximum.at(most, (term, of // BLOCK), w)
        prior = float(toxic.mean()) if len(toxic) else 0.0
        same = {xxhash.xxh3_64_intdigest(t.encode()): i for i, t in reversed(list(enumerate(texts)))}
        return cls(vocabulary, idf, toxic, ids, prior, starts, of, w, most, same)

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest examples of one text, those with a cosine over 0."""
        bounds = weight @ self.most[term]
        best_i, best_c = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best_c) == NEAREST and bounds[b] < best_c[-1] - 1e-12:
                break
            sums = np.zeros(BLOCK)
            for t, q in zip(term.tolist(), weight.tolist(), strict=True):
                x, y = self.starts[t, b], self.starts[t, b + 1]
                sums[self.example[x:y] - b * BLOCK] += q * self.weight[x:y]
            hit = np.flatnonzero(sums > 0)
            i, c = np.concatenate([best_i, hit + b * BLOCK]), np.concatenate([best_c, sums[hit]])
            order = np.lexsort((i, -c))[:NEAREST]
            best_i, best_c = i[order], c[order]
        return best_i, best_c

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float((w @ self.toxic[examples] + PRIOR * self.prior) / (w.sum() + PRIOR))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Score of each text of a chunk, and its evidence: ids and cosines of up to three examples."""
        n_texts = len(offsets) - 1
        of, term, n = _counts(self.vocabulary, data, offsets)
        out, near, cos = np.full(n_texts, self.prior), [[] for _ in range(n_texts)], [[] for _ in range(n_texts)]
        first = np.searchsorted(of, np.arange(n_texts + 1))
        for d in np.flatnonzero(np.diff(first)).tolist():
            t = term[first[d] : first[d + 1]]
            w = n[first[d] : first[d + 1]] * self.idf[t]
            i, c = self.nearest(t, w / np.sqrt(w @ w))
            out[d] = self.vote(i, c)
            near[d], cos[d] = self.ids[i[:3]].tolist(), np.minimum(c[:3], 1.0).tolist()
        for d in np.flatnonzero((np.diff(first) == 0) & (np.diff(offsets) > 0)).tolist():  # without a term, only an equal text is near
            i = self.same.get(xxhash.xxh3_64_intdigest(data[offsets[d] : offsets[d + 1]].tobytes()))
            if i is not None:
                out[d] = self.vote(np.array([i]), np.ones(1))
                near[d], cos[d] = [int(self.ids[i])], [1.0]
        return out, near, cos


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1) -> Index:
    """An index of the examples; ids whose crc32 leaves ``held`` on division by ``folds`` are never among them."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(fold != held)
    picked: dict[int, int] = {}
    for y in (0, 1):
        for r in known.filter(F.col("y") == y).select("id", "y").distinct().orderBy(F.xxhash64("id"), "id").limit(EXAMPLES).collect():
            picked[r["id"]] = max(y, picked.get(r["id"], 0))
    found = rows.filter(F.col("id").isin(list(picked)) & F.col("text").isNotNull()).collect() if picked else []
    by_text = {}
    for r in sorted(found, key=lambda r: r["id"]):
        by_text.setdefault(r["text"], r["id"])
    texts, ids = list(by_text), np.array(list(by_text.values()), np.int64)
    toxic = np.array([picked[i] == 1 for i in ids.tolist()], bool)
    vocabulary = select_terms(texts, toxic) if toxic.any() and not toxic.all() else np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, data, offsets in _text.chunks(batch.column(0)):
                df += np.bincount(_counts(vocabulary, data, offsets)[1], minlength=len(vocabulary))
                n += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(df) + 1), pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["t", "n"])

    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows.select("text").mapInArrow(_text.releasing(count), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # one row a term
        df[r["t"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # the share of toxic rows among all that may be examples, which the picked ones, as many of either label, don't show
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    index = Index.build(vocabulary, idf, texts, toxic, ids)
    index.prior = shares.get(1, 0) / max(1, sum(shares.values()))
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """All columns of ``docs`` and __toxicity: held_out, score, predicted, neighbours (ids) and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in _text.chunks(batch.column(at)):
                values, near, cos = shared.value.scores(data, offsets)
                made = [pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(values)) for c in batch.columns), *made], names=[*(f"c{k}" for k in range(len(batch.columns))), "score", "predicted", "neighbours", "cosines"])

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    made = plain.mapInArrow(_text.releasing(run), f"{kinds}, score double, predicted int, neighbours array<long>, cosines array<double>")
    crc = F.crc32(F.coalesce(F.col(f"c{docs.columns.index(id_col)}").cast("string"), F.lit("")))
    names = [c for c in docs.columns if c != "__toxicity"]
    return made.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c in names),
        F.struct((F.pmod(crc, F.lit(folds)) == held).alias("held_out"), "score", "predicted", "neighbours", "cosines").alias("__toxicity"),
    )
