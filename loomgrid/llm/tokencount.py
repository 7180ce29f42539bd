"""Token counts under a unigram model, by dynamic programming shared along a trie.

The best segmentation of a pre-token is that of the greatest sum of piece scores.  The best score of a prefix
doesn't depend on what follows, so distinct pre-tokens go into a trie and every node's forward score and
count are computed once, from its ancestors; a node where a pre-token ends stores that pre-token's count.
Texts then add up the counts of their pre-tokens.

The pieces and their scores come from a rank file: a piece's probability falls with its rank as
1 / (rank + ``SHIFT``) (Zipf's law), over the same places of the file for every corpus, so nothing is trained.
Every single byte is a piece, so each pre-token has a segmentation.  Ties go to fewer tokens.

Row-local: no shuffle.  The trie lives for one chunk of texts and counts of known pre-tokens are dropped at
``KNOWN``, so memory is bounded.  Defined cases: null and empty texts have 0 tokens; repeated rows are counted
each; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import _text

KNOWN = 300_000
SHIFT = 2.7


class Unigram:
    def __init__(self, scores: dict[bytes, float], pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.scores = scores
        self.longest = max(map(len, scores))
        # Pieces by their reversed bytes: walking up from a node meets each piece that ends there.
        self.back: dict = {}
        for piece, value in scores.items():
            node = self.back
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = value
        self.known: dict[str, int] = {}

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> Unigram:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls({p: -math.log(r + SHIFT) for p, r in ranks.items()}, pattern)

    def learn(self, fresh: list[str]) -> None:
        """Counts of distinct pre-tokens.  In sorted order, the path from the root to the last pre-token's end is all of
        the trie that later ones can share, so the trie is walked without being stored."""
        items = sorted((t.encode(), t) for t in fresh)
        best, count = [0.0], [0]
        before = b""
        for word, text in items:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                node = self.back
                i = end
                while i:
                    i -= 1
                    node = node.get(word[i])
                    if node is None:
                        break
                    value = node.get(-1)
                    if value is not None:
                        value += best[i]
                        if value > top or value == top and count[i] + 1 < n:
                            top, n = value, count[i] + 1
                best.append(top)
                count.append(n)
            self.known[text] = count[-1]
            before = word

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        flat: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                flat += self.find(t)
            ends.append(len(flat))
        fresh = set(flat).difference(self.known)
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
            fresh = set(flat)
        self.learn(list(fresh))
        each = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        total = np.concatenate([[0], np.cumsum(each)])[ends]
        return np.diff(ends), np.diff(total)


_models: dict[tuple[str, str], Unigram] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pre_tokens, n_tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _models:
            _models[path, pattern] = Unigram.from_ranks(path, pattern)
        model = _models[path, pattern]
        for batch in batches:
            column = batch.column(1)
            for at, _, offsets in _text.chunks(column):
                n = len(offsets) - 1
                pre, tokens = model.counts(column.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_pre_tokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_text.releasing(run), f"`{id_col}` {kind}, n_pre_tokens long, n_tokens long")
