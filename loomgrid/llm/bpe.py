"""Byte-level BPE by numpy: length-bucketed padded matrices, one merge a row and round.

Distinct pre-tokens of a chunk of texts that aren't known yet are laid out as matrices of byte ids, grouped by
length and padded.  In each round every row merges its leftmost pair of least rank (``argmin`` gives the
leftmost), rows without a pair leave, and the matrix is compacted to one column less.  Ranks of pairs come
from an open-addressing hash table in numpy arrays.  Pre-tokens longer than ``LONG`` bytes use a heap over a
linked list instead (the same merges): rounds cost the square of the length, a heap n log n steps.  Known pre-tokens are kept per worker up to
``KNOWN`` entries and then dropped, so memory is bounded whatever the vocabulary of the corpus.

Row-local: no shuffle.  Defined cases: null and empty texts give no ids and decode to no bytes; repeated rows
are encoded each; an empty table gives an empty result; columns other than id and text are ignored; ids
outside the vocabulary raise ``ValueError`` on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import _text

#: Pre-tokens of more bytes are merged with a heap.
LONG = 512
#: Pre-tokens that a worker remembers.
KNOWN = 100_000
#: Bytes of text whose pre-tokens are held at once.
CHUNK_BYTES = 512 << 10
#: Bytes of one matrix.
MATRIX = 1 << 20
NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            placed = todo[free][first]
            self.keys[at[placed]] = keys[placed]
            self.rank[at[placed]] = rank[placed]
            self.merged[at[placed]] = merged[placed]
            left_over = np.ones(len(keys), bool)
            left_over[placed] = False
            todo = todo[left_over[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NO_RANK`` where the pair doesn't merge, or either side is padding) and merged ids."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        got = self.keys[at]
        odd = np.flatnonzero((got != keys) & (got != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
            got = self.keys[at[odd]]
            odd = odd[(got != keys[odd]) & (got != -1)]
        return self.rank[at], self.merged[at]


class _Numbers(dict):
    """Numbers new keys as they are asked for."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """Encodes pre-tokens by ``pairs``; ``whole`` takes a pre-token that is a token as it is, before any merge."""

    def __init__(self, token_bytes: dict[int, bytes], pairs: PairTable, pattern: str, whole: bool, special: dict[str, int] | None = None) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.special = special or {}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pairs, self.token_bytes = pairs, token_bytes
        self.by_bytes = {b: i for i, b in token_bytes.items()}
        self.whole = self.by_bytes if whole else {}
        self.byte_ids = np.array([self.by_bytes[bytes([b])] for b in range(256)], np.int32)
        n = max(token_bytes) + 1
        pieces = [token_bytes.get(i, b"") for i in range(n)]
        self.piece_len = np.array([len(p) if i in token_bytes else -1 for i, p in enumerate(pieces)], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(np.maximum(self.piece_len, 0))])
        self.piece_data = np.frombuffer(b"".join(pieces), np.uint8)
        digits = len(str(n)) + 1
        self.decimal = np.frombuffer(b"".join(f"{i},".encode().ljust(digits, b"\0") for i in range(n)), np.uint8).reshape(n, digits)
        self.decimal_len = (self.decimal != 0).sum(1)
        self.reset()

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> Encoder:
        """A rank file: any two tokens whose bytes together are a token merge, by that token's rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*rows, strict=True))
        return cls({i: b for b, i in ranks.items()}, PairTable(left, right, rank, rank), pattern, True)

    @classmethod
    def from_merges(cls, path: str, pattern: str) -> Encoder:
        """A tokenizer file with a merge list: only the listed pairs merge, by their place in the list."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(visible)]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in special}
        return cls(token_bytes | {i: s.encode() for s, i in special.items()}, PairTable(left, right, np.arange(len(pairs), dtype=np.int32), merged), pattern, False, special)

    def reset(self) -> None:
        self.known = _Numbers()
        self.at = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0

    # -- merging -------------------------------------------------------------------------------------------

    def _heap(self, data: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    r, got = self.pairs.find(np.array([ids[x]], np.int32), np.array([ids[after[x]]], np.int32))
                    if r[0] != NO_RANK:
                        heapq.heappush(heap, (int(r[0]), x, ids[x], ids[after[x]], int(got[0])))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _matrix(self, rows: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which rows are done, how many ids each has, their ids one after another); rows hold 2 to ``width`` bytes."""
        m = np.full((len(rows), width), -1, np.int32)
        lens = np.array([len(r) for r in rows])
        m[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        alive = np.arange(len(rows))
        rank, merged = (x.reshape(len(rows), width - 1) for x in self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()))
        while len(alive):
            j = rank.argmin(1)
            go = rank[np.arange(len(alive)), j] != NO_RANK
            if not go.all():
                full = m[~go]
                held = full >= 0
                yield alive[~go], held.sum(1), full[held]
                alive, m, rank, merged, j = alive[go], m[go], rank[go], merged[go], j[go]
                if not len(alive):
                    return
            r = np.arange(len(alive))
            m[r, j] = merged[r, j]
            if m.shape[1] == 2:
                yield alive, np.ones(len(alive), np.int64), m[:, 0]
                return
            m = m[np.arange(m.shape[1]) != (j + 1)[:, None]].reshape(len(alive), -1)
            keep = np.arange(rank.shape[1]) != j[:, None]
            rank, merged = rank[keep].reshape(len(alive), -1), merged[keep].reshape(len(alive), -1)
            for side in (j - 1, j):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                c = side[ok]
                rank[ok, c], merged[ok, c] = self.pairs.find(m[ok, c], m[ok, c + 1])

    def _store(self, numbers: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.count[numbers] = lens
        self.at[numbers] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, fresh: list[str]) -> None:
        """Ids of the pre-tokens numbered last."""
        base = len(self.known) - len(fresh)
        while len(self.known) > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        buckets: dict[int, tuple[list[int], list[bytes]]] = {}
        single: list[tuple[int, int]] = []
        for n, t in enumerate(fresh, base):
            b = t.encode()
            size = len(b)
            if t in self.special:
                single.append((n, self.special[t]))
            elif b in self.whole:
                single.append((n, self.whole[b]))
            elif size == 1:
                single.append((n, int(self.byte_ids[b[0]])))
            elif size > LONG:
                got = self._heap(b)
                self._store(np.array([n]), np.array([len(got)]), got)
            else:
                at = buckets.setdefault(size + size % 2 if size < 17 else (size + 7) // 8 * 8, ([], []))
                at[0].append(n)
                at[1].append(b)
        if single:
            numbers, ids = np.array(single).T
            self._store(numbers, np.ones(len(numbers), np.int64), ids)
        for width, (numbers, rows) in buckets.items():
            step = max(1, MATRIX // (4 * width))
            for i in range(0, len(rows), step):
                part = np.array(numbers[i : i + step])
                for which, lens, ids in self._matrix(rows[i : i + step], width):
                    self._store(part[which], lens, ids)

    # -- whole texts ---------------------------------------------------------------------------------------

    def pre_tokens(self, text: str) -> list[str]:
        if self.cut is None:
            return self.find(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.find(text[at:]) if at else self.find(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text in them."""
        flat: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                flat += self.pre_tokens(t)
            ends.append(len(flat))
        if len(self.known) > KNOWN:
            self.reset()
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        fresh, self.known.fresh = self.known.fresh, []
        self._learn(fresh)
        lens = self.count[which]
        cum = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(self.at[which] - cum[:-1], lens) + np.arange(cum[-1])]
        return ids, cum[np.array(ends)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and the offsets of each text in them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.piece_len) or self.piece_len[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        lens = self.piece_len[ids]
        cum = np.concatenate([[0], np.cumsum(lens)])
        data = self.piece_data[np.repeat(self.piece_at[ids] - cum[:-1], lens) + np.arange(cum[-1])]
        return data, cum[offsets]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        rows = self.decimal[ids].ravel()
        data = rows[rows != 0].tobytes()
        at = np.concatenate([[0], np.cumsum(self.decimal_len[ids])])[offsets].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[tuple[str, str, str], Encoder] = {}


def encoder(path: str, pattern: str, kind: str) -> Encoder:
    """One encoder per worker and vocabulary; ``kind``: ranks or merges."""
    key = (path, pattern, kind)
    if key not in _encoders:
        _encoders[key] = Encoder.from_ranks(path, pattern) if kind == "ranks" else Encoder.from_merges(path, pattern)
    return _encoders[key]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    column = batch.column(1)
    for at, _, offsets in _text.chunks(column, CHUNK_BYTES):
        yield at, column.slice(at, len(offsets) - 1).to_pylist()


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "ranks") -> DataFrame:
    """(id, ids array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, kind)
        for batch in batches:
            for at, texts in _texts(batch):
                ids, offsets = own.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_text.releasing(run), f"`{id_col}` {_id_type(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", kind: str = "ranks") -> DataFrame:
    """(id, data binary): the bytes of the ids of each row; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, kind)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, at = own.decode(np.concatenate([*lists, np.zeros(0, np.int32)]), offsets)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=[id_col, "data"])

    return encoded.select(F.col(f"`{id_col}`"), "ids").mapInArrow(_text.releasing(run), f"`{id_col}` {_id_type(encoded, id_col)}, data binary")


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "ranks") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, digests of both; in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, kind)
        for batch in batches:
            for at, texts in _texts(batch):
                ids, offsets = own.encode(texts)
                data, ends = own.decode(ids, offsets)
                raw = memoryview(np.ascontiguousarray(data))
                ends_list = ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decimals(ids, offsets)]),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends_list[:-1], ends_list[1:], strict=True)]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_text.releasing(run), f"`{id_col}` {_id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
