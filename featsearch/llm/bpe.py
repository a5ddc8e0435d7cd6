"""Byte-level BPE: encoding by a segment tree over byte positions, decoding.

A text is cut by the vocabulary's pattern, and each piece is merged on its
own: a segment tree over the byte positions of the piece holds, per node, the
least (pair rank, position) below it, so its root is the leftmost pair of
minimum rank. A merge changes three leaves (the merged part, its left
neighbour, the part that vanished) and repairs their paths to the root.

Pieces of up to 64 bytes are merged many at a time: row r of a matrix is the
tree of piece r, and every step merges one pair of each piece that still has
one. Longer pieces have a tree of their own. Results per piece are kept in a
bounded table of the Python worker, so frequent pieces are merged once.

Defined results: a null or empty text has no ids; repeated rows are encoded
alike; texts of any length are encoded whole, in chunks of pieces; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready

#: Pieces whose ids a worker keeps, and pieces that are merged together.
TABLE, UNIT = 1 << 18, 1 << 18
SHORT = 64
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of byte strings; ids are ranks. Built once per Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.pieces = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        joined = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[left * self.size + right] = rank
        self.pairs = joined
        self.pair_keys = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[k] for k in self.pair_keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.pool_start, self.pool_len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where the pair does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most ``SHORT`` bytes, one matrix row each."""
        n, longest = len(pieces), max(map(len, pieces))
        width = 1
        while width < longest:
            width *= 2
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.of_byte[raw]
        live = np.arange(width) < lengths[:, None]
        right = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), -1)
        left = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        if width > 1:
            r = self.rank(ids[:, :-1], ids[:, 1:])
            paired = (r != NONE) & live[:, 1:]
            tree[:, width : 2 * width - 1] = np.where(paired, r * width + np.arange(width - 1), NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(n, level // 2, 2).min(axis=2)
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best % width
            gone = right[rows, at]
            after, before = right[rows, gone], left[rows, at]
            ids[rows, at] = best // width
            live[rows, gone] = False
            right[rows, at] = after
            has = after >= 0
            left[rows[has], after[has]] = at[has]
            self._set(tree, width, rows, gone, np.full(len(rows), NONE))
            fresh = self.rank(ids[rows, at], ids[rows, np.maximum(after, 0)])
            self._set(tree, width, rows, at, np.where(has & (fresh != NONE), fresh * width + at, NONE))
            has = before >= 0
            some, b = rows[has], before[has]
            fresh = self.rank(ids[some, b], ids[some, at[has]])
            self._set(tree, width, some, b, np.where(fresh != NONE, fresh * width + b, NONE))
            rows = rows[tree[rows, 1] != NONE]
        return np.split(ids[live], np.cumsum(live.sum(axis=1))[:-1])

    @staticmethod
    def _set(tree, width, rows, at, value) -> None:
        """Point update: one leaf per row, then its path to the root."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, by a tree of its own."""
        n, none, size, pairs = len(piece), NONE, self.size, self.pairs
        width = 1
        while width < n:
            width *= 2
        ids = [int(self.of_byte[b]) for b in piece]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        tree = [none] * (2 * width)

        def leaf(i):
            r = pairs.get(ids[i] * size + ids[right[i]]) if right[i] >= 0 else None
            return none if r is None else r * width + i

        def put(i, value):
            node = i + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            at = tree[1] % width
            gone = right[at]
            ids[at], ids[gone] = tree[1] // width, -1
            right[at] = right[gone]
            if right[at] >= 0:
                left[right[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if left[at] >= 0:
                put(left[at], leaf(left[at]))
        return [i for i in ids if i >= 0]

    def learn(self, new: list[str]) -> None:
        """Merge pieces not met before and keep their ids."""
        found: list = [None] * len(new)
        short: dict[int, list[int]] = {}
        for i, piece in enumerate(new):
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                found[i] = [rank]
            elif len(data) > SHORT:
                found[i] = self.merge_long(data)
            else:
                short.setdefault((len(data) - 1).bit_length(), []).append(i)
        for of_size in short.values():
            for start in range(0, len(of_size), 1 << 15):
                part = of_size[start : start + (1 << 15)]
                for i, ids in zip(part, self.merge_many([new[i].encode() for i in part]), strict=True):
                    found[i] = ids
        lengths = np.array([len(x) for x in found], np.int64)
        first, base = len(self.pool_len), len(self.pool)
        self.pool = np.concatenate([self.pool, *(np.asarray(x, np.int32) for x in found)])
        self.pool_start = np.concatenate([self.pool_start, base + np.cumsum(lengths) - lengths])
        self.pool_len = np.concatenate([self.pool_len, lengths])
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        new = list({p for p in pieces if p not in self.known})
        if len(self.known) + len(new) > TABLE:
            self.forget()
            new = list(set(pieces))
        if new:
            self.learn(new)
        slot = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.pool_len[slot]
        return gather(self.pool, self.pool_start[slot], lengths), lengths

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        ids, counts, pieces, owner = [], np.zeros(len(texts), np.int64), [], []

        def flush():
            got, lengths = self.encode_pieces(pieces)
            ids.append(got)
            np.add.at(counts, np.repeat(*np.array(owner).T), lengths)
            pieces.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for chunk in self._cut(text or ""):
                pieces += chunk
                owner.append((i, len(chunk)))
                if len(pieces) >= UNIT:
                    flush()
        if pieces:
            flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts

    def _cut(self, text: str):
        if len(text) < UNIT:
            found = self.pieces.findall(text)
            if found:
                yield found
            return
        chunk = []
        for m in self.pieces.finditer(text):
            chunk.append(m[0])
            if len(chunk) == UNIT:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``pool[start : start + length]`` in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


_BUILT: dict = {}


def _vocabulary(shared) -> Vocabulary:
    if shared.id not in _BUILT:
        _BUILT[shared.id] = Vocabulary(*shared.value)
    return _BUILT[shared.id]


class _Shared:
    """The rank file and pattern as a broadcast (under 1 MB for 50k ranks)."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = spark.sparkContext.broadcast((f.read(), pattern))
        self.id = (path, pattern)

    @property
    def value(self):
        return self.data.value


def encoder(spark, path: str, pattern: str):
    """Arrow UDF: text column to its ids (``array<int>``)."""
    shared = _Shared(spark, path, pattern)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, counts = _vocabulary(shared).encode_texts(texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))

    return encode.asNondeterministic()


def decoder(spark, path: str, pattern: str):
    """Arrow UDF: ids to the bytes they stand for."""
    shared = _Shared(spark, path, pattern)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(shared)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        ends = ends - ends[0]
        return pa.array([vocabulary.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return decode.asNondeterministic()


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """``id`` and the token ``ids`` of every text."""
    python_ready(docs.sparkSession)
    ids = encoder(docs.sparkSession, path, pattern)(F.col("text"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    return rows.select("id", ids.alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ``ids``."""
    return encoded.withColumn("decoded", decoder(encoded.sparkSession, path, pattern)(F.col("ids")))
