"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; a token is known by the byte offset where it
ends. At a common boundary the two arrays of ends are compared at the current
index shift: while they agree the probe doubles, after a miss it halves, so a
stretch of one-to-one tokens is jumped in a few slice comparisons. Where the
next ends differ, the side that lags advances token by token until both meet
again (an irregular group), which gives the group's links and the new shift.

Texts are cut before blanks between two visible characters: neither tokenizer
joins bytes across such a blank (the first one's pieces start there, no piece of
the second has a blank behind a visible character). So a word is encoded and
aligned once per worker and kept with its links and groups: new words are aligned
together, in one run over both arrays, and a text is what its words give. A text
of any length is taken in bounded memory, in chunks of ``CHUNK`` characters or more.

One pass encodes, aligns and writes a row per document with its different id
pairs, and a row per batch with the pairs of the batch. Their sums over the
corpus are a table of id pairs (bounded by the two vocabularies, not by the
texts). With at most ``LOOKUP`` pairs it goes to the tasks as a sorted array,
otherwise the documents' pairs are joined with it.

Defined results: a null or empty text, and one that a tokenizer does not give
back byte by byte, has no tokens: zeros and an empty digest. Special tokens in
texts are plain text. Repeated rows give repeated rows and count each time; null
ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.bpe import gather
from featsearch.llm.common import join_hot, python_ready, stored
from featsearch.session import Payload

CHUNK = 1 << 16
#: Id pairs that are sent to the tasks (17 bytes each).
LOOKUP = 1 << 21
#: Words whose alignment a worker keeps.
KNOWN = 1 << 19
_CUT = re.compile(r"(?<=\S) (?=\S)")
FIELDS = "id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>, corpus boolean"


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two token sequences over the same bytes.

    ``link_a, link_b``: token numbers of every overlapping pair; ``last_a,
    last_b``: number of the last token of every group, on either side.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b, width = ends_a.tobytes(), ends_b.tobytes(), ends_a.itemsize
    n, i, shift = len(a), 0, 0
    runs, run_shifts, sizes = [], [], []
    own_a, own_b, tail_a, tail_b = [], [], [], []
    while i < n:
        if a[i] == b[i + shift]:
            start, step = i, 1
            i += 1
            while step and i < n:  # exponential probing along the diagonal
                j = i + shift
                if raw_a[i * width : (i + step) * width] == raw_b[j * width : (j + step) * width]:
                    i += step
                    step *= 2
                else:
                    step //= 2
                    break
            while step:
                j = i + shift
                if i < n and raw_a[i * width : (i + step) * width] == raw_b[j * width : (j + step) * width]:
                    i += step
                step //= 2
            i = min(i, n)
            runs.append(start)
            run_shifts.append(shift)
            sizes.append(i - start)
        else:
            j = i + shift
            while True:
                own_a.append(i)
                own_b.append(j)
                left, right = a[i], b[j]
                if left == right:
                    break
                if left < right:
                    i += 1
                else:
                    j += 1
            tail_a.append(i)
            tail_b.append(j)
            i, shift = i + 1, j - i
    sizes = np.array(sizes, np.int64)
    first = np.repeat(np.array(runs, np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    second = first + np.repeat(np.array(run_shifts, np.int64), sizes)

    def joined(run, own):
        return np.concatenate([run, np.array(own, np.int64)])

    last_a, last_b = joined(first, tail_a), joined(second, tail_b)
    order = np.argsort(last_a)
    return joined(first, own_a), joined(second, own_b), last_a[order], last_b[order]


class Side:
    """Byte strings and decimal ids of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = np.array(tokens, object)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        ids = [str(i) for i in range(len(tokens))]
        self.words = {mark: np.array([i + mark for i in ids], object) for mark in ",|;\n"}

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, built once per Python worker."""

    def __init__(self, json_file: bytes, model_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        letters = _byte_letters()
        described = json.loads(json_file)
        entries = described["model"]["vocab"]
        size = max([*entries.values(), *(t["id"] for t in described["added_tokens"])]) + 1
        of_a = [b""] * size
        for t in described["added_tokens"]:
            of_a[t["id"]] = t["content"].encode()
        for token, i in entries.items():
            if all(c in letters for c in token):
                of_a[i] = bytes(letters[c] for c in token)
        of_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            of_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.side_a, self.side_b = Side(of_a), Side(of_b)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.given_back = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # of a word: tokens by either, groups, links
        self.groups: list[str] = []
        self.links, self.starts, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def learn(self, words: list[str]) -> None:
        """Alignment of blank + word by the first with the word (which adds the blank) by the second."""
        whole = [b" " + w.encode() for w in words]
        of_a = [x.ids for x in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        given_back = np.ones(len(words), bool)
        pools = []
        for side, ids in ((self.side_a, of_a), (self.side_b, self.b.encode(words, num_threads=1))):
            lengths = np.array([len(i) for i in ids], np.int64)
            pool = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
            # equal bytes in a row, of equal lengths word by word; else word by word
            sizes = np.add.reduceat(np.append(side.lengths[pool], 0), np.cumsum(lengths) - lengths) * (lengths > 0)
            if b"".join(side.tokens[pool].tolist()) != b"".join(whole) or (sizes != [len(w) for w in whole]).any():
                given_back &= [b"".join(side.tokens[i].tolist()) == w for i, w in zip(ids, whole, strict=True)]
            pools.append((pool, lengths))
        for word in words:
            self.known[word] = len(self.known)
        numbers = np.flatnonzero(given_back)
        (a, word_a), (b, word_b) = [
            (pool[np.repeat(given_back, lengths)], np.repeat(numbers, lengths[given_back])) for pool, lengths in pools
        ]
        link_a, link_b, last_a, last_b = align(self.side_a.ends(a), self.side_b.ends(b))  # every word ends both arrays
        of_link = word_a[link_a]
        order = np.argsort(of_link, kind="stable")
        counts = np.stack([np.bincount(x, minlength=len(words)) for x in (word_a, word_b, word_a[last_a], of_link)], axis=1)
        groups = [""] * len(words)
        text = self.written(a, b, last_a, last_b, np.append(word_b[1:] != word_b[:-1], True)[: len(b)])
        for k, own in zip(numbers.tolist(), text.split("\n")):
            groups[k] = own
        self.given_back = np.concatenate([self.given_back, given_back])
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.links = np.concatenate([self.links, ((a[link_a] << 32) | b[link_b])[order]])
        self.counts = np.concatenate([self.counts, counts])
        self.groups += groups
        self.held += len(text)

    def encode(self, chunks: list[str]) -> Iterator[np.ndarray | None]:
        """Numbers of the words of every chunk (None: bytes are not given back).

        Neither tokenizer joins across the blanks of ``_CUT``, so each word
        between them is encoded and aligned once per ``KNOWN`` words."""
        words = [_CUT.split(c) for c in chunks]
        if len(self.known) > KNOWN or len(self.links) > 16 * KNOWN or self.held > 128 * KNOWN:
            self.forget()
        if fresh := list(dict.fromkeys(w for own in words for w in own if w not in self.known)):
            self.learn(fresh)
        for own in words:
            at = np.array([self.known[w] for w in own])
            yield at if self.given_back[at].all() else None

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> str:
        """Groups as ``a1,a2|b1;a3|b2``, a line per word; ``ends`` marks the last second token of a word."""
        out = np.empty(len(a) + len(b), object)
        before = np.concatenate([[0], last_b[:-1] + 1])
        for side, ids, last, other, mark in ((self.side_a, a, last_a, before, "|"), (self.side_b, b, last_b, last_a + 1, ";")):
            closes = np.zeros(len(ids), bool)
            closes[last] = True
            group = np.cumsum(closes) - closes
            out[np.arange(len(ids)) + other[group]] = np.where(closes, side.words[mark][ids], side.words[","][ids])
        at = np.flatnonzero(ends)
        out[at + (last_a + 1)[(np.cumsum(closes) - closes)[at]]] = self.side_b.words["\n"][b[at]]
        return "".join(out.tolist())


def cut(text: str) -> list[str]:
    """Parts of a text; every blank between two parts is left out."""
    parts, at = [], 0
    while len(text) - at > CHUNK:
        found = _CUT.search(text, at + CHUNK)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]]


def document(pair: Pair, encoded: list[np.ndarray | None]):
    """Counts, digest and id pairs of one document (None: not given back)."""
    if any(at is None for at in encoded):
        return None
    digest, pairs, counts = hashlib.sha256(), [], np.zeros(4, np.int64)
    for k, at in enumerate(encoded):
        own = pair.counts[at]
        counts += own.sum(axis=0)
        pairs.append(gather(pair.links, pair.starts[at], own[:, 3]))
        digest.update((";" * (k > 0) + ";".join(map(pair.groups.__getitem__, at.tolist()))).encode())
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    return *counts.tolist(), digest.hexdigest(), pairs, times


_BUILT: dict = {}
#: Characters that are encoded together.
UNIT = 1 << 21


def _aligned(shared: Payload, key: tuple[str, str]):
    def rows(pair: Pair, texts: list[str | None]):
        """Results in the order of ``texts``, ``UNIT`` characters at a time."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < UNIT):
                size += len(texts[stop] or "")
                stop += 1
            parts = [cut(t) if t else [] for t in texts[at:stop]]
            encoded = pair.encode([c for p in parts for c in p])
            for p in parts:
                yield document(pair, [next(encoded) for _ in p]) if p else None
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT[key] = Pair(*shared.get())
        pair = _BUILT[key]
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [none if r is None else r for r in rows(pair, batch.column(1).to_pylist())]
            every = np.concatenate([r[5] for r in found])
            pairs, where = np.unique(every, return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, where, np.concatenate([r[6] for r in found]))
            found.append((0, 0, 0, 0, "", pairs, times))
            ends = np.concatenate([[0], np.cumsum([len(r[5]) for r in found])]).astype(np.int32)
            columns = [pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])]
            columns += [pa.array([r[k] for r in found], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in found])]
            columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in found]))) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([False] * batch.num_rows + [True])], _names())

    return run


def _names() -> list[str]:
    return [f.split()[0] for f in FIELDS.split(", ")]


def aligned(docs: DataFrame, json_path: str, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Written table: a row per document, and per batch its id pairs (``corpus``)."""
    spark = docs.sparkSession
    python_ready(spark)
    files = []
    for path in (json_path, model_path):
        with open(path, "rb") as f:
            files.append(f.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = Payload(spark, tuple(files), sum(map(len, files)))
    made = rows.mapInArrow(_aligned(shared, (json_path, model_path)), FIELDS.format(kind))
    return stored(made.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair`` (first id * 2^32 + second id), its ``count`` over the corpus, and
    ``best``: no pair of the second id has more."""
    counts = (
        rows.where("corpus").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    )
    counts = stored(counts)
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))  # at most the second vocabulary
    return counts.withColumn("second", second).join(F.broadcast(most), "second").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def _looked_up(shared: Payload):
    @F.arrow_udf("struct<n_best long, count_sum long>")
    def totals(pairs: pa.Array, times: pa.Array) -> pa.Array:
        known, count, best = shared.get()
        ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
        times = times.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, pairs.flatten().to_numpy(zero_copy_only=False))
        sums = []
        for each in (best[at] * times, count[at] * times):
            whole = np.concatenate([[0], np.cumsum(each)])
            sums.append(pa.array(whole[ends[1:]] - whole[ends[:-1]]))
        return pa.StructArray.from_arrays(sums, ["n_best", "count_sum"])

    return totals


def totals(rows: DataFrame, counts: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """Documents of ``rows`` with ``n_best`` and ``count_sum`` over their links."""
    docs = rows.where("not corpus")
    if counts.count() <= lookup:
        table = counts.toArrow().sort_by("pair")
        known, count, best = (table[c].to_numpy() for c in ("pair", "count", "best"))
        sums = _looked_up(Payload(rows.sparkSession, (known, count, best.astype(np.int64)), 24 * len(known) + 1))
        return docs.withColumn("sums", sums("pairs", "times")).select("*", "sums.n_best", "sums.count_sum").drop("sums")
    links = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n")
    )
    sums = join_hot(links, counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    return docs.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, json_path: str, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document ``id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` and its id ``pairs`` with their ``times``."""
    rows = aligned(docs, json_path, model_path, id_col, text_col)
    return totals(rows, pair_counts(rows)).select(
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"
    )
