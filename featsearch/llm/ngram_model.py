"""N-gram language model in an Elias-Fano trie whose levels are mapped files.

Level 1 holds the words of the training texts: their 64-bit hashes, cut into
ranges, one file each with the hashes as an Elias-Fano sequence relative to the
start of the range, and the running sums of the counts as another, so that a
word's place is its id and a difference of two sums its count. Level 2 holds,
per shard, the context ids, the pointers to their successors, and the successors
as one monotone sequence: a successor is stored relative to its context (context
rank times the number of words, plus the word's id), and a query is a successor
search inside the context's range. Each entry has a 16-bit code of its smoothed
probability, as the logarithm of its ratio to the probability it would back off
to, in steps of 2^-11.

The smoothing is a Dirichlet prior: ``p(w | c) = (n(c, w) + MU * p(w)) /
(n(c) + MU)`` with ``p(w) = (n(w) + 0.1) / (N + 0.1 * (V + 1))``. Every word is
followed by exactly one token (the end token included), so ``n(c)`` is the count
of ``c``, known from level 1, and the probabilities of a context add up to 1
without a total per context: a hot context may be split over all shards by its
successor.

Files are written into the shared checkpoint folder by the tasks, under a new
name per attempt; the rows they return name the files that count (one row per
range or shard reaches the driver). Tasks map the ranges of level 1, and one shard
of level 2 each: texts never meet the whole trie. In scoring, the different
pairs of a block of texts are sent to the shard that holds their context, with
the numbers of the texts they occur in, and come back as one number per text.
The number of shards grows with the corpus (``SHARD`` training tokens each).

Defined results: a null or empty text is the end token alone; rows with null ids
are scored but train nothing; repeated rows count and are scored each; words not
seen in training have count 0; without training rows every token has probability
1 (V = N = 0); texts of any length are read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready
from featsearch.llm.elias_fano import EliasFano, joined, parted
from featsearch.llm.shingles import word_hashes
from featsearch.session import checkpoint_dir

#: Strength of the prior, in tokens: the best of powers of ten on held-out rows.
MU = 1000.0
STEP = 2.0**-11
#: Tokens of a block, and training tokens of a shard.
BLOCK, SHARD = 1 << 20, 1 << 22
END = word_hashes(b"</s>")[0] ^ np.uint64(0xFFFF)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: ``crc32(id as text) mod 10`` is 0, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


# Files of the shared folder ---------------------------------------------------


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def put(folder: str, data: bytes) -> str:
    """A new file of ``folder``, visible to all executors; returns its name."""
    from pyarrow import fs

    name = f"{folder}/{uuid.uuid4().hex}.level"
    system, path = (fs.LocalFileSystem(), _local(name)) if _local(name) else fs.FileSystem.from_uri(name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
    return name


def mapped(name: str) -> np.ndarray:
    """The words of a file: mapped where the folder is mounted, else read."""
    if _local(name):
        return np.memmap(_local(name), "<u8", "r")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), "<u8")


# Level 1 ----------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Level 1: ``files`` by range of hashes; ``first`` hash and ``offset`` (ids
    before it) of every file; tokens ``n``, words ``v``, texts ``docs``."""

    files: list[str]
    first: np.ndarray
    offset: np.ndarray
    n: int
    v: int
    docs: int

    def _parts(self, numbers: np.ndarray, starts: np.ndarray):
        """Slices of sorted ``numbers`` that fall between two ``starts``."""
        cuts = np.searchsorted(numbers, starts[1:]) if len(starts) else []
        edges = [0, *cuts, len(numbers)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                yield k, slice(a, b), *(EliasFano(x) for x in parted(mapped(self.files[k])))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        if self.v:
            below = np.searchsorted(hashes, self.first[0])  # before the first range
            for k, at, names, sums in self._parts(hashes[below:], self.first):
                place, equal = names.successor(hashes[below:][at] - self.first[k])
                where = np.arange(below + at.start, below + at.stop)[equal]
                ids[where] = place[equal] + self.offset[k]
                counts[where] = sums.get(place[equal] + 1) - sums.get(place[equal])
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        for k, at, _, sums in self._parts(ids, self.offset) if self.v else ():
            place = ids[at] - self.offset[k]
            out[at] = sums.get(place + 1) - sums.get(place)
        return out

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    @property
    def start(self) -> int:
        """Id of the context before the first word."""
        return self.v

    def totals(self, contexts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(contexts == self.start, self.docs, counts)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, and the end token."""
    return np.append(word_hashes((text or "").encode().lower()), END)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their tokens in a row and the number of tokens of each, in
    blocks of at least ``BLOCK`` tokens (the last one is smaller)."""
    rows, found, size = [], [], 0
    for batch in batches:
        at = 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            found.append(tokens(text))
            size += len(found[-1])
            if size >= BLOCK:
                rows.append(batch.drop_columns(["text"]).slice(at, i + 1 - at))
                yield _block(rows, found)
                rows, found, size, at = [], [], 0, i + 1
        if at < batch.num_rows:
            rows.append(batch.drop_columns(["text"]).slice(at))
    if found:
        yield _block(rows, found)


def _block(rows, found):
    table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    return table, np.concatenate(found), np.array([len(x) for x in found])


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, sizes in _blocks(batches):
            hashes, counts = np.unique(words, return_counts=True)
            part = (hashes >> np.uint64(32)).astype(np.int64) * parts >> 32  # ranges of equal width
            part = np.append(part, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.append(hashes, np.uint64(0)).view(np.int64)), pa.array(np.append(counts, len(sizes)))],
                ["part", "hash", "n"],
            )

    return run


def _range_file(folder: str):
    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes = table.column("hash").to_numpy().view(np.uint64)
        counts = table.column("n").to_numpy()
        if part < 0:  # the number of texts
            return pa.table({"part": [part], "first": [0], "v": [0], "n": [int(counts.sum())], "file": [""]})
        order = np.argsort(hashes)
        hashes, sums = hashes[order], np.concatenate([[0], np.cumsum(counts[order])])
        file = put(folder, joined([EliasFano.build(hashes - hashes[0]), EliasFano.build(sums)]))
        first = pa.array(hashes[:1].view(np.int64))
        return pa.table({"part": [part], "first": first, "v": [len(hashes)], "n": [int(sums[-1])], "file": [file]})

    return write


def _rows(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )


def words(rows: DataFrame, folder: str, parts: int) -> Words:
    """Level 1 of the training texts ``rows(text)``."""
    counted = rows.mapInArrow(_counted(parts), "part long, hash long, n long").groupBy("part", "hash").agg(F.sum("n").alias("n"))
    written = counted.groupBy("part").applyInArrow(_range_file(folder), "part long, first long, v long, n long, file string")
    found = sorted(written.collect(), key=lambda r: r.part)  # a row per range
    docs = sum(r.n for r in found if r.part < 0)
    found = [r for r in found if r.part >= 0]
    sizes = np.array([r.v for r in found], np.int64)
    first = np.array([r.first for r in found], np.int64).view(np.uint64)
    return Words([r.file for r in found], first, np.cumsum(sizes) - sizes, sum(r.n for r in found), int(sizes.sum()), docs)


# Level 2 ----------------------------------------------------------------------


def pack(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers in as few bytes as the largest takes, byte planes, zstandard."""
    out = []
    for x in arrays:
        width = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
        planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        out += [np.array([len(x), width], "<u8").tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        n, width = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(whole.view("<u8").ravel().astype(np.int64))
        at += 16 + n * width
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shard(level: Words, contexts: np.ndarray, counts: np.ndarray, follow: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every pair: by its context, and for contexts that would fill a
    quarter of a shard by the successor too."""
    hot = 4 * shards * level.totals(contexts, counts) > level.n
    mixed = _mixed(contexts)
    return (np.where(hot, _mixed(mixed ^ _mixed(follow + 1)), mixed) >> np.uint64(33)).astype(np.int64) % shards


def _pairs(level: Words, block: np.ndarray, sizes: np.ndarray):
    """Per token: context and word (ids, -1 where unknown) and their counts."""
    hashes, at = np.unique(block, return_inverse=True)
    ids, counts = level.find(hashes)
    word, count = ids[at], counts[at]
    first = np.cumsum(sizes) - sizes
    context, total = np.roll(word, 1), np.roll(count, 1)
    context[first], total[first] = level.start, level.docs
    return context, total, word, count


def _routed(level: Words, shards: int, context, total, word, document):
    """Known pairs by shard: shard, then context (steps), word, occurrences, and
    the document of every occurrence."""
    known = np.flatnonzero((context >= 0) & (word >= 0))
    context, total, word, document = context[known], total[known], word[known], document[known]
    shard = _shard(level, context, total, word, shards)
    order = np.lexsort((document, word, context, shard))
    shard, context, word, document = shard[order], context[order], word[order], document[order]
    new = np.ones(len(shard), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    new = np.flatnonzero(new)
    times = np.diff(np.append(new, len(shard)))
    starts = np.flatnonzero(np.diff(shard[new], prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(new)], strict=False):  # no starts: no pairs
        mine = new[a:b]
        steps = np.diff(context[mine], prepend=0)
        yield int(shard[mine[0]]), [steps, word[mine], times[a:b], document[mine[0] : mine[-1] + times[b - 1]]]


def _trained(level: Words, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, sizes in _blocks(batches):
            context, total, word, _ = _pairs(level, block, sizes)
            for shard, (steps, follow, times, _) in _routed(level, shards, context, total, word, np.zeros(len(word), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([pack([steps, follow, times])])], ["shard", "pairs"])

    return run


def _shard_file(level: Words, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, stride, shard = np.zeros(0, np.int64), np.zeros(0, np.int64), level.v + 1, 0
        waiting, size = [], 0
        for batch in [*batches, None]:
            for data, shard in zip(*(batch.column(c).to_pylist() for c in ("pairs", "shard")), strict=True) if batch else ():
                steps, follow, times = unpack(data)
                waiting.append((np.cumsum(steps) * stride + follow, times))
                size += len(times)
            if size > max(len(keys), BLOCK) or batch is None:  # merged whenever it has doubled
                every, at = np.unique(np.concatenate([keys, *(k for k, _ in waiting)]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, *(t for _, t in waiting)]), len(every)).astype(np.int64)
                keys, waiting, size = every, [], 0
        context, follow = keys // stride, keys % stride
        contexts, start = np.unique(context, return_index=True)
        ids, at = np.unique(follow, return_inverse=True)
        prior = 10.0 ** level.log_p(level.counts(ids))[at]
        codes = np.minimum(np.rint(np.log10(1 + counts / (MU * prior)) / STEP), 65535).astype("<u2")
        rank = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(keys))))
        levels = [EliasFano.build(x) for x in (contexts, np.append(start, len(keys)), rank * stride + follow)]
        file = put(folder, joined([*levels, np.pad(codes, (0, -len(codes) % 4)).view("<u8")]))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([file])], ["shard", "file"])

    return write


class Trie:
    """One shard of level 2, as it lies in its file."""

    def __init__(self, file: str, stride: int):
        contexts, pointers, follow, codes = parted(mapped(file))
        self.contexts, self.pointers, self.follow = EliasFano(contexts), EliasFano(pointers), EliasFano(follow)
        self.codes, self.stride = codes.view("<u2"), stride

    def gains(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log10 of ``p(w | c)`` over its backoff, of pairs sorted by context
        (0: not seen)."""
        own, at = np.unique(context, return_inverse=True)
        rank, held = self.contexts.successor(own)
        rank = np.where(held, rank, 0)
        start, end = self.pointers.get(rank)[at], self.pointers.get(rank + 1)[at]
        place, equal = self.follow.successor(rank[at] * self.stride + word)
        hit = equal & held[at] & (place >= start) & (place < end)
        out = np.zeros(len(word))
        out[hit] = self.codes[place[hit]] * STEP
        return out


# Training and scoring ---------------------------------------------------------


@dataclass(frozen=True)
class Model:
    words: Words
    files: dict[int, str]
    shards: int


def train(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", shard=SHARD) -> Model:
    """Model of the rows where ``learn`` holds."""
    spark = docs.sparkSession
    python_ready(spark)
    folder = f"{checkpoint_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    rows = _rows(docs, id_col, text_col, learn).where("learn").select("text")
    level = words(rows, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(-(-level.n // shard), 1)
    pairs = rows.mapInArrow(_trained(level, shards), "shard long, pairs binary")
    written = pairs.groupBy("shard").applyInArrow(_shard_file(level, folder), "shard long, file string")
    return Model(level, {r.shard: r.file for r in written.collect()}, shards)  # a row per shard


def _asked(model: Model):
    """Blocks of texts: what needs level 1 alone, and the pairs by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = model.words
        for rows, block, sizes in _blocks(batches):
            context, total, word, count = _pairs(level, block, sizes)
            first, document = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            base = level.log_p(count)
            sums = [np.add.reduceat(x, first) for x in (count > 0, base, base + np.log10(MU / (total + MU)))]
            known = pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("learn"), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                ["id", "learn", "n_tokens", "n_known", "base_score", "score"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, known.schema) as out:
                out.write_batch(known)
            number = rows.column("row")[0].as_py()
            made = [(number % model.shards, sink.getvalue().to_pybytes(), True)]
            made += [(s, pack(x), False) for s, x in _routed(level, model.shards, context, total, word, document)]
            for shard, data, texts in made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([number]), pa.array([texts]), pa.array([data], pa.binary())],
                    ["shard", "block", "texts", "data"],
                )

    return run


def _answered(model: Model):
    """Per block of texts the sums of the gains of one shard's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            data = []
            for shard, texts, asked in zip(*(batch.column(c).to_pylist() for c in ("shard", "texts", "data")), strict=True):
                if not texts:
                    trie = trie or Trie(model.files[shard], model.words.v + 1) if shard in model.files else None
                    steps, follow, times, document = unpack(asked)
                    gains = trie.gains(np.cumsum(steps), follow) if trie else np.zeros(len(follow))
                    own, at = np.unique(document, return_inverse=True)
                    sums = np.bincount(at, np.repeat(gains, times), len(own))
                    asked = own.astype("<u4").tobytes() + sums.astype("<f8").tobytes()
                data.append(asked)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("texts"), pa.array(data, pa.binary())], ["block", "texts", "data"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, gains = None, []
    for batch in batches:
        for texts, data in zip(batch.column("texts").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if texts:
                known = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
            else:
                n = len(data) // 12
                gains.append((np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f8", n, 4 * n)))
    score = known.column("score").to_numpy().copy()
    order = sorted(gains, key=lambda x: (x[0][0], x[1].tobytes()))  # one order of addition
    for own, sums in order:
        score[own] += sums
    yield known.set_column(5, "score", pa.array(score))


def score(docs: DataFrame, model: Model, learn: Column, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row ``id, learn, n_tokens, n_known``, the word-by-word ``base_score``
    and the model's ``score`` (log10 probabilities of the whole text)."""
    python_ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, learn).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.mapInArrow(_asked(model), "shard long, block long, texts boolean, data binary")
    answered = asked.groupBy("shard").applyInArrow(_answered(model), "block long, texts boolean, data binary")
    return answered.groupBy("block").applyInArrow(
        _gathered, f"id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double"
    )
