"""Substring dedup over a compacted De Bruijn graph of token k-mers.

Edges of the graph are windows of ``WINDOW`` consecutive words; a document is a
path. Only edges that more than one document may hold enter the graph: each
window is represented by the least 5-gram hash in it (its minimizer), which is
the same wherever the window occurs, and a window whose minimizer occurs in one
document alone is unique. The minimizers of several documents are kept in a
bit table of fixed size; what it lets through by mistake costs work, not results.

Runs of such edges are compacted: they are cut into pieces at edges chosen by
their own hash, so the inner pieces of a passage are equal wherever it occurs.
Equal pieces meet in a join, and a piece that a smaller document also has is
removed as a whole. What is left (one copy of each piece, and the pieces that
contain a branching) is compared edge by edge. The least document that holds an
edge always keeps its piece, so nothing is lost by that. Every removed span
carries its source coordinates: document, first word, edges. Documents are
compared as read: an edge that was removed still marks larger documents.

Edges are told apart by 96 bits, pieces by 128. Hot edges and pieces are
combined before they are shuffled, and joins may split them.

Defined results: null and empty texts have no words; texts shorter than a
window keep all words; a null id counts as larger than every id; rows that
share an id never mark each other; repeated rows get equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsearch.llm.common import join_hot, python_ready, stored
from featsearch.llm.shingles import distinct, scramble, window_hashes, word_hashes

WINDOW, GRAM = 13, 5
#: Size of the bit table (2^27 bits: 16 MB) and bits set per minimizer.
BITS, PROBES = 27, 2
#: A piece ends before an edge whose hash is a multiple of this.
PIECE = 16
#: Spans that are broadcast at most (under 32 MB); more are shuffled.
SMALL = 1 << 20


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, version, text``: ``doc`` orders documents, ``version`` tells
    apart different texts under one id by a 64-bit hash."""
    python_ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col!r} is {kind.simpleString()}: documents are ordered by a whole number; rank other ids first")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(np.iinfo(np.int64).max)).alias("doc"),
        F.xxhash64(text).alias("version"), text.alias("text"),
    )


def _minimizers(hashes: np.ndarray) -> np.ndarray:
    """The minimizer of every window."""
    grams = window_hashes(hashes, GRAM)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).min(axis=1)


def _probe(minimizers: np.ndarray, i: int) -> np.ndarray:
    return scramble(minimizers + np.uint64(i)) >> np.uint64(64 - BITS)


def shared_minimizers(rows: DataFrame) -> DataFrame:
    """``minimizer`` of windows in two documents or more."""

    def run(batches):
        for b in batches:
            found, docs = [], []
            for doc, text in zip(b["doc"].to_pylist(), b["text"].to_pylist(), strict=True):
                hashes = word_hashes(text.encode())
                if len(hashes) >= WINDOW:
                    found.append(distinct(_minimizers(hashes)))
                    docs.append(doc)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)),
                     pa.array(np.repeat(np.array(docs, np.int64), [len(f) for f in found]))],
                    ["minimizer", "doc"],
                )

    pairs = rows.select("doc", "text").mapInArrow(run, "minimizer long, doc long")
    docs_of = pairs.groupBy("minimizer").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    return docs_of.where("first < last").select("minimizer")


def bit_table(shared: DataFrame) -> np.ndarray:
    """The minimizers as bits. At most 2^21 rows of 64 bits are collected."""

    def run(batches):
        for b in batches:
            m = b["minimizer"].to_numpy().view(np.uint64)
            bits = np.unique(np.concatenate([_probe(m, i) for i in range(PROBES)]))
            word = (bits >> np.uint64(6)).astype(np.int64)
            value = np.uint64(1) << (bits & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    words = shared.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["value"].to_numpy().view(np.uint64)
    return table


def _candidates(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return _holds(table, _minimizers(hashes))


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for i in range(PROBES):
        bit = _probe(keys, i)
        found &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def pieces(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``piece, doc, version, start, n, edges``: the compacted paths.

    ``edges`` holds 12 bytes per edge, ``start`` the first word of the first.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table)  # 16 MB
    edge = np.dtype([("a", "<u8"), ("b", "<u4")])

    def run(batches):
        for b in batches:
            out = []
            for doc, version, text in zip(*(b[c].to_pylist() for c in ("doc", "version", "text")), strict=True):
                hashes = word_hashes(text.encode())
                if len(hashes) < WINDOW:
                    continue
                found = _candidates(shared.value, hashes)
                if not found.any():
                    continue
                edges = np.empty(len(found), edge)
                edges["a"], edges["b"] = window_hashes(hashes, WINDOW), window_hashes(hashes, WINDOW, seed=1) >> np.uint64(32)
                begins = found & ((edges["a"] % np.uint64(PIECE) == 0) | ~np.concatenate([[False], found[:-1]]))
                starts = np.flatnonzero(begins)
                gaps = np.flatnonzero(np.concatenate([~found, [True]]))
                stops = np.minimum(np.append(starts[1:], len(found)), gaps[np.searchsorted(gaps, starts)])
                for a, z in zip(starts.tolist(), stops.tolist(), strict=True):
                    path = edges[a:z].tobytes()
                    out.append((xxhash.xxh3_128_digest(path), doc, version, a, z - a, path))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["piece", "doc", "version", "start", "n", "edges"],
                )

    kinds = "piece binary, doc long, version long, start int, n int, edges binary"
    return rows.select("doc", "version", "text").mapInArrow(run, kinds)


def _edges(left: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``a, b, doc, version, at``: the edges of the pieces that are left, of
    those only which a bit table holds, if one is given."""
    shared = None if table is None else left.sparkSession.sparkContext.broadcast(table)  # 16 MB

    def run(batches):
        for p in batches:
            if not p.num_rows:
                continue
            n = p["n"].to_numpy()
            every = np.frombuffer(b"".join(p["edges"].to_pylist()), np.dtype([("a", "<u8"), ("b", "<u4")]))
            begin = np.cumsum(n) - n
            at = np.repeat(p["start"].to_numpy() - begin, n) + np.arange(len(every))
            a = np.ascontiguousarray(every["a"])
            keep = np.ones(len(a), bool) if shared is None else _holds(shared.value, a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep].view(np.int64)), pa.array(every["b"][keep].astype(np.int64)),
                 pa.array(np.repeat(p["doc"].to_numpy(), n)[keep]), pa.array(np.repeat(p["version"].to_numpy(), n)[keep]),
                 pa.array(at[keep].astype(np.int32))],
                ["a", "b", "doc", "version", "at"],
            )

    return left.select("doc", "version", "start", "n", "edges").mapInArrow(run, "a long, b long, doc long, version long, at int")


def spans(rows: DataFrame) -> DataFrame:
    """``doc, version, start, n, source``: runs of ``n`` edges that ``source``,
    a smaller document, also has."""
    table = bit_table(shared_minimizers(rows))
    paths = pieces(rows, table)
    first = paths.groupBy("piece").agg(F.min("doc").alias("source"))
    removed = F.col("source") < F.col("doc")
    met = stored(
        join_hot(paths, first, "piece").select(
            "doc", "version", "start", "n", "source", removed.alias("removed"), F.when(~removed, F.col("edges")).alias("edges")
        )
    )
    whole = met.where("removed").select("doc", "version", "start", "n", "source")
    left = met.where("not removed")
    ends = _edges(left).groupBy("a", "b").agg(F.min("doc").alias("source"), F.max("doc").alias("last"))
    repeated = stored(ends.where("source < last").select("a", "b", "source"))
    # only edges that some other document has go to the join
    several = _edges(left, bit_table(repeated.select(F.col("a").alias("minimizer"))))
    single = join_hot(several, repeated.select("a", F.col("b").alias("b2"), "source"), "a").where("b = b2 and source < doc")
    return whole.unionByName(single.select("doc", "version", F.col("at").alias("start"), F.lit(1).alias("n"), "source"))


def _merged(batches):
    """Spans of a document in order; neighbours of one source become one."""
    for b in batches:
        lists = b["spans"]
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        start, n, source = (flat.field(i).to_numpy() for i in range(3))
        row = np.repeat(np.arange(b.num_rows), np.diff(ends))
        order = np.lexsort((start, source, row))
        row, start, n, source = row[order], start[order], n[order], source[order]
        joins = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (start[1:] == start[:-1] + n[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~joins])) if len(row) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        kinds = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64())])
        merged = pa.StructArray.from_arrays(
            [pa.array(start[first], pa.int32()), pa.array(total, pa.int32()), pa.array(source[first], pa.int64())],
            fields=list(kinds),
        )
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=b.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b["doc"], b["version"], pa.ListArray.from_arrays(bounds, merged)], b.schema.names)


def dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, n_words, n_removed, kept, spans`` of every document.

    ``kept`` joins the remaining words by one space. The spans of a document
    are at most its edges; few spans overall are broadcast, many are shuffled
    to the texts.
    """
    rows = _rows(docs, id_col, text_col)
    grouped = spans(rows).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n", "source")).alias("spans"))
    kinds = "doc long, version long, spans array<struct<start:int,n:int,source:bigint>>"
    cuts = stored(grouped.mapInArrow(_merged, kinds))
    few = (cuts.agg(F.sum(F.size("spans"))).first()[0] or 0) <= SMALL
    kind = "struct<n_words:bigint,n_removed:bigint,kept:string>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for text, a, n in zip(texts.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True):
            words = text.encode().split()
            if not a:
                out.append((len(words), 0, b" ".join(words).decode()))
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            a = np.array(a)
            np.add.at(depth, a, 1)
            np.add.at(depth, a + np.array(n) + WINDOW - 1, -1)
            stays = np.cumsum(depth[:-1]) == 0
            kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        kinds = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        return pa.array([dict(zip(("n_words", "n_removed", "kept"), o, strict=True)) for o in out], kinds)

    joined = rows.join(F.broadcast(cuts) if few else cuts, ["doc", "version"], "left")
    done = cut.asNondeterministic()("text", F.col("spans.start"), F.col("spans.n"))
    return joined.select("id", "spans", done.alias("d")).select("id", "d.*", "spans")
