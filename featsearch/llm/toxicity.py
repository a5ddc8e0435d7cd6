"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are built from labelled texts: the words of toxic documents
that ordinary ones lack, and the words most ordinary documents share. A window
of a text (a word and its borders) is compressed with each; the bytes that the
toxic dictionary saves over the ordinary one are its evidence. Characters take
four bytes in windows and dictionaries, so that a match of a short word outweighs
the frame around it. A document's greatest saving and its counts of windows
over two thresholds are calibrated to a probability on labelled documents that
the dictionaries have not seen: each half of the sample is judged by the
dictionaries of the other half.

Only labels of training rows are read: crc32 of the id as text, modulo 4, not
2. The fit takes at most ``SAMPLE`` rows of each class, in the order of a hash
of their ids; scoring reads every whole text and nothing else.

Defined results: null, empty and wordless texts have no evidence and get the
score of a text without any; if the training rows hold one class only, every
score is its share (0 without rows); documents with several labels count as
toxic if one says so; null ids are scored and never train; repeated rows score
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready, stored

#: Most labelled rows per class that the fit reads, and their length in characters.
SAMPLE, SAMPLE_CHARS = 4000, 20000
#: Words of the two dictionaries at most; a toxic word is in 1 of 250 toxic
#: documents and 25 times as common there.
TOXIC_WORDS, ORDINARY_WORDS = 4096, 20000
LEAST_SHARE, LEAST_RATIO = 1 / 250, 25.0
#: Savings in characters above which a window counts.
SAVED = (1.5, 2.5)
THRESHOLD = 0.3
LEVEL = 19
MEMO = 1 << 20
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]  # bias and one per feature; one weight alone is a constant score


class _Scorer:
    """Per Python worker: compressors of a model and the savings of known words."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        options = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.compressors = []
        for content in (toxic, ordinary):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, **options))
        self.memo: dict[str, float] = {}

    def saved(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            window = _wide(f" {word} ")
            toxic, ordinary = (len(c.compress(window)) for c in self.compressors)
            known = self.memo[word] = (ordinary - toxic) / 4
        return known

    def features(self, text: str | None) -> list[float]:
        most, counts = 0.0, [0] * len(SAVED)
        for m in _WORD.finditer((text or "").lower()):
            s = self.saved(m[0])
            if s > most:
                most = s
            if s > SAVED[0]:
                for i, least in enumerate(SAVED):
                    counts[i] += s > least
        return [most, *(math.log1p(c) for c in counts), *(float(c > 0) for c in counts)]


def _wide(text: str) -> bytes:
    return text.encode("utf-32-le")


_SCORERS: dict = {}


def _scorer(model: Model) -> _Scorer:
    key = (model.toxic, model.ordinary)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = _Scorer(*key)
    return _SCORERS[key]


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """At most ``SAMPLE`` training rows per class: ``id, text, toxic, half``."""
    marked = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("id", F.lit("fit"))
    some = None
    for value in (0, 1):
        part = marked.where(F.col("toxic") == value).orderBy(order, "id").limit(SAMPLE)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("half")
    rows = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(some), "id")  # 2 x SAMPLE ids
    return rows.select("id", "text", "toxic", half)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Model:
    python_ready(docs.sparkSession)
    rows = stored(_sampled(docs, labels, id_col, text_col))
    n = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if len({t for _, t in n}) < 2 or not all(n.get((h, t)) for h in (0, 1) for t in (0, 1)):
        share = sum(v for (_, t), v in n.items() if t) / total if total else 0.0
        return Model(b" ", b" ", [share])

    def words(batches):
        for b in batches:
            found, toxic = [], []
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                own = set(_WORD.findall((t or "").lower()))
                found += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int64())], ["word", "toxic"])

    counts = stored(
        rows.select("half", "text", "toxic").transform(lambda r: _each_half(r, words))
        .groupBy("word", "half").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    )
    # each half is judged by the dictionaries of the other, the final ones take both
    x, y = [], []
    for half in (0, 1):
        other = _dictionaries(counts.where(F.col("half") != half), n[1 - half, 1], n[1 - half, 0])
        part = rows.where(F.col("half") == half)
        seen = part.select("toxic", _features(docs, other)("text").alias("x")).collect()  # SAMPLE rows or so
        x += [r.x for r in seen]
        y += [r.toxic for r in seen]
    both = counts.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    model = _dictionaries(both, n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
    x, y = np.array(x), np.array(y, float)
    trained = labels.where(~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    of_class = {r.toxic: r.n for r in trained.collect()}
    weight = np.where(y > 0, of_class[1] / y.sum(), of_class[0] / (1 - y).sum())
    model.weights = _logistic(x, y, weight / weight.mean())
    return model


def _each_half(rows: DataFrame, words) -> DataFrame:
    """``word, toxic, half`` of every distinct word of every row."""
    return rows.where("half = 0").mapInArrow(words, "word string, toxic long").withColumn("half", F.lit(0)).unionByName(
        rows.where("half = 1").mapInArrow(words, "word string, toxic long").withColumn("half", F.lit(1))
    )


def _dictionaries(counts: DataFrame, n_toxic: int, n_ordinary: int) -> Model:
    """Both dictionaries from document counts ``word, a, b`` (toxic, ordinary)."""
    ratio = ((F.col("a") + 0.5) / (n_toxic + 1)) / ((F.col("b") + 0.5) / (n_ordinary + 1))
    leaning = counts.where((F.col("a") >= max(3, LEAST_SHARE * n_toxic)) & (ratio >= LEAST_RATIO))
    toxic = leaning.orderBy(F.desc("a"), "word").limit(TOXIC_WORDS).collect()
    ordinary = counts.where("b > 0").orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).collect()
    # the commonest words stand last, where matches cost least
    return Model(*(_wide(" " + " ".join(r.word for r in reversed(x)) + " ") for x in (toxic, ordinary)), [0.0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge=1.0, steps=50) -> list[float]:
    """Weighted ridge logistic regression by Newton steps; bias first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _features(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 2 MB of words

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared.value)
        return pa.array([scorer.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return features.asNondeterministic()


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, score, evidence`` of every row; evidence holds the features."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.select("id", _features(docs, model)("text").alias("evidence"))
    if len(model.weights) == 1:
        return found.select("id", F.lit(model.weights[0]).alias("score"), "evidence")
    line = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        line = line + F.lit(w) * F.col("evidence")[i]
    return found.select("id", (1 / (1 + F.exp(-line))).alias("score"), "evidence")
