"""Secret scans: patterns, and character Markov models of what they find.

``train`` counts character transitions over the whole corpus: those inside the
values that the patterns match are the labelled sample of random strings, all
others the sample of ordinary words and identifiers. ``scan`` reports the
pattern matches of every text and, beside them, each token or part of a token
outside the pattern spans of ``LEAST`` or more characters, ``DIFFERENT`` of them
different, whose log-likelihood under the random model exceeds that under the
ordinary model by ``MARGIN`` nats or more. The character that joins a part to a
pattern span before it does not belong to the part.

Defined results: a null or empty text has no spans; spans count code points,
end exclusive; overlapping matches of different kinds are all reported; rows
with null ids and repeated rows are scanned like any other; a corpus without
one of the two samples has a uniform model for it; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready

#: The three patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: any other character, the boundary
LEAST = 16
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Rules and dividers repeat a few characters; a secret does not.
DIFFERENT = 8
#: Nats by which a token must look more random than ordinary.
MARGIN = 20.0
#: Share of the uniform distribution mixed into each model. Random strings come
#: in alphabets the sample may lack, so their model keeps half of it.
UNIFORM = {"random": 0.5, "ordinary": 0.01}

_STATE = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _STATE[ord(_c)] = _i + 1


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the pattern matches, kinds by number."""
    low = text.casefold()
    spans = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _values(text: str) -> list[str]:
    """The labelled random strings of a text."""
    found = []
    if pattern_spans(text):
        found += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        found += [m[0] for m in HEX.finditer(text)]
    return found


def _transitions(data: bytes) -> np.ndarray:
    states = _STATE[np.frombuffer(b"\n" + data + b"\n", np.uint8)]
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def train(docs: DataFrame, text_col="text") -> dict[str, np.ndarray]:
    """Log transition probabilities of both models, from all documents.

    Labelled random strings are the values of the pattern matches; ordinary is
    what no rule would judge. Tokens that ``spans_of`` judges are in neither
    sample, so a secret is not compared with itself.

    The collected counts are at most 2 x 68 x 68 rows.
    """

    def run(batches):
        random, every, unlabelled = np.zeros((3, STATES * STATES), np.int64)
        for b in batches:
            for t in b["text"].to_pylist():
                if t:
                    every += _transitions(t.encode())
                    values = _values(t)
                    if values:
                        random += _transitions("\n".join(values).encode())
                    judged = [t[a:b] for a, b in candidates(t, pattern_spans(t))]
                    if judged:
                        unlabelled += _transitions("\n".join(judged).encode())
        for label, counts in (("random", random), ("ordinary", np.maximum(every - random - unlabelled, 0))):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                ["label", "step", "n"],
            )

    python_ready(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.mapInArrow(run, "label string, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))
    models = {}
    counted = rows.collect()
    for label, uniform in UNIFORM.items():
        table = np.zeros(STATES * STATES)
        for r in counted:
            if r.label == label:
                table[r.step] = r.n
        table = table.reshape(STATES, STATES)
        total = table.sum(axis=1, keepdims=True)
        share = np.divide(table, total, out=np.full_like(table, 1 / STATES), where=total > 0)
        models[label] = np.log((1 - uniform) * share + uniform / STATES)
    return models


def ratio(models: dict[str, np.ndarray], token: str) -> float:
    """Log-likelihood ratio of a token: random over ordinary."""
    states = _STATE[np.frombuffer(token.encode(), np.uint8)]
    steps = states[:-1], states[1:]
    return float((models["random"][steps] - models["ordinary"][steps]).sum())


def spans_of(text: str, models: dict[str, np.ndarray], margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """All spans of a text: pattern matches, then random tokens beside them."""
    spans = pattern_spans(text)
    extra = [(start, 3, end) for start, end in candidates(text, spans) if ratio(models, text[start:end]) >= margin]
    return sorted(spans + extra)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of tokens outside the pattern spans that the models judge."""
    return [
        (start, end)
        for m in TOKEN.finditer(text)
        for start, end in _outside(text, m.start(), m.end(), spans)
        if end - start >= LEAST and len(set(text[start:end])) >= DIFFERENT
    ]


def _outside(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of ``text[start:end]`` outside the spans, which are in order."""
    parts, after = [], False
    for s, _, e in [*spans, (end, 3, end)]:
        if e <= start or s > end:
            continue
        if s > start:
            parts.append((start + (after and text[start] in "+/_=-"), s))
        start, after = e, True
    return parts


def scan(docs: DataFrame, models=None, id_col="doc_id", text_col="text", margin: float = MARGIN) -> DataFrame:
    """``id`` and ``spans``, an array of ``kind, start, end`` in page order."""
    models = models or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # 74 KB
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[(KINDS[k], s, e) for s, k, e in spans_of(t or "", shared.value, margin)] for t in texts.to_pylist()], pa.list_(kind)
        )

    python_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.select("id", find.asNondeterministic()("text").alias("spans"))
