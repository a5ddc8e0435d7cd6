"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger row holds the
measurements and one bit per failed rule. A policy is a versioned set of rules,
a mask over those bits, so applying a policy, comparing versions or asking what
a rule removes on its own (``ablations``) is bitwise arithmetic over the
ledger and never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``;
lines are split at line feeds; a text without a line feed is one line; rows
with a null id, repeated rows and ties are measured like any other; an empty
table gives an empty ledger; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsearch.llm.common import SPACE, python_ready
from featsearch.llm.shingles import IS_WORD, window_hashes, word_hashes

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule names in bit order; a rule keeps its bit for good.
RULES = ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "shouting", "word_length")
BASE = ("few_words", "repeated_windows")
#: Versioned policies: version -> rules whose failure rejects a document.
POLICIES = {"base": BASE, "v1": (*BASE, "many_symbols", "repeated_lines", "shouting", "word_length")}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
_SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def measure(text: str | None) -> tuple:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    data = text.encode()
    hashes = word_hashes(data)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    letters = upper = 0
    for c, n in Counter(text).items():
        if c.isalpha():
            letters += n
            upper += n * c.isupper()
    return (len(hashes), chars, symbols, len(lines), len(lines) - len(set(lines)), _repeated(data, hashes), letters, upper)


def _repeated(data: bytes, hashes: np.ndarray) -> int:
    """Words inside a window that occurs twice or more, first place included.

    Windows meet by the 64-bit hash of their words; those of equal hash are
    compared word by word. Beside the text a few numbers per word are held.
    """
    grams = window_hashes(hashes, WINDOW)
    order = np.argsort(grams, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], grams[order[1:]] != grams[order[:-1]], [True]]))
    sizes = np.diff(bounds)
    if not (sizes > 1).any():
        return 0
    edges = np.flatnonzero(np.diff(IS_WORD[np.frombuffer(b" " + data + b" ", np.uint8)].view(np.int8)))
    first, last = edges[::2], edges[1::2]

    def window(i):
        return tuple(data[a:z] for a, z in zip(first[i : i + WINDOW].tolist(), last[i : i + WINDOW].tolist(), strict=True))

    edge = np.zeros(len(hashes) + 1, np.int32)
    for at, n in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        places = order[at : at + n]
        seen = Counter(map(window, places))
        if len(seen) > 1:  # different windows of one hash
            places = np.array([i for i in places if seen[window(i)] > 1], np.int64)
        edge[places] += 1
        edge[places + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


@F.pandas_udf(_SCHEMA)
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def _failures() -> Column:
    """The failure bits from the measurements; integer comparisons only."""
    m = {name: F.col(f"ledger.{name}") for name in MEASURES}
    enough = m["n_words"] >= 10
    tests = {
        "few_words": m["n_words"] < 10,
        "repeated_windows": m["n_repeat_words"] * 100 > m["n_words"] * 20,
        "many_symbols": m["n_symbols"] * 100 > m["n_words"] * 30,
        "repeated_lines": (m["n_lines"] >= 4) & (m["n_dup_lines"] * 100 > m["n_lines"] * 40),
        "shouting": enough & (m["n_upper"] * 100 > m["n_letters"] * 50),
        "word_length": enough & ((m["word_chars"] > m["n_words"] * 40) | (m["word_chars"] < m["n_words"] * 2)),
    }
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(tests[rule], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _measured_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``row, ledger``: each row of ``docs`` as a struct beside its ledger, so
    no column name can clash."""
    python_ready(docs.sparkSession)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    udf = _measured.asNondeterministic()  # evaluated once, never copied into a pushed filter
    inner = inner.withColumn("ledger", udf(F.col("row").getField(text_col).cast("string")))
    full = F.struct(*[F.col(f"ledger.{m}") for m in MEASURES], _failures().alias("failed"))
    return inner.select("row", full.alias("ledger"))


def annotate(docs: DataFrame, text_col="text", name="ledger") -> DataFrame:
    """``docs`` with a struct column ``name``: measurements and ``failed`` bits."""
    rows = _measured_rows(docs, text_col)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("ledger").alias(name))


def ledger(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, the measurements and the ``failed`` bits of every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return annotate(rows).select("id", "ledger.*")


def passes(failed: Column, policy: str = "v1") -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def accepted(docs: DataFrame, policy: str = "v1", text_col="text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, all columns unchanged."""
    rows = _measured_rows(docs, text_col).where(passes(F.col("ledger.failed"), policy))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of ``policy``: documents it fails and documents it alone rejects.

    One aggregation of bitwise tests over the ledger.
    """
    rules, all_bits = POLICIES[policy], F.lit(mask(POLICIES[policy])).cast("long")
    hit = F.col("failed").bitwiseAND(all_bits)
    sums = ledger_rows.agg(
        *[F.count_if(hit.bitwiseAND(F.lit(mask([r])).cast("long")) != 0).alias(f"f_{r}") for r in rules],
        *[F.count_if(hit == mask([r])).alias(f"o_{r}") for r in rules],
    )
    rows = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in rules
    ])
    return sums.select(F.explode(rows).alias("x")).select("x.*")
