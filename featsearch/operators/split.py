"""Stratified train / val / test split.

Within each class, rows are ordered by ``(u32(seed, 'split', row_id), row_id)``;
the first ``round(n * test%)`` go to test, the next ``round(n * val%)`` to
validation, the rest to train. Counts are exact per class.

No window over a class is used: a class may hold most of the rows, and a
window partitioned by it would put them all in one task. Instead the cut keys
(the k-th smallest key of each class) are found by histogram refinement:
counts over 65,536 hash buckets (which also give the class sizes), then over
the exact hashes inside the boundary bucket, then over the few rows sharing
the boundary hash. Every step is a distributed aggregation with map-side
combine, or a fetch, whose output is bounded by a constant, not by the data.
Small boundary buckets are fetched whole, saving the middle step.
"""

from __future__ import annotations

import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featsearch.functions.rng import u32
from featsearch.session import written

MAX_CLASSES = 64


def split_sizes(n: int, test_pct: int, val_pct: int) -> tuple[int, int]:
    """Per-class test and validation counts, rounded half up in integers."""
    return (n * test_pct + 50) // 100, (n * val_pct + 50) // 100


def _or(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


BUCKET_BITS = 16
# Boundary buckets holding at most this many rows are fetched whole (bounded);
# larger ones are refined by an exact-hash histogram first.
DIRECT_LIMIT = 200_000
# Distinct keys collide on one 32-bit hash only rarely (about N / 2^32 rows);
# more rows than this on one hash means the row key is not unique.
MAX_TIES = 100_000


def class_histogram(df: DataFrame, group: str, h: str) -> dict:
    """Counts per (class, 16-bit bucket): one aggregation, at most 65,536 rows per class."""
    from featsearch.session import bounded_tasks

    b = F.shiftright(F.col(h), 32 - BUCKET_BITS)
    cap = (MAX_CLASSES + 1) << BUCKET_BITS  # bounded fetch, whatever the label
    # each task pre-aggregates to <= 65,536 rows per class: cap the task count
    grouped = bounded_tasks(df).groupBy(F.col(group).alias("_g"), b.alias("_b"))
    rows = grouped.agg(F.count(F.lit(1)).alias("_n")).limit(cap).collect()
    hist: dict = {}
    for r in rows:
        hist.setdefault(r["_g"], {})[r["_b"]] = r["_n"]
    return hist


def _locate(counts: dict, k: int):
    """(key, rank within key) of the k-th item, walking sorted keys."""
    acc = 0
    for key in sorted(counts):
        if acc + counts[key] >= k:
            return key, k - acc
        acc += counts[key]
    raise ValueError("k exceeds the number of rows")


def kth_keys(df: DataFrame, group: str, h: str, rid: str, wanted: dict, hist: dict | None = None) -> dict:
    """k-th smallest ``(h, rid)`` per group value for each requested k (1-based).

    ``wanted`` maps group value -> list of k. Returns {(g, k): (h, rid)}.
    Every step is an aggregation or a bounded fetch; no group of rows is
    ever ranked in one task.
    """
    todo = [(g, k) for g, ks in wanted.items() for k in ks if k > 0]
    if not todo:
        return {}
    hist = hist if hist is not None else class_histogram(df, group, h)
    level1 = {(g, k): _locate(hist[g], k) for g, k in todo}  # -> (bucket, k within bucket)
    bsel_keys = sorted({(g, bb) for (g, _), (bb, _) in level1.items()})
    b = F.shiftright(F.col(h), 32 - BUCKET_BITS)
    bsel = _or([(F.col(group) == F.lit(g)) & (b == F.lit(bb)) for g, bb in bsel_keys])
    out: dict = {}
    if sum(hist[g][bb] for g, bb in bsel_keys) <= DIRECT_LIMIT:
        keys: dict = {}
        for r in df.where(bsel).select(F.col(group).alias("_g"), F.col(h).alias("_h"), F.col(rid).alias("_r")).collect():
            keys.setdefault((r["_g"], r["_h"] >> (32 - BUCKET_BITS)), []).append((r["_h"], r["_r"]))
        for (g, k), (bb, kk) in level1.items():
            out[(g, k)] = sorted(keys[(g, bb)])[kk - 1]
        return out
    # level 2: exact hashes inside the boundary buckets (at most 65,536 values each)
    rows2 = df.where(bsel).groupBy(F.col(group).alias("_g"), F.col(h).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).collect()
    per: dict = {}
    for r in rows2:
        per.setdefault((r["_g"], r["_h"] >> (32 - BUCKET_BITS)), {})[r["_h"]] = r["_n"]
    level2 = {(g, k): _locate(per[(g, bb)], kk) for (g, k), (bb, kk) in level1.items()}
    # level 3: the rows sharing one exact hash (expected one row; bounded by collisions)
    for (g, k), (hh, _) in level2.items():
        n_tied = per[(g, hh >> (32 - BUCKET_BITS))][hh]
        if n_tied > MAX_TIES:
            raise ValueError(f"{n_tied} rows of class {g!r} share one key hash: {rid!r} is not a unique key")
    hsel = _or([(F.col(group) == F.lit(g)) & (F.col(h) == F.lit(hh)) for (g, _), (hh, _) in level2.items()])
    ties: dict = {}
    for r in df.where(hsel).select(F.col(group).alias("_g"), F.col(h).alias("_h"), F.col(rid).alias("_r")).collect():
        ties.setdefault((r["_g"], r["_h"]), []).append(r["_r"])
    for (g, k), (hh, k3) in level2.items():
        out[(g, k)] = (hh, sorted(ties[(g, hh)])[k3 - 1])
    return out


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row. A filter on the result
    is pushed down with all its expressions, and a hash written into every
    comparison would be computed that often."""
    return F.transform(F.array(value), use)[0]


def _le(h: Column, rid: Column, key) -> Column:
    if key is None:
        return F.lit(False)
    kh, kr = key
    return (h < F.lit(kh)) | ((h == F.lit(kh)) & (rid <= F.lit(kr)))


def stratified_split(
    df: DataFrame,
    seed: int = 0,
    test_pct: int = 10,
    val_pct: int = 20,
    key: str = "row_id",
    label: str = "y",
    out: str = "split",
    hashed: bool = False,
) -> DataFrame:
    """Add ``split`` in {train, val, test}; exact per-class counts, partition-independent.

    ``hashed``: ``df`` holds the row hash (``u32(seed, 'split', key)``) as ``_h``.
    """
    base = df if hashed else df.withColumn("_h", u32(seed, "split", F.col(key)))
    cuts = _split_cuts(base, test_pct, val_pct, key, label)
    h = F.col("_h")
    return base.withColumn(out, _split(h, *cuts, key, label) if hashed else once(h, lambda h: _split(h, *cuts, key, label))).drop("_h")


def _split_cuts(base: DataFrame, test_pct: int, val_pct: int, key: str, label: str) -> tuple[dict, dict]:
    hist = class_histogram(base, label, "_h")  # also yields the class sizes
    if None in hist:
        raise ValueError(f"null values in label {label!r}")
    if len(hist) > MAX_CLASSES:
        raise ValueError("too many classes for a stratified split")
    wanted = {}
    for g, buckets in hist.items():
        nt, nv = split_sizes(sum(buckets.values()), test_pct, val_pct)
        wanted[g] = [nt, nt + nv]
    return wanted, kth_keys(base, label, "_h", key, wanted, hist)


def _split(h: Column, wanted: dict, keys: dict, key: str, label: str) -> Column:
    rid = F.col(key)
    is_test = _or([(F.col(label) == F.lit(g)) & _le(h, rid, keys.get((g, ks[0]))) for g, ks in wanted.items()])
    is_val = _or([(F.col(label) == F.lit(g)) & _le(h, rid, keys.get((g, ks[1]))) for g, ks in wanted.items()])
    return F.when(is_test, "test").when(is_val, "val").otherwise("train")


#: Hashes this near to the expected place of a cut lie in a zone of their own.
ZONE_MARGIN = 1 << 26


def _zone_bounds(test_pct: int, val_pct: int) -> list[int]:
    """Hashes at which a new zone begins: a margin before and after every place
    where hashes spread evenly would be cut."""
    places = [(pct << 32) // 100 for pct in (test_pct, test_pct + val_pct)]
    return sorted({min(max(at + m, 0), 1 << 32) for at in places for m in (-ZONE_MARGIN, ZONE_MARGIN)})


def zone(h: Column, test_pct: int = 10, val_pct: int = 20) -> Column:
    """The zone of a row hash, known before the cuts are: rows written by zone need
    not be written again by split."""
    return sum([(h >= F.lit(b)).cast("int") for b in _zone_bounds(test_pct, val_pct)], F.lit(0)).cast("int")


def _zone_split(lo: int, hi: int, first, second) -> str | None:
    """The split of all hashes from ``lo`` to below ``hi``; None if a cut lies among them."""
    a, b = (-1 if cut is None else cut[0] for cut in (first, second))
    if hi <= a:
        return "test"
    if lo > a and hi <= b:
        return "val"
    return "train" if lo > max(a, b) else None


def split_zones(rows: DataFrame, test_pct: int = 10, val_pct: int = 20, key: str = "row_id", label: str = "y",
                out: str = "split") -> DataFrame:
    """``stratified_split`` of rows that lie in folders by ``_zone``, with their ``_h``.

    Zones without a cut are one split each, whatever their rows; only rows of the
    other zones are compared with the cuts. A filter on the split reads the zones
    that hold it and no other folder.
    """
    wanted, keys = _split_cuts(rows, test_pct, val_pct, key, label)
    edges = [0, *_zone_bounds(test_pct, val_pct), 1 << 32]
    zones: dict = {}
    for z, (lo, hi) in enumerate(zip(edges, edges[1:])):
        found = {_zone_split(lo, hi, *[keys.get((g, k)) for k in ks]) for g, ks in wanted.items()}
        zones.setdefault(found.pop() if len(found) == 1 else None, []).append(z)
    parts = []
    for name, held in zones.items():
        value = F.lit(name) if name else _split(F.col("_h"), wanted, keys, key, label)
        parts.append(rows.where(F.col("_zone").isin(held)).withColumn(out, value).drop("_h", "_zone"))
    return reduce(DataFrame.union, parts)


def stratified_split_sql(src: str, seed: int = 0, test_pct: int = 10, val_pct: int = 20) -> str:
    """SQL twin over relation ``src(row_id, y, ...)``: plain per-class ranking."""
    from featsearch.functions.rng import u32_sql

    h = u32_sql(str(seed), "'split'", "row_id")
    return f"""(SELECT s.* EXCLUDE (rk, n),
  CASE WHEN rk <= (n*{test_pct}+50)//100 THEN 'test'
       WHEN rk <= (n*{test_pct}+50)//100 + (n*{val_pct}+50)//100 THEN 'val'
       ELSE 'train' END AS split
FROM (SELECT t.*, row_number() OVER (PARTITION BY y ORDER BY {h}, row_id) AS rk,
             count(*) OVER (PARTITION BY y) AS n FROM {src} t) s)"""


#: Fold columns and rows with folds found so far, per frame.
_FOLDS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _fold_cuts(rows: DataFrame, folds: int, key: str, label: str) -> tuple[dict, dict]:
    hist = class_histogram(rows, label, "_h")
    if None in hist:
        raise ValueError(f"null values in label {label!r}")
    wanted = {}
    for g, buckets in hist.items():
        n = sum(buckets.values())
        wanted[g] = [n * j // folds for j in range(1, folds)]
    return wanted, kth_keys(rows, label, "_h", key, wanted, hist)


def _fold(h: Column, rid: Column, label: str, wanted: dict, keys: dict) -> Column:
    fold = F.lit(0)
    for g, ks in wanted.items():
        beyond = [F.lit(0)] + [(~_le(h, rid, keys.get((g, k)))).cast("int") for k in ks]
        fold = F.when(F.col(label) == F.lit(g), sum(beyond[1:], beyond[0])).otherwise(fold)
    return fold.cast("int")


def fold_of(abt: DataFrame, folds: int, seed: int = 0, split: str = "train", key: str = "row_id", label: str = "y") -> Column:
    """Stratified cross-validation fold of the rows of ``split``, 0 to ``folds - 1``.

    Each class is ordered by ``(u32(seed, 'fold', row), row)`` and cut into
    ``folds`` runs whose sizes differ by at most one. The cut keys come from the
    histogram refinement of the split, so no class is ranked in one task; they
    are found once per frame.
    """
    known = _FOLDS.setdefault(abt, {})
    if (folds, seed, split, key, label) not in known:
        rows = abt.where(F.col("split") == split).withColumn("_h", u32(seed, "fold", F.col(key)))
        known[folds, seed, split, key, label] = _fold_cuts(rows, folds, key, label)
    wanted, keys = known[folds, seed, split, key, label]
    return once(u32(seed, "fold", F.col(key)), lambda h: _fold(h, F.col(key), label, wanted, keys))


def fold_rows(abt: DataFrame, name: str, value: Column, folds: int, seed: int = 0, split: str = "train",
              key: str = "row_id", label: str = "y", keep=lambda rows: written(rows, "folds")) -> DataFrame:
    """``fold, <label>, <name>`` of the rows of ``split``, folds as in ``fold_of``.

    For fits that pass over the rows many times: ``value`` is computed once a frame
    and written with its fold, later passes only read it. ``keep`` writes the rows
    in the form that the passes read. The cuts are found in a written table of keys
    and hashes, so the wide rows are written once.
    """
    known = _FOLDS.setdefault(abt, {})
    if (name, folds, seed, split, key, label) not in known:
        chosen, h = abt.where(F.col("split") == split), u32(seed, "fold", F.col(key))
        cuts = _fold_cuts(written(chosen.select(key, label, h.alias("_h")), "hashes", [key, "_h"]), folds, key, label)
        fold = _fold(F.col("_h"), F.col(key), label, *cuts)
        hashed = chosen.select(h.alias("_h"), key, label, value.alias(name))  # nothing filters by fold: one hash a row
        known[name, folds, seed, split, key, label] = keep(hashed.select(fold.alias("fold"), label, name))
    return known[name, folds, seed, split, key, label]


def fold_sql(src: str, folds: int, seed: int = 0) -> str:
    """SQL twin: ``row_id, fold`` of relation ``src(row_id, y)`` by plain ranking."""
    from featsearch.functions.rng import u32_sql

    h = u32_sql(str(seed), "'fold'", "row_id")
    beyond = " + ".join(["0"] + [f"CASE WHEN rk > (n * {j}) // {folds} THEN 1 ELSE 0 END" for j in range(1, folds)])
    return f"""SELECT row_id, {beyond} AS fold
FROM (SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY {h}, row_id) AS rk, count(*) OVER (PARTITION BY y) AS n
      FROM {src})"""
