"""Standard scaling (P3, P4): mean and population deviation fitted on train only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed-point resolution of the centroid model: features are compared in
# units of 1/SCALE standard deviations, as exact integers.
SCALE = 10000
WIDE_AGG_MAX = 512  # widths up to this use one wide aggregate; wider ones explode


def fit(abt: DataFrame, split: str = "train", features: str = "features", d: int | None = None) -> tuple[list[float], list[float]]:
    """Per-gene mean and ``stddev_pop`` over the fit split; deviation 0 becomes 1.

    One aggregation; each task pre-aggregates to one row per gene, so only
    ``d`` rows per partition are shuffled.
    """
    rows = abt.where(F.col("split") == split)
    if d is None:
        d = rows.select(F.max(F.size(features))).first()[0] or 0
    if d <= WIDE_AGG_MAX:  # one codegen'd aggregate, no explode
        f = F.col(features)
        r = rows.select(*[F.avg(f[j]).alias(f"m{j}") for j in range(d)],
                        *[F.stddev_pop(f[j]).alias(f"s{j}") for j in range(d)]).first()
        stats = [{"gene": j, "mean": r[f"m{j}"], "sd": r[f"s{j}"]} for j in range(d)]
    else:
        stats = (
            rows.select(F.posexplode(features).alias("gene", "x"))
            .groupBy("gene")
            .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
            .collect()
        )
    stats = sorted(stats, key=lambda r: r["gene"])
    means = [float(r["mean"]) for r in stats]
    sds = [1.0 if (r["sd"] is None or r["sd"] == 0) else float(r["sd"]) for r in stats]
    return means, sds


def _of_width(features: Column, d: int | None, entry, otherwise: Column) -> Column:
    """Array of ``entry(value, place)``: up to ``WIDE_AGG_MAX`` entries are generated
    code, where a lambda is interpreted for every entry; ``otherwise`` for arrays of
    another width."""
    if not d or d > WIDE_AGG_MAX:
        return otherwise
    return F.when(F.size(features) == d, F.array(*[entry(F.get(features, F.lit(j)), j) for j in range(d)])).otherwise(otherwise)


def apply(features: Column, means: list[float], sds: list[float]) -> Column:
    m = F.array(*[F.lit(v) for v in means])
    s = F.array(*[F.lit(v) for v in sds])
    return _of_width(features, len(means), lambda x, i: (x - F.lit(means[i])) / F.lit(sds[i]),
                     F.transform(features, lambda x, i: (x - m[i]) / s[i]))


def quantize(features: Column, d: int | None = None) -> Column:
    """Fixed-point copy of standardized features (``floor(z * SCALE)`` as BIGINT);
    ``d``: their usual number."""
    return _of_width(features, d, lambda z, _: F.floor(z * SCALE).cast("bigint"),
                     F.transform(features, lambda z: F.floor(z * SCALE).cast("bigint")))
