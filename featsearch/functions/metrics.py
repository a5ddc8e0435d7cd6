"""Classification metrics as Column expressions over confusion counts.

The fitness operators return ``tp, fp, fn, tn``; every metric is a pure
function of those four integers, so both engines compute bit-identical
doubles. ROC AUC is that of hard predictions, i.e. ``(TPR + TNR) / 2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("f1", "accuracy", "roc_auc")
ALIASES = {"roc_auc_score": "roc_auc"}


def _c(name):
    return F.col(name).cast("double")


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    den = 2 * _c(tp) + _c(fp) + _c(fn)
    return F.when(den == 0, F.lit(0.0)).otherwise(2 * _c(tp) / den)


def accuracy(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    return (_c(tp) + _c(tn)) / (_c(tp) + _c(fp) + _c(fn) + _c(tn))


def roc_auc(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    pos = _c(tp) + _c(fn)
    neg = _c(tn) + _c(fp)
    return F.when((pos == 0) | (neg == 0), F.lit(None).cast("double")).otherwise(
        (_c(tp) / pos + _c(tn) / neg) / 2
    )


def metric(name: str) -> Column:
    name = ALIASES.get(name, name)
    if name == "f1":
        return f1()
    if name == "accuracy":
        return accuracy()
    if name == "roc_auc":
        return roc_auc()
    raise ValueError(f"unknown metric {name!r}; valid: {', '.join(METRICS)}, roc_auc_score")


# SQL text twins (DuckDB), over columns tp, fp, fn, tn of the current relation.
SQL = {
    "f1": "CASE WHEN 2*tp + fp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2*tp AS DOUBLE) / (2*tp + fp + fn) END",
    "accuracy": "CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn)",
    "roc_auc": "CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL "
    "ELSE (CAST(tp AS DOUBLE)/(tp + fn) + CAST(tn AS DOUBLE)/(tn + fp)) / 2 END",
}


def metric_sql(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in SQL:
        raise ValueError(f"unknown metric {name!r}")
    return SQL[name]
