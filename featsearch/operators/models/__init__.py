"""Fitness models (the reference's model slot).

A model turns ``(abt, population)`` into confusion counts per chromosome on an
evaluation split. Every model fits and scores a whole population in shared
passes over partitioned rows.
"""

from __future__ import annotations


def get(name: str, **kw):
    if name == "centroid":
        from featsearch.operators.models.centroid import CentroidModel

        return CentroidModel(**kw)
    if name == "sparse_centroid":
        from featsearch.operators.models.sparse import SparseCentroidModel

        return SparseCentroidModel(**kw)
    if name == "logistic":
        from featsearch.operators.models.logistic import LogisticModel

        return LogisticModel(**kw)
    if name in ("gbt", "xgboost"):
        from featsearch.operators.models.trees import TreesModel

        return TreesModel(**kw)
    if name == "mlp":
        from featsearch.operators.models.mlp import MlpModel

        return MlpModel(**kw)
    raise ValueError(f"unknown model {name!r}; valid: centroid, sparse_centroid, logistic, mlp, gbt (alias xgboost)")
