"""Search configuration (the reference's command-line options, as a dataclass)."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

ALGORITHMS = ("baseline_metrics", "ga", "random", "rfs")
# The reference's three genetic backends share one semantics; all map to "ga".
ALGORITHM_ALIASES = {"ga_seq": "ga", "ga_joblib": "ga", "ga_spark": "ga"}
MODELS = ("centroid", "sparse_centroid", "logistic", "mlp", "gbt", "xgboost")
METRICS = ("f1", "accuracy", "roc_auc", "roc_auc_score")
CROSSOVERS = ("onepoint", "multipoint")


def _now():
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class SearchConfig:
    # Defaults of the reference's command line (fixed values).
    dataset: str = "embeddings"
    crossover: str = "onepoint"
    mutation_rate: float = 0.2
    metric: str = "accuracy"
    population_size: int = 200
    elitism: int = 2
    max_generation: int = 15
    stopping_threshold: float = 0.99
    model: str = "logistic"
    algorithm: str = "ga_joblib"
    backend: str = "processes"
    seed: int = 0
    cv_folds: int = 5
    cv_metric: str = "accuracy"
    started_at: datetime = field(default_factory=_now)
    run_id: str = ""

    def __post_init__(self):
        if not self.run_id:
            self.run_id = self.started_at.strftime("%d.%m.%Y_%H.%M.%S.%f") + "_" + uuid.uuid4().hex[:8]

    @property
    def search(self) -> str:
        return ALGORITHM_ALIASES.get(self.algorithm, self.algorithm)

    def validate(self) -> "SearchConfig":
        """Reject bad options before any work starts."""
        if self.search not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}; valid: {', '.join(ALGORITHMS + tuple(ALGORITHM_ALIASES))}")
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model!r}; valid: {', '.join(MODELS)}")
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; valid: {', '.join(METRICS)}")
        if self.crossover not in CROSSOVERS:
            raise ValueError(f"unknown crossover {self.crossover!r}; valid: {', '.join(CROSSOVERS)}")
        if not 0.0 <= self.mutation_rate <= 1.0:
            raise ValueError("mutation_rate must be within [0, 1]")
        if self.population_size < 1:
            raise ValueError("population_size must be positive")
        if not 0 <= self.elitism <= self.population_size // 2:
            raise ValueError(f"elitism must be within 0..{self.population_size // 2}")
        if self.max_generation < 0:
            raise ValueError("max_generation must be >= 0")
        if self.cv_folds < 2:
            raise ValueError("cv_folds must be >= 2")
        return self

    def row(self) -> dict:
        d = asdict(self)
        return d
