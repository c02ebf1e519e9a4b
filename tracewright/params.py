"""Method parameters (fixed values of the published method, and those used on the test tables)."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values
THRESHOLD = {"CODE_BINARY": 0.1302083283662796, "STRUCTURED": 0.1953125, "IMAGE": 0.0}
ALPHA, LAMBDA, BETA = 0.75, 0.5, 0.1
POOL, SHORTLIST_TOP, MOST_PARENTS, BEST_COMPONENTS = 10, 3, 3, 3
MISSING, EPSILON = 1.0, 1e-12
UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class Method:
    """What the solver needs to know."""

    threshold: float = 0.25
    alpha: float = ALPHA
    penalty: float = LAMBDA
    pool: int = 5
    most_parents: int = MOST_PARENTS
    best: int = BEST_COMPONENTS
    beta: float = BETA
