"""What to audit: the column roles, fixed when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

BINARY = "binary"
MULTICLASS = "multiclass"
REGRESSION = "regression"
PROBLEMS = (BINARY, MULTICLASS, REGRESSION)
AUTO = "auto"  # to be found out from the values when an audit begins

PERFORMANCE = "performance"
BIAS = "bias"
QUALITY = "quality"
EXPLAINABILITY = "explainability"
ANALYSES = (PERFORMANCE, BIAS, QUALITY, EXPLAINABILITY)


@dataclass(frozen=True)
class AuditSpec:
    """Column roles of a table of scored records.

    ``class_scores`` holds ``(label, column)`` pairs for multiclass scores. ``features=None`` means
    every column without another role; ``include_roles=True`` adds the role columns to the features. ``problem="auto"`` is for audits, which
    detect it; single operators want to know it.
    """

    prediction: str | None = "prediction"
    truth: str | None = None
    score: str | None = None
    class_scores: tuple[tuple[Any, str], ...] = ()
    protected: tuple[str, ...] = ()
    features: tuple[str, ...] | None = None
    timestamp: str | None = None
    identifier: str | None = None
    problem: str = BINARY
    positive: Any = 1
    null_group: bool = False
    include_roles: bool = False

    def __post_init__(self) -> None:
        if self.problem not in (*PROBLEMS, AUTO):
            raise ValueError(f"problem must be one of {(*PROBLEMS, AUTO)}, got {self.problem!r}")

    @property
    def role_columns(self) -> tuple[str, ...]:
        single = (self.prediction, self.truth, self.score, self.timestamp, self.identifier)
        return tuple(c for c in single if c) + tuple(c for _, c in self.class_scores)

    def feature_columns(self, columns: list[str], by: tuple[str, ...] = ()) -> list[str]:
        """Features in table order; ``by`` keys are never features."""
        if self.features is not None:
            return [c for c in self.features if c in columns and c not in by]
        taken = set(by) | (set() if self.include_roles else set(self.role_columns))
        return [c for c in columns if c not in taken]

    def with_(self, **changes: Any) -> AuditSpec:
        return replace(self, **changes)
