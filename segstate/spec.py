"""Model dimensions and run parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HsmmSpec:
    """Explicit-duration HSMM dimensions.

    m: hidden states, k: observation symbols, d: duration columns.
    Duration column 0 never receives forward mass, so usable durations are
    1..d-1 and ``d`` must be at least 2 for a finite score.
    """

    m: int = 2
    k: int = 4
    d: int = 4

    def __post_init__(self) -> None:
        if self.m < 1 or self.k < 1 or self.d < 1:
            raise ValueError(f"invalid dimensions {self}")

    @property
    def n_params(self) -> int:
        """Number of scalar cells in (pi, a, b, p)."""
        return self.m + self.m * self.m + self.m * self.k + self.m * self.d

    def model_row_bytes(self) -> int:
        """Upper bound of one model row as doubles, with array overhead."""
        return 8 * self.n_params + 64 * (3 * self.m + 4) + 64


@dataclass(frozen=True)
class RunParams:
    """Parameters of a cross-validation run (defaults of FIXTURES.md)."""

    spec: HsmmSpec = HsmmSpec()
    folds: int = 5
    seed: int = 42
    sample_fraction: float = 1.0
    epsilon: float = 1e-4
    max_iterations: int = 10_000
    t_prefix: int = 3
    feedback_duration: bool = False
    smoothing: float = 0.0
    skip_undefined: bool = False
