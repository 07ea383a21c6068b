"""Options that change results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineOptions:
    """Numbers may not be negative."""

    max_discriminators: int = 150
    unknown_word_prob: float = 0.5
    unknown_word_strength: float = 0.45
    minimum_prob_strength: float = 0.1
    skip_max_word_size: int = 12
    ham_cutoff: float = 0.20
    spam_cutoff: float = 0.90
    nbuckets: int = 200
    fp_weight: float = 10.0
    fn_weight: float = 1.0
    unsure_weight: float = 0.2
    percentiles: tuple[float, ...] = (5.0, 25.0, 75.0, 95.0)
    header_score_digits: int = 2
    expiry_days: int = 7

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int | float) and v < 0:
                raise ValueError(f"{f.name} may not be negative")
        if self.unknown_word_strength <= 0:
            raise ValueError("unknown_word_strength must be positive, or a probability could be 0 or 1")


DEFAULT = EngineOptions()
