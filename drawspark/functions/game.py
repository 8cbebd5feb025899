"""The format of a game and exact probabilities that follow from it."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class GameSpec:
    """``drawn`` distinct labels of 1..``labels`` and one extra label of 1..``extras``."""

    labels: int = 43
    drawn: int = 5
    extras: int = 16
    games: tuple[str, ...] = ("baloto", "revancha")
    warmup: int = 100
    min_train: int = 150
    refit_every: int = 10
    gap_cap: int = 100
    seed: int = 42
    windows: tuple[int, ...] = (10, 30, 100)
    trend_half: int = 15

    @property
    def p_label(self) -> float:
        return self.drawn / self.labels

    @property
    def p_extra(self) -> float:
        return 1 / self.extras

    def drums(self) -> tuple[tuple[str, int], ...]:
        """The drums and how many labels each holds."""
        return (("balls", self.labels), ("sb", self.extras))

    @property
    def first_test(self) -> int:
        return self.warmup + self.min_train

    @property
    def plays(self) -> int:
        return math.comb(self.labels, self.drawn) * self.extras

    def hits_pmf(self) -> list[float]:
        """Hypergeometric chances of 0..drawn hits of a fixed play."""
        n, k = self.labels, self.drawn
        return [math.comb(k, h) * math.comb(n - k, k - h) / math.comb(n, k) for h in range(k + 1)]

    @property
    def hits_variance(self) -> float:
        return sum(p * (h - self.drawn * self.p_label) ** 2 for h, p in enumerate(self.hits_pmf()))


SPEC = GameSpec()


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the chances of all outcomes no likelier than k."""
    def log_pmf(i: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)

    own = log_pmf(k)
    return min(1.0, sum(math.exp(x) for x in map(log_pmf, range(n + 1)) if x <= own + 1e-7))
