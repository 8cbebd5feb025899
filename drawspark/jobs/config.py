"""Settings and places of a run, all under one root."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from drawspark.functions.game import SPEC, GameSpec
from drawspark.operators.montecarlo import N_SIMS

TRUE = {"1", "true", "yes", "si", "sí", "on"}
CALENDAR = [("2017-01-01", "2025-06-02", [2, 5]), ("2025-06-02", "9999-12-31", [0, 2, 5])]


def flag(value: str | None, default: bool) -> bool:
    """A setting's text as yes or no; unset or blank gives the default."""
    return value.strip().lower() in TRUE if value and value.strip() else default


@dataclass(frozen=True)
class Config:
    spec: GameSpec = SPEC
    n_sims: int = N_SIMS
    ingest: bool = True
    web: bool = False
    keep_versions: int = 10
    replay_start: str = "2025-10-11"
    calendar: list = field(default_factory=lambda: CALENDAR)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **changes) -> Config:
        env = os.environ if env is None else env
        base = cls(ingest=flag(env.get("INGEST_ENABLED"), True), web=flag(env.get("INGEST_WEB"), False), keep_versions=int(env.get("KEEP_MODEL_VERSIONS") or 10))
        return replace(base, **changes)


@dataclass(frozen=True)
class Paths:
    root: str

    def at(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def raw(self, game: str) -> str:
        return self.at("data", "raw", f"resultados_{game}.csv")

    @property
    def incoming(self) -> str:
        return self.at("data", "incoming")

    @property
    def new_draws(self) -> str:
        return self.at("data", "interim", "new_draws.csv")

    @property
    def draws(self) -> str:
        return self.at("data", "processed", "draws.csv")

    def features(self, game: str) -> str:
        return self.at("data", "processed", "features", game)

    @property
    def models(self) -> str:
        return self.at("models")

    def staging(self, game: str) -> str:
        return self.at("models", "_staging", game)

    @property
    def predictions(self) -> str:
        return self.at("predictions", "predictions_log.csv")

    @property
    def results(self) -> str:
        return self.at("predictions", "reconciliation_log.csv")

    def report(self, *parts: str) -> str:
        return self.at("reports", *parts)

    @property
    def replay(self) -> str:
        return self.report("simulacion_ganadoras.csv")
