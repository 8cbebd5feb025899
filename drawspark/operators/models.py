"""Trained forecasters under expanding-window evaluation; every unit that has to be fitted together is one task's work.

Two models: a logistic regression for each label, and gradient boosting over the pooled rows of a drum, which does not
know which label a row is of.  Both see the same features of the draws before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawspark.functions.game import SPEC, GameSpec
from drawspark.operators.history import normalized

NUMERIC = ["freq_10", "freq_30", "freq_100", "gap", "trend"]
DAYS = ["dia_lunes", "dia_miercoles", "dia_sabado"]
NAMES = NUMERIC + DAYS
FORECAST = "juego string, drum string, t long, num int, y int, p double"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 60, start: np.ndarray | None = None) -> np.ndarray:
    """L2 logistic regression with a free intercept (first coefficient) by Newton's method.

    ``start`` is where to begin: the loss is convex, so it only saves steps.
    """
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.r_[0.0, np.full(x.shape[1] - 1, 1 / c)]
    beta = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(ridge + 1e-12), x.T @ (p - y) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return beta


@dataclass
class Scaler:
    """log1p of the gap, then the numeric features standardised by the training rows; weekdays stay.

    ``legacy``: every column standardised as it is, which lets a rare weekday or a long gap stand many deviations off.
    """

    legacy: bool = False

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float, copy=True)
        if not self.legacy:
            x[:, NUMERIC.index("gap")] = np.log1p(x[:, NUMERIC.index("gap")])
        return x

    def fit(self, train: np.ndarray) -> Scaler:
        train = self._prepared(train)
        self.n = train.shape[1] if self.legacy else len(NUMERIC)
        self.mean, std = train[:, : self.n].mean(0), train[:, : self.n].std(0)
        self.scale = np.where(std > 0, std, 1.0)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = self._prepared(x)
        x[:, : self.n] = (x[:, : self.n] - self.mean) / self.scale
        return x


def fit_label(x: np.ndarray, y: np.ndarray, c: float = 1.0, legacy: bool = False, start: np.ndarray | None = None) -> tuple[Callable, np.ndarray | None]:
    """(forecast of feature rows, coefficients) of one label; one that is always or never drawn gets a smoothed rate."""
    if y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return (lambda rows: np.full(len(rows), rate)), None
    scaler = Scaler(legacy).fit(x)
    beta = logistic(scaler.apply(x), y, c, start=start)
    return (lambda rows: _sigmoid(beta[0] + scaler.apply(rows) @ beta[1:])), beta


def _blocks(t: np.ndarray, first: int, every: int) -> range:
    return range(first, int(t.max()) + 1, every) if len(t) else range(0)


def walk_forward_logistic(features: DataFrame, spec: GameSpec = SPEC, c: float = 1.0, legacy: bool = False, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """(by…, juego, drum, t, num, y, p): each label has its own model, refitted every ``refit_every`` draws on the draws before.

    A group is the history of one label of one game (and resample), the unit that has to be fitted together; its blocks
    follow one another, each starting from the coefficients of the one before.  The extra label's chances are made to
    add up to 1.  A history that ends before the first test draw gives no row.
    """
    names = columns or NAMES

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x, y, t = rows[names].to_numpy(float), rows.y.to_numpy(float), rows.t.to_numpy()
        out, beta = [], None
        for start in _blocks(t, spec.first_test, spec.refit_every):
            train, test = (t >= spec.warmup) & (t < start), (t >= start) & (t < start + spec.refit_every)
            if columns:  # plain columns: standardised as they are
                scale = np.where((std := x[train].std(0)) > 0, std, 1.0)
                a, b = (x[train] - x[train].mean(0)) / scale, (x[test] - x[train].mean(0)) / scale
                beta = logistic(a, y[train], c, start=beta)
                p = _sigmoid(beta[0] + b @ beta[1:])
            else:
                model, beta = fit_label(x[train], y[train], c, legacy, beta)
                p = model(x[test])
            out.append(rows.loc[test, [*by, "juego", "drum", "t", "num"]].assign(y=y[test].astype(int), p=p))
        return pd.concat(out) if out else pd.DataFrame(columns=[*by, "juego", "drum", "t", "num", "y", "p"])

    keys = [*by, "juego", "drum", "num"]
    kinds = "".join(f"{k} {features.schema[k].dataType.simpleString()}, " for k in by)
    known = features.where(F.col("y").isNotNull())
    apart = known.repartition(spec.labels * len(spec.games), *keys)  # few bytes, much work: not to be coalesced
    return normalized(apart.groupBy(*keys).applyInPandas(fit, kinds + FORECAST))


def require_history(draws: DataFrame, spec: GameSpec = SPEC) -> None:
    """An error if a game is too short for a single test draw."""
    short = [r["juego"] for r in draws.groupBy("juego").count().where(F.col("count") <= spec.first_test).collect()]
    if short:
        raise ValueError(f"not more than {spec.first_test} draws of {sorted(short)}")


# --- boosting


class Trees:
    """Boosted trees for a binary target: Newton steps on histograms, leaves shrunk by an L2 term."""

    def __init__(self, rounds: int = 100, rate: float = 0.05, depth: int = 3, least: int = 40, l2: float = 1.0, bins: int = 64):
        self.rounds, self.rate, self.depth, self.least, self.l2, self.bins = rounds, rate, depth, least, l2, bins

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes, n_bins = self._codes(x), self.bins + 1
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = np.log(rate / (1 - rate))
        z = np.full(len(y), self.base)
        width = x.shape[1] * n_bins
        flat = codes + np.arange(x.shape[1]) * n_bins
        self.trees = []
        for _ in range(self.rounds):
            p = _sigmoid(z)
            grad, hess = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for _ in range(self.depth):
                k = int(node.max()) + 1 if len(node) else 1
                at = (node[:, None] * width + flat).ravel()
                g, h, c = (np.bincount(at, np.repeat(w, x.shape[1]) if w is not None else None, k * width).reshape(k, x.shape[1], n_bins) for w in (grad, hess, None))
                split = self._best(g.cumsum(2), h.cumsum(2), c.cumsum(2))
                tree.append(split)
                right = codes[np.arange(len(y)), split[0][node]] > split[1][node]
                node = node * 2 + right
            leaves = 1 << self.depth
            value = -np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.l2)
            z += self.rate * value[node]
            self.trees.append((tree, value))
        return self

    def _best(self, g, h, c) -> tuple[np.ndarray, np.ndarray]:
        """(feature, last bin of the left side) for each node; a node without a gain keeps its rows on the left."""
        gain = lambda a, b: a**2 / (b + self.l2)
        ga, ha, ca = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
        better = gain(g, h) + gain(ga - g, ha - h) - gain(ga, ha)
        better = np.where((c >= self.least) & (ca - c >= self.least), better, 0.0)
        best = better.reshape(len(g), -1).argmax(1)
        none = better.reshape(len(g), -1).max(1) <= 1e-12
        return np.where(none, 0, best // g.shape[2]), np.where(none, g.shape[2], best % g.shape[2])

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, z = self._codes(x), np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, last in tree:
                node = node * 2 + (codes[np.arange(len(x)), feature[node]] > last[node])
            z += self.rate * value[node]
        return _sigmoid(z)


def walk_forward_boosting(features: DataFrame, spec: GameSpec = SPEC, by: tuple[str, ...] = (), **params) -> DataFrame:
    """As the logistic walk-forward, with one boosted model a drum and block over all its labels' rows.

    A group is one block, which needs its drum's rows up to the block: they are bounded by the length of a history.
    """
    kinds = "".join(f"{k} {features.schema[k].dataType.simpleString()}, " for k in by)
    keys = [*by, "juego", "drum"]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        t, start = rows.t.to_numpy(), int(rows.start.iloc[0])
        train = (t >= spec.warmup) & (t < start)
        test = t >= start
        x, y = rows[NAMES].to_numpy(float), rows.y.to_numpy(float)
        p = Trees(**params).fit(x[train], y[train]).predict(x[test])
        return rows.loc[test, [*keys, "t", "num"]].assign(y=y[test].astype(int), p=p)

    known = features.where(F.col("y").isNotNull())
    starts = known.groupBy(*keys).agg(F.max("t").alias("last")).where(F.col("last") >= spec.first_test)
    starts = starts.select(*keys, F.explode(F.sequence(F.lit(spec.first_test).cast("long"), F.col("last"), F.lit(spec.refit_every).cast("long"))).alias("start"))
    rows = known.join(F.broadcast(starts), keys).where((F.col("t") < F.col("start") + spec.refit_every) & (F.col("t") >= spec.warmup))
    apart = rows.repartition(256, *keys, "start")
    return normalized(apart.groupBy(*keys, "start").applyInPandas(fit, kinds + FORECAST))


#: The models by name; the one that makes the live forecasts was chosen beforehand and never by results.
MODELS = {"logistica": walk_forward_logistic, "gradient_boosting": walk_forward_boosting}
PRODUCTION = "logistica"


def fit_final(features: DataFrame, spec: GameSpec = SPEC, c: float = 1.0) -> DataFrame:
    """(juego, drum, num, rate, intercept, coefficients, mean, scale): the logistic models of whole histories, as a table."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[NAMES].to_numpy(float), rows.y.to_numpy(float)
        one = {"juego": rows.juego.iloc[0], "drum": rows.drum.iloc[0], "num": int(rows.num.iloc[0]), "rate": None, "intercept": None, "coefficients": None, "mean": None, "scale": None}
        _, beta = fit_label(x, y, c)
        if beta is None:
            return pd.DataFrame([one | {"rate": (y.sum() + 1) / (len(y) + 2)}])
        scaler = Scaler().fit(x)
        return pd.DataFrame([one | {"intercept": beta[0], "coefficients": beta[1:].tolist(), "mean": scaler.mean.tolist(), "scale": scaler.scale.tolist()}])

    rows = features.where((F.col("t") >= spec.warmup) & F.col("y").isNotNull())
    kinds = "juego string, drum string, num int, rate double, intercept double, coefficients array<double>, mean array<double>, scale array<double>"
    return rows.groupBy("juego", "drum", "num").applyInPandas(fit, kinds)


def forecast(features: DataFrame, model: DataFrame) -> DataFrame:
    """(juego, drum, t, num, y, p) of feature rows by a table of fitted models, in column expressions alone."""
    x = [F.log1p(c) if c == "gap" else F.col(c) for c in NUMERIC]
    z = F.col("intercept")
    for k, c in enumerate(x):
        z += F.col("coefficients")[k] * (c - F.col("mean")[k]) / F.col("scale")[k]
    for k, c in enumerate(DAYS):
        z += F.col("coefficients")[len(NUMERIC) + k] * F.col(c)
    z = F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))
    rows = features.join(F.broadcast(model), ["juego", "drum", "num"])  # 59 rows a game
    return normalized(rows.select("juego", "drum", "t", "num", "y", F.coalesce("rate", 1 / (1 + F.exp(-z))).alias("p")))
