"""Controls of the method: planted signals, regularisation, and two classic ways to fool oneself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC, GameSpec
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.operators import models
from drawspark.operators import montecarlo as M
from drawspark.operators import significance as S

EFFECTS, SEEDS = [0.0, 0.5, 1.5], [1, 2]
C_GRID = [1.0, 0.3, 0.1, 0.03, 0.01, 0.003]
ROLLING = ["freq_10", "freq_30", "freq_100"]


def mean_over_seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Histories by key with their mean hits and mean skill."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.avg("hits").alias("hits"), F.avg("skill_log_loss_balls").alias("skill_log_loss_balls"))


def positive_control(dates: DataFrame, forecasters: dict[str, Callable[[DataFrame], DataFrame]], effects=EFFECTS, seeds=SEEDS, spec: GameSpec = SPEC) -> DataFrame:
    """(model, effect, n_seeds, hits, skill): what each model finds in histories with a planted signal, and in fair ones."""
    histories = S.tagged(M.sticky_histories(dates, effects, seeds, spec), "effect", "seed")
    out = None
    for name, model in forecasters.items():
        rows = S.untagged(S.metrics(histories, model, spec), "effect", "seed").withColumn("model", F.lit(name)).withColumn("effect", F.col("effect").cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return mean_over_seeds(out, ["model", "effect"])


def regularisation(dates: DataFrame, grid=C_GRID, effects=EFFECTS, seeds=SEEDS, spec: GameSpec = SPEC) -> DataFrame:
    """The logistic model with each strength of its penalty, on the same histories: an analysis, never a choice."""
    of = {str(c): (lambda rows, c=c: models.walk_forward_logistic(H.features(rows, spec), spec, c)) for c in grid}
    return positive_control(dates, of, effects, seeds, spec).withColumn("c", F.col("model").cast("double")).drop("model")


def rolling_features(members: DataFrame, leaky: bool, windows: tuple[int, ...] = SPEC.windows) -> DataFrame:
    """Frequencies of the balls in windows that end before the draw or, if ``leaky``, with it."""
    counted = members.where((F.col("drum") == "balls") & F.col("y").isNotNull()).withColumn("past", H.past_count())
    if leaky:  # the window of the next draw, one place early
        counted = counted.withColumn("past", F.col("past") + F.col("y")).withColumn("t", F.col("t") + 1)
    cols = [H.window_frequency("past", w).alias(f"freq_{w}") for w in windows]
    return counted.select("juego", "drum", (F.col("t") - int(leaky)).alias("t"), "num", "y", *cols)


def _fixed_split(features: DataFrame, spec: GameSpec, test_share: float, names: list[str]) -> DataFrame:
    """Forecasts of a random quarter of the draws by models fitted on the others, before and after: the wrong way."""
    import numpy as np
    import pandas as pd

    lot = F.pmod(F.xxhash64("juego", "t", F.lit(spec.seed)), F.lit(1 << 20)) / (1 << 20)
    rows = features.where(F.col("t") >= spec.warmup).withColumn("held", lot < test_share)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, held = rows[names].to_numpy(float), rows.y.to_numpy(float), rows.held.to_numpy(bool)
        scale = np.where((std := x[~held].std(0)) > 0, std, 1.0)
        z = (x - x[~held].mean(0)) / scale
        beta = models.logistic(z[~held], y[~held])
        return rows.loc[held, ["juego", "drum", "t", "num"]].assign(y=y[held].astype(int), p=models._sigmoid(beta[0] + z[held] @ beta[1:]))

    return rows.groupBy("juego", "num").applyInPandas(fit, models.FORECAST)


def trap_grid(draws: DataFrame, spec: GameSpec = SPEC, test_share: float = 0.25) -> DataFrame:
    """(features, validation, juego, n_draws, hits, …): leaky or honest windows, under a random split or walk-forward."""
    members = H.membership(draws, spec)
    extra = members.where("drum = 'sb'").select("juego", "drum", "t", "num", "y", F.lit(spec.p_extra).alias("p"))
    out = None
    for leaky in (True, False):
        x = rolling_features(members, leaky, spec.windows)
        names = [f"freq_{w}" for w in spec.windows]
        for how, forecast in (("split aleatorio", _fixed_split(x, spec, test_share, names)), ("walk-forward", models.walk_forward_logistic(x, spec, columns=names))):
            whole = forecast.unionByName(extra.join(forecast.select("juego", "t").distinct(), ["juego", "t"], "left_semi"))
            rows = E.summary(E.draw_scores(whole, spec), spec).select("juego", "n_draws", "hits", "hits_low", "hits_high", "log_loss_balls", "skill_log_loss_balls")
            rows = rows.select(F.lit("con fuga" if leaky else "correctas").alias("features"), F.lit(how).alias("validation"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def strategy_hits(members: DataFrame, windows: list[int], spec: GameSpec = SPEC) -> DataFrame:
    """(juego, t, w, kind, hits): hits of the play of the most ('calientes') or least ('frios') frequent balls of a window.

    Each draw is ranked within its own row: counts over one window stand as their frequencies do, and ties go by the digest
    of ``E.ranked``, made only for labels that reach the last place played.
    """
    tested = H.window_counts(members, windows, spec.labels).where(F.col("t") >= spec.first_test)
    low = F.transform("counts", lambda c: -c)
    side = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.element_at(F.sort_array(value, asc=False), spec.drawn).alias("least"))
    rows = tested.select("juego", "t", "drawn", "w", F.explode(F.array(side("calientes", F.col("counts")), side("frios", low))).alias("side"))
    value = lambda j: F.get("side.value", j - 1)
    key = lambda j: E.seeded_key(F.lit(spec.seed), F.col("juego"), F.lit("balls"), F.col("t"), F.col("w"), F.col("side.kind"), j)
    reach = F.filter(F.sequence(F.lit(1), F.lit(spec.labels)), lambda j: value(j) >= F.col("side.least"))
    placed = F.array_sort(F.transform(reach, lambda j: F.struct((-value(j)).alias("v"), key(j).alias("key"), F.get("drawn", j - 1).alias("y"))))
    hits = F.aggregate(F.slice(placed, 1, spec.drawn), F.lit(0).cast("long"), lambda total, x: total + x["y"])
    return rows.select("juego", "t", "w", "side.kind", hits.alias("hits"))


def selection_bias(members: DataFrame, windows: list[int], spec: GameSpec = SPEC) -> DataFrame:
    """(juego, w, kind, hits_a, hits_b, n_a, n_b, best): the strategies' mean hits in two halves of the test draws, and
    the one that looks best in the first, with the bands of chance."""
    hits = strategy_hits(members, windows, spec)
    last = members.where(F.col("y").isNotNull()).groupBy("juego").agg((F.max("t") + 1).alias("n"))
    half = spec.first_test + F.floor((F.col("n") - spec.first_test) / 2)
    a = F.col("t") < half
    g = hits.join(F.broadcast(last), "juego").groupBy("juego", "w", "kind").agg(
        F.avg(F.when(a, F.col("hits"))).alias("hits_a"), F.avg(F.when(~a, F.col("hits"))).alias("hits_b"), F.sum(a.cast("long")).alias("n_a"), F.sum((~a).cast("long")).alias("n_b")
    )
    first = Window.partitionBy("juego").orderBy(F.round("hits_a", 12).desc(), "w", "kind")
    mean, sd = spec.drawn * spec.p_label, spec.hits_variance**0.5
    bands = [(mean + s * E.Z95 * sd / F.sqrt(f"n_{p}")).alias(f"{name}_{p}") for p in "ab" for s, name in ((-1, "low"), (1, "high"))]
    return g.withColumn("best", F.row_number().over(first) == 1).select("*", *bands)
