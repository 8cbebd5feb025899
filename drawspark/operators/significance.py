"""Could chance have done as well?  Nulls of outcomes, of two games' independence, and of whole histories with refitting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawspark.functions.game import SPEC, GameSpec, binomial_two_sided
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.operators import montecarlo as M

#: Simulations that one row of work makes.
CHUNK = 100
BETTER = {"hits": "greater", "log_loss_balls": "less", "accuracy_sb": "greater", "log_loss_sb": "less"}
RESAMPLED = ("skill_log_loss_balls", "hits", "skill_log_loss_sb", "accuracy_sb")
CORRELATIONS = 2000


def unpivoted(wide: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "observed") -> DataFrame:
    return wide.unpivot(keys, values, name, value)


def _work(spark, n_sims: int) -> DataFrame:
    """(first, sims): rows of work that make n_sims simulations together."""
    chunks = -(-n_sims // CHUNK)
    return spark.range(0, chunks, 1, min(M.SIM_PARTS, chunks)).select((F.col("id") * CHUNK).alias("first"), F.least(F.lit(CHUNK).cast("long"), n_sims - F.col("id") * CHUNK).alias("sims"))


def outcome_null(forecast: DataFrame, n_sims: int = M.N_SIMS, spec: GameSpec = SPEC) -> DataFrame:
    """(juego, metric, value) of ``n_sims`` fair sequences of outcomes under forecasts that stay.

    Any fixed play's hits are hypergeometric and a fixed extra label is right with its chance, whatever the forecast;
    log-losses are those of the drawn labels.  A game's forecast (draws x labels numbers) goes to every task: it is
    bounded by the length of a history.
    """
    p = forecast.groupBy("juego", "drum").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "num", "p"))), lambda x: x["p"]).alias("p"))
    games = p.groupBy("juego").agg(*[F.max(F.when(F.col("drum") == d, F.col("p"))).alias(d) for d in ("balls", "sb")])
    rows = _work(forecast.sparkSession, n_sims).join(F.broadcast(games), F.lit(True))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                rng = M.generator("resultados", r.juego, int(r.first), seed=spec.seed)
                balls = np.clip(np.asarray(r.balls).reshape(-1, spec.labels), E.EPS, 1 - E.EPS)
                sb, m = np.clip(np.asarray(r.sb).reshape(-1, spec.extras), E.EPS, 1), len(balls)
                miss, odds = -np.log1p(-balls).mean(), np.log(balls) - np.log1p(-balls)
                for _ in range(int(r.sims)):
                    drawn = M._fair(rng, m, spec)
                    out.append((r.juego, "hits", rng.hypergeometric(spec.drawn, spec.labels - spec.drawn, spec.drawn, m).mean()))
                    out.append((r.juego, "log_loss_balls", miss - np.take_along_axis(odds, drawn, 1).sum() / (m * spec.labels)))
                    out.append((r.juego, "accuracy_sb", rng.binomial(m, spec.p_extra) / m))
                    out.append((r.juego, "log_loss_sb", -np.log(sb[np.arange(m), rng.integers(0, spec.extras, m)]).mean()))
            yield pd.DataFrame(out, columns=["juego", "metric", "value"])

    return rows.mapInPandas(run, "juego string, metric string, value double")


def outcome_significance(forecast: DataFrame, n_sims: int = M.N_SIMS, spec: GameSpec = SPEC) -> DataFrame:
    """Each metric's place among fair outcomes: better than chance means more hits, less loss."""
    null = outcome_null(forecast, n_sims, spec).cache()
    scores = E.summary(E.draw_scores(forecast, spec), spec)
    observed = unpivoted(scores, ["juego"], list(BETTER))
    return _placed(null, observed, ["juego", "metric"], BETTER)


def _placed(null: DataFrame, observed: DataFrame, keys: list[str], better: dict[str, str]) -> DataFrame:
    parts = []
    for side in sorted(set(better.values())):
        own = F.col("metric").isin([m for m, s in better.items() if s == side])
        parts.append(E.place_in_null(null.where(own), observed.where(own), keys, side))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- uniformity


def uniformity_nulls(draws: DataFrame, n_sims: int = M.N_SIMS, spec: GameSpec = SPEC) -> DataFrame:
    """The observed chi2 of both drums and the largest |z| of a ball, each placed among fair histories of its length."""
    counts = E.uniformity(E.label_counts(draws, spec), spec)
    balls = counts.select("juego", F.lit("balls").alias("drum"), F.expr("stack(2, 'chi2', chi2, 'max_abs_z', max_abs_z) AS (statistic, observed)"))
    extra = extra_uniformity(draws, spec).select("juego", F.lit("sb").alias("drum"), F.lit("chi2").alias("statistic"), F.col("chi2").alias("observed"))
    lengths = [(r["juego"], r["count"]) for r in draws.groupBy("juego").count().orderBy("juego").collect()]
    null = M.simulated_counts(M.simulations(draws.sparkSession, lengths, n_sims), spec.seed, spec)
    return E.place_in_null(null, balls.unionByName(extra), ["juego", "drum", "statistic"])


def extra_uniformity(draws: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """(juego, n_draws, chi2, p) of the extra label, zeros included."""
    counted = draws.groupBy("juego").agg(F.count("*").alias("n_draws"), *[F.sum((F.col("superbalota") == k).cast("long")).alias(f"k{k}") for k in range(1, spec.extras + 1)])
    share = F.col("n_draws") * spec.p_extra
    parts = [(F.col(f"k{k}") - share) ** 2 / share for k in range(1, spec.extras + 1)]
    out = counted.select("juego", "n_draws", sum(parts[1:], parts[0]).alias("chi2"))
    return out.withColumn("p", E.chi2_tail(F.col("chi2"), spec.extras - 1))


# --- independence of two games


def aligned(draws: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """Draw numbers that both games have, with both results."""
    a, b = (draws.where(F.col("juego") == g).select("n_sorteo", F.col("balls").alias(f"balls_{k}"), F.col("superbalota").alias(f"extra_{k}")) for g, k in zip(spec.games, "ab", strict=True))
    return a.join(b, "n_sorteo")


def common(pairs: DataFrame) -> DataFrame:
    return pairs.select("n_sorteo", F.size(F.array_intersect("balls_a", "balls_b")).alias("common"), (F.col("extra_a") == F.col("extra_b")).cast("int").alias("same_extra"))


def binned_chi2(pairs: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """(n, mean_common, same_extra, chi2): chi2 of 0, 1, 2 and more common balls against the hypergeometric law."""
    pmf = spec.hits_pmf()
    law = [pmf[0], pmf[1], pmf[2], sum(pmf[3:])]
    g = common(pairs).agg(
        F.count("*").alias("n"), F.avg("common").alias("mean_common"), F.sum("same_extra").alias("same_extra"),
        *[F.sum((F.least("common", F.lit(3)) == k).cast("long")).alias(f"c{k}") for k in range(4)],
    )
    parts = [(F.col(f"c{k}") - F.col("n") * p) ** 2 / (F.col("n") * p) for k, p in enumerate(law)]
    return g.withColumn("chi2", sum(parts[1:], parts[0]))


def pair_correlations(pairs: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """(j, k, correlation) of every ball of one game with every ball of the other, from counts alone."""
    n = pairs.agg(F.count("*").alias("n"))
    one = lambda c, name: pairs.select(F.explode(c).alias(name)).groupBy(name).agg(F.count("*").alias(f"n_{name}"))
    both = pairs.select(F.explode("balls_a").alias("j"), "balls_b").select("j", F.explode("balls_b").alias("k")).groupBy("j", "k").agg(F.count("*").alias("n_jk"))
    grid = one("balls_a", "j").join(one("balls_b", "k"), F.lit(True)).join(n, F.lit(True)).join(both, ["j", "k"], "left")  # 43 x 43 labels
    x, y = F.col("n_j") / F.col("n"), F.col("n_k") / F.col("n")
    return grid.select("j", "k", ((F.coalesce("n_jk", F.lit(0)) / F.col("n") - x * y) / F.sqrt(x * (1 - x) * y * (1 - y))).alias("correlation"))


def independence_null(pairs: DataFrame, n_sims: int = M.N_SIMS, n_correlations: int = CORRELATIONS, spec: GameSpec = SPEC) -> DataFrame:
    """(statistic, value): fair independent draws (mean, binned chi2) and one game's draws dealt anew over the other's
    dates (mean, equal extra labels, largest |correlation|).  The aligned history goes to every task."""
    history = pairs.agg(F.sort_array(F.collect_list(F.struct("n_sorteo", "balls_a", "balls_b", "extra_a", "extra_b"))).alias("h"))
    rows = _work(pairs.sparkSession, n_sims).join(F.broadcast(history), F.lit(True))
    pmf = spec.hits_pmf()
    law = np.array([pmf[0], pmf[1], pmf[2], sum(pmf[3:])])

    def hot(lists) -> np.ndarray:
        out = np.zeros((len(lists), spec.labels), np.float32)
        for i, own in enumerate(lists):
            out[i, np.asarray(own) - 1] = 1
        return out

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a, b = hot([x["balls_a"] for x in r.h]), hot([x["balls_b"] for x in r.h])
                ea, eb = (np.array([x[c] for x in r.h]) for c in ("extra_a", "extra_b"))
                n = len(a)
                za, zb = ((y - y.mean(0)) / np.where(y.std(0) > 0, y.std(0), 1) for y in (a, b))
                rng = M.generator("independencia", int(r.first), seed=spec.seed)
                for k in range(int(r.sims)):
                    hits = rng.hypergeometric(spec.drawn, spec.labels - spec.drawn, spec.drawn, n)
                    seen = np.bincount(np.minimum(hits, 3), minlength=4)
                    perm = rng.permutation(n)
                    out += [("mean_fair", hits.mean()), ("chi2_fair", ((seen - n * law) ** 2 / (n * law)).sum()), ("mean_dealt", (a * b[perm]).sum() / n), ("same_extra_dealt", float((ea == eb[perm]).sum()))]
                    if r.first + k < n_correlations:
                        out.append(("max_correlation_dealt", float(np.abs(za.T @ zb[perm] / n).max())))
            yield pd.DataFrame(out, columns=["statistic", "value"]).astype({"value": float})

    return rows.mapInPandas(run, "statistic string, value double")


def independence(pairs: DataFrame, n_sims: int = M.N_SIMS, n_correlations: int = CORRELATIONS, spec: GameSpec = SPEC) -> DataFrame:
    """Every statistic of the two games' dependence placed in its null, and the exact binomial p of equal extra labels."""
    null = independence_null(pairs, n_sims, n_correlations, spec).cache()
    seen = binned_chi2(pairs, spec)
    top = pair_correlations(pairs, spec).agg(F.max(F.abs("correlation")).alias("top"))
    wide = seen.join(top, F.lit(True)).select(
        F.col("mean_common").alias("mean_fair"), F.col("chi2").alias("chi2_fair"), F.col("mean_common").alias("mean_dealt"), F.col("same_extra").cast("double").alias("same_extra_dealt"),
        F.col("top").alias("max_correlation_dealt"), F.col("n").cast("double").alias("n_draws"),
    )
    observed = wide.unpivot(["n_draws"], wide.columns[:-1], "statistic", "observed")
    place = lambda names, side, centre=None: E.place_in_null(null.where(F.col("statistic").isin(names)), observed.where(F.col("statistic").isin(names)).drop("n_draws"), ["statistic"], side, centre)
    out = place(["chi2_fair", "max_correlation_dealt"], "greater").unionByName(place(["mean_fair"], "two-sided", spec.drawn * spec.p_label)).unionByName(place(["mean_dealt", "same_extra_dealt"], "two-sided"))
    exact = F.udf(lambda k, n: float(binomial_two_sided(int(k), int(n), spec.p_extra)), "double")  # one row
    binomial = observed.where("statistic = 'same_extra_dealt'").select("statistic", exact("observed", "n_draws").alias("p_binomial"))
    return out.join(binomial, "statistic", "left")


# --- whole histories with refitting


def metrics(draws: DataFrame, model: Callable[[DataFrame], DataFrame], spec: GameSpec = SPEC) -> DataFrame:
    """(juego, four metrics) of a model's walk-forward over histories."""
    return E.summary(E.draw_scores(model(H.membership(draws, spec)), spec), spec).select("juego", *RESAMPLED)


def tagged(draws: DataFrame, *tags: str) -> DataFrame:
    """Histories that differ in ``tags`` as games of their own: the tags join the game's name."""
    return draws.withColumn("juego", F.concat_ws("#", "juego", *[F.col(t).cast("string") for t in tags]))


def untagged(rows: DataFrame, *tags: str) -> DataFrame:
    parts = F.split("juego", "#")
    return rows.withColumns({t: parts[k + 1] for k, t in enumerate(tags)} | {"juego": parts[0]})


def resampling_null(draws: DataFrame, model: Callable[[DataFrame], DataFrame], kind: str, n: int, spec: GameSpec = SPEC) -> DataFrame:
    """(juego, metric, value) of ``n`` whole walk-forwards over resampled histories; a resample is one more key, so all
    of them are one job."""
    rows = metrics(tagged(M.resampled(draws, kind, n, spec.seed, spec), "resample"), model, spec)
    return untagged(rows, "resample").unpivot(["juego", "resample"], list(RESAMPLED), "metric", "value").drop("resample")


def resampling_significance(draws: DataFrame, model: Callable[[DataFrame], DataFrame], runs: dict[str, int], spec: GameSpec = SPEC) -> DataFrame:
    """(juego, test, metric, observed, null, p): a model's metrics among those of permuted and of synthetic histories."""
    observed = metrics(draws, model, spec).unpivot(["juego"], list(RESAMPLED), "metric", "observed")
    out = None
    for kind, n in runs.items():
        if n > 0:
            part = E.place_in_null(resampling_null(draws, model, kind, n, spec), observed, ["juego", "metric"]).withColumn("test", F.lit(kind))
            out = part if out is None else out.unionByName(part)
    return out
