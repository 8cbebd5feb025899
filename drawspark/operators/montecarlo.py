"""Simulated, permuted and resampled histories; one row of work a simulation, spread over tasks."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC, GameSpec
from drawspark.operators.evaluation import clipped, seeded_key
from drawspark.operators.history import chance

N_SIMS = 10_000
SIM_PARTS = 64


def generator(*keys: str | int, seed: int = SPEC.seed) -> np.random.Generator:
    """A stream of its own for every analysis: names count by a stable checksum, so no order of runs matters."""
    return np.random.default_rng(np.random.SeedSequence([seed, *[k if isinstance(k, int) else zlib.crc32(k.encode()) for k in keys]]))


def _fair(rng: np.random.Generator, n: int, spec: GameSpec) -> np.ndarray:
    return np.argpartition(rng.random((n, spec.labels), dtype=np.float32), spec.drawn, axis=1)[:, : spec.drawn]


def simulations(spark: SparkSession, histories: list[tuple[str, int]], n_sims: int) -> DataFrame:
    """(juego, n_draws, sim): one row for each simulated history of each game's own length."""
    games = spark.createDataFrame(histories, "juego string, n_draws long")
    return spark.range(0, n_sims, 1, SIM_PARTS).withColumnRenamed("id", "sim").join(F.broadcast(games), F.lit(True))


def simulated_counts(sims: DataFrame, seed: int = SPEC.seed, spec: GameSpec = SPEC) -> DataFrame:
    """(juego, sim, drum, statistic, value) of fair histories: chi2 of both drums and the balls' largest |z|.

    A simulation's stream depends on seed, game and number alone, not on the task that runs it.
    """

    def run(batches):
        for batch in batches:
            out = []
            for game, n, sim in zip(batch.juego, batch.n_draws, batch.sim, strict=True):
                n, rng = int(n), generator("conteos", game, int(sim), seed=seed)
                seen = np.bincount(_fair(rng, n, spec).ravel(), minlength=spec.labels)
                extra = rng.multinomial(n, [spec.p_extra] * spec.extras)
                expected, share = n * spec.p_label, n * spec.p_extra
                spread = (expected * (1 - spec.p_label)) ** 0.5
                out += [
                    (game, sim, "balls", "chi2", float(((seen - expected) ** 2 / expected).sum())), (game, sim, "balls", "max_abs_z", float(np.abs(seen - expected).max() / spread)),
                    (game, sim, "sb", "chi2", float(((extra - share) ** 2 / share).sum())),
                ]
            yield pd.DataFrame(out, columns=["juego", "sim", "drum", "statistic", "value"])

    return sims.mapInPandas(run, "juego string, sim long, drum string, statistic string, value double")


def _key(*of: Column) -> Column:
    return seeded_key(*of)


def sampled_draws(rows: DataFrame, seed: int = SPEC.seed, spec: GameSpec = SPEC, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """``rows`` with balls and superbalota drawn fairly: the labels of the smallest keyed digests, so every engine draws the same."""
    of = [F.col(c) for c in by]
    first = lambda n, name: F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.struct(_key(F.lit(seed), F.lit(name), *of, j).alias("k"), j.alias("j"))))
    chosen = F.array_sort(F.transform(F.slice(first(spec.labels, "balls"), 1, spec.drawn), lambda s: s["j"]))
    return rows.withColumns({"balls": chosen, "superbalota": F.element_at(first(spec.extras, "sb"), 1)["j"]})


def permuted(draws: DataFrame, seed: int = SPEC.seed, by: tuple[str, ...] = ()) -> DataFrame:
    """Dates stay, results are dealt to them in the order of a keyed digest, within each game (and resample)."""
    game = Window.partitionBy(*by, "juego")
    dates = draws.select(*by, "juego", "n_sorteo", "fecha", F.row_number().over(game.orderBy("n_sorteo")).alias("k"))
    results = draws.select(*by, "juego", "balls", "superbalota", F.row_number().over(game.orderBy(_key(F.lit(seed), *[F.col(b) for b in by], F.col("juego"), F.col("n_sorteo")))).alias("k"))
    return dates.join(results, [*by, "juego", "k"]).drop("k")


def resampled(draws: DataFrame, kind: str, n: int, seed: int = SPEC.seed, spec: GameSpec = SPEC) -> DataFrame:
    """``n`` copies of the histories, ``resample`` 0 .. n - 1: results permuted ('permutacion') or drawn fairly ('sintetico')."""
    copies = draws.select("juego", "n_sorteo", "fecha", "balls", "superbalota").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if kind == "permutacion":
        return permuted(copies, seed, ("resample",))
    if kind == "sintetico":
        return sampled_draws(copies, seed, spec, ("resample", "juego", "n_sorteo"))
    raise ValueError(f"unknown resampling: {kind}")


def sticky_histories(dates: DataFrame, effects: list[float], seeds: list[int], spec: GameSpec = SPEC) -> DataFrame:
    """Histories with a planted signal: labels of the draw before weigh 1 + effect (0: fair draws).

    (effect, seed, juego, n_sorteo, fecha, balls, superbalota); a history is drawn in order, so it is one task's work.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_sorteo")
        effect, seed, game = float(rows.effect.iloc[0]), int(rows.seed.iloc[0]), rows.juego.iloc[0]
        rng = generator("pegajoso", f"{effect}", seed, game, seed=spec.seed)
        before = {"balls": np.zeros(spec.labels), "sb": np.zeros(spec.extras)}
        balls, extra = [], []
        for _ in range(len(rows)):
            keys = {d: np.log1p(effect * w) + rng.gumbel(size=len(w)) for d, w in before.items()}
            picked, one = np.argsort(-keys["balls"])[: spec.drawn], int(np.argmax(keys["sb"]))
            before = {d: np.zeros(len(w)) for d, w in before.items()}
            before["balls"][picked] = 1
            before["sb"][one] = 1
            balls.append(sorted(int(x) + 1 for x in picked))
            extra.append(one + 1)
        return rows.assign(balls=balls, superbalota=extra)[["effect", "seed", "juego", "n_sorteo", "fecha", "balls", "superbalota"]]

    grid = dates.select("juego", "n_sorteo", "fecha").withColumn("effect", F.explode(F.array(*map(F.lit, effects)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return grid.groupBy("effect", "seed", "juego").applyInPandas(run, "effect double, seed int, juego string, n_sorteo long, fecha date, balls array<int>, superbalota int")


def ratios(forecast: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """Adds score, a label's log ratio to its chance; a play's score is the sum of its labels' scores."""
    return forecast.withColumn("score", F.log(clipped(F.col("p"), 1.0) / chance(spec)))


def score_arrays(forecast: DataFrame, keys: list[str], spec: GameSpec = SPEC) -> DataFrame:
    """(keys, s_balls, s_extra): the scores of all labels, in order; 59 values a draw."""
    rows = ratios(forecast, spec).groupBy(*keys, "drum").agg(F.transform(F.sort_array(F.collect_list(F.struct("num", "score"))), lambda x: x["score"]).alias("s"))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("drum") == "balls", F.col("s"))).alias("s_balls"), F.max(F.when(F.col("drum") == "sb", F.col("s"))).alias("s_extra"))


def play_percentile(scores: DataFrame, labels: list[str], spec: GameSpec = SPEC) -> DataFrame:
    """(labels, score, percentile) of each row's play among all plays, ties counting half.

    ``scores`` has arrays s_balls and s_extra of log ratios and the play (balls, superbalota).  The sums of five labels
    are those of all combinations, listed once a Python worker; a play's rank takes one search an extra label.
    """
    from itertools import combinations

    def run(batches):
        combos = np.array(list(combinations(range(spec.labels), spec.drawn)), np.int8)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                s, e = np.asarray(row.s_balls, float), np.asarray(row.s_extra, float)
                sums = np.sort(sum(s[combos[:, k]] for k in range(spec.drawn)))
                score = sum(s[b - 1] for b in row.balls) + e[row.superbalota - 1]
                below = sum(np.searchsorted(sums, score - x - 1e-9) for x in e)
                upto = sum(np.searchsorted(sums, score - x + 1e-9, side="right") for x in e)
                out.append((score, 100 * (below + upto) / 2 / spec.plays))
            yield pd.concat([batch[labels].reset_index(drop=True), pd.DataFrame(out, columns=["score", "percentile"])], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    return scores.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in labels) + ", score double, percentile double")


def winner_percentiles(scores: DataFrame, labels: list[str], n_random: int = 2000, spec: GameSpec = SPEC) -> DataFrame:
    """(labels, u): the share, 0..1, of ``n_random`` random plays that score less than the one drawn, ties counting half."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rng = generator("ganadoras", *[str(getattr(row, c)) for c in labels], seed=spec.seed)
                s, e = np.asarray(row.s_balls, float), np.asarray(row.s_extra, float)
                own = s[np.asarray(row.balls) - 1].sum() + e[row.superbalota - 1]
                others = s[_fair(rng, n_random, spec)].sum(1) + e[rng.integers(0, spec.extras, n_random)]
                tie = np.abs(others - own) <= 1e-12
                out.append(((others < own) & ~tie).mean() + 0.5 * tie.mean())
            yield batch[labels].reset_index(drop=True).assign(u=out)

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    return scores.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in labels) + ", u double")
