"""Queries without SQL take every draw of every game and agree with plain Python and with what must hold."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawspark.functions.game import SPEC
from drawspark.operators import controls, models, montecarlo, significance
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.plans import analysis, lottery

RUN = {q.name: q.run for q in lottery.QUERIES}
FIRST = SPEC.first_test
QUICK = dataclasses.replace(SPEC, warmup=20, min_train=30, refit_every=200)


def _draws(spark, sf):
    return {r["juego"]: r["count"] for r in lottery._daily(spark, sf).groupBy("juego").count().collect()}


@pytest.fixture(scope="module")
def past(spark, sf):
    return {r["n_sorteo"]: r for r in lottery._daily(spark, sf).where("juego = 'revancha'").collect()}


def test_logistic_forecasts_every_draw(spark, sf):
    rows = models.walk_forward_logistic(H.features(lottery._members(spark, sf).where("num <= 2")), dataclasses.replace(SPEC, refit_every=50))
    got = {(r["juego"], r["drum"]): r["n"] for r in rows.groupBy("juego", "drum").agg({"t": "count"}).withColumnRenamed("count(t)", "n").collect()}
    assert got == {(g, drum): 2 * (n - FIRST) for g, n in _draws(spark, sf).items() for drum in ("balls", "sb")}


def test_short_history_is_an_error(spark, sf):
    with pytest.raises(ValueError):
        models.require_history(lottery._daily(spark, sf).where("n_sorteo <= 250"))
    models.require_history(lottery._daily(spark, sf))


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.3).astype(float)
    beta = models.logistic(x, y, 0.5)
    cold, warm = beta, models.logistic(x, y, 0.5, start=beta + 0.3)
    assert np.abs(cold - warm).max() < 1e-8
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    grad = np.r_[(p - y).sum(), x.T @ (p - y) + beta[1:] / 0.5]
    assert np.abs(grad).max() < 1e-6


def test_fixed_label_gets_a_smoothed_rate():
    model, beta = models.fit_label(np.ones((8, 8)), np.zeros(8))
    assert beta is None and model(np.ones((2, 8))).tolist() == [0.1, 0.1]


def test_legacy_scaling():
    x = np.tile(np.arange(8.0), (5, 1)) + np.arange(5.0)[:, None]
    now, before = models.Scaler().fit(x), models.Scaler(legacy=True).fit(x)
    assert np.allclose(before.apply(x).std(0), 1) and np.allclose(now.apply(x)[:, :5].std(0), 1)
    assert np.allclose(now.apply(x)[:, 5:], x[:, 5:])


def test_trees_learn_a_step_and_nothing_from_noise():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < np.where(x[:, 1] > 0.6, 0.7, 0.2)).astype(float)
    p = models.Trees(rounds=80).fit(x, y).predict(np.array([[0.5, 0.2, 0.5], [0.5, 0.9, 0.5]]))
    assert abs(p[0] - 0.2) < 0.06 and abs(p[1] - 0.7) < 0.06
    flat = models.Trees(least=3000).fit(x, y)
    assert np.allclose(flat.predict(x), y.mean(), atol=1e-6)


def test_fitted_table_forecasts_as_the_model(spark, sf):
    features = H.features(lottery._members(spark, sf).where("juego = 'baloto' AND num = 3"))
    table = models.forecast(features, models.fit_final(features)).where("drum = 'balls'").orderBy("t").collect()
    rows = features.where("drum = 'balls'").orderBy("t").toPandas()
    train = rows.t >= SPEC.warmup
    model, _ = models.fit_label(rows[models.NAMES].to_numpy(float)[train], rows.y.to_numpy(float)[train])
    assert np.allclose([r["p"] for r in table], model(rows[models.NAMES].to_numpy(float)), atol=1e-9)


def test_every_draw_has_a_percentile(spark, sf, past):
    plays = analysis._plays(spark, sf)
    assert {(r["juego"], r["n_sorteo"]) for r in plays.select("juego", "n_sorteo").collect()} == {(g, n) for g, last in _draws(spark, sf).items() for n in range(FIRST + 1, last + 1)}
    n, own = 300, past[300]
    row = montecarlo.play_percentile(plays.where(f"juego = 'revancha' AND n_sorteo = {n}"), ["n_sorteo"]).first()
    seen = lambda hit: sum(hit(past[k]) for k in range(1, n))
    ratio = lambda k, p: math.log((k + 10 * p) / (n - 1 + 10) / p)
    want = sum(ratio(seen(lambda r: b in r["balls"]), 5 / 43) for b in own["balls"]) + ratio(seen(lambda r: r["superbalota"] == own["superbalota"]), 1 / 16)
    assert abs(row["score"] - want) < 1e-9
    u = montecarlo.winner_percentiles(plays.where(f"juego = 'revancha' AND n_sorteo = {n}"), ["n_sorteo"], 20_000).first()["u"]
    assert abs(100 * u - row["percentile"]) < 1.5


def test_equal_chances_stand_at_the_middle(spark):
    df = spark.createDataFrame([(1, [0.0] * 43, [0.0] * 16, [1, 2, 3, 4, 5], 6)], "k int, s_balls array<double>, s_extra array<double>, balls array<int>, superbalota int")
    assert montecarlo.play_percentile(df, ["k"]).first()["percentile"] == 50
    assert montecarlo.winner_percentiles(df, ["k"]).first()["u"] == 0.5


def test_simulated_histories(spark):
    sims = montecarlo.simulated_counts(montecarlo.simulations(spark, [("baloto", 600)], 300)).toPandas()
    again = montecarlo.simulated_counts(montecarlo.simulations(spark, [("baloto", 600)], 300)).toPandas()
    key = ["sim", "drum", "statistic"]
    assert sims.sort_values(key).value.tolist() == again.sort_values(key).value.tolist() and len(sims) == 900
    chi2 = sims[sims.statistic == "chi2"].groupby("drum").value.mean()
    assert abs(chi2["balls"] - 38) < 2 and abs(chi2["sb"] - 15) < 1.2  # 43 - 5 and 16 - 1


def test_outcome_null_is_that_of_chance(spark, sf):
    forecast = lottery._forecast(spark, sf).where("juego = 'baloto'").select("juego", "drum", "t", "num", "y", "p")
    null = significance.outcome_null(forecast, 300).toPandas().groupby("metric").value
    assert abs(null.mean()["hits"] - 25 / 43) < 0.01 and abs(null.mean()["accuracy_sb"] - 1 / 16) < 0.003
    p = forecast.where("drum = 'balls'").toPandas()
    want = -(5 / 43 * np.log(p.p) + 38 / 43 * np.log1p(-p.p)).mean()
    assert abs(null.mean()["log_loss_balls"] - want) < 2e-4
    placed = significance.outcome_significance(forecast, 200).collect()
    assert {r["metric"] for r in placed} == set(significance.BETTER) and all(0 < r["p"] <= 1 for r in placed)


def test_independence(spark, sf):
    pairs = significance.aligned(lottery._daily(spark, sf))
    got = {r["statistic"]: r for r in significance.independence(pairs, 300, 100).collect()}
    assert set(got) == {"mean_fair", "chi2_fair", "mean_dealt", "same_extra_dealt", "max_correlation_dealt"}
    assert got["max_correlation_dealt"]["n"] == 100 and abs(got["mean_fair"]["null_mean"] - 25 / 43) < 0.01
    rows = pairs.collect()
    k = sum(r["extra_a"] == r["extra_b"] for r in rows)
    pmf = [math.comb(len(rows), i) * (1 / 16) ** i * (15 / 16) ** (len(rows) - i) for i in range(len(rows) + 1)]
    assert abs(got["same_extra_dealt"]["p_binomial"] - min(1, sum(p for p in pmf if p <= pmf[k] * (1 + 1e-7)))) < 1e-6


def test_resampled_histories(spark, sf):
    model = lambda m: analysis._frequency(m, QUICK)
    rows = significance.resampling_significance(lottery._daily(spark, sf).where("n_sorteo <= 120"), model, {"permutacion": 3, "sintetico": 2}, QUICK).collect()
    assert {(r["juego"], r["test"], r["n"]) for r in rows} == {(g, t, n) for g in SPEC.games for t, n in (("permutacion", 3), ("sintetico", 2))}
    assert len(rows) == 16
    dealt = montecarlo.resampled(lottery._daily(spark, sf), "permutacion", 2)
    count = lambda df: sorted(map(str, df.select("juego", "balls", "superbalota").collect()))
    assert count(dealt.where("resample = 1")) == count(lottery._daily(spark, sf))


def test_planted_signal_is_found(spark, sf):
    dates = lottery._daily(spark, sf).where("juego = 'baloto'")
    rows = montecarlo.sticky_histories(dates, [0.0, 30.0], [1]).toPandas().sort_values("n_sorteo")
    repeated = {e: np.mean([len(set(a) & set(b)) for a, b in zip(g.balls, g.balls[1:], strict=False)]) for e, g in rows.groupby("effect")}
    assert abs(repeated[0.0] - 25 / 43) < 0.15 and repeated[30.0] > 2
    found = controls.positive_control(dates.where("n_sorteo <= 300"), {"logistica": lambda m: analysis._logistic(m, QUICK)}, [30.0], [1], QUICK).first()
    assert found["hits"] > 1.2 and found["n_seeds"] == 1


def test_trap(spark, sf):
    rows = {(r["features"], r["validation"]): r for r in controls.trap_grid(lottery._daily(spark, sf).where("juego = 'baloto'"), dataclasses.replace(SPEC, refit_every=200)).collect()}
    assert len(rows) == 4
    assert all(rows["con fuga", v]["hits"] > rows["correctas", v]["hits"] + 0.2 for v in ("split aleatorio", "walk-forward"))


def test_chi2_tails(spark):
    # by the incomplete gamma series, term by term
    def tail(x, df):
        a, term = df / 2, math.exp(df / 2 * math.log(x / 2) - x / 2 - math.lgamma(df / 2 + 1))
        total, k = term, 0
        while term > 1e-18:
            k += 1
            term *= x / 2 / (a + k)
            total += term
        return 1 - total

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (0.5, 3.0, 9.0, 15.0, 27.0, 50.0)], "x double")
    for r in df.select("x", E.chi2_tail(F.col("x"), 42).alias("even"), E.chi2_tail(F.col("x"), 15).alias("odd")).collect():
        assert abs(r["even"] - tail(r["x"], 42)) < 1e-9 and abs(r["odd"] - tail(r["x"], 15)) < 1e-9


def test_kolmogorov_smirnov(spark):
    rows = [("even", (i + 0.5) / 200) for i in range(200)] + [("low", (i / 200) ** 2) for i in range(200)]
    got = {r["g"]: r for r in E.ks_uniform(spark.createDataFrame(rows, "g string, u double"), "u", ["g"]).collect()}
    assert abs(got["even"]["d"] - 0.0025) < 1e-12 and got["even"]["p_ks"] == 1
    assert abs(got["low"]["d"] - 0.25) < 0.01 and got["low"]["p_ks"] < 1e-6


def test_percentiles_of_chance(spark):
    rows = [("even", i + 0.5) for i in range(100)] + [("middle", 50.0)] * 30
    got = {r["g"]: r for r in E.percentile_summary(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert (got["even"]["mean"], got["even"]["middle_share"], got["even"]["deciles"]) == (50, 0.5, [10] * 10) and abs(got["even"]["from_90"] - 0.1) < 1e-12
    assert got["middle"]["p_binomial"] < 1e-6


def test_window_counts_across_blocks(spark, sf, past):
    rows = H.window_counts(lottery._members(spark, sf).where("juego = 'revancha' AND t < 60"), [3, 7, 20], SPEC.labels, block=5).collect()
    assert len(rows) == len({(r["t"], r["w"]) for r in rows}) == 60 * 3
    for r in rows:
        assert [j + 1 for j, y in enumerate(r["drawn"]) if y] == sorted(past[r["t"] + 1]["balls"])
        before = [b for k in range(max(r["t"] - r["w"], 0), r["t"]) for b in past[k + 1]["balls"]]
        assert r["counts"] == [before.count(j) for j in range(1, SPEC.labels + 1)]


def test_no_task_ranks_a_whole_game(spark, sf):
    hits = controls.strategy_hits(lottery._members(spark, sf), [5, 200]).select("juego", "t", F.spark_partition_id().alias("task"))
    tasks = [r["n"] for r in hits.distinct().groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == sum(n - FIRST for n in _draws(spark, sf).values())
    assert len(tasks) > len(SPEC.games) and max(tasks) <= H.BLOCK
