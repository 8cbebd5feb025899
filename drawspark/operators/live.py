"""The append-only log of predictions and its reconciliation with results."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawspark.functions.game import SPEC, GameSpec
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.operators import montecarlo as M


def format_combination(balls: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(balls), lambda b: F.lpad(b.cast("string"), 2, "0")), "-")


def parse_combination(text: Column) -> Column:
    return F.transform(F.split(text, "-"), lambda x: x.cast("int"))


def prediction_id(game: Column, number: Column) -> Column:
    return F.concat_ws("-", game, number.cast("string"))


def deadline_utc(day: Column) -> Column:
    """20:00 at five hours behind UTC, as ISO text: one in the morning of the next day."""
    return F.concat(F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit("T01:00:00Z"))


def pending(predictions: DataFrame, done: DataFrame) -> DataFrame:
    return predictions.join(done.select("prediccion_id"), "prediccion_id", "left_anti")


RESULT_COLUMNS = [
    "prediccion_id", "conciliada_utc", "juego", "n_sorteo", "fecha_sorteo", "fecha_real", "modelo_version", "combinacion", "resultado", "superbalota_sugerida", "superbalota_real",
    "aciertos", "acierto_superbalota", "aciertos_esperados", "log_loss_balotas", "log_loss_constante", "log_loss_superbalota", "log_loss_superbalota_constante",
]
SCORE_COLUMNS = ["puntaje_resultado", "percentil_resultado"]


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_text(utc: Column) -> Column:
    """An ISO time in UTC as it is read five hours behind."""
    return F.date_format(F.to_timestamp(F.regexp_replace(utc, "Z$", ""), "yyyy-MM-dd'T'HH:mm:ss") - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm")


def suggested(forecast: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """(juego, t, combinacion, superbalota_sugerida): the most likely play of every draw, ties by a seeded digest."""
    top = E.ranked(forecast, F.col("p"), seed=spec.seed)
    balls = F.collect_list(F.when((F.col("drum") == "balls") & (F.col("r") <= spec.drawn), F.col("num")))
    return top.groupBy("juego", "t").agg(format_combination(balls).alias("combinacion"), F.max(F.when((F.col("drum") == "sb") & (F.col("r") == 1), F.col("num"))).alias("superbalota_sugerida"))


def probabilities(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p_balls, p_sb): the chances of all labels as two arrays, rounded as they are logged."""
    rows = forecast.groupBy(*keys, "drum").agg(F.transform(F.sort_array(F.collect_list(F.struct("num", "p"))), lambda x: F.bround(x["p"], 6)).alias("p"))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("drum") == "balls", F.col("p"))).alias("p_balls"), F.max(F.when(F.col("drum") == "sb", F.col("p"))).alias("p_sb"))


def predictions(forecast: DataFrame, draws_to_come: DataFrame, now: Column, version: Column, model: str, spec: GameSpec = SPEC) -> DataFrame:
    """Rows of the prediction log for forecasts (juego, drum, t, num, p) of draws (juego, t, n_sorteo, fecha)."""
    both = suggested(forecast, spec).join(probabilities(forecast, ["juego", "t"]), ["juego", "t"]).join(draws_to_come, ["juego", "t"])
    return both.select(
        prediction_id(F.col("juego"), F.col("n_sorteo")).alias("prediccion_id"), utc_text(now).alias("creada_utc"), "juego", "n_sorteo", F.col("fecha").alias("fecha_sorteo"),
        deadline_utc(F.col("fecha")).alias("hora_limite_utc"), version.alias("modelo_version"), F.lit(model).alias("modelo"), "combinacion", "superbalota_sugerida", "p_balls", "p_sb",
    )


def admitted(new: DataFrame, logged: DataFrame) -> DataFrame:
    """Predictions made before their deadline whose draw has none yet; the first one logged is the one that counts."""
    return pending(new.where(F.col("creada_utc") < F.col("hora_limite_utc")), logged)


def reconcile(predictions: DataFrame, done: DataFrame, draws: DataFrame, now: Column | None = None, spec: GameSpec = SPEC) -> DataFrame:
    """Every open prediction whose draw has taken place, beside the result: hits and losses of the logged chances.

    The balls' loss is the mean over labels of clipped chances; the extra label's chances are divided by their sum.
    """
    actual = draws.select("juego", "n_sorteo", F.col("fecha").alias("fecha_real"), "balls", F.col("superbalota").alias("superbalota_real"))
    own = pending(predictions, done).join(actual, ["juego", "n_sorteo"])
    ref = E.references(spec)
    hit = lambda j: F.array_contains("balls", j + 1)
    loss = F.aggregate(F.transform("p_balls", lambda p, j: F.when(hit(j), -F.log(E.clipped(p))).otherwise(-F.log1p(-E.clipped(p)))), F.lit(0.0), lambda a, x: a + x) / spec.labels
    total = F.aggregate("p_sb", F.lit(0.0), lambda a, p: a + E.clipped(p, 1.0))
    extra = -F.log(E.clipped(F.element_at("p_sb", F.col("superbalota_real")), 1.0) / total)
    return own.select(
        "prediccion_id", utc_text(now if now is not None else F.current_timestamp()).alias("conciliada_utc"), "juego", "n_sorteo", "fecha_sorteo", "fecha_real", "modelo_version", "combinacion",
        format_combination(F.col("balls")).alias("resultado"), "superbalota_sugerida", "superbalota_real",
        F.size(F.array_intersect(parse_combination(F.col("combinacion")), "balls")).alias("aciertos"), (F.col("superbalota_sugerida") == F.col("superbalota_real")).cast("int").alias("acierto_superbalota"),
        F.lit(round(spec.drawn * spec.p_label, 6)).alias("aciertos_esperados"), F.bround(loss, 6).alias("log_loss_balotas"), F.lit(round(ref["log_loss_balls"], 6)).alias("log_loss_constante"),
        F.bround(extra, 6).alias("log_loss_superbalota"), F.lit(round(ref["log_loss_sb"], 6)).alias("log_loss_superbalota_constante"),
    )


def with_scores(reconciled: DataFrame, predictions: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """The two columns at the right: the score of the result under the logged chances, and its percentile among all plays.

    Also completes an older log: its own cells stay as they are.
    """
    known = predictions.select("prediccion_id", "p_balls", "p_sb")
    ratio = lambda c, chance: F.transform(c, lambda p: F.log(E.clipped(p, 1.0) / chance))
    plays = reconciled.join(known, "prediccion_id").select(
        "prediccion_id", parse_combination(F.col("resultado")).alias("balls"), F.col("superbalota_real").alias("superbalota"), ratio("p_balls", spec.p_label).alias("s_balls"), ratio("p_sb", spec.p_extra).alias("s_extra")
    )
    found = M.play_percentile(plays, ["prediccion_id"], spec)
    return reconciled.join(found.select("prediccion_id", F.bround("score", 6).alias("puntaje_resultado"), F.bround("percentile", 2).alias("percentil_resultado")), "prediccion_id").select(*reconciled.columns, *SCORE_COLUMNS)


def live_summary(reconciled: DataFrame, spec: GameSpec = SPEC, logged: DataFrame | None = None) -> DataFrame:
    """Totals by game with pointwise bands; games without a row appear with zeros and without means.

    ``logged``: the prediction log, to count predictions and those still open.
    """
    games = reconciled.sparkSession.createDataFrame([(g,) for g in spec.games], "juego string")
    mean, var, q = spec.drawn * spec.p_label, spec.hits_variance, spec.p_extra
    means = [F.avg(c).alias(n) for c, n in (("log_loss_balotas", "log_loss"), ("percentil_resultado", "percentile")) if c in reconciled.columns]
    g = reconciled.groupBy("juego").agg(F.count("*").alias("n"), F.sum("aciertos").alias("hits"), F.sum("acierto_superbalota").alias("extra_hits"), *means)
    out = games.join(g, "juego", "left").na.fill(0, ["n", "hits", "extra_hits"])
    if logged is not None:
        out = out.join(logged.groupBy("juego").agg(F.count("*").alias("predictions")), "juego", "left").na.fill(0, ["predictions"]).withColumn("open", F.col("predictions") - F.col("n"))
    half, extra_half = E.Z95 * F.sqrt(F.col("n") * var), E.Z95 * F.sqrt(F.col("n") * q * (1 - q))
    more = [c for c in ("log_loss", "percentile", "predictions", "open") if c in out.columns]
    return out.select(
        "juego", "n", "hits", "extra_hits", (F.col("n") * mean).alias("expected"), (F.col("n") * mean - half).alias("low"), (F.col("n") * mean + half).alias("high"),
        (F.col("n") * q).alias("extra_expected"), (F.col("n") * q - extra_half).alias("extra_low"), (F.col("n") * q + extra_half).alias("extra_high"),
        F.when(F.col("n") > 0, (F.col("hits") - F.col("n") * mean) / F.sqrt(F.col("n") * var)).alias("z"), *more,
    )


def replay(features: DataFrame, draws: DataFrame, done: DataFrame, start: str, spec: GameSpec = SPEC, model: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Where each result from ``start`` on would have stood: refitted before every draw on all draws before it.

    (juego, n_sorteo, fecha, resultado, superbalota, sorteos_entrenamiento, puntaje_resultado, percentil_resultado); draws
    in ``done`` (juego, n_sorteo) are left out, so a run only adds what is new.
    """
    from drawspark.operators.models import walk_forward_logistic

    each = dataclasses.replace(spec, refit_every=1)
    rows = H.indexed(draws).select("juego", "t", "n_sorteo", "fecha", "balls", "superbalota").where((F.col("fecha") >= F.lit(start).cast("date")) & (F.col("t") >= spec.first_test))
    rows = rows.join(done.select("juego", "n_sorteo"), ["juego", "n_sorteo"], "left_anti")
    first = rows.groupBy("juego").agg(F.min("t").alias("first"))
    floor = first.agg(F.min("first")).first()[0]
    if floor is None:
        return rows.select("juego", "n_sorteo", "fecha", format_combination(F.col("balls")).alias("resultado"), "superbalota", F.lit(0).cast("long").alias("sorteos_entrenamiento"), F.lit(0.0).alias("puntaje_resultado"), F.lit(0.0).alias("percentil_resultado")).limit(0)
    each = dataclasses.replace(each, min_train=floor - spec.warmup)  # fits begin with the first draw that is wanted
    forecast = (model or walk_forward_logistic)(features, each)
    plays = M.score_arrays(forecast.join(rows.select("juego", "t"), ["juego", "t"], "left_semi"), ["juego", "t"], spec).join(rows, ["juego", "t"])
    found = M.play_percentile(plays.repartition(64, "juego", "t"), ["juego", "t"], spec)
    return rows.join(found, ["juego", "t"]).select(
        "juego", "n_sorteo", "fecha", format_combination(F.col("balls")).alias("resultado"), "superbalota", (F.col("t") - spec.warmup).alias("sorteos_entrenamiento"),
        F.bround("score", 6).alias("puntaje_resultado"), F.bround("percentile", 2).alias("percentil_resultado"),
    )


def append_only_violations(old: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """Positions of old rows that are gone or differ; new rows and new columns at the right are allowed."""
    if new.columns[: len(old.columns)] != old.columns:
        raise ValueError("columns were reordered or removed")
    values = [c for c in old.columns if c != position]
    same = F.lit(True)
    for c in values:
        same &= F.col(c).eqNullSafe(F.col(f"new_{c}"))
    right = new.select(F.col(position).alias("at"), F.lit(True).alias("there"), *[F.col(c).alias(f"new_{c}") for c in values])
    return old.join(right, old[position] == right["at"], "left").where(F.col("there").isNull() | ~same).select(position)
