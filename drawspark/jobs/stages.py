"""The stages of a run, each from files to files, and the rule that chains them.

Nothing is done where nothing is new: models are fitted again only if the validated draws of a game have changed.
"""

from __future__ import annotations

import logging
import os
import platform
import shutil
import subprocess
from dataclasses import dataclass, field

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawspark.jobs.config import Config, Paths
from drawspark.jobs.registry import METADATA, MODEL, Registry, code_digest, version_id
from drawspark.operators import controls, evaluation, history, live, models, significance, validation
from drawspark.operators.calendar import calendar, next_days
from drawspark.sources import draws as D
from drawspark.sources import store
from drawspark.sources.web import WebError, WebSource

log = logging.getLogger(__name__)
PREDICTIONS = "prediccion_id string, creada_utc string, juego string, n_sorteo long, fecha_sorteo date, hora_limite_utc string, modelo_version string, modelo string, combinacion string, superbalota_sugerida int, p_balls array<double>, p_sb array<double>"
RESULTS = "prediccion_id string, conciliada_utc string, juego string, n_sorteo long, fecha_sorteo date, fecha_real date, modelo_version string, combinacion string, resultado string, superbalota_sugerida int, superbalota_real int, aciertos int, acierto_superbalota int, aciertos_esperados double, log_loss_balotas double, log_loss_constante double, log_loss_superbalota double, log_loss_superbalota_constante double"
SCORED = RESULTS + ", puntaje_resultado double, percentil_resultado double"
REPLAY = "juego string, n_sorteo long, fecha date, resultado string, superbalota int, sorteos_entrenamiento long, puntaje_resultado double, percentil_resultado double"


def with_balls(draws: DataFrame) -> DataFrame:
    return draws.withColumn("balls", F.array(*D.BALLS))


def known_last(draws: DataFrame) -> dict[str, int]:
    return {r["juego"]: r["last"] for r in draws.groupBy("juego").agg(F.max("n_sorteo").alias("last")).collect()}


@dataclass
class Run:
    """A session, a root and a configuration; ``now`` is an ISO time in UTC."""

    spark: SparkSession
    paths: Paths
    config: Config = field(default_factory=Config)
    web: WebSource | None = None

    def draws(self) -> DataFrame:
        return D.read_draws(self.spark, self.paths.draws)

    def game(self, game: str) -> DataFrame:
        return with_balls(self.draws().where(F.col("juego") == game))

    def games(self) -> list[str]:
        present = {r["juego"] for r in self.draws().select("juego").distinct().collect()}
        return [g for g in self.config.spec.games if g in present]

    def calendar(self) -> DataFrame:
        return calendar(self.spark, self.config.calendar)

    def digest(self, game: str) -> str:
        return store.content_digest(self.draws().where(F.col("juego") == game), D.KEY)

    # --- ingest and validate

    def local(self) -> tuple[DataFrame, DataFrame]:
        """(distinct rows of all local sources, their contradictions)."""
        files = {g: self.paths.raw(g) for g in self.config.spec.games}
        collected = D.concat_draws(D.raw_histories(self.spark, files), D.incoming(self.spark, self.paths.incoming)).dropDuplicates(D.COLUMNS)
        return collected, validation.source_conflicts(collected)

    def scrape(self) -> str | None:
        """New draws of the web as an incoming file, written only if they pass with the history."""
        collected, bad = self.local()
        local = D.concat_draws(collected, self.draws()).dropDuplicates(D.COLUMNS)
        fetched = self.web.fetch(self.spark, known_last(local))
        if fetched.isEmpty():
            return None
        validation.checked(D.concat_draws(local, fetched), self.calendar(), self.config.spec, bad.unionByName(validation.conflicts(local, fetched)))
        return store.write_incoming(fetched, self.paths.incoming, "web")

    def ingest(self) -> int:
        """The draws that are not processed yet, as the interim file; an error if sources or history contradict."""
        if not self.config.ingest:
            store.write_draws(D.empty_draws(self.spark), self.paths.new_draws)
            return 0
        if self.config.web and self.web:
            try:
                self.scrape()
            except WebError as e:
                log.warning("no results from the web: %s", e)
        known, (collected, bad) = self.draws(), self.local()
        issues = bad.unionByName(validation.conflicts(known, collected))
        found = [r.asDict() | {"n_affected": 1, "n_sorteos": [r["n_sorteo"]]} for r in issues.limit(20).collect()]
        if found:
            raise validation.ValidationError(found)
        new = validation.split_new(known, collected)
        store.write_draws(new, self.paths.new_draws)
        return new.count()

    def validate(self) -> list:
        """History and new draws checked together; the report is always written, the history only if there is no error."""
        known, new = self.draws(), D.read_draws(self.spark, self.paths.new_draws)
        combined = D.concat_draws(known, new)
        rows = validation.checked(combined, self.calendar(), self.config.spec, validation.conflicts(known, new), must=False)
        ok = not any(r["level"] == "error" for r in rows)
        store.write_json({"ok": ok, "n_errores": sum(r["level"] == "error" for r in rows), "n_avisos": sum(r["level"] != "error" for r in rows), "problemas": rows}, self.paths.report("validation.json"))
        if not ok:
            raise validation.ValidationError(rows)
        if not new.isEmpty():
            store.write_draws(combined, self.paths.draws)
        if os.path.exists(self.paths.new_draws):
            os.remove(self.paths.new_draws)
        return rows

    # --- features and models

    def features(self, game: str) -> DataFrame:
        rows = self.game(game)
        return history.features(history.membership(rows, self.config.spec, next_days(rows, self.calendar())), self.config.spec)

    def build_features(self, game: str) -> str:
        self.features(game).coalesce(1).write.mode("overwrite").parquet(self.paths.features(game))
        return self.paths.features(game)

    def needs_training(self, game: str) -> bool:
        known = Registry(self.paths.models).metadata(game)
        return known is None or known["datos"]["hash"] != self.digest(game)

    def train(self, game: str) -> str:
        """Fit the production model on the whole history, from features that are those of the present draws."""
        if not os.path.exists(self.paths.features(game)):
            self.build_features(game)
        stored, order = self.spark.read.parquet(self.paths.features(game)), ["drum", "t", "num"]
        digest = store.content_digest(stored, order)
        if digest != store.content_digest(self.features(game), order):
            raise RuntimeError(f"{game}: the stored features are not those of the present draws")
        staging = self.paths.staging(game)
        models.fit_final(stored, self.config.spec).coalesce(1).write.mode("overwrite").parquet(os.path.join(staging, MODEL))
        store.write_json(self._metadata(game, digest), os.path.join(staging, METADATA))
        return staging

    def _metadata(self, game: str, features_digest: str) -> dict:
        ends = self.game(game).agg(F.min("fecha"), F.max("fecha"), F.min("n_sorteo"), F.max("n_sorteo"), F.count("*")).first()
        data, code, spec = self.digest(game), code_digest(), self.config.spec
        settings = {"logistica": {"C": 1.0}}
        inputs = {"datos": data, "codigo": code, "hiperparametros": settings, "warmup": spec.warmup, "semilla": spec.seed}
        try:
            commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=self.paths.root, capture_output=True, text=True).stdout.strip() or None
        except OSError:
            commit = None
        return {
            "version": version_id(str(ends[1]), inputs), "juego": game, "modelo_produccion": models.PRODUCTION, "modelos": [models.PRODUCTION],
            "datos": {"hash": data, "n_sorteos": ends[4], "primer_sorteo": ends[2], "ultimo_sorteo": ends[3], "fecha_inicio": str(ends[0]), "fecha_fin": str(ends[1])},
            "entrenamiento": {"n_objetivo": ends[4] - spec.warmup, "warmup": spec.warmup, "semilla": spec.seed, "hiperparametros": settings},
            "features": {"por_numero": models.NUMERIC, "compartidas": models.DAYS, "hash": features_digest},
            "codigo": {"hash": code, "git_commit": commit}, "entorno": {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__},
        }

    def evaluate(self) -> dict:
        """Walk-forward of every model over all games, and the checks of the draws, as one report a game."""
        spec, out = self.config.spec, {}
        rows = with_balls(self.draws())
        members = history.membership(rows, spec).where(F.col("y").isNotNull())
        tested = F.col("t") >= spec.first_test
        forecasts = {
            "constante": history.constant_baseline(members, spec).where(tested), "frecuencia": history.frequency_baseline(members, spec=spec).where(tested),
            "logistica": models.walk_forward_logistic(history.features(members, spec), spec),
        }
        for name, forecast in forecasts.items():
            forecast = forecast.select("juego", "drum", "t", "num", "y", "p").cache()
            for r in evaluation.summary(evaluation.draw_scores(forecast, spec), spec).collect():
                out.setdefault(r["juego"], {"modelos": {}})["modelos"][name] = r.asDict()
            for r in significance.outcome_significance(forecast, self.config.n_sims, spec).collect():
                out[r["juego"]]["modelos"][name].setdefault("significancia", {})[r["metric"]] = r.asDict()
        last = known_last(self.draws())
        for game, report in out.items():
            report["ultimo_sorteo_prueba"] = last[game]
            store.write_json(report, self.paths.report("evaluation", f"{game}.json"))
        placed = significance.uniformity_nulls(rows, self.config.n_sims, spec).collect()
        store.write_json({"uniformidad": [r.asDict() for r in placed]}, self.paths.report("analysis.json"))
        return out

    def significance(self, runs: dict[str, int]) -> list:
        """The logistic model's metrics among those of resampled histories, and the positive control."""
        rows, spec = with_balls(self.draws()), self.config.spec
        model = lambda m: models.walk_forward_logistic(history.features(m, spec), spec)
        found = significance.resampling_significance(rows, model, runs, spec).collect()
        store.write_json([r.asDict() for r in found], self.paths.report("significance", "resampling.json"))
        frequency = lambda m: history.frequency_baseline(m, spec=spec).where(F.col("t") >= spec.first_test)
        control = controls.positive_control(rows.where(F.col("juego") == self.games()[0]), {"frecuencia": frequency, "logistica": model}, spec=spec).collect()
        store.write_json([r.asDict() for r in control], self.paths.report("significance", "controles.json"))
        return found

    def register(self, game: str) -> str:
        staging, registry = self.paths.staging(game), Registry(self.paths.models)
        metadata, path = store.read_json(os.path.join(staging, METADATA)), self.paths.report("evaluation", f"{game}.json")
        if os.path.exists(path):
            report = store.read_json(path)
            if report["ultimo_sorteo_prueba"] == metadata["datos"]["ultimo_sorteo"]:
                metadata["metricas_walk_forward"] = {n: {k: m.get(k) for k in ("hits", "skill_log_loss_balls", "accuracy_sb")} for n, m in report["modelos"].items()}
        version = registry.register(staging, metadata)
        registry.prune(game, self.config.keep_versions)
        shutil.rmtree(staging)
        return version

    # --- live

    def next_forecast(self, game: str) -> tuple[DataFrame, DataFrame, dict, bool]:
        """(chances of the next draw, the draw, the model's metadata, whether it was fitted on the present draws)."""
        model, metadata = Registry(self.paths.models).load(self.spark, game)
        rows = self.game(game)
        to_come = history.indexed(rows).groupBy("juego").agg((F.max("t") + 1).alias("t"), (F.max("n_sorteo") + 1).alias("n_sorteo")).join(next_days(rows, self.calendar()), "juego")
        chances = models.forecast(self.features(game).where(F.col("y").isNull()), model)
        return chances, to_come, metadata, metadata["datos"]["hash"] == self.digest(game)

    def predict_next(self, game: str, now: str | None = None) -> int:
        """Log the next draw's forecast if a model is in force and up to date, in time, and there is none yet."""
        try:
            chances, to_come, metadata, fresh = self.next_forecast(game)
        except FileNotFoundError:
            return 0
        if not fresh:
            return 0
        moment = F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'") if now else F.current_timestamp()
        new = live.predictions(chances, to_come, moment, F.lit(metadata["version"]), metadata["modelo_produccion"], self.config.spec)
        return store.append_rows(live.admitted(new, store.read_log(self.spark, self.paths.predictions, PREDICTIONS)), self.paths.predictions)

    def upgrade_results(self) -> int:
        """Complete an older results log by the two score columns, from the chances that were logged before the draws."""
        if not os.path.exists(self.paths.results):
            return 0
        with open(self.paths.results, encoding="utf-8") as f:
            header = f.readline().strip().split(",")
        if header != live.RESULT_COLUMNS:
            return 0
        old = store.read_log(self.spark, self.paths.results, RESULTS)
        scored = {r["prediccion_id"]: [r[c] for c in live.SCORE_COLUMNS] for r in live.with_scores(old, store.read_log(self.spark, self.paths.predictions, PREDICTIONS), self.config.spec).collect()}
        ids = [r["prediccion_id"] for r in old.select("prediccion_id").coalesce(1).collect()]
        store.add_columns(self.paths.results, live.SCORE_COLUMNS, [scored[i] for i in ids])
        return len(ids)

    def reconcile(self, now: str | None = None) -> int:
        self.upgrade_results()
        logged = store.read_log(self.spark, self.paths.predictions, PREDICTIONS)
        done = store.read_log(self.spark, self.paths.results, SCORED)
        moment = F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss'Z'") if now else None
        rows = live.with_scores(live.reconcile(logged, done, with_balls(self.draws()), moment, self.config.spec), logged, self.config.spec)
        added = store.append_rows(rows.orderBy("juego", "n_sorteo"), self.paths.results)
        results = store.read_log(self.spark, self.paths.results, SCORED)
        store.write_json({r["juego"]: r.asDict() for r in live.live_summary(results, self.config.spec, logged).collect()}, self.paths.report("live_summary.json"))
        return added

    def replay(self) -> int:
        done = store.read_log(self.spark, self.paths.replay, REPLAY)
        rows = with_balls(self.draws())
        spec = self.config.spec
        new = live.replay(history.features(history.membership(rows, spec), spec), rows, done, self.config.replay_start, spec)
        return store.append_rows(new.orderBy("juego", "n_sorteo"), self.paths.replay)


@dataclass
class Result:
    new: int = 0
    trained: dict[str, str] = field(default_factory=dict)
    predicted: int = 0
    reconciled: int = 0
    replayed: int = 0

    @property
    def nothing_to_do(self) -> bool:
        return not self.trained


def pipeline(run: Run, force: bool = False, now: str | None = None) -> Result:
    """Ingest, validate, and, only for games whose draws changed, features, fits, evaluation and registration; then
    predictions, results and replay for every game."""
    out = Result(new=run.ingest())
    run.validate()
    present = run.games()
    pending = [g for g in present if force or run.needs_training(g)]
    if not pending:
        return out
    for game in pending:
        run.build_features(game)
        run.train(game)
    run.evaluate()
    out.trained = {game: run.register(game) for game in pending}
    out.predicted = sum(run.predict_next(game, now) for game in present)
    out.reconciled, out.replayed = run.reconcile(now), run.replay()
    return out


def summary_text(result: Result) -> str:
    """What a run did, as Markdown."""
    rows = [("new draws", result.new), *[(f"model of {g}", v) for g, v in sorted(result.trained.items())], ("predictions", result.predicted), ("results", result.reconciled), ("replayed", result.replayed)]
    return "\n".join(["| step | result |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in rows]]) + "\n"
