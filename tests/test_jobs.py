"""Whole runs on a small history: ingest to replay, reruns, new draws, refusals."""

import dataclasses
import datetime
import os

import pytest

from drawspark.functions.game import SPEC
from drawspark.jobs import cli
from drawspark.jobs.config import Config, Paths, flag
from drawspark.jobs.registry import Registry, code_digest, version_id
from drawspark.jobs.stages import PREDICTIONS, Run, pipeline, summary_text
from drawspark.operators import calendar as C
from drawspark.operators import live as L
from drawspark.operators import montecarlo as M
from drawspark.operators import validation as V
from drawspark.sources import draws as D
from drawspark.sources import store

SMALL = dataclasses.replace(SPEC, warmup=10, min_train=30, refit_every=10)
CONFIG = Config(spec=SMALL, n_sims=60, replay_start="2025-09-01")


def _history(spark, run, n):
    days = C.draw_days(spark, "2025-05-03", n, run.calendar())
    rows = M.sampled_draws(days.selectExpr("k + 1000 AS n_sorteo", "fecha", "explode(array('baloto', 'revancha')) AS juego"), by=("juego", "n_sorteo"))
    return rows.select("fecha", "n_sorteo", "juego", *[rows["balls"][k].cast("int").alias(f"b{k + 1}") for k in range(5)], rows["superbalota"].cast("int").alias("superbalota"))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = Run(spark, Paths(str(tmp_path_factory.mktemp("run"))), CONFIG)
    store.write_incoming(_history(spark, out, 45), out.paths.incoming, "hand")
    return out


@pytest.fixture(scope="module")
def first(run):
    return pipeline(run, now="2025-08-14T00:00:00Z")


def _state(run):
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(run.paths.root) for f in files if "features" not in d}


def test_first_run(run, first):
    assert first.new == 90 and sorted(first.trained) == ["baloto", "revancha"] and first.predicted == 2 and first.reconciled == 0
    assert not first.nothing_to_do and "| new draws | 90 |" in summary_text(first)
    assert run.draws().count() == 90 and not os.path.exists(run.paths.new_draws)
    report = store.read_json(run.paths.report("evaluation", "baloto.json"))
    assert set(report["modelos"]) == {"constante", "frecuencia", "logistica"} and report["modelos"]["constante"]["skill_log_loss_balls"] == 0
    assert set(report["modelos"]["logistica"]["significancia"]) == {"hits", "log_loss_balls", "accuracy_sb", "log_loss_sb"}
    logged = store.read_log(run.spark, run.paths.predictions, PREDICTIONS).collect()
    assert {r["n_sorteo"] for r in logged} == {1045} and all(abs(sum(r["p_sb"]) - 1) < 1e-4 and len(r["p_balls"]) == 43 for r in logged)


def test_second_run_touches_nothing(run, first):
    before = _state(run)
    again = pipeline(run, now="2025-08-14T00:00:00Z")
    assert again.nothing_to_do and again.new == 0
    after = _state(run)
    assert {k for k in before if before[k] != after.get(k)} <= {run.paths.report("validation.json")}


def test_new_draws_start_everything_again(run, first):
    old = open(run.paths.predictions).read()
    store.write_incoming(_history(run.spark, run, 47).where("n_sorteo >= 1045"), run.paths.incoming, "hand")
    result = pipeline(run, now="2025-08-18T12:00:00Z")
    assert result.new == 4 and len(result.trained) == 2 and result.reconciled == 2
    assert store.only_grew(old, open(run.paths.predictions).read())
    rows = run.spark.read.option("header", True).csv(run.paths.results).collect()
    assert {r["n_sorteo"] for r in rows} == {"1045"} and all(0 <= float(r["percentil_resultado"]) <= 100 for r in rows)
    assert set(store.read_json(run.paths.report("live_summary.json"))) == set(SPEC.games)
    assert len(Registry(run.paths.models).versions("baloto")) == 2
    # an older log without the two last columns is completed, its own cells stay
    lines = [line.rsplit(",", 2)[0] for line in open(run.paths.results).read().splitlines()]
    whole = open(run.paths.results).read()
    open(run.paths.results, "w").write("\n".join(lines) + "\n")
    assert run.upgrade_results() == 2 and run.upgrade_results() == 0
    assert open(run.paths.results).read() == whole


def test_late_or_stale_predictions_are_refused(run, first):
    assert run.predict_next("baloto", "2099-01-01T00:00:00Z") == 0
    assert Run(run.spark, Paths(run.paths.root + "/none"), CONFIG).predict_next("baloto") == 0


def test_replay_adds_only_what_is_new(run, first):
    early = dataclasses.replace(CONFIG, replay_start="2025-08-01")
    other = Run(run.spark, run.paths, early)
    added = other.replay()
    rows = run.spark.read.option("header", True).csv(run.paths.replay).collect()
    assert added == len(rows) > 0 and other.replay() == 0
    assert all(int(r["sorteos_entrenamiento"]) == int(r["n_sorteo"]) - 1000 - 10 for r in rows)


def test_conflicts_stop_a_run(run, first, tmp_path):
    changed = run.draws().where("n_sorteo = 1003").withColumn("superbalota", D.F.col("superbalota") % 16 + 1)
    file = store.write_incoming(changed, run.paths.incoming, "bad")
    try:
        with pytest.raises(V.ValidationError):
            run.ingest()
        assert cli.main(["--root", run.paths.root, "ingest"], run) == 1
    finally:
        os.remove(file)
    assert cli.main(["--root", run.paths.root, "ingest"], run) == 0


def test_errors_keep_the_history(run, first):
    before = open(run.paths.draws).read()
    last = run.draws().agg({"n_sorteo": "max"}).first()[0]
    store.write_draws(run.draws().where(f"n_sorteo = {last}").withColumn("n_sorteo", D.F.col("n_sorteo") + 5), run.paths.new_draws)
    with pytest.raises(V.ValidationError, match="saltos"):
        run.validate()
    assert open(run.paths.draws).read() == before and os.path.exists(run.paths.new_draws)
    assert not store.read_json(run.paths.report("validation.json"))["ok"]
    os.remove(run.paths.new_draws)


def test_stale_features_are_refused(run, first):
    run.spark.createDataFrame([("baloto", "balls", 1, 1)], "juego string, drum string, t long, num int").write.mode("overwrite").parquet(run.paths.features("baloto"))
    with pytest.raises(RuntimeError, match="stored features"):
        run.train("baloto")
    run.build_features("baloto")


def test_registry(tmp_path, spark):
    registry = Registry(str(tmp_path / "m"))
    assert registry.latest("g") is None and registry.versions("g") == []
    staging = str(tmp_path / "s")
    spark.range(1).write.parquet(os.path.join(staging, "model"))
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        registry.register(staging, {"juego": "g", "version": version_id(day, {"x": 1}), "k": day})
    assert len(registry.versions("g")) == 3 and registry.latest("g").startswith("2026-01-03_")
    registry.register(staging, {"juego": "g", "version": version_id("2026-01-01", {"x": 1}), "k": "other"})
    assert registry.metadata("g")["k"] == "2026-01-01"  # the version stays, only the pointer moves
    assert registry.prune("g", 1) == [version_id("2026-01-02", {"x": 1}), version_id("2026-01-03", {"x": 1})] and registry.versions("g") == [registry.latest("g")]
    model, meta = registry.load(spark, "g")
    assert model.count() == 1 and meta["juego"] == "g"
    with pytest.raises(FileNotFoundError):
        registry.load(spark, "h")
    assert version_id("d", {"a": 1, "b": 2}) == version_id("d", {"b": 2, "a": 1}) and len(code_digest()) == 64


def test_settings():
    assert [flag(x, True) for x in (None, " ", "no", "0", "SÍ", "on", "True")] == [True, True, False, False, True, True, True]
    assert Config.from_env({"INGEST_ENABLED": "false", "KEEP_MODEL_VERSIONS": "3"}).keep_versions == 3
    assert cli.parser().parse_args(["pipeline", "--force"]).force


def test_calendar(spark):
    segments = C.calendar(spark, [("2017-01-01", "2025-06-02", [2, 5]), ("2025-06-02", "9999-12-31", [0, 2, 5])])
    days = spark.createDataFrame([(datetime.date.fromisoformat(x),) for x in ("2025-05-28", "2025-05-31", "2026-09-26")], "fecha date")
    assert [str(r["next_date"]) for r in C.following(days, segments).orderBy("fecha").collect()] == ["2025-05-31", "2025-06-02", "2026-09-28"]
    with pytest.raises(Exception, match="no draw"):
        C.following(spark.createDataFrame([(datetime.date(2016, 1, 1),)], "fecha date"), segments).collect()
    with pytest.raises(ValueError):
        C.calendar(spark, [])


def test_deadline_is_kept(spark):
    rows = spark.createDataFrame([("a", "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z"), ("b", "2026-01-01T01:00:00Z", "2026-01-01T01:00:00Z"), ("c", "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z")], "prediccion_id string, creada_utc string, hora_limite_utc string")
    logged = spark.createDataFrame([("c",)], "prediccion_id string")
    assert [r["prediccion_id"] for r in L.admitted(rows, logged).collect()] == ["a"]
