"""Further queries over the draw view: places in nulls, strategies, plays, the live side, controls and fits."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC
from drawspark.functions.text import format_es
from drawspark.operators import calendar as C
from drawspark.operators import controls, models, montecarlo, significance
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.operators import live as L
from drawspark.sources import draws as D

from .lottery import SCORES, UNIFORM, _daily, _forecast, _members, _predictions, _scores, calendar, query

#: Controls refit ten times less often than the live model: they ask whether a signal is found, not how fast.
CONTROL = dataclasses.replace(SPEC, refit_every=100)
WINDOWS = list(range(5, 205, 5))

# --- scalar functions


@query("SELECT juego, n_sorteo, (isodow(fecha) - 1)::INTEGER AS weekday, NULL::INTEGER AS none FROM d")
def weekday_from_name(s, d):
    name = F.upper(F.element_at(F.array(*map(F.lit, D.WEEKDAYS)), F.weekday("fecha") + 1))
    return _daily(s, d).select("juego", "n_sorteo", D.weekday_from_name(F.concat(F.lit(" "), name)).alias("weekday"), D.weekday_from_name(F.lit("feriado")).alias("none"))


@query("SELECT juego, n_sorteo, superbalota FROM d")
def decode_one_hot(s, d):
    hot = _members(s, d).where("drum = 'sb'").groupBy("juego", "n_sorteo").agg(F.sum(F.col("num") * F.col("y")).cast("int").alias("superbalota"), F.sum("y").alias("ones"))
    return hot.where("ones = 1").drop("ones")


@query("SELECT juego, n_sorteo, t FROM dt WHERE t < 100")
def first_draws(s, d):
    return H.head(_daily(s, d), 100).select("juego", "n_sorteo", "t")


@query("""SELECT (row_number() OVER (ORDER BY f) - 1)::BIGINT AS k, f::VARCHAR AS fecha FROM (SELECT (DATE '1997-12-20' + i::INTEGER) AS f FROM range(0, 800) g(i)) WHERE isodow(f) IN (3, 6) OR (isodow(f) = 1 AND f >= DATE '1998-01-01') ORDER BY f LIMIT 300""")
def draw_dates(s, d):
    return C.draw_days(s, "1997-12-20", 300, calendar(s)).select("k", F.col("fecha").cast("string").alias("fecha"))


@query("SELECT juego, n_sorteo, fecha::VARCHAR || ' 20:00' AS local FROM d")
def deadline_local(s, d):
    return _daily(s, d).select("juego", "n_sorteo", L.local_text(L.deadline_utc(F.col("fecha"))).alias("local"))


@query("""SELECT juego, n_sorteo, replace(replace(replace(format('{:,}', n_sorteo * 1237), ',', '_'), '.', ','), '_', '.') AS whole, replace(replace(replace(format('{:,.2f}', n_sorteo * 12.25::DOUBLE), ',', '_'), '.', ','), '_', '.') AS two FROM d""")
def format_numbers(s, d):
    return _daily(s, d).select("juego", "n_sorteo", format_es(F.col("n_sorteo") * 1237, 0).alias("whole"), format_es(F.col("n_sorteo") * F.lit(12.25), 2).alias("two"))


@query("SELECT juego, n_sorteo, round_even(n_sorteo / 8.0::DOUBLE, 2) AS half_even FROM d")
def round_half_even(s, d):
    return _daily(s, d).select("juego", "n_sorteo", F.bround(F.col("n_sorteo") / 8.0, 2).alias("half_even"))


# --- joins


@query("SELECT juego, n_sorteo, (t >= (SELECT max(t) - 30 FROM dt x WHERE x.juego = dt.juego)) AS live FROM dt WHERE t >= 250")
def replay_origin(s, d):
    """Which replayed draws also stand in the live log: that of the last 31 draws here."""
    rows = H.indexed(_daily(s, d)).where(F.col("t") >= SPEC.first_test)
    last = rows.groupBy("juego").agg(F.max("t").alias("last"))
    logged = rows.join(last, "juego").where("t >= last - 30").select("juego", "n_sorteo", F.lit(True).alias("live"))
    return rows.join(logged, ["juego", "n_sorteo"], "left").select("juego", "n_sorteo", F.coalesce("live", F.lit(False)).alias("live"))


@query(", x AS (SELECT juego, t, num, drum, round_even(p, 6) AS q FROM top) SELECT d.juego || '-' || d.n_sorteo AS prediccion_id, round(sum(CASE WHEN drum = 'balls' AND list_contains(d.balls, num) THEN ln(q / (5.0::DOUBLE / 43)) WHEN drum = 'sb' AND num = d.superbalota THEN ln(q * 16) ELSE 0 END), 8) AS score FROM dt d JOIN x USING (juego, t) GROUP BY ALL")
def logged_result_scores(s, d):
    """The score of every result by the chances that were logged for it: a lookup, then a sum over six labels."""
    logged = _predictions(s, d).select("prediccion_id", "juego", "n_sorteo", "p_balls", "p_sb")
    both = logged.join(_daily(s, d).select("juego", "n_sorteo", "balls", "superbalota"), ["juego", "n_sorteo"])
    balls = F.aggregate("balls", F.lit(0.0), lambda a, b: a + F.log(E.clipped(F.element_at("p_balls", b), 1.0) / SPEC.p_label))
    return both.select("prediccion_id", F.round(balls + F.log(E.clipped(F.element_at("p_sb", F.col("superbalota")), 1.0) / SPEC.p_extra), 8).alias("score"))


@query("SELECT d.fecha::VARCHAR AS fecha, d.n_sorteo, d.juego, list_sort(list_transform(x.balls, lambda b: b::INTEGER))[1] AS lowest, x.superbalota FROM d JOIN (SELECT juego, n_sorteo, list(num ORDER BY num) FILTER (WHERE drum = 'balls') AS balls, max(num) FILTER (WHERE drum = 'sb')::INTEGER AS superbalota FROM (SELECT d.juego, d.n_sorteo, 'balls' AS drum, num::INTEGER AS num, row_number() OVER (PARTITION BY d.juego, n_sorteo ORDER BY md5('42:balls:0:' || d.juego || ':' || n_sorteo || ':' || num)) AS r FROM d, range(1, 44) g(num) UNION ALL SELECT d.juego, d.n_sorteo, 'sb', num::INTEGER, row_number() OVER (PARTITION BY d.juego, n_sorteo ORDER BY md5('42:sb:0:' || d.juego || ':' || n_sorteo || ':' || num)) FROM d, range(1, 17) g(num)) WHERE (drum = 'balls' AND r <= 5) OR (drum = 'sb' AND r = 1) GROUP BY juego, n_sorteo) x ON x.juego = d.juego AND x.n_sorteo = d.n_sorteo")
def synthetic_draws(s, d):
    """Fair draws on the same dates."""
    rows = montecarlo.resampled(_daily(s, d), "sintetico", 1)
    return rows.select(F.col("fecha").cast("string").alias("fecha"), "n_sorteo", "juego", F.col("balls")[0].cast("int").alias("lowest"), F.col("superbalota").cast("int").alias("superbalota"))


@query(""", days AS (SELECT (row_number() OVER (ORDER BY f) - 1)::BIGINT AS k, f FROM (SELECT (DATE '2001-01-03' + i::INTEGER) AS f FROM range(0, 300) g(i)) WHERE isodow(f) IN (1, 3, 6) ORDER BY f LIMIT 60)
SELECT g AS juego, k + 1 AS n_sorteo, f::VARCHAR AS fecha, array_to_string(list_sort((list(num ORDER BY md5('42:balls:' || g || ':' || (k + 1) || ':' || num)))[1:5]), '-') AS balls FROM days, (VALUES ('baloto'), ('revancha')) x(g), range(1, 44) n(num) GROUP BY g, k, f""")
def synthetic_history(s, d):
    """Fair draws of both games over the calendar's next sixty days."""
    days = C.draw_days(s, "2001-01-03", 60, calendar(s)).select((F.col("k") + 1).alias("n_sorteo"), "fecha")
    grid = days.withColumn("juego", F.explode(F.array(*map(F.lit, SPEC.games))))
    return montecarlo.sampled_draws(grid, by=("juego", "n_sorteo")).select("juego", "n_sorteo", F.col("fecha").cast("string").alias("fecha"), F.array_join("balls", "-").alias("balls"))


# --- aggregations and shapes


@query(", e AS (SELECT juego, drum, min(p) AS low, (max(p) - min(p)) / 40 AS w FROM fb GROUP BY juego, drum) SELECT juego, drum, CASE WHEN w > 0 THEN least(floor(round((p - low) / w, 9)), 39) ELSE 0 END::INTEGER AS bin, count(*) AS n FROM fb JOIN e USING (juego, drum) GROUP BY ALL")
def score_histogram(s, d):
    return E.histogram(H.frequency_baseline(_members(s, d)), "p", ["juego", "drum"])


@query("SELECT juego, drum, t, num FROM top WHERE r <= CASE drum WHEN 'balls' THEN 5 ELSE 1 END")
def top_k(s, d):
    most = F.when(F.col("drum") == "balls", SPEC.drawn).otherwise(1)
    return E.ranked(_forecast(s, d), F.col("p")).where(F.col("r") <= most).select("juego", "drum", "t", "num")


@query("SELECT juego, (isodow(fecha) - 1)::INTEGER AS weekday, count(*) FILTER (WHERE superbalota <= 4) AS c1, count(*) FILTER (WHERE superbalota BETWEEN 5 AND 8) AS c2, count(*) FILTER (WHERE superbalota BETWEEN 9 AND 12) AS c3, count(*) FILTER (WHERE superbalota > 12) AS c4 FROM d GROUP BY ALL")
def pivot_counts(s, d):
    rows = _daily(s, d).select("juego", F.weekday("fecha").alias("weekday"), F.concat(F.lit("c"), F.ceil(F.col("superbalota") / 4).cast("string")).alias("c"))
    return rows.groupBy("juego", "weekday").pivot("c", ["c1", "c2", "c3", "c4"]).agg(F.count(F.lit(1))).na.fill(0)


@query(SCORES + "SELECT juego, t, metric, round(value, 9) AS value FROM (SELECT juego, t, log_loss_balls, brier_balls, hits::DOUBLE AS hits FROM s) UNPIVOT (value FOR metric IN (log_loss_balls, brier_balls, hits))")
def unpivot_series(s, d):
    rows = _scores(s, d).select("juego", "t", "log_loss_balls", "brier_balls", F.col("hits").cast("double").alias("hits"))
    return rows.unpivot(["juego", "t"], ["log_loss_balls", "brier_balls", "hits"], "metric", "value").withColumn("value", F.round("value", 9))


@query("SELECT juego, n_sorteo, (row_number() OVER (PARTITION BY juego ORDER BY n_sorteo DESC))::INTEGER AS place FROM d")
def newest_first(s, d):
    return _daily(s, d).select("juego", "n_sorteo", F.row_number().over(Window.partitionBy("juego").orderBy(F.desc("n_sorteo"))).alias("place"))


@query(SCORES + "SELECT juego, 'balotas' AS part, k AS metric, round(v, 8) AS value FROM (SELECT juego, unnest(['brier', 'log_loss']) AS k, unnest([avg(brier_balls), avg(log_loss_balls)]) AS v FROM s GROUP BY juego) UNION ALL SELECT juego, 'superbalota', k, round(v, 8) FROM (SELECT juego, unnest(['brier', 'log_loss']) AS k, unnest([avg(brier_sb), avg(log_loss_sb)]) AS v FROM s GROUP BY juego)")
def flatten_report(s, d):
    """A nested report (part, metric) as rows."""
    g = E.summary(_scores(s, d))
    part = lambda x: F.create_map(F.lit("brier"), F.col(f"brier_{x}"), F.lit("log_loss"), F.col(f"log_loss_{x}"))
    nested = g.select("juego", F.create_map(F.lit("balotas"), part("balls"), F.lit("superbalota"), part("sb")).alias("report"))
    each = nested.select("juego", F.explode("report").alias("part", "metrics"))
    return each.select("juego", "part", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 8))


@query("SELECT juego AS model, (n_sorteo % 3)::INTEGER AS effect, count(*) AS n_seeds, round(avg(superbalota), 9) AS hits, round(avg(balls[1]), 9) AS skill_log_loss_balls FROM d GROUP BY ALL")
def mean_over_seeds(s, d):
    rows = _daily(s, d).select(F.col("juego").alias("model"), (F.col("n_sorteo") % 3).cast("int").alias("effect"), F.col("superbalota").alias("hits"), F.col("b1").alias("skill_log_loss_balls"))
    out = controls.mean_over_seeds(rows, ["model", "effect"])
    return out.select("model", "effect", "n_seeds", F.round("hits", 9).alias("hits"), F.round("skill_log_loss_balls", 9).alias("skill_log_loss_balls"))


# --- features and forecasts


@query("SELECT p.juego, p.drum, p.t, p.num, round((past - coalesce(lag(past, 10) OVER o, 0)) / greatest(least(t, 10), 1)::DOUBLE, 9) AS freq_10, (isodow(fecha) = 1)::INTEGER AS lunes FROM past p WINDOW o AS (PARTITION BY juego, drum, num ORDER BY t)")
def long_design(s, d):
    """A row a draw and label, the label itself no feature."""
    f = H.features(_members(s, d))
    return f.select("juego", "drum", "t", "num", F.round("freq_10", 9).alias("freq_10"), F.col("dia_lunes").cast("int").alias("lunes"))


@query(""", f AS (SELECT juego, drum, t, num, (past - coalesce(lag(past, 10) OVER o, 0)) / greatest(least(t, 10), 1)::DOUBLE AS freq_10,
  ln(1 + least(t - coalesce(max(CASE WHEN y = 1 THEN t END) OVER (PARTITION BY juego, drum, num ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), 100)) AS gap FROM past WINDOW o AS (PARTITION BY juego, drum, num ORDER BY t)),
b AS (SELECT juego, t AS start FROM dt WHERE t >= 250 AND (t - 250) % 100 = 0)
SELECT f.juego, drum, num, start, count(*) AS n, round(avg(freq_10), 9) AS freq_10_mean, round(avg(gap), 9) AS gap_mean, round(CASE WHEN stddev_pop(gap) > 1e-9 THEN stddev_pop(gap) ELSE 1 END, 7) AS gap_scale FROM f JOIN b ON f.juego = b.juego AND f.t >= 100 AND f.t < start GROUP BY f.juego, drum, num, start""")
def scaler_statistics(s, d):
    starts = H.indexed(_daily(s, d)).where("t >= 250 AND (t - 250) % 100 = 0").select("juego", F.col("t").alias("start"))
    rows = H.scaler_statistics(H.features(_members(s, d)), starts, ["freq_10", "gap"])
    return rows.select("juego", "drum", "num", "start", "n", F.round("freq_10_mean", 9).alias("freq_10_mean"), F.round("gap_mean", 9).alias("gap_mean"), F.round("gap_scale", 7).alias("gap_scale"))


@query("SELECT juego, drum, t, num, round(CASE drum WHEN 'sb' THEN x / sum(x) OVER (PARTITION BY juego, drum, t) ELSE x END, 9) AS p FROM (SELECT *, p * (1 + num / 100.0::DOUBLE) AS x FROM fb)")
def normalize_probabilities(s, d):
    rows = H.frequency_baseline(_members(s, d)).withColumn("p", F.col("p") * (1 + F.col("num") / 100.0))
    return H.normalized(rows).select("juego", "drum", "t", "num", F.round("p", 9).alias("p"))


@query("SELECT juego, t, num, round(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END, 9) AS loss FROM top WHERE drum = 'balls'")
def log_loss_balls(s, d):
    return _forecast(s, d).where("drum = 'balls'").select("juego", "t", "num", F.round(E.log_loss(F.col("y"), F.col("p")), 9).alias("loss"))


@query("SELECT juego, t, sum(y)::BIGINT AS hits FROM top WHERE drum = 'balls' AND r <= 5 GROUP BY juego, t")
def hits_at_5(s, d):
    return E.ranked(_forecast(s, d), F.col("p")).where("drum = 'balls' AND r <= 5").groupBy("juego", "t").agg(F.sum("y").alias("hits"))


@query("SELECT h::INTEGER AS hits, round([" + ", ".join(repr(p) for p in SPEC.hits_pmf()) + "][h + 1]::DOUBLE, 12) AS chance FROM range(0, 6) g(h)")
def hits_pmf(s, d):
    n, k = SPEC.labels, SPEC.drawn
    choose = lambda a, b: F.exp(F.aggregate(F.sequence(F.lit(1), b), F.lit(0.0), lambda acc, i: acc + F.log((a - b + i) / i)))
    ways = lambda a, b: F.when(b > 0, choose(a, b)).otherwise(1.0)
    h = F.col("hits")
    out = s.range(k + 1).select(F.col("id").cast("int").alias("hits"))
    return out.select("hits", F.round(ways(F.lit(k), h) * ways(F.lit(n - k), k - h) / choose(F.lit(n), F.lit(k)), 12).alias("chance"))


@query("SELECT juego, drum, t, num, round(ln(p / p0), 9) AS score FROM top")
def combination_scores(s, d):
    return montecarlo.ratios(_forecast(s, d)).select("juego", "drum", "t", "num", F.round("score", 9).alias("score"))


@query("SELECT juego, t, array_to_string(list_sort(list(lpad(num::VARCHAR, 2, '0')) FILTER (WHERE drum = 'balls' AND r <= 5)), '-') AS combinacion, (max(num) FILTER (WHERE drum = 'sb' AND r = 1))::INTEGER AS superbalota_sugerida FROM top GROUP BY juego, t")
def suggested_combination(s, d):
    return L.suggested(_forecast(s, d))


# --- places in nulls

_X2 = UNIFORM.replace("SELECT juego, max(n) AS n_draws", "SELECT juego, sum((seen - n * 5.0::DOUBLE / 43) ** 2 / (n * 5.0::DOUBLE / 43)) AS x, max(n) AS n_draws")
_EVEN = "list_sum(list_transform(range(0, 21), lambda k: exp(k * ln({x} / 2) - {x} / 2 - lgamma(k + 1))))"


@query(_X2.replace("SELECT juego, sum(", ", q AS (SELECT juego, sum(", 1) + ") SELECT juego, round(" + _EVEN.format(x="x") + ", 8) AS p_plain, round(" + _EVEN.format(x="(x * 42 / 38)") + ", 8) AS p_corrected FROM q")
def uniformity_p(s, d):
    r = E.uniformity(E.label_counts(_daily(s, d)))
    return r.select("juego", F.round(E.chi2_tail(F.col("chi2"), 42), 8).alias("p_plain"), F.round(E.chi2_tail(F.col("chi2_corrected"), 42), 8).alias("p_corrected"))


@query(""", g AS (SELECT juego, x.k, count(d2.superbalota) AS seen FROM (SELECT DISTINCT juego FROM d) CROSS JOIN range(1, 17) x(k) LEFT JOIN (SELECT juego AS j, superbalota FROM d) d2 ON d2.j = juego AND d2.superbalota = x.k GROUP BY juego, x.k),
q AS (SELECT juego, sum((seen - n / 16.0::DOUBLE) ** 2 / (n / 16.0::DOUBLE)) AS x FROM (SELECT *, sum(seen) OVER (PARTITION BY juego) AS n FROM g) GROUP BY juego)
SELECT juego, round(x, 6) AS chi2, round(1 - list_sum(list_transform(range(0, 400), lambda n: exp((7.5 + n) * ln(x / 2) - x / 2 - lgamma(8.5 + n)))), 7) AS p FROM q""")
def uniformity_super_p(s, d):
    r = significance.extra_uniformity(_daily(s, d))
    return r.select("juego", F.round("chi2", 6).alias("chi2"), F.round("p", 7).alias("p"))


def _null(s, d, side: str) -> DataFrame:
    """The balls' counts after all draws as a null, ball 7's as the observed value."""
    counts = E.label_counts(_daily(s, d)).select("juego", "num", F.col("seen").cast("double").alias("value"))
    observed = counts.where("num = 7").select("juego", F.col("value").alias("observed"))
    out = E.place_in_null(counts.drop("num"), observed, ["juego"], side)
    return out.select("juego", "observed", "n", *[F.round(c, 9).alias(c) for c in ("null_mean", "null_low", "null_high", "percentile", "p", "p_low", "p_high")], "verdict")


def _null_sql(extreme: str) -> str:
    return f""", c AS (SELECT juego, num, sum(y)::DOUBLE AS v FROM m WHERE drum = 'balls' GROUP BY juego, num), seven AS (SELECT juego, v AS o FROM c WHERE num = 7),
x AS (SELECT *, avg(v) OVER (PARTITION BY juego) AS mid FROM c JOIN seven USING (juego)),
g AS (SELECT juego, any_value(o) AS observed, count(*) AS n, avg(v) AS null_mean, quantile_cont(v, 0.025) AS null_low, quantile_cont(v, 0.975) AS null_high, 100 * avg((v <= o)::INTEGER) AS percentile, (1 + count(*) FILTER (WHERE {extreme})) / (1 + count(*))::DOUBLE AS p FROM x GROUP BY juego),
wil AS (SELECT *, (p + 3.8416 / (2 * (n + 1))) / (1 + 3.8416 / (n + 1)) AS mid, 1.96 * sqrt(p * (1 - p) / (n + 1) + 3.8416 / (4 * (n + 1) * (n + 1))) / (1 + 3.8416 / (n + 1)) AS half FROM g)
SELECT juego, observed, n, round(null_mean, 9) AS null_mean, round(null_low, 9) AS null_low, round(null_high, 9) AS null_high, round(percentile, 9) AS percentile, round(p, 9) AS p, round(greatest(mid - half, 0), 9) AS p_low, round(least(mid + half, 1), 9) AS p_high,
CASE WHEN p < 0.05 THEN 'se rechaza H0 (p < 0.05)' ELSE 'no se rechaza H0 (p >= 0.05)' END AS verdict FROM wil"""


@query(_null_sql("v >= o - 1e-12"))
def null_greater(s, d):
    return _null(s, d, "greater")


@query(_null_sql("v <= o + 1e-12"))
def null_less(s, d):
    return _null(s, d, "less")


@query(_null_sql("abs(v - mid) >= abs(o - mid) - 1e-12"))
def null_two_sided(s, d):
    return _null(s, d, "two-sided")


@query(", c AS (SELECT juego, (n_sorteo * 37 % 1000) / 10.0::DOUBLE AS x FROM d) SELECT juego, count(*) AS n, round(avg(x), 9) AS mean, round(count(*) FILTER (WHERE x / 100 >= 0.25 AND x / 100 < 0.75) / count(*)::DOUBLE, 9) AS middle_share, round(avg((x / 100 >= 0.9)::INTEGER), 9) AS from_90, array_to_string(list_transform(range(0, 10), lambda k: len(list_filter(list(x), lambda v: least(floor(round(v / 100, 12) * 10), 9) = k))), ',') AS deciles FROM c GROUP BY juego")
def percentile_summary(s, d):
    rows = _daily(s, d).select("juego", ((F.col("n_sorteo") * 37 % 1000) / 10.0).alias("x"))
    out = E.percentile_summary(rows, "x", ["juego"])
    return out.select("juego", "n", F.round("mean", 9).alias("mean"), F.round("middle_share", 9).alias("middle_share"), F.round("from_90", 9).alias("from_90"), F.array_join("deciles", ",").alias("deciles"))


_PAIRS = "FROM d l JOIN d r ON l.n_sorteo = r.n_sorteo WHERE l.juego = 'baloto' AND r.juego = 'revancha'"


@query(f""", x AS (SELECT len(list_intersect(l.balls, r.balls)) AS common, (l.superbalota = r.superbalota)::INTEGER AS same {_PAIRS}),
e AS (SELECT unnest([0, 1, 2, 3]) AS k, unnest([{', '.join(repr(p) for p in [*SPEC.hits_pmf()[:3], sum(SPEC.hits_pmf()[3:])])}]::DOUBLE[]) AS p), n AS (SELECT count(*) AS n, avg(common) AS mean, sum(same)::BIGINT AS same FROM x),
c AS (SELECT k, p, (SELECT count(*) FROM x WHERE least(common, 3) = k) AS seen FROM e)
SELECT any_value(n) AS n, round(any_value(mean), 9) AS mean_common, any_value(same) AS same_extra, round(sum((seen - n * p) ** 2 / (n * p)), 6) AS chi2 FROM c, n""")
def independence_chi2(s, d):
    g = significance.binned_chi2(significance.aligned(_daily(s, d)))
    return g.select("n", F.round("mean_common", 9).alias("mean_common"), "same_extra", F.round("chi2", 6).alias("chi2"))


@query(f""", x AS (SELECT l.n_sorteo, l.balls AS a, r.balls AS b {_PAIRS}), n AS (SELECT count(*)::DOUBLE AS n FROM x),
j AS (SELECT j, count(*) / (SELECT n FROM n) AS pj FROM (SELECT unnest(a) AS j FROM x) GROUP BY j), k AS (SELECT k, count(*) / (SELECT n FROM n) AS pk FROM (SELECT unnest(b) AS k FROM x) GROUP BY k),
jk AS (SELECT j, k, count(*) / (SELECT n FROM n) AS p FROM (SELECT unnest(a) AS j, b FROM x) y, unnest(y.b) z(k) GROUP BY j, k)
SELECT j.j::INTEGER AS j, k.k::INTEGER AS k, round((coalesce(p, 0) - pj * pk) / sqrt(pj * (1 - pj) * pk * (1 - pk)), 8) AS correlation FROM j CROSS JOIN k LEFT JOIN jk ON jk.j = j.j AND jk.k = k.k""")
def pair_correlations(s, d):
    rows = significance.pair_correlations(significance.aligned(_daily(s, d)))
    return rows.select("j", "k", F.round("correlation", 8).alias("correlation"))


# --- strategies and plays

_HOT = """, f AS (SELECT juego, t, num, y, w, past FROM past CROSS JOIN (SELECT unnest(range(5, 205, 5)) AS w) WHERE drum = 'balls'),
fr AS (SELECT a.juego, a.t, a.num, a.y, a.w, (a.past - coalesce(b.past, 0)) / greatest(least(a.t, a.w), 1)::DOUBLE AS freq FROM f a LEFT JOIN past b ON b.juego = a.juego AND b.drum = 'balls' AND b.num = a.num AND b.t = a.t - a.w WHERE a.t >= 250),
sides AS (SELECT *, 'calientes' AS kind, freq AS v FROM fr UNION ALL SELECT *, 'frios', -freq FROM fr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY juego, t, w, kind ORDER BY round(v, 12) DESC, md5('42:' || juego || ':balls:' || t || ':' || w || ':' || kind || ':' || num)) AS r FROM sides),
hits AS (SELECT juego, t, w, kind, sum(y)::BIGINT AS hits FROM ranked WHERE r <= 5 GROUP BY juego, t, w, kind)
"""


@query(_HOT.replace("range(5, 205, 5)", "range(50, 100, 50)") + "SELECT juego, t, kind, hits FROM hits")
def hot_cold_hits(s, d):
    """The most and the least frequent balls of the last fifty draws, played in every test draw."""
    return controls.strategy_hits(_members(s, d), [50]).select("juego", "t", "kind", "hits")


@query(_HOT + f""", l AS (SELECT juego, 250 + floor((max(t) + 1 - 250) / 2) AS half FROM dt GROUP BY juego),
g AS (SELECT juego, w, kind, avg(hits) FILTER (WHERE t < half) AS hits_a, avg(hits) FILTER (WHERE t >= half) AS hits_b, count(*) FILTER (WHERE t < half) AS n_a, count(*) FILTER (WHERE t >= half) AS n_b FROM hits JOIN l USING (juego) GROUP BY juego, w, kind)
SELECT juego, w::INTEGER AS w, kind, round(hits_a, 9) AS hits_a, round(hits_b, 9) AS hits_b, n_a, n_b, (row_number() OVER (PARTITION BY juego ORDER BY round(hits_a, 12) DESC, w, kind) = 1) AS best,
round(25.0::DOUBLE / 43 - 1.96 * {SPEC.hits_variance**0.5!r}::DOUBLE / sqrt(n_a), 8) AS low_a, round(25.0::DOUBLE / 43 + 1.96 * {SPEC.hits_variance**0.5!r}::DOUBLE / sqrt(n_a), 8) AS high_a FROM g""")
def selection_bias(s, d):
    """Eighty strategies: the best in the first half of the test draws, and what it does in the second."""
    rows = controls.selection_bias(_members(s, d), WINDOWS)
    return rows.select("juego", "w", "kind", F.round("hits_a", 9).alias("hits_a"), F.round("hits_b", 9).alias("hits_b"), "n_a", "n_b", "best", F.round("low_a", 8).alias("low_a"), F.round("high_a", 8).alias("high_a"))


PLAY = (4, 11, 19, 27, 40)


@query("SELECT juego, t, round(sum(CASE WHEN (drum = 'balls' AND num IN (4, 11, 19, 27, 40)) OR (drum = 'sb' AND num = 7) THEN ln(p / p0) END), 9) AS score FROM top GROUP BY juego, t")
def play_score(s, d):
    """One play's score under every draw's forecast."""
    own = ((F.col("drum") == "balls") & F.col("num").isin(*PLAY)) | ((F.col("drum") == "sb") & (F.col("num") == 7))
    return montecarlo.ratios(_forecast(s, d)).where(own).groupBy("juego", "t").agg(F.round(F.sum("score"), 9).alias("score"))


N_PLAYS = 10_000
_LAST = "l AS (SELECT juego, max(t) AS t FROM dt GROUP BY juego), sc AS (SELECT fb.juego, drum, num, ln(p / p0) AS x FROM fb JOIN l USING (juego, t))"


@query(f""", {_LAST}, pl AS (SELECT t AS play, num, row_number() OVER (PARTITION BY t ORDER BY md5('42:balls:' || t || ':' || num)) AS r FROM range(0, {N_PLAYS}) a(t), range(1, 44) b(num)),
ex AS (SELECT t AS play, arg_min(num, md5('42:sb:' || t || ':' || num)) AS num FROM range(0, {N_PLAYS}) a(t), range(1, 17) b(num) GROUP BY t),
own AS (SELECT juego, sum(x) AS own FROM sc WHERE (drum = 'balls' AND num IN (4, 11, 19, 27, 40)) OR (drum = 'sb' AND num = 7) GROUP BY juego),
s AS (SELECT juego, play, sum(x) AS score FROM (SELECT play, 'balls' AS drum, num FROM pl WHERE r <= 5 UNION ALL SELECT play, 'sb', num FROM ex) p JOIN sc USING (drum, num) GROUP BY juego, play)
SELECT juego, round(any_value(own), 9) AS score, count(*) AS n, round(100 * avg((round(score, 10) <= round(own, 10))::INTEGER), 6) AS percentile FROM s JOIN own USING (juego) GROUP BY juego""")
def random_plays(s, d):
    """The share of 10,000 random plays that score no more than a given one, by the last draw's forecast."""
    rows = montecarlo.ratios(_forecast(s, d))
    last = rows.groupBy("juego").agg(F.max("t").alias("t"))
    scores = rows.join(last, ["juego", "t"]).select("juego", "drum", "num", "score")
    plays = montecarlo.sampled_draws(s.range(N_PLAYS).withColumnRenamed("id", "t"))
    label = F.explode(F.concat(F.transform("balls", lambda b: F.struct(F.lit("balls").alias("drum"), b.cast("int").alias("num"))), F.array(F.struct(F.lit("sb").alias("drum"), F.col("superbalota").cast("int").alias("num")))))
    each = plays.select("t", label.alias("x")).select("t", "x.drum", "x.num").join(F.broadcast(scores), ["drum", "num"]).groupBy("juego", "t").agg(F.sum("score").alias("other"))
    mine = ((F.col("drum") == "balls") & F.col("num").isin(*PLAY)) | ((F.col("drum") == "sb") & (F.col("num") == 7))
    own = scores.where(mine).groupBy("juego").agg(F.sum("score").alias("own"))
    return each.join(own, "juego").groupBy("juego").agg(F.round(F.first("own"), 9).alias("score"), F.count("*").alias("n"), F.round(100 * F.avg((F.round("other", 10) <= F.round("own", 10)).cast("double")), 6).alias("percentile"))


# --- simulated and fitted: no SQL; tests hold them against plain NumPy and against what must hold


@query()
def simulate_ball_counts(s, d):
    """10,000 fair histories of each game's own length: (juego, sim, drum, statistic, value)."""
    lengths = [(r["juego"], r["count"]) for r in _daily(s, d).groupBy("juego").count().orderBy("juego").collect()]
    return montecarlo.simulated_counts(montecarlo.simulations(s, lengths, montecarlo.N_SIMS))


@query()
def uniformity_nulls(s, d):
    return significance.uniformity_nulls(_daily(s, d))


@query()
def independence(s, d):
    return significance.independence(significance.aligned(_daily(s, d)))


@query()
def outcome_significance(s, d):
    return significance.outcome_significance(_forecast(s, d).select("juego", "drum", "t", "num", "y", "p"))


def _logistic(members: DataFrame, spec=SPEC) -> DataFrame:
    return models.walk_forward_logistic(H.features(members, spec), spec)


def _frequency(members: DataFrame, spec=SPEC) -> DataFrame:
    return H.frequency_baseline(members, spec=spec).where(F.col("t") >= spec.first_test)


@query()
def logistic_walk_forward(s, d):
    return E.summary(E.draw_scores(_logistic(_members(s, d))))


@query()
def boosting_walk_forward(s, d):
    """Refitted every 100 draws, every draw forecast."""
    return E.summary(E.draw_scores(models.walk_forward_boosting(H.features(_members(s, d)), CONTROL), CONTROL), CONTROL)


@query()
def resampling_significance(s, d):
    """The frequency model among ten permuted and ten synthetic histories of each game."""
    return significance.resampling_significance(_daily(s, d), _frequency, {"permutacion": 10, "sintetico": 10})


@query()
def sticky_draws(s, d):
    rows = montecarlo.sticky_histories(_daily(s, d), controls.EFFECTS, controls.SEEDS)
    return rows.select("effect", "seed", "juego", "n_sorteo", "balls", "superbalota")


@query()
def positive_control(s, d):
    dates = _daily(s, d).where("juego = 'baloto'")  # one template of dates, as both games share theirs
    of = {"frecuencia": lambda m: _frequency(m, CONTROL), "logistica": lambda m: _logistic(m, CONTROL)}
    return controls.positive_control(dates, of, spec=CONTROL)


@query()
def regularisation(s, d):
    return controls.regularisation(_daily(s, d).where("juego = 'baloto'"), grid=[1.0, 0.03], effects=[0.0, 1.5], seeds=[1], spec=CONTROL)


@query()
def trap_grid(s, d):
    return controls.trap_grid(_daily(s, d), CONTROL)


def _plays(s, d) -> DataFrame:
    scores = montecarlo.score_arrays(_forecast(s, d), ["juego", "n_sorteo"])
    return scores.join(_daily(s, d).select("juego", "n_sorteo", "balls", "superbalota"), ["juego", "n_sorteo"]).repartition(64, "juego", "n_sorteo")  # few bytes, much work


@query()
def play_score_percentile(s, d):
    return montecarlo.play_percentile(_plays(s, d), ["juego", "n_sorteo"])


@query()
def winner_percentiles(s, d):
    return montecarlo.winner_percentiles(_plays(s, d), ["juego", "n_sorteo"])


@query()
def winner_percentile_summary(s, d):
    """Mean with its interval, tenths, and the distance from the uniform law, of where results stood among random plays."""
    rows = montecarlo.winner_percentiles(_plays(s, d), ["juego", "n_sorteo"]).cache()  # one number a draw
    low, high = E.mean_interval(F.col("u"))
    tenth = F.least(F.floor(F.round("u", 12) * 10), F.lit(9))
    g = rows.groupBy("juego").agg(F.count("*").alias("n"), F.avg("u").alias("mean"), low.alias("low"), high.alias("high"), F.array(*[F.sum((tenth == k).cast("long")) for k in range(10)]).alias("deciles"))
    return g.join(E.ks_uniform(rows, "u", ["juego"]).select("juego", "d", "p_ks"), "juego")


@query()
def replay(s, d):
    """Results of the last 40 days of the histories, each by a model fitted on all draws before it."""
    rows = _daily(s, d)
    start = rows.agg(F.date_add(F.max("fecha"), -40).cast("string")).first()[0]
    none = rows.select("juego", "n_sorteo").limit(0)
    return L.replay(H.features(_members(s, d)), rows, none, start)


@query()
def next_draw_forecast(s, d):
    """The production model fitted on whole histories, and its chances for the draw that comes."""
    rows = _daily(s, d)
    features = H.features(H.membership(rows, next_days=C.next_days(rows, calendar(s))))
    return models.forecast(features.where("y IS NULL"), models.fit_final(features)).drop("y")
