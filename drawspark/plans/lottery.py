"""Queries over the derived draw view, each with equivalent SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC
from drawspark.operators import evaluation as E
from drawspark.operators import history as H
from drawspark.operators import live as L
from drawspark.operators import calendar as C
from drawspark.operators import models, montecarlo
from drawspark.operators import validation as V
from drawspark.sources import draws as D
from drawspark.sources import store


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str = ""


QUERIES: list[Query] = []


def query(sql: str = ""):
    def add(f):
        QUERIES.append(Query(f.__name__, f, sql and VIEW + sql))
        return f

    return add


# The draw view in SQL; queries below go on from d (daily draws), a (all orders), m (membership of d) and w (dirty draws).
VIEW = """
WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'baloto' ELSE 'revancha' END AS juego, o_orderdate::DATE AS fecha, o_orderkey AS k, o_custkey AS c FROM orders),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY juego, fecha ORDER BY k) AS r FROM o) WHERE r = 1),
d AS (SELECT fecha, row_number() OVER (PARTITION BY juego ORDER BY fecha) AS n_sorteo, juego,
  list_sort(list_transform([0, 1, 2, 3, 4], lambda i: ((k * 17 + c) % 43 + i * (1 + c % 42)) % 43 + 1)) AS balls, (1 + (k + c) % 16)::INTEGER AS superbalota FROM first_),
a AS (SELECT fecha, row_number() OVER (PARTITION BY juego ORDER BY fecha, k) AS n_sorteo, juego,
  list_sort(list_transform([0, 1, 2, 3, 4], lambda i: ((k * 17 + c) % 43 + i * (1 + c % 42)) % 43 + 1)) AS balls, (1 + (k + c) % 16)::INTEGER AS superbalota FROM o),
dt AS (SELECT *, n_sorteo - 1 AS t FROM d),
m AS (SELECT juego, 'balls' AS drum, t, n_sorteo, fecha, num::INTEGER AS num, list_contains(balls, num)::INTEGER AS y FROM dt, range(1, 44) g(num)
  UNION ALL SELECT juego, 'sb', t, n_sorteo, fecha, num::INTEGER, (superbalota = num)::INTEGER FROM dt, range(1, 17) g(num)),
past AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY juego, drum, num ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past FROM m),
fb AS (SELECT *, (past + 10.0 * p0) / (t + 10.0) AS p FROM (SELECT *, CASE drum WHEN 'balls' THEN 5.0::DOUBLE / 43 ELSE 1.0::DOUBLE / 16 END AS p0 FROM past)),
top AS (SELECT *, row_number() OVER (PARTITION BY juego, drum, t ORDER BY round(p, 12) DESC, md5('42:' || juego || ':' || drum || ':' || t || ':' || num)) AS r FROM fb WHERE t >= 250),
w0 AS (SELECT CASE WHEN n_sorteo % 307 = 0 THEN NULL WHEN n_sorteo % 151 = 0 THEN fecha - 9 ELSE fecha END AS fecha, n_sorteo, CASE WHEN n_sorteo % 211 = 0 THEN 'miloto' ELSE juego END AS juego, balls[1]::INTEGER AS b1,
  CASE WHEN n_sorteo % 83 = 0 THEN balls[1] ELSE balls[2] END::INTEGER AS b2, balls[3]::INTEGER AS b3, balls[4]::INTEGER AS b4, CASE WHEN n_sorteo % 97 = 0 THEN 44 ELSE balls[5] END::INTEGER AS b5,
  CASE WHEN n_sorteo % 89 = 0 THEN 17 ELSE superbalota END AS superbalota FROM d WHERE n_sorteo % 101 <> 0),
w AS (SELECT * FROM w0 UNION ALL SELECT * FROM w0 WHERE n_sorteo % 103 = 0 UNION ALL SELECT * REPLACE (superbalota % 16 + 1 AS superbalota) FROM w0 WHERE n_sorteo % 107 = 0),
wk AS (SELECT *, row_number() OVER (PARTITION BY juego, n_sorteo, fecha, b1, b2, b3, b4, b5, superbalota) AS copy FROM w WHERE juego IN ('baloto', 'revancha')),
wn AS (SELECT * FROM wk WHERE fecha IS NOT NULL), u AS (SELECT * FROM wn WHERE copy = 1),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY juego, n_sorteo ORDER BY fecha, b1, b2, b3, b4, b5, superbalota) AS r FROM u) WHERE r = 1)
"""
TEXT = "fecha::VARCHAR AS fecha, n_sorteo, juego"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return D.draws_daily(s, d)


def _members(s: SparkSession, d: str) -> DataFrame:
    return H.membership(_daily(s, d))


def _dirty(s: SparkSession, d: str) -> DataFrame:
    return D.dirty(_daily(s, d))


def _day():
    return F.col("fecha").cast("string").alias("fecha")


# --- projections and scalar functions


@query(f"SELECT {TEXT}, balls[1]::INTEGER AS b1, balls[2]::INTEGER AS b2, balls[3]::INTEGER AS b3, balls[4]::INTEGER AS b4, balls[5]::INTEGER AS b5, superbalota FROM d")
def canonicalize(s, d):
    mixed = _daily(s, d).withColumn("juego", F.concat(F.lit("  "), F.upper("juego")))
    mixed = mixed.withColumns({"b1": F.col("b5"), "b5": F.col("b1")})
    return D.canonical(mixed).withColumn("fecha", _day())


@query("""SELECT n_sorteo, juego, CASE WHEN n_sorteo % 7 <> 0 THEN fecha::VARCHAR END AS fecha FROM d""")
def parse_spanish_date(s, d):
    """Accents, the other spelling of September, capitals and spaces; every seventh text is no date."""
    name = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), F.month("fecha"))
    month = F.when(name == "septiembre", F.when(F.col("n_sorteo") % 2 == 0, "setiembre").otherwise("Séptiembre")).when(F.col("n_sorteo") % 3 == 0, F.upper(name)).otherwise(F.initcap(name))
    day = F.when(F.col("n_sorteo") % 7 == 0, F.lit("32")).otherwise(F.dayofmonth("fecha").cast("string"))
    text = F.concat(F.lit(" "), day, F.lit("  de "), month, F.lit(" De "), F.year("fecha").cast("string"), F.lit(" "))
    return _daily(s, d).select("n_sorteo", "juego", D.parse_spanish_date(text).cast("string").alias("fecha"))


@query("SELECT n_sorteo, juego, strip_accents(['lunes', 'martes', 'miércoles', 'Ñandú', 'pingüino', 'SÁBADO', 'ÍÓÉ'][1 + n_sorteo % 7] || juego) AS plain FROM d")
def strip_accents(s, d):
    words = F.array(*map(F.lit, ("lunes", "martes", "miércoles", "Ñandú", "pingüino", "SÁBADO", "ÍÓÉ")))
    return _daily(s, d).select("n_sorteo", "juego", D.strip_accents(F.concat(F.get(words, (F.col("n_sorteo") % 7).cast("int")), "juego")).alias("plain"))


@query("SELECT juego, n_sorteo, (isodow(fecha) - 1)::INTEGER AS weekday, (isodow(fecha) = 1)::INTEGER AS lunes, (isodow(fecha) = 3)::INTEGER AS miercoles, (isodow(fecha) = 6)::INTEGER AS sabado FROM d")
def weekday_one_hot(s, d):
    day = F.weekday("fecha")
    return _daily(s, d).select("juego", "n_sorteo", day.alias("weekday"), *[(day == k).cast("int").alias(n) for k, n in ((0, "lunes"), (2, "miercoles"), (5, "sabado"))])


@query("SELECT juego || '-' || n_sorteo AS id, array_to_string(list_transform(balls, lambda b: lpad(b::VARCHAR, 2, '0')), '-') AS combination FROM d")
def format_combination(s, d):
    return _daily(s, d).select(L.prediction_id(F.col("juego"), F.col("n_sorteo")).alias("id"), L.format_combination(F.col("balls")).alias("combination"))


@query("SELECT juego, n_sorteo, (fecha + 1)::VARCHAR || 'T01:00:00Z' AS deadline FROM d")
def prediction_deadline(s, d):
    return _daily(s, d).select("juego", "n_sorteo", L.deadline_utc(F.col("fecha")).alias("deadline"))


@query("""SELECT juego, n_sorteo, array_to_string(list_transform(range(1, 44), lambda j: list_contains(balls, j)::INTEGER), '') AS y_balls,
  array_to_string(list_transform(range(1, 17), lambda j: (superbalota = j)::INTEGER), '') AS y_extra FROM d""")
def multi_hot(s, d):
    hot = lambda n, test: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: test(j).cast("int").cast("string")), "")
    return _daily(s, d).select("juego", "n_sorteo", hot(43, lambda j: F.array_contains("balls", j)).alias("y_balls"), hot(16, lambda j: F.col("superbalota") == j).alias("y_extra"))


@query("SELECT juego, n_sorteo, array_to_string(balls, '-') AS balls FROM d")
def decode_multi_hot(s, d):
    members = _members(s, d).where("y = 1 AND drum = 'balls'").groupBy("juego", "n_sorteo").agg(F.array_sort(F.collect_list("num")).alias("balls"))  # five a draw
    return members.select("juego", "n_sorteo", F.array_join("balls", "-").alias("balls"))


@query("SELECT sha256(sha256(string_agg(fecha::VARCHAR || ',' || n_sorteo || ',' || juego || ',' || array_to_string(balls, ',') || ',' || superbalota, chr(10) ORDER BY juego, n_sorteo))) AS digest FROM d")
def draws_hash(s, d):
    return store.digest_frame(_daily(s, d).select(D.COLUMNS), D.KEY)


@query("SELECT juego, n_sorteo, (isodow(fecha) IN (1, 3, 6) AND (isodow(fecha) <> 1 OR fecha >= DATE '1998-01-01')) AS draw_day FROM d")
def calendar_is_draw_day(s, d):
    off = V.off_calendar(_daily(s, d).select(D.COLUMNS), calendar(s)).select("juego", "n_sorteo", F.lit(False).alias("ok"))
    return _daily(s, d).join(off, ["juego", "n_sorteo"], "left").select("juego", "n_sorteo", F.coalesce("ok", F.lit(True)).alias("draw_day"))


def calendar(s: SparkSession) -> DataFrame:
    return C.calendar(s, [("1990-01-01", "1998-01-01", [2, 5]), ("1998-01-01", "2100-01-01", [0, 2, 5])])


@query("""SELECT juego, n_sorteo, (SELECT min(fecha + i::INTEGER) FROM range(1, 15) g(i) WHERE isodow(fecha + i::INTEGER) IN (3, 6) OR (isodow(fecha + i::INTEGER) = 1 AND fecha + i::INTEGER >= DATE '1998-01-01'))::VARCHAR AS next_date FROM d""")
def next_draw_date(s, d):
    rows = _daily(s, d)
    return rows.join(C.following(rows, calendar(s)), "fecha").select("juego", "n_sorteo", F.col("next_date").cast("string").alias("next_date"))


# --- joins


@query("SELECT juego, n_sorteo FROM d ANTI JOIN (SELECT juego, n_sorteo FROM d WHERE n_sorteo % 3 <> 0) k USING (juego, n_sorteo)")
def split_new(s, d):
    rows = _daily(s, d)
    return V.split_new(rows.where("n_sorteo % 3 <> 0"), rows).select("juego", "n_sorteo")


@query("SELECT w.juego, w.n_sorteo FROM w JOIN w0 USING (juego, n_sorteo) WHERE NOT (w.fecha IS NOT DISTINCT FROM w0.fecha AND w.b1 = w0.b1 AND w.b2 = w0.b2 AND w.b3 = w0.b3 AND w.b4 = w0.b4 AND w.b5 = w0.b5 AND w.superbalota = w0.superbalota)")
def find_conflicts(s, d):
    return V.conflicts(_dirty_base(s, d), _dirty(s, d)).select("juego", "n_sorteo")


def _dirty_base(s, d):
    return D.faulty(_daily(s, d))


CROSS = "FROM (SELECT * FROM one WHERE juego = 'baloto') l FULL JOIN (SELECT * FROM one WHERE juego = 'revancha') r ON l.n_sorteo = r.n_sorteo WHERE l.n_sorteo IS NULL OR r.n_sorteo IS NULL OR l.fecha <> r.fecha"
CROSS_CHECK = "CASE WHEN r.n_sorteo IS NULL THEN 'cruce_solo_baloto' WHEN l.n_sorteo IS NULL THEN 'cruce_solo_revancha' ELSE 'cruce_fecha_distinta' END"
CROSS_GAME = "CASE WHEN r.n_sorteo IS NULL THEN 'baloto' WHEN l.n_sorteo IS NULL THEN 'revancha' END"


@query(f"SELECT 'warning' AS level, {CROSS_CHECK} AS \"check\", {CROSS_GAME} AS juego, coalesce(l.n_sorteo, r.n_sorteo) AS n_sorteo {CROSS}")
def cross_game(s, d):
    return V.cross_game(_dirty(s, d), *SPEC.games)


@query("SELECT juego, drum, n_sorteo, num, y FROM m")
def membership_long(s, d):
    return _members(s, d).select("juego", "drum", "n_sorteo", "num", "y")


@query("SELECT l.n_sorteo, len(list_intersect(l.balls, r.balls))::INTEGER AS common, (l.superbalota = r.superbalota)::INTEGER AS same_extra FROM d l JOIN d r ON l.n_sorteo = r.n_sorteo WHERE l.juego = 'baloto' AND r.juego = 'revancha'")
def common_balls(s, d):
    rows = _daily(s, d)
    a, b = (rows.where(F.col("juego") == g).select("n_sorteo", F.col("balls").alias(f"balls_{g}"), F.col("superbalota").alias(f"extra_{g}")) for g in SPEC.games)
    return a.join(b, "n_sorteo").select("n_sorteo", F.size(F.array_intersect("balls_baloto", "balls_revancha")).alias("common"), (F.col("extra_baloto") == F.col("extra_revancha")).cast("int").alias("same_extra"))


@query("SELECT count(*) AS combinations FROM range(1, 44) a(a), range(1, 44) b(b), range(1, 44) c(c), range(1, 44) e(e), range(1, 44) f(f) WHERE a < b AND b < c AND c < e AND e < f")
def combination_space(s, d):
    out = s.range(1, 44).select(F.col("id").alias("x0"))
    for k in range(1, 5):  # each level only meets the larger labels
        out = out.withColumn(f"x{k}", F.explode(F.when(F.col(f"x{k - 1}") < 43, F.sequence(F.col(f"x{k - 1}") + 1, F.lit(43).cast("long")))))
    return out.agg(F.count("*").alias("combinations"))


PREDICTED = """, pred AS (SELECT juego, t, array_to_string(list_sort(list(lpad(num::VARCHAR, 2, '0')) FILTER (WHERE drum = 'balls' AND r <= 5)), '-') AS combinacion, (max(num) FILTER (WHERE drum = 'sb' AND r = 1))::INTEGER AS sup FROM top GROUP BY juego, t),
rec AS (SELECT p.juego || '-' || d.n_sorteo AS prediccion_id, p.juego, d.n_sorteo, p.t, p.combinacion, p.sup, array_to_string(list_transform(d.balls, lambda b: lpad(b::VARCHAR, 2, '0')), '-') AS resultado, d.superbalota,
  len(list_intersect(list_transform(string_split(p.combinacion, '-'), lambda x: x::INTEGER), list_transform(d.balls, lambda b: b::INTEGER)))::INTEGER AS aciertos, (p.sup = d.superbalota)::INTEGER AS acierto_superbalota
  FROM pred p JOIN dt d ON d.juego = p.juego AND d.t = p.t),
loss AS (SELECT juego, t, avg(CASE WHEN drum = 'balls' THEN -CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END END) AS balls, -ln(sum(CASE WHEN drum = 'sb' THEN q * y END) / sum(CASE WHEN drum = 'sb' THEN q END)) AS sb
  FROM (SELECT *, round_even(p, 6) AS q FROM fb WHERE t >= 250) GROUP BY juego, t)
"""


def _forecast(s, d):
    """The frequency baseline of every draw from the first test draw on."""
    return H.frequency_baseline(_members(s, d)).where(F.col("t") >= SPEC.first_test)


def _predictions(s, d):
    """A prediction of every draw, as it would have been logged the day before."""
    rows = H.indexed(_daily(s, d)).select("juego", "t", "n_sorteo", "fecha")
    return L.predictions(_forecast(s, d), rows, F.to_timestamp(F.date_add("fecha", -1)), F.lit("v"), "frecuencia")


@query(PREDICTED + ", last_ AS (SELECT juego, max(n_sorteo) AS n FROM d GROUP BY juego) SELECT prediccion_id FROM rec JOIN last_ l USING (juego) WHERE n_sorteo > l.n - 30")
def pending_predictions(s, d):
    """Results of all but each game's last thirty draws are known."""
    logged = _predictions(s, d).select("juego", "n_sorteo", "prediccion_id")
    last = logged.groupBy("juego").agg(F.max("n_sorteo").alias("n"))
    return L.pending(logged, logged.join(last, "juego").where("n_sorteo <= n - 30")).select("prediccion_id")


RECONCILED = PREDICTED


def _reconciled(s, d):
    logged = _predictions(s, d)
    return L.reconcile(logged, logged.limit(0), _daily(s, d))


@query(RECONCILED + """SELECT prediccion_id, juego, n_sorteo, combinacion, resultado, sup AS superbalota_sugerida, superbalota AS superbalota_real, aciertos, acierto_superbalota, 0.581395::DOUBLE AS aciertos_esperados, round_even(loss.balls, 6) AS log_loss_balotas,
  0.359445::DOUBLE AS log_loss_constante, round_even(loss.sb, 6) AS log_loss_superbalota, 2.772589::DOUBLE AS log_loss_superbalota_constante FROM rec JOIN loss USING (juego, t)""")
def reconcile(s, d):
    return _reconciled(s, d).select(*[c for c in L.RESULT_COLUMNS if c not in ("conciliada_utc", "fecha_sorteo", "fecha_real", "modelo_version")])


@query(RECONCILED + f""", g AS (SELECT juego, count(*) AS n, sum(aciertos)::BIGINT AS hits, sum(acierto_superbalota)::BIGINT AS extra_hits, avg(round_even(loss.balls, 6)) AS ll FROM rec JOIN loss USING (juego, t) GROUP BY juego)
SELECT juego, n, hits, extra_hits, round(n * 25.0::DOUBLE / 43, 6) AS expected, round(n * 25.0::DOUBLE / 43 - 1.96 * sqrt(n * {SPEC.hits_variance!r}::DOUBLE), 6) AS low, round(n * 25.0::DOUBLE / 43 + 1.96 * sqrt(n * {SPEC.hits_variance!r}::DOUBLE), 6) AS high,
  round(n / 16.0::DOUBLE - 1.96 * sqrt(n * 15.0::DOUBLE / 256), 6) AS extra_low, round(n / 16.0::DOUBLE + 1.96 * sqrt(n * 15.0::DOUBLE / 256), 6) AS extra_high,
  round((hits - n * 25.0::DOUBLE / 43) / sqrt(n * {SPEC.hits_variance!r}::DOUBLE), 6) AS z, round(ll, 8) AS log_loss, n AS predictions, 0::BIGINT AS open FROM g""")
def live_summary(s, d):
    rows = L.live_summary(_reconciled(s, d), logged=_predictions(s, d))
    return rows.select("juego", "n", "hits", "extra_hits", *[F.round(c, 6).alias(c) for c in ("expected", "low", "high", "extra_low", "extra_high", "z")], F.round("log_loss", 8).alias("log_loss"), "predictions", "open")


# --- aggregations


@query("SELECT juego, max(n_sorteo) AS last FROM d GROUP BY juego")
def known_last(s, d):
    return _daily(s, d).groupBy("juego").agg(F.max("n_sorteo").alias("last"))


@query("""SELECT juego, year(fecha)::INTEGER AS year, (isodow(fecha) - 1)::INTEGER AS weekday, count(*) AS n, min(fecha)::VARCHAR AS first, max(fecha)::VARCHAR AS last
  FROM d GROUP BY GROUPING SETS ((juego), (juego, year(fecha)::INTEGER), (juego, (isodow(fecha) - 1)::INTEGER))""")
def summarize(s, d):
    rows = _daily(s, d).select("juego", "fecha", F.year("fecha").alias("year"), F.weekday("fecha").alias("weekday"))
    juego, year, weekday = rows["juego"], rows["year"], rows["weekday"]
    sets = rows.groupingSets([[juego], [juego, year], [juego, weekday]], juego, year, weekday)
    return sets.agg(F.count("*").alias("n"), F.min("fecha").cast("string").alias("first"), F.max("fecha").cast("string").alias("last"))


@query("SELECT DISTINCT fecha::VARCHAR AS fecha, n_sorteo, juego, b1, b2, b3, b4, b5, superbalota FROM w")
def dedupe_draws(s, d):
    return _dirty(s, d).dropDuplicates(D.COLUMNS).withColumn("fecha", _day())


@query("SELECT fecha::VARCHAR AS fecha, n_sorteo, juego, b1, b2, b3, b4, b5, superbalota FROM w UNION ALL SELECT fecha::VARCHAR, n_sorteo, juego, b1, b2, b3, b4, b5, superbalota FROM w0")
def concat_draws(s, d):
    return D.concat_draws(_dirty(s, d), _dirty_base(s, d)).withColumn("fecha", _day())


@query("SELECT juego, num::INTEGER AS num, sum(y)::BIGINT AS seen, count(*) AS n FROM m WHERE drum = 'balls' GROUP BY juego, num")
def ball_counts(s, d):
    return E.label_counts(_daily(s, d)).select("juego", "num", "seen", "n")


@query(RECONCILED + "SELECT g.juego, h.h::INTEGER AS hits, count(rec.aciertos) AS n FROM (SELECT DISTINCT juego FROM rec) g CROSS JOIN range(0, 6) h(h) LEFT JOIN rec ON rec.juego = g.juego AND rec.aciertos = h.h GROUP BY ALL")
def hits_distribution(s, d):
    seen = _reconciled(s, d).groupBy("juego", F.col("aciertos").alias("hits")).count()
    grid = seen.select("juego").distinct().withColumn("hits", F.explode(F.array(*map(F.lit, range(6)))))
    return grid.join(seen, ["juego", "hits"], "left").select("juego", "hits", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("SELECT juego, drum, least(floor(round(p, 12) * 10), 9)::INTEGER AS decile, count(*) AS n FROM fb GROUP BY ALL")
def decile_histogram(s, d):
    return E.deciles(_baseline(s, d), "p", ["juego", "drum"])


@query(RECONCILED + """SELECT juego, round(avg(aciertos), 9) AS mean, round(stddev_samp(aciertos), 9) AS std, round(avg(aciertos) - 1.96 * stddev_samp(aciertos) / sqrt(count(*)), 9) AS ci_low, round(avg(aciertos) + 1.96 * stddev_samp(aciertos) / sqrt(count(*)), 9) AS ci_high,
  round(quantile_cont(aciertos, 0.025), 9) AS low, round(quantile_cont(aciertos, 0.975), 9) AS high FROM rec GROUP BY juego""")
def mean_and_interval(s, d):
    low, high = E.mean_interval(F.col("aciertos"))
    return _reconciled(s, d).groupBy("juego").agg(
        F.round(F.avg("aciertos"), 9).alias("mean"), F.round(F.stddev_samp("aciertos"), 9).alias("std"), F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"),
        F.round(F.percentile("aciertos", 0.025), 9).alias("low"), F.round(F.percentile("aciertos", 0.975), 9).alias("high"),
    )


# --- sequences


@query("SELECT juego, n_sorteo, t FROM dt")
def draw_index(s, d):
    return H.indexed(_daily(s, d)).select("juego", "n_sorteo", "t")


@query("SELECT juego, drum, t, num, past FROM past UNION ALL SELECT juego, drum, max(t) + 1, num, sum(y)::BIGINT FROM m GROUP BY juego, drum, num")
def past_counts(s, d):
    """With the row of the draw that comes."""
    rows = _daily(s, d)
    members = H.membership(rows, next_days=C.next_days(rows, calendar(s)))
    return members.select("juego", "drum", "t", "num", H.past_count().cast("long").alias("past"))


FEATURES = """SELECT juego, drum, t, num, past,
  round((past - coalesce(lag(past, 10) OVER o, 0)) / greatest(least(t, 10), 1)::DOUBLE, 9) AS freq_10, round((past - coalesce(lag(past, 30) OVER o, 0)) / greatest(least(t, 30), 1)::DOUBLE, 9) AS freq_30,
  round((past - coalesce(lag(past, 100) OVER o, 0)) / greatest(least(t, 100), 1)::DOUBLE, 9) AS freq_100,
  least(t - coalesce(max(CASE WHEN y = 1 THEN t END) OVER (PARTITION BY juego, drum, num ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), 100) AS gap,
  round((past - coalesce(lag(past, 15) OVER o, 0)) / greatest(least(t, 15), 1)::DOUBLE - (coalesce(lag(past, 15) OVER o, 0) - coalesce(lag(past, 30) OVER o, 0)) / greatest(least(t - 15, 15), 1)::DOUBLE, 9) AS trend
  FROM past WINDOW o AS (PARTITION BY juego, drum, num ORDER BY t)"""


@query(FEATURES)
def number_features(s, d):
    f = H.features(_members(s, d))
    return f.select("juego", "drum", "t", "num", "past", *[F.round(c, 9).alias(c) for c in ("freq_10", "freq_30", "freq_100")], "gap", F.round("trend", 9).alias("trend"))


@query("SELECT juego, drum, t, num, round(avg(y) OVER (PARTITION BY juego, drum, num ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS freq FROM m")
def rolling_frequency_leaky(s, d):
    return H.leaky_frequency(_members(s, d)).select("juego", "drum", "t", "num", F.round("freq", 9).alias("freq"))


@query(RECONCILED + "SELECT juego, n_sorteo, sum(aciertos) OVER o::BIGINT AS observed, round(row_number() OVER o * 25.0::DOUBLE / 43, 6) AS expected, round(1.96 * sqrt(row_number() OVER o * " + repr(SPEC.hits_variance) + "::DOUBLE), 6) AS band FROM rec WINDOW o AS (PARTITION BY juego ORDER BY n_sorteo)")
def cumulative_vs_chance(s, d):
    o = Window.partitionBy("juego").orderBy("n_sorteo")
    return _reconciled(s, d).select("juego", "n_sorteo", F.sum("aciertos").over(o).alias("observed"), F.round(F.row_number().over(o) * 25.0 / 43, 6).alias("expected"), F.round(1.96 * F.sqrt(F.row_number().over(o) * SPEC.hits_variance), 6).alias("band"))


@query("SELECT juego, t, floor((t - 250) / 10)::BIGINT AS block, (250 + 10 * floor((t - 250) / 10))::BIGINT AS train_end FROM dt WHERE t >= 250")
def walk_forward_blocks(s, d):
    block = F.floor((F.col("t") - 250) / 10)
    return H.indexed(_daily(s, d)).where("t >= 250").select("juego", "t", block.alias("block"), (250 + 10 * block).alias("train_end"))


# --- validation

KNOWN = "juego IN ('baloto', 'revancha')"
OFF = "NOT (isodow(fecha) IN (1, 3, 6) AND (isodow(fecha) <> 1 OR fecha >= DATE '1998-01-01'))"
CHECKS = {
    "v_nulls": ("SELECT juego, n_sorteo FROM wk WHERE fecha IS NULL", "nulos"),
    "v_ball_range": ("SELECT juego, n_sorteo FROM wn WHERE least(b1, b2, b3, b4, b5) < 1 OR greatest(b1, b2, b3, b4, b5) > 43", "rango_balotas"),
    "v_super_range": ("SELECT juego, n_sorteo FROM wn WHERE superbalota NOT BETWEEN 1 AND 16", "rango_superbalota"),
    "v_repeated": ("SELECT juego, n_sorteo FROM wn WHERE len(list_distinct([b1, b2, b3, b4, b5])) < 5", "repetidas"),
    "v_unknown_game": (f"SELECT juego, n_sorteo FROM w WHERE NOT {KNOWN}", "juego_desconocido"),
    "v_dup_rows": ("SELECT juego, n_sorteo FROM wn WHERE copy > 1", "filas_duplicadas"),
    "v_dup_number": ("SELECT juego, n_sorteo FROM u QUALIFY count(*) OVER (PARTITION BY juego, n_sorteo) > 1", "n_sorteo_duplicado"),
    "v_dup_date": ("SELECT juego, n_sorteo FROM u QUALIFY count(*) OVER (PARTITION BY juego, fecha) > 1", "fecha_duplicada"),
    "v_gaps": ("SELECT juego, n_sorteo FROM one QUALIFY n_sorteo - lag(n_sorteo) OVER (PARTITION BY juego ORDER BY n_sorteo) > 1", "saltos"),
    "v_date_order": ("SELECT juego, n_sorteo FROM one QUALIFY fecha - lag(fecha) OVER (PARTITION BY juego ORDER BY n_sorteo) <= 0", "orden_fechas"),
    "v_off_calendar": (f"SELECT juego, n_sorteo FROM one WHERE {OFF}", "fuera_de_calendario"),
}


def _check(name: str, check: str):
    def run(s, d):
        return V.findings(_dirty(s, d), calendar(s)).where(F.col("check") == check).select("juego", "n_sorteo")

    run.__name__ = name
    return run


for _name, (_sql, _kind) in CHECKS.items():
    query(_sql)(_check(_name, _kind))


GAPS = """, gap AS (SELECT juego, n_sorteo, lag(n_sorteo) OVER (PARTITION BY juego ORDER BY n_sorteo) AS b FROM one),
gaps AS (SELECT juego, n_sorteo, CASE WHEN n_sorteo - b > 2 THEN (b + 1) || '..' || (n_sorteo - 1) ELSE (b + 1)::VARCHAR END AS missing FROM gap WHERE n_sorteo - b > 1)
"""


@query(GAPS + "SELECT juego, n_sorteo, missing FROM gaps")
def gap_ranges(s, d):
    found = V.findings(_dirty(s, d), calendar(s)).where(F.col("check") == "saltos")
    return found.select("juego", "n_sorteo", V.gap_text(F.col("before"), F.col("n_sorteo")).alias("missing"))


@query("""SELECT 'baloto' AS juego FROM (SELECT 1) WHERE 'baloto' NOT IN (SELECT juego FROM d WHERE juego = 'revancha')""")
def missing_games(s, d):
    return V.missing_games(_daily(s, d).where("juego = 'revancha'")).select("juego")


@query("""SELECT 'error' AS level, 'conflicto_entre_fuentes' AS "check", juego, n_sorteo FROM (SELECT DISTINCT fecha, juego, n_sorteo, b1, b2, b3, b4, b5, superbalota FROM w) GROUP BY juego, n_sorteo HAVING count(*) > 1""")
def source_conflicts(s, d):
    return V.source_conflicts(_dirty(s, d))


_NAMES = "['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo']"


@query(GAPS + ", every AS (" + " UNION ALL ".join(f"SELECT '{k}' AS c, {'NULL' if k == 'juego_desconocido' else 'juego'} AS juego, n_sorteo FROM ({q})" for q, k in CHECKS.values()) + f"""
 UNION ALL SELECT {CROSS_CHECK}, {CROSS_GAME}, coalesce(l.n_sorteo, r.n_sorteo) {CROSS}),
 k AS (SELECT *, row_number() OVER (PARTITION BY c, juego ORDER BY n_sorteo) AS k FROM every),
 g AS (SELECT c, juego, count(n_sorteo) AS n, array_to_string(list(n_sorteo ORDER BY n_sorteo) FILTER (WHERE k <= 20), ',') AS ns FROM k GROUP BY c, juego),
 gd AS (SELECT juego, string_agg(missing, ', ' ORDER BY n_sorteo) AS t FROM (SELECT *, row_number() OVER (PARTITION BY juego ORDER BY n_sorteo) AS k FROM gaps) WHERE k <= 20 GROUP BY juego),
 od AS (SELECT juego, string_agg(DISTINCT n, ', ' ORDER BY n) AS t FROM (SELECT juego, {_NAMES}[isodow(fecha)] AS n FROM one WHERE {OFF}) GROUP BY juego)
 SELECT list_position([{', '.join(repr(x) for x in V.ORDER)}], c)::INTEGER AS place, CASE WHEN c IN ({', '.join(repr(x) for x in V.ERRORS)}) THEN 'error' ELSE 'warning' END AS level, c AS "check", g.juego, n AS n_affected, ns AS n_sorteos,
 coalesce(CASE c WHEN 'saltos' THEN gd.t WHEN 'fuera_de_calendario' THEN od.t END, '') AS detail FROM g LEFT JOIN gd ON gd.juego = g.juego LEFT JOIN od ON od.juego = g.juego""")
def validation_report(s, d):
    return V.report(_dirty(s, d), calendar(s)).withColumn("n_sorteos", F.array_join("n_sorteos", ","))


# --- forecasts and scores


def _baseline(s, d):
    return H.frequency_baseline(_members(s, d))


@query("SELECT juego, drum, t, num, round(p, 9) AS p FROM fb")
def baseline_frequency(s, d):
    return _baseline(s, d).select("juego", "drum", "t", "num", F.round("p", 9).alias("p"))


@query("SELECT juego, drum, t, num, round(p0, 9) AS p FROM fb")
def baseline_constant(s, d):
    return H.constant_baseline(_members(s, d)).select("juego", "drum", "t", "num", F.round("p", 9).alias("p"))


SCORES = """, s AS (SELECT juego, t, avg(CASE WHEN drum = 'balls' THEN -CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END END) AS log_loss_balls, avg(CASE WHEN drum = 'balls' THEN (p - y) * (p - y) END) AS brier_balls,
  sum(CASE WHEN drum = 'balls' AND r <= 5 THEN y ELSE 0 END)::BIGINT AS hits, -ln(sum(CASE WHEN drum = 'sb' THEN p * y END)) AS log_loss_sb, sum(CASE WHEN drum = 'sb' THEN (p - y) * (p - y) END) AS brier_sb,
  sum(CASE WHEN drum = 'sb' AND r = 1 THEN y ELSE 0 END)::BIGINT AS hit_sb FROM top GROUP BY juego, t)
"""


def _scores(s, d):
    return E.draw_scores(_forecast(s, d))


@query(SCORES + "SELECT juego, t, round(log_loss_balls, 9) AS log_loss_balls, round(brier_balls, 9) AS brier_balls, hits, round(log_loss_sb, 9) AS log_loss_sb, round(brier_sb, 9) AS brier_sb, hit_sb FROM s")
def draw_scores(s, d):
    return _scores(s, d).select("juego", "t", *[F.round(c, 9).alias(c) for c in ("log_loss_balls", "brier_balls", "log_loss_sb", "brier_sb")], "hits", "hit_sb")


_BALL = "(-(5.0::DOUBLE / 43 * ln(5.0::DOUBLE / 43) + 38.0::DOUBLE / 43 * ln(38.0::DOUBLE / 43)))"
_REFS = {"log_loss_balls": _BALL, "brier_balls": "(5.0::DOUBLE / 43 * 38.0::DOUBLE / 43)", "log_loss_sb": "ln(16.0::DOUBLE)", "brier_sb": "(15.0::DOUBLE / 16)"}


def _interval(c: str, shift: str, name: str) -> str:
    return ", ".join(f"round(avg({c} - {shift}) {sign} 1.96 * stddev_samp({c} - {shift}) / sqrt(count(*)), 8) AS {name}_{end}" for sign, end in (("-", "low"), ("+", "high")))


@query(SCORES + "SELECT juego, count(*) AS n_draws, " + ", ".join(f"round(avg({c}), 8) AS {c}, round(1 - avg({c}) / {r}, 7) AS skill_{c}" for c, r in _REFS.items()) + ", "
  + ", ".join(_interval(c, r, f"{c}_delta") for c, r in _REFS.items() if c.startswith("log")) + ", round(avg(hits), 8) AS hits, " + _interval("hits", "0", "hits") + ", round(avg(hit_sb), 8) AS accuracy_sb, " + _interval("hit_sb", "0", "accuracy_sb") + " FROM s GROUP BY juego")
def evaluation_summary(s, d):
    rows = E.summary(_scores(s, d))
    return rows.select("juego", "n_draws", *[F.round(c, 7 if c.startswith("skill") else 8).alias(c) for c in rows.columns[2:]])


@query("""SELECT juego, num, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier FROM top WHERE drum = 'balls' GROUP BY juego, num""")
def label_losses(s, d):
    return E.label_losses(_forecast(s, d)).select("juego", "num", F.round("log_loss", 9).alias("log_loss"), F.round("brier", 9).alias("brier"))


@query("""SELECT juego, round(avg(x), 9) AS mean_total FROM (SELECT juego, t, sum(p) AS x FROM top WHERE drum = 'balls' GROUP BY juego, t) GROUP BY juego""")
def mean_total(s, d):
    return E.mean_total(_forecast(s, d)).select("juego", F.round("mean_total", 9).alias("mean_total"))


_PMF = ", ".join(repr(x) for x in SPEC.hits_pmf())


@query(SCORES + f"SELECT juego, h::INTEGER AS hits, count(*) FILTER (WHERE hits = h) AS n, round(count(*) * [{_PMF}][h + 1]::DOUBLE, 6) AS expected FROM s, range(0, 6) g(h) GROUP BY juego, h")
def hit_law(s, d):
    return E.hit_law(_scores(s, d)).select("juego", "hits", "n", F.round("expected", 6).alias("expected"))


@query(""", v AS (SELECT juego, round(p, 12) AS p, y FROM top WHERE drum = 'balls'),
e AS (SELECT juego, quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM v GROUP BY juego),
b AS (SELECT juego, least(greatest(len(list_filter(edges, lambda x: round(x, 12) <= p)) - 1, 0), 9)::INTEGER AS bin, p, y FROM v JOIN e USING (juego)),
g AS (SELECT juego, bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM b GROUP BY juego, bin)
SELECT juego, bin, n, round(predicted, 9) AS predicted, round(observed, 9) AS observed, round(1.96 * sqrt(greatest(observed * (1 - observed), 1e-12) / n), 9) AS half_width FROM g""")
def reliability_curve(s, d):
    return E.reliability(_forecast(s, d)).select("juego", "bin", "n", *[F.round(c, 9).alias(c) for c in ("predicted", "observed", "half_width")])


UNIFORM = """, c AS (SELECT juego, num, sum(y)::BIGINT AS seen, count(*) AS n FROM m WHERE drum = 'balls' GROUP BY juego, num)
SELECT juego, max(n) AS n_draws, round(sum((seen - n * 5.0::DOUBLE / 43) ** 2 / (n * 5.0::DOUBLE / 43)), 6) AS chi2, round(sum((seen - n * 5.0::DOUBLE / 43) ** 2 / (n * 5.0::DOUBLE / 43)) * 42 / 38, 6) AS chi2_corrected,
  arg_max(num, seen * 100 - num) AS hottest, arg_min(num, seen * 100 + num) AS coldest, round(max(abs(seen - n * 5.0::DOUBLE / 43) / sqrt(n * 5.0::DOUBLE / 43 * 38.0::DOUBLE / 43)), 6) AS max_abs_z FROM c GROUP BY juego"""


@query(UNIFORM)
def uniformity_chi2(s, d):
    r = E.uniformity(E.label_counts(_daily(s, d)))
    return r.select("juego", "n_draws", F.round("chi2", 6).alias("chi2"), F.round("chi2_corrected", 6).alias("chi2_corrected"), "hottest", "coldest", F.round("max_abs_z", 6).alias("max_abs_z"))


@query("""SELECT juego, round(sum((k - n / 16.0) ** 2 / (n / 16.0)), 6) AS chi2 FROM (SELECT juego, superbalota, count(*) AS k, sum(count(*)) OVER (PARTITION BY juego) AS n FROM d GROUP BY juego, superbalota) GROUP BY juego""")
def uniformity_super(s, d):
    g = _daily(s, d).groupBy("juego", "superbalota").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("juego")) / 16)
    return g.groupBy("juego").agg(F.round(F.sum((F.col("k") - F.col("n")) ** 2 / F.col("n")), 6).alias("chi2"))


@query("""SELECT count(*) AS n, round(avg(common), 9) AS mean_common, sum(same)::BIGINT AS same_extra FROM (SELECT len(list_intersect(l.balls, r.balls)) AS common, (l.superbalota = r.superbalota)::INTEGER AS same FROM d l JOIN d r ON l.n_sorteo = r.n_sorteo WHERE l.juego = 'baloto' AND r.juego = 'revancha')""")
def independence_observed(s, d):
    return common_balls(s, d).agg(F.count("*").alias("n"), F.round(F.avg("common"), 9).alias("mean_common"), F.sum("same_extra").alias("same_extra"))


@query("""SELECT juego, n_sorteo, t, md5('42:' || juego || ':' || n_sorteo) AS key FROM dt""")
def permutation_keys(s, d):
    return H.indexed(_daily(s, d)).select("juego", "n_sorteo", "t", montecarlo._key(F.lit(42), F.col("juego"), F.col("n_sorteo")).alias("key"))


@query("""SELECT x.juego, x.n_sorteo, array_to_string(y.balls, '-') AS balls FROM (SELECT *, row_number() OVER (PARTITION BY juego ORDER BY n_sorteo) AS k FROM d) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY juego ORDER BY md5('42:' || juego || ':' || n_sorteo)) AS k FROM d) y ON x.juego = y.juego AND x.k = y.k""")
def permute_draws(s, d):
    return montecarlo.permuted(_daily(s, d)).select("juego", "n_sorteo", F.array_join("balls", "-").alias("balls"))


@query("""SELECT t, string_agg(num::VARCHAR, '-' ORDER BY num) AS balls, max(x)::INTEGER AS superbalota FROM (SELECT t, num, row_number() OVER (PARTITION BY t ORDER BY md5('42:balls:' || t || ':' || num)) AS r FROM range(0, 500) a(t), range(1, 44) b(num))
  JOIN (SELECT t, arg_min(num, md5('42:sb:' || t || ':' || num)) AS x FROM range(0, 500) a(t), range(1, 17) b(num) GROUP BY t) USING (t) WHERE r <= 5 GROUP BY t""")
def sample_without_replacement(s, d):
    rows = montecarlo.sampled_draws(s.range(500).withColumnRenamed("id", "t"))
    return rows.select("t", F.array_join("balls", "-").alias("balls"), F.col("superbalota").cast("int").alias("superbalota"))


@query("""SELECT juego, n_sorteo, len(list_intersect(balls, [4, 11, 19, 27, 40]))::INTEGER AS hits, (superbalota = 7) AS extra FROM a""")
def backtest(s, d):
    hit = F.size(F.array_intersect("balls", F.array(*map(F.lit, (4, 11, 19, 27, 40)))))
    return D.draws_all(s, d).select("juego", "n_sorteo", hit.alias("hits"), (F.col("superbalota") == 7).alias("extra"))


@query(f"""SELECT juego, h::INTEGER AS hits, e AS extra, count(*) FILTER (WHERE len(list_intersect(balls, [4, 11, 19, 27, 40])) = h AND (superbalota = 7) = e) AS n, round(count(*) * [{_PMF}][h + 1]::DOUBLE * CASE WHEN e THEN 1.0::DOUBLE / 16 ELSE 15.0::DOUBLE / 16 END, 6) AS expected
  FROM a, range(0, 6) g(h), (VALUES (true), (false)) x(e) WHERE e OR h > 2 GROUP BY juego, h, e""")
def prize_categories(s, d):
    """Categories that win something: any hits with the extra label, three or more without."""
    hit = F.size(F.array_intersect("balls", F.array(*map(F.lit, (4, 11, 19, 27, 40)))))
    rows = D.draws_all(s, d).select("juego", hit.alias("h"), (F.col("superbalota") == 7).alias("e"))
    kinds = [(h, e) for h in range(SPEC.drawn + 1) for e in (True, False) if e or h > 2]
    pmf, q = SPEC.hits_pmf(), SPEC.p_extra
    counts = rows.groupBy("juego").agg(F.count("*").alias("all"), *[F.sum(((F.col("h") == h) & (F.col("e") == e)).cast("long")).alias(f"c{k}") for k, (h, e) in enumerate(kinds)])
    cells = [F.struct(F.lit(h).alias("hits"), F.lit(e).alias("extra"), F.col(f"c{k}").alias("n"), F.round(F.col("all") * (pmf[h] * (q if e else 1 - q)), 6).alias("expected")) for k, (h, e) in enumerate(kinds)]
    return counts.select("juego", F.explode(F.array(*cells)).alias("x")).select("juego", "x.*")


@query("SELECT juego || '-' || n_sorteo AS id FROM d WHERE n_sorteo % 50 = 0 OR n_sorteo % 60 = 0")
def append_only_violations(s, d):
    """Of a log that lost some rows, changed others and gained a column."""
    old = _daily(s, d).select(L.prediction_id(F.col("juego"), F.col("n_sorteo")).alias("id"), "n_sorteo", "superbalota", "b1")
    new = old.where("n_sorteo % 50 <> 0").withColumn("b1", F.when(F.col("n_sorteo") % 60 == 0, F.col("b1") + 1).otherwise(F.col("b1"))).withColumn("added", F.lit(1))
    return L.append_only_violations(old, new, "id")
