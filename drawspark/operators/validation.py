"""Checks of draw tables, in one pass over the rows: every row carries the checks it fails.

Errors stop a table from being taken over, warnings do not.  A report has one row a check and game, in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC, GameSpec
from drawspark.sources.draws import BALLS, COLUMNS, KEY, WEEKDAYS

#: Draws that a report names as examples.
LISTED = 20
ERRORS = ["nulos", "rango_balotas", "rango_superbalota", "repetidas", "filas_duplicadas", "n_sorteo_duplicado", "fecha_duplicada", "saltos", "orden_fechas", "conflicto", "conflicto_entre_fuentes", "juego_desconocido"]
WARNINGS = ["sin_datos", "fuera_de_calendario", "cruce_solo_baloto", "cruce_solo_revancha", "cruce_fecha_distinta"]
#: The order of a report: unknown games, then each game's checks, then the games against each other.
ORDER = ["conflicto_entre_fuentes", "conflicto", "juego_desconocido", "sin_datos", *ERRORS[:9], "fuera_de_calendario", *WARNINGS[2:]]
FOUND = "level string, check string, juego string, n_sorteo long"


def _found(df: DataFrame, check: str) -> DataFrame:
    return df.select(F.lit("error" if check in ERRORS else "warning").alias("level"), F.lit(check).alias("check"), "juego", "n_sorteo")


def _any_ball(test) -> Column:
    return reduce(lambda a, b: a | b, [test(F.col(c)) for c in BALLS])


def flagged(d: DataFrame, calendar: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """The rows with ``checks``, the names of those they fail; and ``before``, the number before theirs.

    Rows with a null fail that check alone.  Copies of a row after the first fail 'filas_duplicadas' and no later
    check; of rows that share a number the first by date, balls and extra label stands for it in the checks of sequence
    and calendar.  Windows are by game and number, by game and date, and by game in the order of numbers.
    """
    clean = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in COLUMNS])
    order = ["fecha", *BALLS, "superbalota"]
    rows = d.select(COLUMNS).withColumn("clean", clean)
    by_number = Window.partitionBy("clean", *KEY)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("clean", *KEY, *order).orderBy("fecha")))
    one = F.col("clean") & (F.col("copy") == 1)
    rows = rows.withColumn("same_number", F.sum(one.cast("int")).over(by_number)).withColumn("place", F.row_number().over(by_number.orderBy(*order, "copy")))
    rows = rows.withColumn("same_date", F.sum(one.cast("int")).over(Window.partitionBy("clean", "juego", "fecha")))
    first = one & (F.col("place") == 1)
    line = Window.partitionBy("clean", "juego", first).orderBy("n_sorteo")
    rows = rows.withColumn("first", first).withColumn("before", F.lag("n_sorteo").over(line)).withColumn("day_before", F.lag("fecha").over(line))
    on = (F.col("fecha") >= F.col("start")) & (F.col("fecha") < F.col("until"))
    rows = rows.join(F.broadcast(calendar), on, "left")  # a few segments
    known = F.col("juego").isin(*spec.games)
    game = F.col("clean") & known
    tests = {
        "nulos": ~F.col("clean") & known, "rango_balotas": game & _any_ball(lambda b: (b < 1) | (b > spec.labels)), "rango_superbalota": game & ~F.col("superbalota").between(1, spec.extras),
        "repetidas": game & (F.size(F.array_distinct(F.array(*BALLS))) < spec.drawn), "filas_duplicadas": game & (F.col("copy") > 1),
        "n_sorteo_duplicado": game & one & (F.col("same_number") > 1), "fecha_duplicada": game & one & (F.col("same_date") > 1),
        "saltos": game & first & (F.col("n_sorteo") - F.col("before") > 1), "orden_fechas": game & first & (F.datediff("fecha", "day_before") <= 0),
        "juego_desconocido": ~known, "fuera_de_calendario": game & first & (F.col("weekdays").isNull() | ~F.array_contains("weekdays", F.weekday("fecha"))),
    }
    failed = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(*COLUMNS, "before", "first", failed.alias("checks"))


def findings(d: DataFrame, calendar: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """(level, check, juego, n_sorteo, before, fecha) of every row and check that it fails."""
    each = flagged(d, calendar, spec).select("juego", "n_sorteo", "before", "fecha", F.explode("checks").alias("check"))
    return each.select(F.when(F.col("check").isin(*ERRORS), "error").otherwise("warning").alias("level"), "check", "juego", "n_sorteo", "before", "fecha")


def gap_text(before: Column, number: Column) -> Column:
    """The missing numbers between two draws: one number, or ``a..b``."""
    return F.when(number - before > 2, F.concat((before + 1).cast("string"), F.lit(".."), (number - 1).cast("string"))).otherwise((before + 1).cast("string"))


def first_of_number(d: DataFrame) -> DataFrame:
    """One row a game and number, the smallest by date, balls and extra."""
    order = Window.partitionBy(KEY).orderBy("fecha", *BALLS, "superbalota")
    return d.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def off_calendar(d: DataFrame, calendar: DataFrame) -> DataFrame:
    """Draws on days that the segment (start, until, weekdays) in force does not name; segments are few."""
    on = (F.col("fecha") >= F.col("start")) & (F.col("fecha") < F.col("until"))
    joined = d.join(F.broadcast(calendar), on, "left")
    return _found(joined.where(F.col("weekdays").isNull() | ~F.array_contains("weekdays", F.weekday("fecha"))), "fuera_de_calendario")


def cross_game(d: DataFrame, left: str, right: str) -> DataFrame:
    """Numbers that one game has alone, and numbers of both with different dates; games that are empty are not compared."""
    days = d.where(F.col("fecha").isNotNull()).where(F.col("juego").isin(left, right)).groupBy("juego", "n_sorteo").agg(F.min("fecha").alias("fecha"))
    both = days.groupBy("n_sorteo").agg(F.max(F.when(F.col("juego") == left, F.col("fecha"))).alias("a"), F.max(F.when(F.col("juego") == right, F.col("fecha"))).alias("b"))
    check = F.when(F.col("b").isNull(), f"cruce_solo_{left}").when(F.col("a").isNull(), f"cruce_solo_{right}").when(F.col("a") != F.col("b"), "cruce_fecha_distinta")
    game = F.when(F.col("check") == f"cruce_solo_{left}", left).when(F.col("check") == f"cruce_solo_{right}", right)
    return both.withColumn("check", check).where(F.col("check").isNotNull()).select(F.lit("warning").alias("level"), "check", game.alias("juego"), "n_sorteo")


def conflicts(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Known draws that arrive with another content."""
    values = [c for c in COLUMNS if c not in KEY]
    a = known.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in values])
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in values])
    return _found(arrived.join(a, KEY).where(differs), "conflicto")


def source_conflicts(collected: DataFrame) -> DataFrame:
    """Numbers that sources give different content for, one row each."""
    distinct = collected.select(COLUMNS).dropDuplicates(COLUMNS)
    return _found(distinct.groupBy(KEY).count().where("count > 1"), "conflicto_entre_fuentes")


def missing_games(d: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    games = d.sparkSession.createDataFrame([(g,) for g in spec.games], "juego string")
    return _found(games.join(d.select("juego").distinct(), "juego", "left_anti").withColumn("n_sorteo", F.lit(None).cast("long")), "sin_datos")


def split_new(known: DataFrame, arrived: DataFrame) -> DataFrame:
    return arrived.join(known.select(KEY), KEY, "left_anti")


def report(d: DataFrame, calendar: DataFrame, spec: GameSpec = SPEC, more: DataFrame | None = None) -> DataFrame:
    """(place, level, check, juego, n_affected, n_sorteos, detail): one row a check and game that found something.

    ``n_sorteos`` lists the first draws, ``detail`` the missing numbers of gaps and the weekdays off the calendar.
    ``more``: further findings (level, check, juego, n_sorteo), as conflicts.
    """
    own = findings(d, calendar, spec)
    text = F.when(F.col("check") == "saltos", gap_text(F.col("before"), F.col("n_sorteo"))).when(F.col("check") == "fuera_de_calendario", F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("fecha") + 1))
    every = own.select("level", "check", "juego", "n_sorteo", text.alias("text"))
    for part in (missing_games(d, spec), cross_game(d, *spec.games), *([more] if more is not None else [])):
        every = every.unionByName(part.withColumn("text", F.lit(None).cast("string")))
    game = F.when(F.col("check") != "juego_desconocido", F.col("juego"))
    keep = lambda x: F.slice(F.transform(F.sort_array(x), lambda s: s["n"]), 1, LISTED)
    # the smallest numbers alone are kept while groups are merged: few rows fail, but one check may fail everywhere
    ranked = every.withColumn("juego", game).withColumn("k", F.row_number().over(Window.partitionBy("level", "check", game).orderBy("n_sorteo")))
    g = ranked.groupBy("level", "check", "juego").agg(
        F.count("n_sorteo").alias("n_affected"), keep(F.collect_list(F.when(F.col("k") <= LISTED, F.struct(F.col("n_sorteo").alias("n"))))).alias("n_sorteos"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when((F.col("k") <= LISTED) | (F.col("check") == "fuera_de_calendario"), F.struct(F.when(F.col("check") == "saltos", F.col("n_sorteo")).alias("n"), F.col("text").alias("t"))))), lambda s: s["t"]), ", ").alias("detail"),
    )
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("check"))
    return g.select(place.cast("int").alias("place"), "level", "check", "juego", "n_affected", "n_sorteos", "detail")


class ValidationError(ValueError):
    """A table failed its checks; ``issues`` holds the report's rows."""

    def __init__(self, issues: list):
        self.issues = issues
        lines = [f"[{r['juego'] or '-'}] {r['check']}: {r['n_affected']} ({', '.join(map(str, r['n_sorteos']))})" for r in issues if r["level"] == "error"]
        super().__init__("validation failed:\n  " + "\n  ".join(lines[:10]))


def checked(d: DataFrame, calendar: DataFrame, spec: GameSpec = SPEC, more: DataFrame | None = None, must: bool = True) -> list:
    """The report's rows in order; an error if any is one and ``must``."""
    rows = report(d, calendar, spec, more).orderBy("place", "juego").collect()
    if must and any(r["level"] == "error" for r in rows):
        raise ValidationError(rows)
    return rows
