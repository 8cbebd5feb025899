"""Which days draws take place on: segments (start, until, weekdays), each in force until the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days after a draw within which the next one has to come.
AHEAD = 14


def calendar(spark: SparkSession, segments: list[tuple[str, str, list[int]]]) -> DataFrame:
    if not segments or [s[0] for s in segments] != sorted(s[0] for s in segments):
        raise ValueError("segments have to be given, in the order of time")
    return spark.createDataFrame(segments, "start string, until string, weekdays array<int>").select(F.to_date("start").alias("start"), F.to_date("until").alias("until"), "weekdays")


def _in_force(day: str):
    return (F.col(day) >= F.col("start")) & (F.col(day) < F.col("until")) & F.array_contains("weekdays", F.weekday(day))


def following(days: DataFrame, segments: DataFrame) -> DataFrame:
    """(fecha, next_date) of distinct days; an error where no draw comes within two weeks."""
    ahead = days.select("fecha").distinct().withColumn("day", F.explode(F.sequence(F.date_add("fecha", 1), F.date_add("fecha", AHEAD))))
    found = ahead.join(F.broadcast(segments), _in_force("day"), "left").groupBy("fecha").agg(F.min(F.when(F.col("start").isNotNull(), F.col("day"))).alias("next_date"))
    return found.withColumn("next_date", F.coalesce("next_date", F.raise_error(F.concat(F.lit("no draw in the two weeks after "), F.col("fecha").cast("string"))).cast("date")))


def next_days(draws: DataFrame, segments: DataFrame) -> DataFrame:
    """(juego, fecha): the day of every game's next draw."""
    last = draws.groupBy("juego").agg(F.max("fecha").alias("fecha"))
    return last.join(following(last, segments), "fecha").select("juego", F.col("next_date").alias("fecha"))


def draw_days(spark: SparkSession, start: str, n: int, segments: DataFrame) -> DataFrame:
    """(k, fecha): the first n draw days from ``start`` on; a week has one at least."""
    span = spark.range(0, 7 * n + AHEAD).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("fecha"))
    return span.join(F.broadcast(segments), _in_force("fecha")).select("fecha").orderBy("fecha").limit(n).select((F.row_number().over(_line()) - 1).cast("long").alias("k"), "fecha")


def _line():
    from pyspark.sql.window import Window

    return Window.orderBy("fecha")
