"""Sources of draws: the derived view over orders, and the CSV forms of histories."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BALLS = ["b1", "b2", "b3", "b4", "b5"]
KEY = ["juego", "n_sorteo"]
COLUMNS = ["fecha", "n_sorteo", "juego", *BALLS, "superbalota"]
SCHEMA = T.StructType(
    [T.StructField("fecha", T.DateType()), T.StructField("n_sorteo", T.LongType()), T.StructField("juego", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in [*BALLS, "superbalota"]]
)
RAW = ["Date", "C1", "C2", "C3", "C4", "C5", "SB", "#Sorteo"]

# Spanish month names as they stand in the history files.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
MONTH_ALIAS = ("setiembre", "septiembre")
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
PLAIN_WEEKDAYS = ["lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"]


def empty_draws(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def strip_accents(c: Column) -> Column:
    return F.translate(c, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def parse_spanish_date(text: Column) -> Column:
    """Day, month name and year with the word "de" between them, as ``7 de Agosto de 1819``, in any case, spacing and
    with or without accents; null where that is no date."""
    words = F.filter(F.split(F.lower(strip_accents(F.trim(text))), " +"), lambda w: w != "")
    shaped = (F.size(words) == 5) & (F.get(words, F.lit(1)) == "de") & (F.get(words, F.lit(3)) == "de")
    day, name, year = (F.get(words, F.lit(k)) for k in (0, 2, 4))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(name == MONTH_ALIAS[0], MONTH_ALIAS[1]).otherwise(name))
    written = shaped & (month > 0) & day.rlike("^[0-9]{1,2}$") & year.rlike("^[0-9]{4}$")
    return F.when(written, F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def weekday_from_name(name: Column) -> Column:
    """0 for Monday to 6, whatever the case and accents; null for any other word."""
    at = F.array_position(F.array(*[F.lit(w) for w in PLAIN_WEEKDAYS]), F.lower(strip_accents(F.trim(name))))
    return F.when(at > 0, (at - 1).cast("int"))


def canonical(df: DataFrame) -> DataFrame:
    """The canonical columns, balls ascending within the row; a missing column is an error before any job."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    balls = F.array_sort(F.array(*[F.col(c).cast("int") for c in BALLS]))
    return df.select(
        F.col("fecha").cast("date").alias("fecha"), F.col("n_sorteo").cast("long").alias("n_sorteo"), F.lower(F.trim("juego")).alias("juego"),
        *[balls[i].alias(c) for i, c in enumerate(BALLS)], F.col("superbalota").cast("int").alias("superbalota"),
    )


def raw_history(spark: SparkSession, path: str, game: str) -> DataFrame:
    """A history file: all text, Spanish dates, a thousands dot in the number."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return canonical(raw_to_columns(rows, game))


def raw_to_columns(rows: DataFrame, game: str) -> DataFrame:
    date = parse_spanish_date(F.col("Date"))
    checked = F.when(date.isNull(), F.raise_error(F.concat(F.lit("no date: "), F.col("Date"))).cast("date")).otherwise(date)
    return rows.select(
        checked.alias("fecha"), F.regexp_replace("`#Sorteo`", r"\.", "").cast("long").alias("n_sorteo"), F.lit(game).alias("juego"),
        *[F.col(f"C{i}").cast("int").alias(f"b{i}") for i in range(1, 6)], F.col("SB").cast("int").alias("superbalota"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern names anything, by the file system it lies on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def raw_histories(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The history files of several games in one table; a file that is missing is only warned of."""
    out = empty_draws(spark)
    for game, path in sorted(files.items()):
        if _exists(spark, path):
            out = out.unionByName(raw_history(spark, path, game))
        else:
            logging.getLogger(__name__).warning("no history of %s at %s", game, path)
    return canonical(out)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical CSV files: all text, then cast; a missing column is an error, other columns are dropped."""
    rows = spark.read.option("header", True).csv(path)
    return canonical(rows.select([F.col(c) for c in rows.columns]))


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """A canonical table, or the empty one where there is none."""
    return read_canonical(spark, path) if _exists(spark, path) else empty_draws(spark)


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """All canonical CSV files of a folder without exact duplicates; none: the empty table."""
    files = f"{folder.rstrip('/')}/*.csv"
    if not _exists(spark, files):
        return empty_draws(spark)
    return read_canonical(spark, files).dropDuplicates(COLUMNS)


def concat_draws(*frames: DataFrame) -> DataFrame:
    """The rows of all tables, canonical."""
    out = frames[0].select(COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(COLUMNS))
    return canonical(out)


def _numbers(df: DataFrame, spec_labels: int = 43) -> DataFrame:
    """Five distinct balls and an extra of 1..16 by arithmetic on an order's key k and customer c."""
    start, step = (F.col("k") * 17 + F.col("c")) % spec_labels, 1 + F.col("c") % (spec_labels - 1)
    balls = F.array_sort(F.array(*[((start + i * step) % spec_labels + 1).cast("int") for i in range(5)]))
    return df.withColumn("balls", balls).withColumn("superbalota", (1 + (F.col("k") + F.col("c")) % 16).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    game = F.when(F.col("o_orderkey") % 2 == 0, "baloto").otherwise("revancha")
    return o.select(game.alias("juego"), F.col("o_orderdate").cast("date").alias("fecha"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def draws_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw a game and day, that of the smallest order key; columns as canonical and ``balls``."""
    first = _orders(spark, sf_dir).groupBy("juego", "fecha").agg(F.min(F.struct("k", "c")).alias("o")).select("juego", "fecha", "o.k", "o.c")
    n = F.row_number().over(Window.partitionBy("juego").orderBy("fecha")).cast("long")
    rows = _numbers(first.withColumn("n_sorteo", n))
    return rows.select("fecha", "n_sorteo", "juego", *[F.col("balls")[i].alias(c) for i, c in enumerate(BALLS)], "superbalota", "balls")


def draws_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a draw, by day and key."""
    n = F.row_number().over(Window.partitionBy("juego").orderBy("fecha", "k")).cast("long")
    rows = _numbers(_orders(spark, sf_dir).withColumn("n_sorteo", n))
    return rows.select("fecha", "n_sorteo", "juego", *[F.col("balls")[i].alias(c) for i, c in enumerate(BALLS)], "superbalota", "balls")


def faulty(draws: DataFrame) -> DataFrame:
    """Draws with faults within rows and in their sequence, by arithmetic on the number."""
    n = F.col("n_sorteo")
    out = draws.select(COLUMNS).withColumn("fecha", F.when(n % 307 != 0, F.col("fecha")))
    out = out.withColumn("b5", F.when(n % 97 == 0, 44).otherwise(F.col("b5"))).withColumn("superbalota", F.when(n % 89 == 0, 17).otherwise(F.col("superbalota")))
    out = out.withColumn("b2", F.when(n % 83 == 0, F.col("b1")).otherwise(F.col("b2"))).withColumn("fecha", F.when(n % 151 == 0, F.date_add("fecha", -9)).otherwise(F.col("fecha")))
    return out.withColumn("juego", F.when(n % 211 == 0, "miloto").otherwise(F.col("juego"))).where("n_sorteo % 101 <> 0")


def dirty(draws: DataFrame) -> DataFrame:
    """The faulty draws with some repeated and some repeated with another extra label."""
    out = faulty(draws)
    other = out.where("n_sorteo % 107 = 0").withColumn("superbalota", F.col("superbalota") % 16 + 1)
    return out.unionByName(out.where("n_sorteo % 103 = 0")).unionByName(other)
