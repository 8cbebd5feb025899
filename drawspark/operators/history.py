"""Ordered-sequence operators over a game's draws; features of a draw use earlier draws alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC, GameSpec

#: Draws that a task takes together; those before them that their windows need come on top.
BLOCK = 500


def _order():
    return Window.partitionBy("juego", "drum", "num").orderBy("t")


def _past():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def indexed(draws: DataFrame) -> DataFrame:
    """Adds t, a draw's place in its game from 0."""
    return draws.withColumn("t", (F.row_number().over(Window.partitionBy("juego").orderBy("n_sorteo")) - 1).cast("long"))


def head(draws: DataFrame, n: int) -> DataFrame:
    """The first n draws of every game."""
    return indexed(draws).where(F.col("t") < n)


def membership(draws: DataFrame, spec: GameSpec = SPEC, next_days: DataFrame | None = None) -> DataFrame:
    """A row a draw and label of both drums ('balls', 'sb'), y saying whether it was drawn.

    ``next_days`` (juego, fecha) adds the unknown draw that comes, with y and n_sorteo null.
    """
    rows = indexed(draws).select("juego", "t", "n_sorteo", "fecha", "balls", "superbalota")
    if next_days is not None:
        last = rows.groupBy("juego").agg((F.max("t") + 1).alias("t"))
        after = last.join(next_days.select("juego", "fecha"), "juego")
        nothing = {"n_sorteo": "long", "balls": "array<int>", "superbalota": "int"}
        rows = rows.unionByName(after.select("juego", "t", "fecha", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()]))
    labels = [F.struct(F.lit(d).alias("drum"), F.lit(j).alias("num")) for d, k in spec.drums() for j in range(1, k + 1)]
    each = rows.withColumn("label", F.explode(F.array(*labels))).select("*", "label.drum", "label.num")
    drawn = F.when(F.col("drum") == "balls", F.array_contains("balls", F.col("num"))).otherwise(F.col("superbalota") == F.col("num"))
    return each.select("juego", "drum", "t", "n_sorteo", "fecha", "num", drawn.cast("int").alias("y"))


def past_count() -> Column:
    return F.coalesce(F.sum("y").over(_past()), F.lit(0))


def window_frequency(count: str, start: int, end: int = 0) -> Column:
    """Share of draws t-start .. t-end-1 with the label, over those that exist, from the running count before t."""
    def upto(k: int) -> Column:
        return F.lag(count, k, 0).over(_order()) if k else F.col(count)

    t = F.col("t")
    width = F.greatest(F.greatest(t - end, F.lit(0)) - F.greatest(t - start, F.lit(0)), F.lit(1))
    return (upto(end) - upto(start)) / width


def gap(cap: int = SPEC.gap_cap) -> Column:
    last = F.coalesce(F.max(F.when(F.col("y") == 1, F.col("t"))).over(_past()), F.lit(-1))
    return F.least(F.col("t") - last, F.lit(cap))


def features(members: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """Frequencies, gap, trend and weekdays; all windows share one partitioning and order, so one shuffle."""
    counted = members.withColumn("past", past_count()).withColumn("gap", gap(spec.gap_cap))
    h = spec.trend_half
    day = F.weekday("fecha")
    return counted.select(
        "juego", "drum", "t", "num", "y", "past", *[window_frequency("past", w).alias(f"freq_{w}") for w in spec.windows], "gap",
        (window_frequency("past", h) - window_frequency("past", 2 * h, h)).alias("trend"),
        *[(day == k).cast("double").alias(n) for k, n in ((0, "dia_lunes"), (2, "dia_miercoles"), (5, "dia_sabado"))],
    )


def chance(spec: GameSpec = SPEC) -> Column:
    """The chance of a label of the row's drum."""
    return F.when(F.col("drum") == "balls", F.lit(spec.p_label)).otherwise(F.lit(spec.p_extra))


def constant_baseline(members: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    return members.withColumn("p", chance(spec))


def frequency_baseline(members: DataFrame, a: float = 10.0, spec: GameSpec = SPEC) -> DataFrame:
    """(count before t + a p0) / (t + a), p0 the chance of a label."""
    return members.withColumn("p", (past_count() + a * chance(spec)) / (F.col("t") + a))


def leaky_frequency(members: DataFrame, w: int = 10) -> DataFrame:
    """A rolling frequency that includes the draw itself: wrong on purpose, to show what leakage does."""
    inside = _order().rowsBetween(1 - w, 0)
    return members.withColumn("freq", F.sum("y").over(inside) / F.count("y").over(inside))


def normalized(forecast: DataFrame) -> DataFrame:
    """The extra label's chances made to add up to 1 in every draw; the balls' stay."""
    total = F.sum("p").over(Window.partitionBy("juego", "drum", "t"))
    return forecast.withColumn("p", F.when(F.col("drum") == "sb", F.col("p") / total).otherwise(F.col("p")))


def scaler_statistics(features: DataFrame, block_starts: DataFrame, columns: list[str], spec: GameSpec = SPEC, legacy: bool = False) -> DataFrame:
    """Mean and scale by which the columns of each label are standardised, for the training rows of every block.

    ``block_starts``: (juego, start); a block trains on warmup <= t < start.  The gap counts as log1p of it unless
    ``legacy``; a column without spread has scale 1.  Counts, sums and sums of squares are accumulated once, so a block
    costs one lookup and not one pass.
    """
    rows = features.where((F.col("t") >= spec.warmup) & F.col("y").isNotNull())
    value = lambda c: F.log1p(c) if c == "gap" and not legacy else F.col(c).cast("double")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.select("juego", "drum", "num", "t", F.count("*").over(before).alias("n"), *[x for c in columns for x in (F.sum(value(c)).over(before).alias(f"{c}_s"), F.sum(value(c) ** 2).over(before).alias(f"{c}_q"))])
    at = kept.join(block_starts.withColumnRenamed("start", "t"), ["juego", "t"])
    out = [F.col("juego"), F.col("drum"), F.col("num"), F.col("t").alias("start"), F.col("n")]
    for c in columns:
        mean = F.col(f"{c}_s") / F.col("n")
        spread = F.greatest(F.col(f"{c}_q") / F.col("n") - mean**2, F.lit(0.0))
        out += [mean.alias(f"{c}_mean"), F.when(spread > 1e-18, F.sqrt(spread)).otherwise(1.0).alias(f"{c}_scale")]
    return at.where("n > 0").select(*out)


def window_counts(members: DataFrame, windows: list[int], labels: int, drum: str = "balls", block: int = BLOCK) -> DataFrame:
    """(juego, t, drawn, w, counts): of each label 1..``labels`` whether a draw has it and how many of the w draws before have.

    A game's draws are dealt out in blocks, each with as many draws before its own as the widest window has, so that no
    task holds a game's windows; all windows come from one running count, so forty cost little more than one.
    """
    widest = max(windows)
    size = max(block, widest)
    known = members.where((F.col("drum") == drum) & F.col("y").isNotNull())
    each = known.groupBy("juego", "t").agg(*[F.max(F.when(F.col("num") == j, F.col("y"))).alias(f"y{j}") for j in range(1, labels + 1)])
    drawn = F.array(*[F.coalesce(f"y{j}", F.lit(0)).cast("tinyint") for j in range(1, labels + 1)])
    placed = each.select("juego", "t", drawn.alias("drawn"), (F.row_number().over(Window.partitionBy("juego").orderBy("t")) - 1).alias("place"))
    own = F.floor(F.col("place") / size)
    needed = F.when(F.col("place") % size >= size - widest, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("block", F.explode(needed)).repartition(64, "juego", "block")  # few bytes, much work: not to be coalesced

    order = Window.partitionBy("juego", "block").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    past = F.array(*[F.coalesce(F.sum(F.get("drawn", F.lit(j))).over(before), F.lit(0)).cast("int") for j in range(labels)])
    counted = dealt.withColumn("past", past)
    none = F.array_repeat(F.lit(0), labels)
    pick = F.array(*[F.struct(F.lit(w).alias("w"), F.coalesce(F.lag("past", w).over(order), none).alias("then")) for w in windows])
    picked = counted.select("juego", "t", "drawn", "past", (own == F.col("block")).alias("own"), pick.alias("picked")).where("own")
    x = picked.select("juego", "t", "drawn", "past", F.explode("picked").alias("x"))
    return x.select("juego", "t", "drawn", "x.w", F.zip_with("past", "x.then", lambda now, then: now - then).alias("counts"))
