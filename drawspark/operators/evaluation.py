"""Scores of probabilistic forecasts, uniformity and dependence statistics, places in a null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawspark.functions.game import SPEC, GameSpec

EPS = 1e-15
Z95 = 1.96
TOLERANCE = 1e-12
ALPHA = 0.05


def seeded_key(*of: Column) -> Column:
    """The same order in every engine: a digest of a seed and of what names the row."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in of]))


def clipped(p: Column, high: float = 1 - EPS) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(high))


def log_loss(y: Column, p: Column) -> Column:
    return -F.when(y == 1, F.log(clipped(p))).otherwise(F.log1p(-clipped(p)))


def skill(value: Column, reference: float) -> Column:
    return 1 - value / reference


def ranked(forecast: DataFrame, value: Column, name: str = "r", seed: int = SPEC.seed, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank of ``value`` (highest first) within the draw and drum; ties go by a seeded digest.

    Values are compared to twelve digits, so that sums made in another order do not decide a tie.
    """
    keys = ["juego", "drum", "t", *extra]
    order = Window.partitionBy(*keys).orderBy(F.round(value, 12).desc(), seeded_key(F.lit(seed), *[F.col(c) for c in keys], F.col("num")))
    return forecast.withColumn(name, F.row_number().over(order))


def draw_scores(forecast: DataFrame, spec: GameSpec = SPEC, by: tuple[str, ...] = ()) -> DataFrame:
    """Six scores of every draw of a long forecast (juego, drum, t, num, y, p); ``by`` names further keys (model, resample).

    Balls: mean log-loss and Brier score of the labels, hits of the most likely play.  Extra label: log-loss of the one
    drawn, Brier score over the drum, whether the most likely one was drawn.
    """
    y, p, balls = F.col("y"), F.col("p"), F.col("drum") == "balls"
    top = ranked(forecast, p, seed=spec.seed, extra=by)
    return top.groupBy(*by, "juego", "t").agg(
        F.avg(F.when(balls, log_loss(y, p))).alias("log_loss_balls"), F.avg(F.when(balls, (p - y) ** 2)).alias("brier_balls"),
        F.sum(F.when(balls & (F.col("r") <= spec.drawn), y).otherwise(0)).alias("hits"),
        (-F.log(clipped(F.sum(F.when(~balls, p * y))))).alias("log_loss_sb"), F.sum(F.when(~balls, (p - y) ** 2)).alias("brier_sb"),
        F.sum(F.when(~balls & (F.col("r") <= 1), y).otherwise(0)).alias("hit_sb"),
    )


def references(spec: GameSpec = SPEC) -> dict[str, float]:
    """What the constant forecast scores, exactly, whatever is drawn."""
    p, q = spec.p_label, spec.p_extra
    return {"log_loss_balls": -(p * math.log(p) + (1 - p) * math.log(1 - p)), "brier_balls": p * (1 - p), "log_loss_sb": math.log(spec.extras), "brier_sb": 1 - q}


def mean_interval(value: Column) -> tuple[Column, Column]:
    """Ends of the normal interval of a mean; null for a single value."""
    half = Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return F.avg(value) - half, F.avg(value) + half


def summary(scores: DataFrame, spec: GameSpec = SPEC, by: tuple[str, ...] = ()) -> DataFrame:
    """Means, skills against the constant forecast and intervals, a row a game."""
    ref = references(spec)
    out = [F.count("*").alias("n_draws")]
    for c, r in ref.items():
        low, high = mean_interval(F.col(c) - r)
        out += [F.avg(c).alias(c), skill(F.avg(c), r).alias(f"skill_{c}")] + ([low.alias(f"{c}_delta_low"), high.alias(f"{c}_delta_high")] if c.startswith("log") else [])
    for c, name in (("hits", "hits"), ("hit_sb", "accuracy_sb")):
        low, high = mean_interval(F.col(c))
        out += [F.avg(c).alias(name), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return scores.groupBy(*by, "juego").agg(*out)


def label_losses(forecast: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean log-loss and Brier score of every ball over all draws."""
    return forecast.where("drum = 'balls'").groupBy(*by, "juego", "num").agg(F.avg(log_loss(F.col("y"), F.col("p"))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def mean_total(forecast: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over draws of what the balls' chances add up to."""
    per_draw = forecast.where("drum = 'balls'").groupBy(*by, "juego", "t").agg(F.sum("p").alias("total"))
    return per_draw.groupBy(*by, "juego").agg(F.avg("total").alias("mean_total"))


def hit_law(scores: DataFrame, spec: GameSpec = SPEC, by: tuple[str, ...] = (), hits: str = "hits") -> DataFrame:
    """Draws by number of hits beside what chance expects, zeros included."""
    n = scores.groupBy(*by, "juego").agg(F.count("*").alias("n_draws"), *[F.sum((F.col(hits) == h).cast("long")).alias(f"n{h}") for h in range(spec.drawn + 1)])
    rows = F.array(*[F.struct(F.lit(h).alias("hits"), F.col(f"n{h}").alias("n"), (F.col("n_draws") * p).alias("expected")) for h, p in enumerate(spec.hits_pmf())])
    return n.select(*by, "juego", F.explode(rows).alias("x")).select(*by, "juego", "x.*")


def label_counts(draws: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """Appearances of every ball by game, zeros included; counted before the small grid is joined."""
    seen = draws.select("juego", F.explode("balls").alias("num")).groupBy("juego", "num").count()
    totals = draws.groupBy("juego").agg(F.count("*").alias("n"))
    grid = totals.withColumn("num", F.explode(F.sequence(F.lit(1), F.lit(spec.labels))))
    return grid.join(seen, ["juego", "num"], "left").select("juego", "num", "n", F.coalesce("count", F.lit(0)).cast("long").alias("seen"))


def chi_square(seen: Column, expected: Column) -> Column:
    return F.sum((seen - expected) ** 2 / expected)


def chi2_tail(x: Column, df: int) -> Column:
    """P(X >= x) of the chi-squared law by the finite sums that hold for whole degrees of freedom."""
    half, odd = x / 2, df % 2
    powers = F.array(*[F.struct(F.lit(k - odd / 2).alias("k"), F.lit(math.lgamma(k - odd / 2 + 1)).alias("g")) for k in range(odd, (df + odd) // 2)])
    start = 2 * normal_tail(F.sqrt(x)) if odd else F.lit(0.0)
    return F.when(x <= 0, 1.0).otherwise(F.aggregate(powers, start, lambda a, s: a + F.exp(s["k"] * F.log(half) - half - s["g"])))


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for z >= 0 by a continued fraction beyond 2 and by the power series below."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), z, lambda a, k: z + k / a)
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda a: a["total"])
    return F.when(z < 2, 0.5 - density * total).otherwise(density / fraction)


def uniformity(counts: DataFrame, spec: GameSpec = SPEC) -> DataFrame:
    """Chi-squared of the labels against equal chances, plain and corrected for drawing without replacement, with tails."""
    expected = F.col("n") * spec.p_label
    z = (F.col("seen") - expected) / F.sqrt(expected * (1 - spec.p_label))
    out = counts.withColumn("expected", expected).withColumn("z", z)
    g = out.groupBy("juego").agg(
        F.max("n").alias("n_draws"), chi_square(F.col("seen"), F.col("expected")).alias("chi2"),
        F.max_by("num", F.struct(F.col("seen"), -F.col("num"))).alias("hottest"), F.min_by("num", F.struct(F.col("seen"), F.col("num"))).alias("coldest"), F.max(F.abs("z")).alias("max_abs_z"),
    )
    return g.withColumn("chi2_corrected", F.col("chi2") * (spec.labels - 1) / (spec.labels - spec.drawn))


def reliability(forecast: DataFrame, bins: int = 10, drum: str = "balls") -> DataFrame:
    """Observed against mean predicted chance by quantile bins of the prediction; bins without a row are left out."""
    rows = forecast.where(F.col("drum") == drum).select("juego", F.round("p", 12).alias("p"), "y")
    edges = rows.groupBy("juego").agg(F.percentile("p", F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("edges"))
    # the edges are a few numbers a game
    at = F.least(F.greatest(F.size(F.filter("edges", lambda e: F.round(e, 12) <= F.col("p"))) - 1, F.lit(0)), F.lit(bins - 1))
    placed = rows.join(F.broadcast(edges), "juego").select("juego", at.alias("bin"), "p", "y")
    g = placed.groupBy("juego", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    return g.withColumn("half_width", Z95 * F.sqrt(F.greatest(F.col("observed") * (1 - F.col("observed")), F.lit(1e-12)) / F.col("n")))


# --- places in a simulated null


def wilson(p: Column, n_sims: Column) -> tuple[Column, Column]:
    """Interval of a Monte Carlo p-value, which rests on n_sims + 1 cases, within 0 and 1."""
    n, z = n_sims + 1, Z95
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def verdict(p: Column, alpha: float = ALPHA) -> Column:
    return F.when(p < alpha, F.concat(F.lit("se rechaza H0 (p < "), F.lit(str(alpha)), F.lit(")"))).otherwise(F.concat(F.lit("no se rechaza H0 (p >= "), F.lit(str(alpha)), F.lit(")")))


def place_in_null(simulated: DataFrame, observed: DataFrame, keys: list[str], side: str = "greater", centre: float | None = None) -> DataFrame:
    """A row a key: the observed value's p, percentile, the null's mean and central interval, and a verdict.

    ``simulated`` (keys, value), ``observed`` (keys, observed).  p is (1 + values as extreme) / (1 + values); two-sided
    means as far from ``centre``, the null's mean if not given.
    """
    if side not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown side: {side}")
    rows = simulated.join(F.broadcast(observed), keys)
    x, obs = F.col("value"), F.col("observed")
    if side == "two-sided" and centre is None:
        means = simulated.groupBy(*keys).agg(F.avg("value").alias("centre"))
        rows = rows.join(F.broadcast(means), keys)
    mid = F.col("centre") if side == "two-sided" and centre is None else F.lit(centre)
    extreme = {"greater": x >= obs - TOLERANCE, "less": x <= obs + TOLERANCE, "two-sided": F.abs(x - mid) >= F.abs(obs - mid) - TOLERANCE}[side]
    g = rows.groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.count("*").alias("n"), F.sum(extreme.cast("long")).alias("extreme"), F.avg("value").alias("null_mean"),
        F.percentile("value", 0.025).alias("null_low"), F.percentile("value", 0.975).alias("null_high"), (100 * F.avg((x <= obs).cast("double"))).alias("percentile"),
    )
    g = g.withColumn("p", (1 + F.col("extreme")) / (1 + F.col("n")))
    low, high = wilson(F.col("p"), F.col("n"))
    return g.withColumn("p_low", low).withColumn("p_high", high).withColumn("verdict", verdict(F.col("p"))).drop("extreme")


def deciles(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Counts in tenths of 0..1, the last one closed."""
    return values.groupBy(*by, F.least(F.floor(F.round(F.col(column), 12) * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, by: list[str], bins: int = 40) -> DataFrame:
    """Counts in ``bins`` parts of equal width from the smallest to the largest value."""
    ends = values.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor(F.round((F.col(column) - F.col("low")) / width, 9)), F.lit(bins - 1))).otherwise(0)
    return values.join(F.broadcast(ends), by).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ks_uniform(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of values in 0..1 from the uniform law, and its p by the asymptotic series with the
    correction for finite n."""
    order = Window.partitionBy(*by).orderBy(column)
    every = Window.partitionBy(*by)
    rows = values.select(*by, F.col(column).cast("double").alias("v"), F.row_number().over(order).alias("i"), F.count("*").over(every).alias("n"))
    g = rows.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.greatest(F.col("i") / F.col("n") - F.col("v"), F.col("v") - (F.col("i") - 1) / F.col("n"))).alias("d"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * F.col("lam") * F.col("lam")))
    return g.withColumn("lam", lam).withColumn("p_ks", F.when(F.col("lam") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))).drop("lam")


def percentile_summary(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Of percentiles 0..100: n, mean, share in the middle half and from 90 on, tenths, and both tests against chance."""
    from drawspark.functions.game import binomial_two_sided

    u = F.col(column) / 100
    middle = ((u >= 0.25) & (u < 0.75)).cast("long")
    tenth = F.least(F.floor(F.round(u, 12) * 10), F.lit(9))
    g = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.sum(middle).alias("in_middle"), F.avg((u >= 0.9).cast("double")).alias("from_90"),
        F.array(*[F.sum((tenth == k).cast("long")) for k in range(10)]).alias("deciles"),
    )
    binomial = F.udf(lambda k, n: float(binomial_two_sided(k, n, 0.5)), "double")  # one row a game
    ks = ks_uniform(values.select(*by, u.alias("u")), "u", by).select(*by, "p_ks")
    return g.join(ks, by).withColumn("middle_share", F.col("in_middle") / F.col("n")).withColumn("p_binomial", binomial("in_middle", "n"))
