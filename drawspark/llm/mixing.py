"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

1. Targets: the weights' shares of the wanted total, none above ``most`` times its source's size.
2. The blocks go to sources by the highest quotients target / (2 k + 1), no source beyond ``most`` copies.
3. Each source's blocks go to its shards by the highest quotients of the shards' sizes, in two steps (groups of
   shards, then the shards of a group), so a shard gets an integer quota and can be drawn alone.
4. A shard's documents, in seeded order, are one stream of words, cut into equal blocks; a systematic draw
   with a seeded start takes the quota.  A document takes what its stretch of the stream has of those blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, settle, tidy
from .components import spread_join

#: A shard holds about so many words or documents of one source, whichever makes it smaller.
SHARD_WORDS = 1 << 21
SHARD_ROWS = 2000
#: Shards of a source whose quotas one task works out; a source may have the square of it.
GROUP_SHARDS = 4096
BLOCK_WORDS = 64
#: Sources up to which their figures are broadcast; beyond it they are joined with hot sources dealt out.
BROADCAST_SOURCES = 100_000


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); ties go to the earlier one; nobody gets beyond its cap."""
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(w > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def given(d: float) -> np.ndarray:
        return np.minimum(caps, np.floor(w / d + 0.5).astype(np.int64))

    low, high = w[w > 0].min() / (2 * caps.max() + 2), 3 * w.max() + 1
    for _ in range(100):  # at low nobody is short of a seat, at high there is none
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    got = given(high)
    while (short := seats - int(got.sum())) > 0:
        quotient = np.where(got < caps, w / (2 * got + 1), -1.0)
        got[np.argsort(-quotient, kind="stable")[: min(short, int((quotient > 0).sum()))]] += 1
    return got


def capped_targets(sizes, weights, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight; what a source's limit cuts off is shared anew until none is above."""
    limit, w = np.asarray(sizes, float) * most, np.asarray(weights, float)
    target, open_ = np.zeros(len(w)), (limit > 0) & (w > 0)
    left = min(float(total), float(limit[open_].sum()))
    while open_.any():
        share = left * w / w[open_].sum()
        over = open_ & (share >= limit)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = limit[over]
        left -= float(limit[over].sum())
        open_ &= ~over
    return target


def whole_copies(sizes, wanted: int, most: int) -> np.ndarray:
    """How often to take each of some whole documents so that their sizes add up to nearly ``wanted``.

    From the largest down, each document is taken as often as its share so far leaves room for; what one leaves over the
    next ones take.  What is left at the end goes by single copies, the largest first, where one more brings the sum
    nearer.
    """
    sizes = np.asarray(sizes, np.int64)
    total, out = int(sizes.sum()), np.zeros(len(sizes), np.int64)
    if 2 * wanted > most * total:  # what is left out is chosen in the same way
        return np.where(sizes > 0, most - whole_copies(sizes, most * total - wanted, most), 0)
    due = have = 0
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        if n == 0:
            continue
        due += n
        out[i] = min(most, max(0, (due * wanted - have * total) // (n * total)))
        have += int(out[i]) * n
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        if 0 < n < 2 * (wanted - have) and out[i] < most:
            out[i], have = out[i] + 1, have + n
    return out


def _drawn(narrow: DataFrame, weights, share: float, most: int, seed: int) -> DataFrame:
    """``narrow`` (id, source, size, …) with draw, source_size, target, shard and taken."""
    spark = narrow.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    narrow = settle(narrow.withColumn("draw", F.xxhash64("id", F.lit(seed))).withColumn("key", key))
    with tidy(spark):
        sources = narrow.groupBy("key", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas()
    sources["last"] = sources.source.isna()
    sources["at"] = sources.source.map(lambda x: x.encode("utf-32-be") if isinstance(x, str) else b"")
    sources = sources.sort_values(["last", "at"]).reset_index(drop=True)
    total = int(sources["size"].sum())
    sources["weight"] = [weights[i % len(weights)] for i in range(len(sources))]
    sources["target"] = capped_targets(sources["size"], sources.weight, share * total, most)
    sources["shards"] = np.maximum(1, np.maximum(-(-sources["size"] // SHARD_WORDS), -(-sources["rows"] // SHARD_ROWS))).astype(np.int64)
    least = sources.target[sources.target > 0].min() if total else 0
    block = max(1, min(BLOCK_WORDS, int(least) // 512))
    blocks = np.maximum(1, np.round(sources["size"] / block)).astype(np.int64)
    sources["quota"] = sainte_lague(sources.target, round(sources.target.sum() / block), most * blocks + sources.shards * most)
    facts = spark.createDataFrame(
        [(r.key, int(r.size_), float(r.target), int(r.quota), int(r.shards)) for r in sources.rename(columns={"size": "size_"}).itertuples()],
        "of string, source_size long, target double, quota long, shards long",
    )
    known = narrow.join(F.broadcast(facts), F.col("key") == F.col("of")) if len(sources) <= BROADCAST_SOURCES else spread_join(narrow, "key", facts, "of")
    rows = known.drop("of").withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards"))).withColumn("pool", F.floor(F.col("shard") / GROUP_SHARDS))
    n = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long")
    parts = rows.groupBy("key", "pool", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota")).withColumn("blocks", n)

    def shared(name: str, by: list[str]):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(by)
            got = sainte_lague(rows["words"], int(rows["quota"].iloc[0]), most * rows["blocks"])
            return pd.DataFrame({c: rows[c] for c in ["key", *by, "words", "blocks"]} | {name: got})

        return run

    pools = parts.groupBy("key", "pool").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("quota").alias("quota"))
    pools = pools.groupBy("key").applyInPandas(shared("own", ["pool"]), "key string, pool long, words long, blocks long, own long")
    own = pools.select(F.col("key").alias("k"), F.col("pool").alias("p"), F.col("own").alias("quota"))
    shards = parts.drop("quota").join(own, (F.col("key") == F.col("k")) & (F.col("pool") == F.col("p")))
    quotas = shards.groupBy("key", "pool").applyInPandas(shared("taken_blocks", ["pool", "shard"]), "key string, pool long, shard long, words long, blocks long, taken_blocks long")
    quotas = quotas.select(F.col("key").alias("k"), F.col("shard").alias("s"), "words", "blocks", "taken_blocks")
    order = Window.partitionBy("key", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("place", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = placed.join(quotas, (F.col("key") == F.col("k")) & (F.col("shard") == F.col("s")))
    out = out.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1)))).otherwise(F.lit(0)))
    # block i is the stretch of words whose place p has p * blocks div words = i; the draw takes
    # floor((i + 1 + start) q / n) - floor((i + start) q / n) copies of it
    taken = F.expr(
        """CASE WHEN size = 0 OR taken_blocks = 0 THEN 0L ELSE
        aggregate(sequence((place * blocks) div words, ((place + size - 1) * blocks) div words), 0L, (acc, i) -> acc
          + ((((i + 1 + start) * taken_blocks) div blocks) - (((i + start) * taken_blocks) div blocks))
          * (least(place + size, ((i + 1) * words + blocks - 1) div blocks) - greatest(place, (i * words + blocks - 1) div blocks))) END"""
    )
    return out.withColumn("taken", taken.cast("long"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(documents: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """One row a document: id, source, size, its source's size and target, and the words that the mix takes.

    Null and empty texts have size 0 and take 0; a null source is a source of its own, the last.  Sources
    without words have target 0.  Repeated rows are rows of their own; a text of any length counts whole and may be
    taken in part.  Rows without an id take part, as if they shared one.  An empty table gives an empty result.
    Figures of the sources come to the driver (a catalogue, not data: some 100 bytes a source); figures by source and
    shard are spread out.
    """
    narrow = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(F.col(f"`{text_col}`")).alias("size"))
    rows = _drawn(narrow, weights, share, most, seed)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns only.

    Every shard takes the words that ``mix`` takes of it, in whole documents (``whole_copies``).  Documents without
    words are not taken.  Rows that are equal in id, text and source are taken together, so an id may be missing or
    repeated.  An empty table gives an empty result.
    """
    key, times = free_name(documents, "row_key"), free_name(documents, "times")
    same = F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{source_col}`").isNull())
    narrow = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(F.col(f"`{text_col}`")).alias("size"), same.alias("same"))
    drawn = _drawn(narrow, weights, share, most, seed).select(F.col("id").cast("string").alias("id"), "same", "key", "shard", "size", "taken")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "same"], ascending=False, kind="stable")
        return pd.DataFrame({"id": rows["id"], "same": rows["same"], "n": whole_copies(rows["size"], int(rows["taken"].sum()), most)})

    kind = narrow.schema["id"].dataType.simpleString()
    copies = drawn.groupBy("key", "shard").applyInPandas(whole, "id string, same long, n long").groupBy(F.col("id").cast(kind).alias("id"), "same").agg(F.sum("n").alias(times)).where(F.col(times) > 0)
    copies = settle(copies).withColumnRenamed("id", free_name(documents, "copy_id")).withColumnRenamed("same", free_name(documents, "copy_key"))
    at, of, _ = copies.columns
    joined = documents.withColumn(key, same).join(copies, F.col(f"`{id_col}`").eqNullSafe(F.col(at)) & (F.col(key) == F.col(of)))
    one = joined.dropDuplicates([id_col, key])
    repeat = free_name(documents, "repeat")
    return one.withColumn(repeat, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in documents.columns])
