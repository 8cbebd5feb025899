"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, settle, tidy

#: Rows of one key that a task may hold; rows of a key that has more are dealt over several tasks.
HOT_ROWS = 100_000
#: Keys with so many rows come to every task; they are at most as many.
MOST_HOT = 10_000


def spread_join(left: DataFrame, key: str, right: DataFrame, right_key: str, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key), where one key may hold any share of ``left``.

    Keys of more than ``hot_rows`` rows, or of more than a ten-thousandth of the table where that is more, are
    counted first.  Their rows are dealt over as many salts as they hold ``hot_rows``, and their one row on the right
    is repeated for each salt.  At most ten thousand keys can be that frequent, so their list is broadcast.
    """
    spark = left.sparkSession
    with tidy(spark):
        bar = max(hot_rows, left.count() // MOST_HOT)
        hot = {r[key]: -(-r["count"] // bar) for r in left.groupBy(key).count().where(F.col("count") > bar).collect()}
    if not hot:
        return left.join(right, left[key] == right[right_key], how)
    salts = F.broadcast(spark.createDataFrame(list(hot.items()), f"hot_key {left.schema[key].dataType.simpleString()}, salts long"))
    dealt = left.join(salts, left[key] == salts["hot_key"], "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("salts", F.lit(1)))).drop("hot_key", "salts")
    copies = right.join(salts, right[right_key] == salts["hot_key"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hot_key", "salts")
    return dealt.join(copies, (dealt[key] == copies[right_key]) & (dealt["salt"] == copies["copy"]), how).drop("salt", "copy")


def components(links: DataFrame, rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links reach.

    Each round a node takes the smallest label among its own, its neighbours' and its label's own label
    (pointer jumping), so a chain of n links takes about log n rounds.  Labels are settled every round, and those of
    the round before are deleted.  A node with many links, or a label of many nodes, is dealt over several tasks.
    Nodes without a link, null ends and an empty table give no row; links from a node to itself and repeated links
    count for nothing.
    """
    clean = links.select("a", "b").where("a <> b")
    both = settle(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        near = spread_join(both, "b", labels, "node", hot_rows).groupBy("a").agg(F.min("component").alias("near"))
        low = settle(labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low")))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("up"))
        moved = settle(spread_join(low, "low", up, "at", hot_rows).select("node", "old", F.least("low", "up").alias("component")))
        drop(low, labels)
        labels = moved.select("node", "component")
        labels._settled_at = moved._settled_at
        if moved.where("component <> old").isEmpty():
            drop(both)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
