"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: a space and the ASCII control characters from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: Spark's own switch for dropping a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="settled-")


def settled_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    A session that names neither gets a folder of this machine if it runs on this machine alone; on a cluster that
    is an error, as files in a machine's own folder are lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = _local_folder()
    return named.rstrip("/")


@contextmanager
def tidy(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read that instead.

    The shuffle files of the query that makes it go when it is written; ``drop`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{settled_folder(spark)}/settled-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(df: DataFrame, group: str, order: list[Column], name: str, rows: int | None = None, rows_per_part: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no task that holds a whole group.

    Rows are dealt by a hash into parts of about ``rows_per_part``; a row's number is its rank in its part
    plus the rows of the group's earlier parts.  Only the counts by group and part meet in a window.  Rows that are
    equal in ``order`` are told apart by the task that read them, so one row repeated without end is dealt as well;
    the parts are settled, so they stay.  ``rows``: how many there are, counted here if not given.
    """
    part, base = free_name(df, "part_no"), free_name(df, "part_base")
    n_parts = max(1, -(-(df.count() if rows is None else rows) // rows_per_part))
    own = df.columns
    df = settle(df.withColumn(part, F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(n_parts))))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.groupBy(group, part).count()
    sizes = counted.select(F.col(group).alias("g__"), F.col(part).alias("p__"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    rank = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1
    ranked = df.withColumn(name, rank).join(sizes, F.col(group).eqNullSafe(F.col("g__")) & (F.col(part) == F.col("p__")))
    return ranked.select(*own, (F.col(name) + F.col(base)).cast("long").alias(name))
