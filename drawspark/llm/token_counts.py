"""Exact histogram of encoded lengths; suffix sums over it answer questions for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle
from .encoding import encoder, vocabulary


def lengths(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The number of tokens of every whole text, however long; null and empty texts have 0.

    Repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    path = path or vocabulary()

    def count(batches):
        encode = encoder(path)
        for batch in batches:
            ids, texts = batch.columns
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())], names=["id", "n_tokens"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)


def histogram(counted: DataFrame) -> DataFrame:
    """How many documents have each number of tokens; repeated rows count each, an empty table gives no row."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, block: int = 256) -> DataFrame:
    """One row a length L that occurs: what a context limit of L tokens keeps, cuts and reaches.

    docs, tokens: of that length; docs_over, tokens_over: of greater lengths; truncated_tokens: all tokens
    if every document is cut at L; whole_docs: documents that fit; docs_total, tokens_total; quantile: the
    share of documents of at most L tokens.  Sums are taken within blocks of lengths, then over blocks, so
    a window never holds more than ``block`` lengths or the blocks.  The histogram, small beside the texts, is
    settled first, so no text is encoded twice.  An empty table gives no row.
    """
    hist = settle(hist)
    own = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = own.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = own.select("*", F.coalesce(F.sum("docs").over(inside), F.lit(0)).alias("d_in"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in"))
    out = over.join(blocks, "block").select(
        "n_tokens", "docs", "tokens", (F.col("d_in") + F.col("d_later")).alias("docs_over"), (F.col("t_in") + F.col("t_later")).alias("tokens_over"), "docs_total", "tokens_total"
    )
    return out.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
        (F.col("docs_total") - F.col("docs_over")).alias("whole_docs"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )
