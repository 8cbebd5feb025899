"""Not-modified revisits of a web archive resolved against the full responses they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

#: Headers of a 304 answer that describe the missing body and so never replace those of the stored response.
FIXED_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection")
BUCKET_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and the default port, no scheme, fragment, tracking parameters or final
    slash, query parameters sorted.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")

    def made(x: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(x, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
        path = F.regexp_replace(F.regexp_extract(x, r"^[^/?]*([^?]*)", 1), "/+$", "")
        params = F.array_sort(F.filter(F.split(F.regexp_extract(x, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^utm_")))
        return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))

    return let(bare, made)


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, replaced and added to by the permitted ones of the revisit."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*FIXED_HEADERS))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row a revisit: the latest earlier full response of its canonical URL and the merged headers.

    ``records`` has record_id, kind ('response' or 'revisit'), url, ts (seconds), etag, last_modified and headers
    (lower-case names).  outcome: 'resolved'; 'changed' if both sides have an ETag and these differ, or, without a
    pair of ETags, both have a Last-Modified and these differ; 'unmatched' without an earlier response, as for
    null URLs or times.  Of responses at one time the greatest record_id counts; one at the revisit's own time is
    not earlier.  Repeated revisits are each resolved; other columns are not read; no records, no rows.

    The as-of join is a last-value window within a URL and time bucket, and over the buckets' last responses, so
    a URL with a large share of all captures is spread over its buckets.
    """
    url = F.when(F.col("ts").isNotNull(), canonical_url(F.col("url")))
    is_response = F.col("kind") == "response"
    rows = records.select("record_id", "kind", "ts", "etag", "last_modified", "headers", url.alias("canonical_url"))
    known = rows.where(F.col("canonical_url").isNotNull()).withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    facts = F.struct("ts", "record_id", "etag", "last_modified", F.to_json("headers").alias("headers"))  # maps have no order, their text has
    known = known.withColumn("full", F.when(is_response, facts))
    ends = known.groupBy("canonical_url", "bucket").agg(F.max("full").alias("end"))
    earlier = F.last("end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("canonical_url").alias("u"), F.col("bucket").alias("b"), earlier.alias("carried"))
    order = Window.partitionBy("canonical_url", "bucket").orderBy("ts", F.when(is_response, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = known.withColumn("inside", F.last("full", ignorenulls=True).over(order)).where("kind = 'revisit'")
    found = seen.join(ends, (F.col("canonical_url") == F.col("u")) & (F.col("bucket") == F.col("b"))).withColumn("full", F.coalesce("inside", "carried"))
    found = found.select("record_id", "canonical_url", "ts", "etag", "last_modified", "headers", "full")
    alone = rows.where("kind = 'revisit' and canonical_url is null").select("record_id", "canonical_url", "ts", "etag", "last_modified", "headers", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    every = found.unionByName(alone)
    etags, dates = F.col("etag").isNotNull() & F.col("full.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull()
    differ = F.when(etags, F.col("etag") != F.col("full.etag")).when(dates, F.col("last_modified") != F.col("full.last_modified")).otherwise(F.lit(False))
    outcome = F.when(F.col("full").isNull(), "unmatched").when(differ, "changed").otherwise("resolved")
    merged = F.when(F.col("outcome") == "resolved", merge_headers(F.from_json("full.headers", "map<string,string>"), F.col("headers")))
    return every.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", "outcome", F.when(F.col("outcome") != "unmatched", F.col("full.record_id")).alias("response_id"), merged.alias("headers")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records of an archive made from the table ``pages``: for each page a full response, a revisit five minutes
    later (of another ETag for each seventh page) and one five minutes earlier, by its Last-Modified."""
    p = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("bytes"), (F.lit(1_600_000_000) + F.col("page_id") * 600).alias("t"))
    etag, modified = F.substring("digest", 1, 16), F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string")))
    pair = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])
    none = F.lit(None).cast("string")
    kinds = (
        (0, "response", F.col("url"), 0, etag, modified, pair(content_type=F.lit("text/html"), content_length=F.col("bytes"), server=F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")), date=F.col("t"))),
        (1, "revisit", F.concat("url", F.lit("#again")), 300, F.when(F.col("page_id") % 7 == 0, "new").otherwise(etag), none, pair(content_length=F.lit(0), date=F.col("t") + 300, expires=F.col("t") + 900)),
        (2, "revisit", F.col("url"), -300, none, modified, pair(date=F.col("t") - 300)),
    )
    each = F.array(*[F.struct((F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("kind"), u.alias("url"), (F.col("t") + d).alias("ts"), e.alias("etag"), m.alias("last_modified"), h.alias("headers")) for k, kind, u, d, e, m, h in kinds])
    return p.select(F.explode(each).alias("r")).select("r.*")
