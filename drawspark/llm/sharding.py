"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents of equal text are linked.  A text's documents are first condensed to at most ``CELLS`` cells by a
hash of their ids, so a text that holds a third of all rows is no hot group, and a text's links are a star
over its cells rather than pairs.  In every round each cell asks for the shard where most bytes of its text
lie; of those that ask, a shard admits as many as its quota and what leaves it leave room for.  Whole texts and
documents without a link then even out the sizes.  Texts of more bytes than a shard fill whole shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, let, numbered, settle, tidy

CELLS = 256
BINS = 1 << 16
#: Rounds of propagation at most; it ends when no cell asks for another shard.
MOST_ROUNDS = 12
#: Rows, of about 100 bytes each, that a partition of the working tables holds; small tables get eight partitions.
PART_ROWS = 50_000
#: By what share of the mean a shard may exceed it: after single documents, and after whole texts have moved.
FINE, COARSE = 0.001, 0.05


def _bin(bins: int, *of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(bins)).cast("int")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    with tidy(rows.sparkSession):
        loads = {r["shard"]: r["load"] for r in rows.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [loads.get(s, 0) for s in range(shards)]


def _shift(rows: DataFrame, shards: int, movable: Column, spot: Column, slack: float, over: float = 0.0) -> DataFrame | None:
    """``rows`` (with size and shard) with some of the movable ones brought from shards above the mean to those below.

    Rows leave in the order of their bin ``spot``, whole bins only and never more than a shard has too much or another
    has room for, which is up to the mean and the share ``over`` of it.  The driver sees loads and bin ranges by shard.  None: no shard is beyond the mean by more than
    the slack's share, or nothing can go.
    """
    load, shard = _loads(rows, shards), F.col("shard")
    mean = sum(load) / shards
    spare = {s: load[s] - mean for s in range(shards) if load[s] > mean}
    room = {s: mean * (1 + over) - load[s] for s in range(shards) if load[s] < mean}
    if not spare or max(spare.values()) <= mean * slack:
        return None
    plan = []  # (from, to, first byte, last byte) on the axis of a shard's movable bytes
    done = dict.fromkeys(spare, 0.0)
    while spare and room:  # the fullest shard gives to the emptiest
        s, t = max(spare, key=lambda x: spare[x]), max(room, key=lambda x: room[x])
        n = min(spare[s], room[t])
        plan.append((s, t, int(done[s]), int(done[s] + n)))
        done[s] += n
        for left, x in ((spare, s), (room, t)):
            left[x] -= n
            if left[x] < 1:
                del left[x]
    able = movable & shard.isin([s for s, *_ in plan])
    bins = rows.where(able).groupBy("shard", spot.alias("bin")).agg(F.sum("size").alias("bytes"))
    up_to = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bin"))
    ends = bins.select("shard", "bin", up_to.alias("stop"), (up_to - F.col("bytes")).alias("start"))
    steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for s, t, lo, hi in plan])
    step = F.filter(steps, lambda x: (x["s"] == shard) & (F.col("start") >= x["lo"]) & (F.col("stop") <= x["hi"]))
    with tidy(rows.sparkSession):
        ranges = ends.withColumn("to", F.get(step, F.lit(0))["t"]).where("to is not null").groupBy("shard", "to").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).collect()
    if not ranges:
        return None
    moves = F.array(*[F.struct(F.lit(r["shard"]).alias("s"), F.lit(r["to"]).alias("t"), F.lit(r["a"]).alias("a"), F.lit(r["b"]).alias("b")) for r in sorted(ranges)])
    to = F.when(able, F.get(let(spot, lambda bin: F.filter(moves, lambda x: (x["s"] == shard) & bin.between(x["a"], x["b"]))), F.lit(0))["t"])
    out = settle(rows.withColumn("shard", F.coalesce(to, "shard")))
    drop(rows)
    return out


def _admitted(load: list[int], flow: dict[tuple[int, int], int], cap: float) -> list[float]:
    """The share of what asks for each shard that it can take, counting what leaves it; a fixed point from below."""
    share = [1.0] * len(load)
    for _ in range(50):
        for t in range(len(load)):
            into = sum(n for (_, x), n in flow.items() if x == t)
            out = sum(n * share[x] for (s, x), n in flow.items() if s == t)
            share[t] = min(share[t], max(0.0, (cap - load[t] + out) / into)) if into else 1.0
    return share


def _propagate(cells: DataFrame, shards: int, cap: float, pinned: list[int]) -> DataFrame:
    """Cells (text, cell, size, shard) after the rounds, every text whole; a round is one join by text and two small collects.

    ``pinned`` bytes of each shard are taken already.  What the rounds leave split joins its largest part at the end.
    """
    for k in range(MOST_ROUNDS + 1):
        loads = cells.groupBy("text", "shard").agg(F.sum("size").alias("load"))
        home = F.max_by("shard", F.struct("load", F.xxhash64("text", "shard", F.lit(k))))
        homes = loads.groupBy(F.col("text").alias("of")).agg(home.alias("home"), F.count("*").alias("n")).where("n > 1")
        asked = settle(cells.join(homes, F.col("text") == F.col("of"), "left").select("text", "cell", "size", "shard", F.when(F.col("home") != F.col("shard"), F.col("home")).alias("wish")))
        drop(cells)
        with tidy(cells.sparkSession):
            flow = {(r["shard"], r["wish"]): r["bytes"] for r in asked.where("wish is not null").groupBy("shard", "wish").agg(F.sum("size").alias("bytes")).collect()}
        cells = asked
        if not flow:
            break
        load = [a + b for a, b in zip(_loads(asked, shards), pinned, strict=True)]
        share = _admitted(load, flow, cap) if k < MOST_ROUNDS else [1.0] * shards
        lot = F.pmod(F.xxhash64("text", F.lit(k), F.lit("lot")), F.lit(1 << 20)) / (1 << 20)
        go = F.col("wish").isNotNull() & (lot < F.get(F.array(*[F.lit(float(x)) for x in share]), F.col("wish")))
        cells = settle(asked.select("text", "cell", "size", F.when(go, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
        drop(asked)
    return cells


def shard(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row a document: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards get nearly equal sizes.  Documents of equal text share a shard unless the text's
    documents are more than a shard's quota (these fill whole shards, so few parts are cut) or sizes could not be
    evened out within 5 % otherwise; then a text at the end of a range is cut, at most one for each pair of shards.
    Null texts have size 1, the checksum of no bytes, and are linked with nothing; empty texts are equal to each other.
    Repeated rows are rows of their own.  A document larger than a shard's quota makes its shard that much larger.
    An empty table gives an empty result.  Slots count each shard's rows from 0 without gaps.  grown_shard is null
    under this law.
    """
    text = F.col(f"`{text_col}`")
    base = documents.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("text"),
    )
    spark = documents.sparkSession
    cell = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(CELLS)).cast("int")
    docs = settle(base.withColumn("cell", cell))
    with tidy(spark):
        known = docs.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, parts = known["size"] or 0, max(8, -(-known["n"] // PART_ROWS))
    quota = max(1, -(-total // shards))
    u = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    cells = docs.where("text is not null").groupBy("text", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    texts = cells.groupBy("text").agg(F.sum("rows").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    linked = settle(cells.join(texts.select("text", "bytes"), "text").select("text", "cell", "size", "bytes").coalesce(parts))
    # texts beyond a shard's quota are fewer than the shards, their cells fewer than 256 times that: one window holds them
    before = F.sum("size").over(Window.orderBy("text", "cell").rowsBetween(Window.unboundedPreceding, -1))
    place = F.least(F.lit(shards - 1), F.floor(F.coalesce(before, F.lit(0)) / quota)).cast("int")
    large = settle(linked.where(F.col("bytes") > quota).select("text", "cell", "size", place.alias("shard")))
    pinned = _loads(large, shards)
    # everything else starts where shards have room, by the hash of a cell or of an id
    room = [max(0.0, quota - x) for x in pinned]
    bounds, up_to = [], 0.0
    for x in room:
        up_to += x / max(1.0, sum(room))
        bounds.append(up_to)
    start = lambda v: F.least(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= v)), F.lit(shards - 1))
    small = linked.where(F.col("bytes") <= quota).select("text", "cell", "size", let(u("text", "cell"), start).alias("shard"))
    moved = _propagate(settle(small), shards, quota * (1 + COARSE), pinned)
    labels = moved.select("text", "cell", F.col("shard").alias("label"), F.lit(False).alias("pinned"))
    labels = labels.unionByName(large.select("text", "cell", F.col("shard").alias("label"), F.lit(True).alias("pinned")))
    joined = docs.join(labels, ["text", "cell"], "left")
    rows = settle(
        joined.select("id", "size", "text_crc32", F.xxhash64("text").alias("text"), F.coalesce("label", let(u("id"), start)).alias("shard"), F.col("label").isNotNull().alias("linked"), F.coalesce("pinned", F.lit(False)).alias("pinned")).coalesce(parts)
    )
    drop(docs, linked, moved, large)
    single, whole = ~F.col("linked"), F.col("linked") & ~F.col("pinned")
    steps = [(single, _bin(BINS, "id", F.lit(k)), FINE, 0.0) for k in range(3)] + [(whole, _bin(BINS, "text", F.lit(k)), COARSE / 2, 0.9 * COARSE) for k in range(8)]
    steps += [(single, _bin(BINS, "id", F.lit(k)), FINE, 0.0) for k in range(3, 6)]
    # only where sizes are still further apart: ranges whose ends may cut a text
    steps += [(F.lit(True), _bin(1 << 10, "text", F.lit(k)) * 64 + _bin(64, "id", F.lit(k)), COARSE, 0.0) for k in range(3)]
    for step in steps:
        rows = _shift(rows, shards, *step) or rows
    out = numbered(rows, "shard", [F.col("id"), F.col("text_crc32"), F.col("size")], "slot", known["n"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
