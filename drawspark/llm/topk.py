"""Exact top-k inner products, pruned by segment statistics at several resolutions.

A vector is cut into segments; with a segment's mean m and deviation s over its w components, the inner product
of two segments is at most w (m m' + s s').  (For distances this is the bound w ((m - m')^2 + (s - s')^2) from
below.)  Sums over few segments are cheap and coarse, over many finer; the finest of them, segments of two, are then
replaced by the components themselves, a quarter of the vector at a time.  Only pairs whose bound reaches the query's
k-th best score so far go on to the next resolution, and the survivors are computed exactly, whole and as integers.

Queries and candidates are dealt into tiles of bounded size that meet in one job.  A first pass over a bounded sample
of the candidates gives every query a floor, which goes to all its tiles with it; inside a tile the candidates of the
highest bounds are computed first, so the floor is near its final height when the others are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, settle, tidy

#: Widths of segments, coarse to fine, and the shares of the vector that finer levels take as it is.
WIDTHS = (16, 4, 2)
SHARES = (0.5, 0.75)
QUERY_TILE = 4096
CANDIDATE_TILE = 8192
SAMPLE_ROWS = 2048
SLICE = 1024
#: Pairs that are computed exactly at once.
PAIRS = 1 << 16
LOW = 62
#: Scores up to here are sums of whole numbers that floating point holds exactly.
EXACT = float(1 << 53)


def _segments(x: np.ndarray, width: int) -> np.ndarray:
    """sqrt(width) times the mean and the deviation of each segment; the last one may be shorter."""
    if not x.shape[1]:
        return x
    cols = []
    whole = x.shape[1] // width * width
    parts = [x[:, :whole].reshape(len(x), -1, width)] if whole else []
    if whole < x.shape[1]:
        parts.append(x[:, None, whole:])
    for p in parts:
        cols += [p.mean(2) * p.shape[2] ** 0.5, p.std(2) * p.shape[2] ** 0.5]
    return np.concatenate(cols, 1)


def resolutions(x: np.ndarray) -> list[np.ndarray]:
    """The matrices whose inner products bound those of the vectors, coarse to fine."""
    d = x.shape[1]
    out = [_segments(x, w) for w in WIDTHS if w < d]
    for share in SHARES if d >= 8 else ():
        k = int(d * share)
        out.append(np.concatenate([x[:, :k], _segments(x[:, k:], WIDTHS[-1])], 1))
    return out


class Best:
    """The k best candidates so far of each query of a tile, and how many pairs were computed exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, vectors, k
        with np.errstate(all="ignore"):
            self.levels, self.norm = resolutions(vectors), np.linalg.norm(vectors, axis=1)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.rows = np.empty((0, 4), np.int64)  # query number, high part of the score, low part, id
        self.pairs = self.computed = 0
        self.useful = [True] * len(self.levels)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(ids), SLICE):
            with np.errstate(all="ignore"):
                self._offer(ids[i : i + SLICE], x[i : i + SLICE])

    def _offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        own, norm = resolutions(x), np.linalg.norm(x, axis=1)
        slack = 1e-11 * self.norm[:, None] * norm[None, :]
        other = self.ids[:, None] != ids[None, :]
        self.pairs += int(other.sum())
        open_, bound = other.copy(), None
        for k, (a, b) in enumerate(zip(self.levels, own, strict=True)):
            last = k == len(own) - 1
            if not (self.useful[k] or last):
                continue
            bound = a @ b.T + slack
            before = np.count_nonzero(open_)
            open_ &= ~(bound < self.floor[:, None])  # not a number stays open
            left = np.count_nonzero(open_)
            self.useful[k] = left < 0.98 * before  # a level that prunes nothing costs more than it saves
            if not left:
                return
        if bound is not None and len(ids) > self.k:
            # the highest bounds first: they raise the floor for the rest
            first = np.argpartition(np.where(open_, -bound, np.inf), self.k - 1, axis=1)[:, : self.k]
            seen = np.zeros_like(open_)
            np.put_along_axis(seen, first, True, axis=1)
            seen &= open_
            self._exact(ids, x, norm, seen)
            open_ &= ~seen & ~(bound < self.floor[:, None])
        self._exact(ids, x, norm, open_)

    def _exact(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, wanted: np.ndarray) -> None:
        r, c = np.nonzero(wanted)
        self.computed += len(r)
        new = []
        plain = len(r) and float(self.norm.max()) * float(norm.max()) < EXACT
        for i in range(0, len(r), PAIRS):
            a, b = r[i : i + PAIRS], c[i : i + PAIRS]
            if plain:
                score = np.einsum("ij,ij->i", self.q[a], x[b]).astype(np.int64)
                high, low, near = score >> LOW, score & ((1 << LOW) - 1), score.astype(float)
            else:
                score = [sum(int(u) * int(v) for u, v in zip(self.q[m], x[n])) for m, n in zip(a, b)]
                high = np.array([max(-(1 << 62), min(1 << 62, s >> LOW)) for s in score], np.int64)
                low = np.array([s & ((1 << LOW) - 1) for s in score], np.int64)
                near = high * 2.0**LOW
            keep = ~(near * (1 + 1e-15 * np.sign(near)) + 2.0**LOW * (not plain) < self.floor[a])
            new.append(np.stack([a[keep], high[keep], low[keep], ids[b[keep]]], 1))
        if not new or not sum(map(len, new)):
            return
        merged = np.concatenate([self.rows, *new])
        merged = merged[np.lexsort((merged[:, 3], -merged[:, 2], -merged[:, 1], merged[:, 0]))]
        first = np.searchsorted(merged[:, 0], np.arange(len(self.ids) + 1))
        self.rows = merged[np.arange(len(merged)) - first[merged[:, 0]] < self.k]
        first = np.searchsorted(self.rows[:, 0], np.arange(len(self.ids) + 1))
        full = np.diff(first) == self.k
        least = self.rows[first[1:][full] - 1]
        floor = least[:, 1] * 2.0**LOW + np.where(np.abs(least[:, 1]) < 1 << 20, least[:, 2], 0).astype(float)
        self.floor[full] = np.maximum(self.floor[full], np.where(least[:, 1] == -1, (least[:, 2] - (1 << LOW)).astype(float), floor))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(64 * flat).reshape(len(column), -1)


def _meet(queries: pa.Table, candidates: pa.Table, k: int):
    """(Best, …) of a query tile and a candidate tile, one for each length of vectors."""
    for d in np.unique(queries.column("d").to_numpy()):
        q, c = queries.filter(pa.compute.equal(queries.column("d"), int(d))), candidates.filter(pa.compute.equal(candidates.column("d"), int(d)))
        best = Best(q.column("id").to_numpy(), _matrix(q.column("v")), k, q.column("floor").to_numpy())
        if c.num_rows:
            best.offer(c.column("id").to_numpy(), _matrix(c.column("v")))
        yield best


def _pass(queries: DataFrame, candidates: DataFrame, k: int, query_tiles: int, candidate_tiles: int) -> DataFrame:
    """(query_no, query_id, high, low, id): of every pair of tiles the k best of each query, in one job."""
    import pyarrow.compute  # noqa: F401

    n = min(query_tiles * candidate_tiles, 1 << 15)
    tile = lambda tiles: F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    q = queries.withColumn("a", tile(query_tiles)).withColumn("b", every(candidate_tiles)).repartition(n, "a", "b")
    c = candidates.withColumn("b", tile(candidate_tiles)).withColumn("a", every(query_tiles)).repartition(n, "a", "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.concatenate([s.ids[s.rows[:, 0]][:, None], s.rows[:, 1:]], 1) for s in _meet(left, right, k)] if left.num_rows else []
        rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        return pa.table({name: pa.array(rows[:, i], pa.int64()) for i, name in enumerate(("query_id", "high", "low", "id"))})

    return q.groupBy("a", "b").cogroup(c.groupBy("a", "b")).applyInArrow(run, "query_id long, high long, low long, id long")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products, ties to the smaller id.

    Components count as floor(64 x).  A query's own rows (those of its id) are no candidates.  Null or empty
    vectors, vectors with null or non-finite components and rows without an id take no part; a pair needs
    vectors of one length.  Rows that repeat an id and a vector count once; ids are whole numbers.  Sums beyond
    2**53 are made of exact integers and ranked as such; a score that a long cannot hold is shown as the nearest it can.
    Queries without a candidate give no row, an empty table none at all.  A task holds 4,096 queries and 8,192
    candidates at most, whatever the table's size.
    """
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull()).where(F.coalesce(usable, F.lit(False)))
    rows = settle(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.size(v).alias("d")).dropDuplicates(["id", "v"]))
    asked = rows.where(is_query(F.col("id")))
    with tidy(vectors.sparkSession):
        n, n_asked = rows.count(), asked.count()
    query_tiles, candidate_tiles = max(1, -(-n_asked // QUERY_TILE)), max(1, -(-n // CANDIDATE_TILE))
    unknown = asked.withColumn("floor", F.lit(float("-inf")))
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, n))))
    seen = _pass(unknown, rows.where(share), k, query_tiles, 1)
    # the k-th best of the sample, a float that is no higher than it
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"))
    whole = F.shiftleft(F.col("high"), LOW) + F.col("low")
    worth = F.when(F.col("high").between(-2, 1), whole.cast("double")).otherwise(F.col("high").cast("double") * 2.0**LOW)
    floors = seen.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("of"), (worth - F.abs(worth) * 1e-14 - 1).alias("floor"))
    known = settle(asked.join(floors, F.col("id") == F.col("of"), "left").select("id", "v", "d", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    every = settle(_pass(known, rows, k, query_tiles, candidate_tiles))
    drop(rows, known)
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    most = (1 << 63) - 1
    score = F.when(F.col("high").between(-2, 1), whole).otherwise(F.when(F.col("high") > 0, F.lit(most)).otherwise(F.lit(-most - 1)))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), score.cast("long").alias("score"))
