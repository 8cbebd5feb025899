"""Exact n-gram Jaccard join with token-combination prefixes.

A document is the set of hashes of its word shingles; sets x, y link when |x & y| >= t |x | y|.

* Extended prefix.  In the order of the hashes, the first L(n) = min(n, 3 p / 2 + e) shingles of a set of n, with
  p = n - ceil(t n) + 1, are its extended prefix.  Linked sets share k = min over both of L - p + 1 shingles of
  their extended prefixes (a set's k-th shared shingle stands at most at n - ceil(t n) + k).
* Index list.  Shingles of the extended prefixes are counted over all sets.  Inside its extended prefix each set
  puts uncounted and rare shingles first, frequent ones by rising count; the first L - k + 1 + c + s of them are its
  index list, s = p / 3.  Under any one order of all shingles, linked sets share at least c + 1 + s shingles of their
  lists (s of the smaller set).
* Signatures.  A shingle below the frequent count is a signature by itself.  Frequent shingles fall into c
  classes by hash, and two of the same class make one signature.  Of c + 1 shared shingles one is rare or two
  frequent ones share a class, so linked sets share a signature.
* Verification.  A set is first compared to one other only: of the smallest sets of its signatures the one that
  most of them have.  Links merge sets into components; the sets that have enough
  signatures that still span several components (a link takes c + 1 + s shared shingles) are joined among themselves
  by their whole sets, with prefixes for each size of partner, and pairs across components are compared.  Pairs
  inside a component need no look, as only reachability is asked for.  Whole sets, made anew from the texts, decide.

Equal sets are one class from the start and never expanded into pairs.  Sets, not documents, are the nodes of all
links, so rows that share an id but not the text stay apart.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop, free_name, settle, tidy
from .components import components, spread_join

EXTRA = 24
#: Most classes of frequent shingles, by set size: both schemes are written where sizes of linked sets may differ.
SMALL, LARGE = 4, 16
LARGE_FROM, SMALL_TO = 24, 29
MOST_FREQUENT = 1 << 20
#: Bits of the map of repeated shingles: four for each, within these bounds (8 and 128 MB).
LEAST_BITS, MOST_BITS = 1 << 26, 1 << 30
#: Shingles are counted in so many slices by hash, one after the other, so only a slice of them is on disk at a time.
SLICES = 4
#: Sets of one signature that a task compares with all others of it; longer lists are dealt over several tasks.
TILE = 2048
#: Ids (8 MB) up to which the wanted documents are found by a broadcast; beyond it by a shuffled join.
BROADCAST_ROWS = 1 << 20


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one if there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII letters and ASCII spaces alone
    if not words:
        return np.empty(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


class Rule:
    """Lengths that follow from the threshold percent / 100."""

    def __init__(self, percent: int):
        if not 80 <= percent <= 100:
            raise ValueError("sizes of linked sets have to lie within a fifth: percent is 80 to 100")
        self.percent = percent
        # a scheme has fewer classes than its smallest sets share shingles of their lists (that share never falls with n)
        first = next(n for n in range(1, 101) if not self.alone(n) or n == 100)
        self.small = max(1, min(SMALL, min(map(self.least_shared, range(first, SMALL_TO + 1)), default=2) - 1))
        self.large = min(LARGE, min(map(self.least_shared, range(LARGE_FROM, 256))) - 1)

    def need(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.need(n) + 1

    def extended(self, n: int) -> int:
        return min(n, 3 * self.prefix(n) // 2 + EXTRA)

    def shared(self, n: int) -> int:
        """Shingles of the extended prefixes that a set of n shares with any linked set no smaller, at least."""
        return self.extended(n) - self.prefix(n) + 1

    def least_shared(self, n: int) -> int:
        return min(self.shared(n), self.shared(max(1, self.need(n))))

    def spare(self, n: int) -> int:
        """By how many more shingles index lists are extended, to tell near sets from those that share a passage."""
        return self.prefix(n) // 3

    def least_spare(self, n: int) -> int:
        return self.spare(max(1, self.need(n)))

    def alone(self, n: int) -> bool:
        """Sets so small that only an equal set can link."""
        return n == 0 or (self.need(n) == n and self.percent * (n + 1) > 100 * n)

    def classes(self, n: int) -> list[int]:
        return ([self.small] if n < SMALL_TO else []) + ([self.large] if n >= LARGE_FROM else [])


def _index_lists(ext: np.ndarray, n: int, rule: Rule, counted: Counted):
    """(scheme, shingles that are signatures by themselves, frequent shingles for pairs) of each scheme of a set."""
    count = counted.of(ext)
    order = np.lexsort((ext, count))
    for c in rule.classes(n):
        take = order[: len(ext) - rule.least_shared(n) + 1 + c + rule.spare(n)]
        single = count[take] == 0
        own = ext[take][single]
        yield c, own[counted.twice(own)], np.sort(ext[take][~single]).view(np.uint64)


def _signatures(ext: np.ndarray, n: int, rule: Rule, counted: Counted) -> np.ndarray:
    """Even numbers for single shingles, odd ones for pairs."""
    out = []
    for c, single, rest in _index_lists(ext, n, rule, counted):
        out.append(single & ~np.int64(1))
        group = (rest >> np.uint64(7)) % np.uint64(c)
        for g in np.unique(group):
            own = rest[group == g]
            i, j = np.triu_indices(len(own), 1)
            pair = (own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(c)
            out.append((pair ^ (pair >> np.uint64(30))).view(np.int64) | np.int64(1))
    return np.unique(np.concatenate(out)) if out else ext[:0]


def _may_link(open_: DataFrame, rule: Rule, counted: Counted) -> DataFrame:
    """The ids among ``open_`` (rep, n, ext, singles) whose lists can share as many shingles as a link takes.

    ``singles`` counts a set's single signatures that other components have too; frequent shingles may all be shared.
    """
    held = open_.sparkSession.sparkContext.broadcast(counted)

    def make(batches):
        known = held.value
        for batch in batches:
            ids, sizes, exts, singles = batch.columns
            keep = []
            for n, ext, own in zip(sizes.to_pylist(), exts, singles.to_pylist(), strict=True):
                lists = _index_lists(ext.values.to_numpy(), n, rule, known)
                keep.append(any(own + len(rest) >= c + 1 + rule.least_spare(n) for c, _, rest in lists))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep, pa.bool_()))], names=["id"])

    return open_.select("rep", "n", "ext", "singles").mapInArrow(make, "id long")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def _node(s: np.ndarray) -> int:
    """The number of a set: a 64-bit hash of its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def _sets(rows: DataFrame, width: int, rule: Rule, with_ext: bool = True) -> DataFrame:
    """Every column of ``rows`` but the text, the set's size and node, and its extended prefix if wanted."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def make(batches):
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 512):
                sizes, nodes, exts = [], [], []
                for t in texts.slice(i, 512).to_pylist():
                    s = shingles(t, width)
                    sizes.append(len(s))
                    nodes.append(_node(s))
                    if with_ext:
                        exts.append(s[:0] if rule.alone(len(s)) else s[: rule.extended(len(s))])
                cols = [batch.column(f.name).slice(i, 512) for f in kept] + [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())] + ([_lists(exts)] if with_ext else [])
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + ["n", "node"] + ["ext"] * with_ext)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n long, node long" + ", ext array<long>" * with_ext
    return rows.mapInArrow(make, schema)


def _index(reps: DataFrame, rule: Rule, counted: Counted) -> DataFrame:
    held = reps.sparkSession.sparkContext.broadcast(counted)

    def make(batches):
        known = held.value
        for batch in batches:
            ids, sizes, exts = batch.columns
            for i in range(0, batch.num_rows, 1024):
                reps_, ns = ids.slice(i, 1024).to_numpy(), sizes.slice(i, 1024).to_pylist()
                sigs = [_signatures(e.values.to_numpy(), n, rule, known) for e, n in zip(exts.slice(i, 1024), ns, strict=True)] or [np.empty(0, np.int64)]
                who = np.repeat(reps_, [len(x) for x in sigs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(who)], names=["sig", "rep"])

    return reps.select("rep", "n", "ext").mapInArrow(make, "sig long, rep long")


def _numbered(reps: DataFrame) -> DataFrame:
    """``reps`` (node, id, …) with ``rep``, the number that a set has in links.

    That is its smallest id where ids are whole numbers, so the smallest of some sets is the one that came first, which
    later versions mostly resemble; of sets with one smallest id all but one keep their hash, as do all for other ids.
    """
    if reps.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return reps.withColumn("rep", F.col("node"))
    clash = settle(reps.groupBy(F.col("id").alias("of_id")).agg(F.min("node").alias("first"), F.count("*").alias("k")).where("k > 1").select("of_id", "first"))
    known = reps.withColumn("first", F.col("node")) if clash.isEmpty() else reps.join(clash, F.col("id") == F.col("of_id"), "left").drop("of_id").withColumn("first", F.coalesce("first", "node"))
    return known.withColumn("rep", F.when(F.col("first") == F.col("node"), F.col("id").cast("long")).otherwise(F.col("node"))).drop("first")


def _few(pairs: DataFrame) -> DataFrame:
    """The nodes in the pairs."""
    return settle(pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).distinct())


def _marked(nodes: DataFrame) -> DataFrame:
    """For a broadcast if there are few."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes


def _wanted(nodes: DataFrame, reps: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the wanted sets by their numbers, made anew from the texts: from those rows whose id a set has as
    its smallest."""
    of = settle(reps.select("rep", F.col("node").alias("of_node"), F.col("id").alias("of_id")).join(_marked(nodes), F.col("rep") == F.col("at"), "left_semi"))
    texts = rows.join(_marked(of.select("of_id").distinct()), rows["id"] == F.col("of_id"), "left_semi")
    made = _whole(texts, width).join(_marked(of.select("rep", "of_node")), F.col("id") == F.col("of_node"))
    out = settle(made.select(F.col("rep").alias("id"), "shingles").dropDuplicates(["id"]))
    drop(of)
    return out


def _verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, width: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link: first by the extended prefixes, then by the whole sets."""
    p = rule.percent
    ends = _few(pairs)
    known = reps.select("rep", "n", "ext").join(_marked(ends), F.col("rep") == F.col("at"), "left_semi")
    left = known.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("ext").alias("ext_a"))
    right = known.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("ext").alias("ext_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")

    def shared(n):
        prefix = n - F.ceil(n * p / 100).cast("long") + 1
        return F.least(n, F.floor(prefix * 3 / 2).cast("long") + EXTRA) - prefix + 1

    near = settle(
        pairs.join(left, "a").join(right, "b").where(100 * small >= p * large)
        .where(F.size(F.array_intersect("ext_a", "ext_b")) >= F.least(shared(small), shared(large))).select("a", "b")
    )
    drop(ends)
    ends = _few(near)
    sets = _wanted(ends, reps, rows, width)
    links = _linked(near, sets, p)
    drop(near, ends, sets)
    return links


class Counted:
    """What tasks know of the shingles' counts: those of the frequent ones, and a bitmap of all that occur twice.

    The bitmap may also hold others, which only costs work; a shingle that it doesn't hold occurs once.
    """

    def __init__(self, shingles: np.ndarray, counts: np.ndarray, bits: np.ndarray):
        self.shingles, self.counts, self.bits = shingles, counts, bits

    def of(self, s: np.ndarray) -> np.ndarray:
        """Counts; 0 for shingles that are not frequent."""
        if not len(self.shingles):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.counts[at], 0)

    def twice(self, s: np.ndarray) -> np.ndarray:
        at = s & np.int64(8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _counted(sets: DataFrame, least: int, most: int) -> Counted:
    """Counts of the shingles in ``ext``; the bar for frequent ones is doubled until at most ``most`` are left."""
    shingle = sets.select(F.explode("ext").alias("s"))
    slices = [settle(shingle.where(F.pmod(F.shiftright("s", 40), F.lit(SLICES)) == k).groupBy("s").count().where("count > 1")) for k in range(SLICES)]
    counted = slices[0]
    for part in slices[1:]:
        counted = counted.unionByName(part)
    with tidy(sets.sparkSession):
        by_size = counted.groupBy(F.least(F.floor(F.log2("count")), F.lit(62)).cast("int").alias("k")).count().collect()
        n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * sum(r["count"] for r in by_size)).bit_length()))
        at = F.col("s").bitwiseAND(F.lit(n_bits - 1))
        maps = counted.groupBy(F.floor(at / 32768).alias("k")).agg(F.bitmap_construct_agg(at % 32768).alias("m")).toArrow()
        bits = np.zeros(n_bits // 8, np.uint8)
        for k, m in zip(maps["k"].to_pylist(), maps["m"].to_pylist(), strict=True):
            bits[k * 4096 : (k + 1) * 4096] = np.frombuffer(m, np.uint8)
        while sum(r["count"] for r in by_size if 2 << r["k"] > least) > most and counted.where(F.col("count") >= least).count() > most:
            least *= 2
        found = counted.where(F.col("count") >= least).toArrow()  # as Arrow batches: Rows of Python objects take ten times the memory
    drop(*slices)
    s = found["s"].to_numpy()
    order = np.argsort(s)
    return Counted(s[order], found["count"].to_numpy()[order], bits)


def _steps(most: int) -> list[int]:
    """First sizes of size buckets that grow by a twentieth."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return out


def _fine_index(sets: DataFrame, rule: Rule, counted: Counted) -> DataFrame:
    """(sig, rep, n, pos) over whole sets in the order of rising count, with a prefix for each size bucket of a partner.

    For partners of at least m shingles a set of n needs p (n + m) / (100 + p) shared ones, which is far more than
    for the smallest possible partner.  Shingles that occur once are left out.
    """
    p = rule.percent
    held = sets.sparkSession.sparkContext.broadcast(counted)

    def make(batches):
        known = held.value
        steps = _steps(1 << 16)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                cols: list[list] = [[], [], [], []]
                for rep, own in zip(batch.column(0).slice(i, 512).to_pylist(), batch.column(1).slice(i, 512), strict=True):
                    own = own.values.to_numpy()
                    n = len(own)
                    while steps[-1] <= 2 * n:
                        steps.append(steps[-1] * 21 // 20)
                    count, often = known.of(own), known.twice(own)
                    order = np.lexsort((own, count, often))
                    own, often = own[order].view(np.uint64), often[order]
                    least, mine = rule.need(n), bisect.bisect_right(steps, n) - 1
                    for b in range(bisect.bisect_right(steps, least) - 1, bisect.bisect_right(steps, 100 * n // p)):
                        need = -(-p * (n + max(steps[b], least)) // (100 + p))
                        upto = np.arange(max(0, n - need + 1))
                        upto = upto[often[upto]]
                        if len(upto):
                            mark = np.uint64((min(b, mine) * 4096 + max(b, mine) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                            sig = (own[upto] ^ mark) * np.uint64(0xD6E8FEB86659FD93)
                            cols[0].append((sig ^ (sig >> np.uint64(32))).view(np.int64))
                            cols[1].append(np.full(len(upto), rep))
                            cols[2].append(np.full(len(upto), n))
                            cols[3].append(upto + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols], names=["sig", "rep", "n", "pos"])

    return sets.where(F.size("shingles") > 0).mapInArrow(make, "sig long, rep long, n long, pos long")


def _across(open_nodes: DataFrame, labels: DataFrame, reps: DataFrame, rows: DataFrame, width: int, rule: Rule, most_frequent: int, tile: int = TILE) -> DataFrame:
    """All links (a, b) between the given sets that join two components."""
    p = rule.percent
    sets = _wanted(open_nodes, reps, rows, width)
    counted = _counted(sets.select(F.col("shingles").alias("ext")), 2, most_frequent)
    known = labels.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    made = settle(_fine_index(sets, rule, counted).join(known, "rep", "left").select("sig", "rep", "n", "pos", F.coalesce("c", "rep").alias("c")))
    # signatures of one component alone are left out; the others' lists are cut into tiles
    lists = settle(made.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("held")).where("low <> high").select("sig", F.ceil(F.col("held") / tile).alias("tiles")))
    index = made.join(lists, "sig")
    x, y = (index.select("sig", "tiles", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "pos", "c")]) for k in "ab")
    x = x.withColumn("tile", F.pmod(F.xxhash64("rep_a"), F.col("tiles"))).drop("tiles")
    y = y.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    left = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    within = (F.col("rep_a") < F.col("rep_b")) & (F.col("c_a") != F.col("c_b")) & (100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
    # the first shingle that a linked pair shares leaves room for all that it has to share
    within &= (100 + p) * left >= p * (F.col("n_a") + F.col("n_b"))
    pairs = settle(x.join(y, ["sig", "tile"]).where(within).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct())
    links = _linked(pairs, sets, p)
    drop(sets, made, lists, pairs)
    return links


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return settle(pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b"))


def _whole(rows: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of each text, the id that of the set."""

    def whole(batches):
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 512):
                sets = [shingles(t, width) for t in texts.slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], names=["id", "shingles"])

    return rows.select("text").mapInArrow(whole, "id long, shingles array<long>")


def classes(rows: DataFrame, rule: Rule, width: int, frequent_from: int = 8, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(node, id, component) of every set of the rows (id, text): its smallest id, and the smallest number that links reach."""
    base = settle(_sets(rows, width, rule).where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("ext").alias("ext")))
    reps = _numbered(base)
    indexed = reps.where(F.size("ext") > 0)
    counted = _counted(indexed, frequent_from, most_frequent)
    every = settle(_index(indexed, rule, counted))
    heads = every.groupBy("sig").agg(F.min("rep").alias("head"), F.count("*").alias("held")).where("held > 1").select("sig", "head")
    index = settle(every.join(heads, "sig").select("sig", "rep", "head"))
    drop(every)
    common = index.where("rep <> head").groupBy("head", "rep").count()
    stars = settle(common.groupBy(F.col("rep").alias("b")).agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a")).select("a", "b"))
    links = _verified(stars, indexed, rows, width, rule)
    labels = components(links)
    known = settle(index.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("component")))
    drop(stars, index)
    spread = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    singles = known.join(spread, "sig").groupBy("rep").agg(F.sum((F.col("sig") % 2 == 0).cast("long")).alias("singles"))
    open_nodes = settle(_may_link(indexed.join(singles, "rep"), rule, counted).withColumnRenamed("id", "at"))
    drop(known)
    more = _across(open_nodes, labels, reps, rows, width, rule, most_frequent)
    if not more.isEmpty():
        drop(labels)
        labels = components(links.unionByName(more))
    ends = labels.select(F.col("node").alias("end"), "component")
    out = settle(reps.select("rep", "node", "id").join(ends, F.col("rep") == F.col("end"), "left").select("node", "id", F.coalesce("component", "rep").alias("component")))
    drop(base, links, more, open_nodes, labels)
    return out


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def join(documents: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text", frequent_from: int = 8, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Lower-cases A-Z alone; words are split at ASCII white space.  Null, empty and blank texts have no shingle and
    link with nothing, not even each other.  Rows that repeat an id stay rows of their own, linked by their own texts;
    ids may be of any type that has an order.  A null id reaches nothing and is reached by nothing, but its row gets
    the component of an equal text.  Texts of any length count whole.  An empty table gives an empty result.  Only
    the frequent shingles and a bitmap come to the driver and are broadcast: ``most_frequent`` (2**20, 16 MB) at most,
    the bar for frequent rising until they fit, and four bits a repeated shingle, 128 MB at most; both only prune and
    never change the result.  Shingles and sets are told apart by 64-bit hashes.
    """
    rule = Rule(percent)
    rows = _rows(documents, id_col, text_col)
    known = classes(rows, rule, width, frequent_from, most_frequent)
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    of = settle(spread_join(known, "component", smallest.withColumnRenamed("component", "c"), "c").select(F.col("node").alias("of"), "component_id"))
    drop(known)
    made = settle(_sets(rows, width, rule, with_ext=False))  # made anew from the texts; that is cheaper than keeping the lists
    out = spread_join(made, "node", of, "of", how="left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")
    )


def distinct(documents: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with all its columns: of the smallest id, then the smallest hash of the text.

    Documents without words are linked with nothing and stay, and so do rows without an id.  Of rows that are equal in
    id and text one stays, whichever; rows that share an id alone are documents of their own.  An empty table gives an
    empty result.  Whole texts are shuffled once, with the key that both the choice and the removal of repeats use.
    """
    rule = Rule(percent)
    text = F.col(f"`{text_col}`").cast("string")
    has = F.col(f"`{id_col}`").isNotNull() & F.coalesce(text.rlike(WORD), F.lit(False))
    rows = _rows(documents, id_col, text_col)
    known = classes(rows, rule, width)
    narrow = _sets(rows.where("id is not null").withColumn("key", F.xxhash64("text")), width, rule, with_ext=False).where("n > 0")
    groups = narrow.groupBy("node").agg(F.min(F.struct("id", "key")).alias("first"))
    heads = settle(groups.join(known.select("node", "component"), "node").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id").alias("head_id"), F.col("first.key").alias("head_key")))
    drop(known)
    taken, key = documents.columns, free_name(documents, "text_key")
    keyed = documents.where(has).withColumn(key, F.xxhash64(text))
    one = keyed.join(heads, (keyed[id_col] == heads["head_id"]) & (keyed[key] == heads["head_key"]), "left_semi").dropDuplicates([id_col, key])
    kept = one.select(*[F.col(f"`{c}`") for c in taken])
    return kept.unionByName(documents.where(~has))
