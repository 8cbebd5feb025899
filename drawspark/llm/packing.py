"""Hierarchical packing of documents into sequences of several context lengths.

A document's tokens fill whole windows of the longest tier; what is left goes to the shortest tier that
holds it.  Every tier packs its pieces, longest first, into windows of its own length; gaps of long windows
are filled from shorter tiers, cutting the last piece to fit.  What remains at the end, less than one long
window, is cut by the binary digits of its length into full windows of shorter tiers.  Every task packs the
documents of its own partition, in chunks of bounded size, and writes no shared state, so a lost executor
costs only its own tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, vocabulary

TIERS = (64, 128, 256, 512, 1024)
CHUNK_TOKENS = 1 << 21
STEP_SEQUENCES = 8


def pack(pieces: list[tuple[int, int, int]], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces) of pieces (document, start, length); every token goes to exactly one.

    All sequences are full but at most one; pieces longer than the longest tier are cut into whole windows.
    """
    longest = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    for doc, start, length in pieces:
        while length > longest:
            out.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            waiting[bisect.bisect_left(tiers, length)].append((doc, start, length))
    queues = [deque(sorted(w, key=lambda p: (-p[2], p))) for w in waiting]

    def fit(room: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of the tiers that fit the room, else the head of a longer one, cut."""
        for q in reversed(queues[: bisect.bisect_right(tiers, room)]):
            if q:
                return q.popleft()
        q = next((q for q in queues if q), None)
        if q is None:
            return None
        doc, start, length = q.popleft()
        if length > room:
            rest = length - room
            queues[bisect.bisect_left(tiers, rest)].append((doc, start + room, rest))
            length = room
        return doc, start, length

    for at in range(len(tiers) - 1, -1, -1):
        # a tier is packed into its own windows where its own pieces and the shorter ones can fill them
        size = tiers[at]
        while queues[at] and _holds(queues[: at + 1], size):
            held, room = [queues[at].popleft()], size
            room -= held[0][2]
            while room:
                piece = fit(room)
                held.append(piece)
                room -= piece[2]
            out.append((size, held))
    rest = [p for q in queues for p in q]
    left = sum(p[2] for p in rest)
    for size in (1 << b for b in range(left.bit_length() - 1, -1, -1)):
        if left & size:
            held, room = [], size
            while room:
                doc, start, length = rest.pop()
                if length > room:
                    rest.append((doc, start + room, length - room))
                    length = room
                held.append((doc, start, length))
                room -= length
            out.append((size, held))
    return out


def _holds(queues, least: int) -> bool:
    """Whether the queues hold at least ``least`` tokens; stops counting there."""
    total = 0
    for q in reversed(queues):
        for p in q:
            total += p[2]
            if total >= least:
                return True
    return False


FIELDS = [
    ("id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
]


def packed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers=TIERS, end_id: int = 0, step: int = STEP_SEQUENCES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.  Repeated rows are packed as
    documents of their own.  Only a chunk's last sequences are of shorter lengths, all powers of two, so none is
    padded.  step_group deals a chunk's sequences of one tier into groups of ``step``, so that a group's
    sequences are of one length and its tokens those of any other group of the tier.  A text of any length is packed
    whole, cut into windows of the longest tier, and may be a chunk by itself; pieces of equal length keep the order of
    their documents.  Documents without an id are packed like any other.  An empty table gives an empty result.
    """
    path = path or vocabulary()
    kind = documents.schema[id_col].dataType

    def make(batches):
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 40
        chunk: list[tuple[object, np.ndarray]] = []
        held = seq = groups = 0

        def flush():
            nonlocal seq, groups
            cols: dict[str, list] = {k: [] for k, _ in FIELDS}
            in_tier: dict[int, tuple[int, int]] = {}
            for tier, pieces in pack([(i, 0, len(ids)) for i, (_, ids) in enumerate(chunk)], tiers):
                group, n = in_tier.get(tier, (0, step))
                if n == step:
                    group, n, groups = groups, 0, groups + 1
                in_tier[tier] = (group, n + 1)
                offset = 0
                for doc, start, length in pieces:
                    key, ids = chunk[doc]
                    row = (key, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + seq, offset, tier, base + group)
                    for (k, _), v in zip(FIELDS, row, strict=True):
                        cols[k].append(v)
                    offset += length
                seq += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[k], t or id_type) for k, t in FIELDS], names=[k for k, _ in FIELDS])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                for key, text in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4") if text else np.array([end_id], "<u4")
                    chunk.append((key, ids))
                    held += len(ids)
                    if held >= chunk_tokens:
                        yield flush()
                        chunk, held = [], 0
        if chunk:
            yield flush()

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{k}` {'int' if t == pa.int32() else 'long'}" for k, t in FIELDS[1:])
    return rows.mapInArrow(make, f"id {kind.simpleString()}, {fields}").withColumnRenamed("id", id_col)
