"""Sinks and the logs: deterministic text, append-only.

Tables here are reports and histories of draws, some hundred bytes a row; what grows with the data stays in Spark and
is written as Parquet.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawspark.sources.draws import BALLS, COLUMNS, KEY

#: Rows of a hash block: blocks are hashed apart, then their digests in order.
HASH_ROWS = 100_000


def _write(path: str, text: str, mode: str = "w") -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)


def _csv(header: Sequence[str] | None, rows) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header is not None:
        writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def draws_text(draws: DataFrame) -> str:
    """The canonical CSV of a table of draws: the same rows give the same bytes, whatever their order."""
    rows = draws.select(COLUMNS).orderBy(*KEY, "fecha", *BALLS, "superbalota").collect()
    return _csv(COLUMNS, ([r["fecha"].isoformat() if r["fecha"] else "", *list(r)[1:]] for r in rows))


def write_draws(draws: DataFrame, path: str) -> str:
    _write(path, draws_text(draws))
    return path


def write_incoming(draws: DataFrame, folder: str, prefix: str) -> str | None:
    """``<prefix>_<first>-<last>_<digest>.csv`` with these draws; nothing for an empty table."""
    ends = draws.agg(F.min("n_sorteo"), F.max("n_sorteo")).first()
    if ends[0] is None:
        return None
    text = draws_text(draws)
    path = os.path.join(folder, f"{prefix}_{ends[0]}-{ends[1]}_{hashlib.sha256(text.encode()).hexdigest()[:8]}.csv")
    _write(path, text)
    return path


def digest_frame(table: DataFrame, order: list[str], rows: int = HASH_ROWS) -> DataFrame:
    """One row, ``digest``: a digest of a table's content that no task has to hold whole and that its order does not change.

    Format: rows as comma-separated text, sorted by ``order`` within blocks of about ``rows`` rows that a hash of the
    order columns deals; SHA-256 of each block's lines, then of the blocks' digests joined by line feeds in block order.
    """
    n = max(1, -(-table.count() // rows))
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns])
    # the block of a row depends on its own content, so equal tables have equal blocks
    block = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in order]), F.lit(n)).alias("block")
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    blocks = table.select(block, F.struct(*order, line.alias("line")).alias("x")).groupBy("block").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("d"))
    every = F.transform(F.sort_array(F.collect_list(F.struct("block", "d"))), lambda x: x["d"])
    return blocks.agg(F.sha2(F.array_join(every, "\n"), 256).alias("digest"))


def content_digest(table: DataFrame, order: list[str], rows: int = HASH_ROWS) -> str:
    return digest_frame(table, order, rows).first()["digest"]


def jsonable(value, digits: int = 6):
    """Rows, dates and numbers as JSON takes them: six significant digits, nothing for what is not finite, zero for
    rounding dust."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): jsonable(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v, digits) for v in value]
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    x = float(value)
    if not math.isfinite(x):
        return None
    return 0.0 if abs(x) < 1e-12 else float(f"{x:.{digits}g}")


def write_json(value, path: str) -> None:
    _write(path, json.dumps(jsonable(value), ensure_ascii=False, indent=2) + "\n")


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


# --- logs


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log as a table of the given columns; empty where there is no file, an error where a column is missing.

    Array columns stand as one column an element, named by ``split``.
    """
    empty = spark.createDataFrame([], schema)
    if not os.path.exists(path):
        return empty
    text = spark.read.option("header", True).csv(path)
    if missing := [c for c in empty.columns if c not in text.columns and not _parts(text.columns, c)]:
        raise ValueError(f"{path}: missing columns {missing}")
    cols = []
    for f in empty.schema.fields:
        parts = _parts(text.columns, f.name)
        value = F.array(*[F.col(c).cast("double") for c in parts]) if parts else F.col(f.name).cast(f.dataType)
        cols.append(value.alias(f.name))
    return text.select(*cols)


#: How array columns of chances are spread over columns of a file.
ARRAYS = {"p_balls": "p_b", "p_sb": "p_sb"}


def _parts(columns: Sequence[str], name: str) -> list[str]:
    stem = ARRAYS.get(name)
    return sorted(c for c in columns if stem and c.startswith(stem) and c[len(stem) :].isdigit())


def _flat(rows: DataFrame) -> tuple[list[str], list[list]]:
    found = [r.asDict() for r in rows.collect()]
    header, cells = [], [[] for _ in found]
    for c in rows.columns:
        if c in ARRAYS:
            width = max((len(r[c]) for r in found), default=0)
            header += [f"{ARRAYS[c]}{k:02d}" for k in range(1, width + 1)]
        else:
            header.append(c)
        for out, r in zip(cells, found, strict=True):
            out += r[c] if c in ARRAYS else [r[c]]
    return header, cells


def append_rows(rows: DataFrame, path: str) -> int:
    """Rows added at the end of a log, with a header where the file is new; what stands there is never rewritten."""
    header, cells = _flat(rows)
    if cells:
        new = not os.path.exists(path) or os.path.getsize(path) == 0
        _write(path, _csv(header if new else None, cells), "a")
    return len(cells)


def add_columns(path: str, columns: Sequence[str], values: Sequence[Sequence]) -> None:
    """New columns at the right of every row of a log; the bytes of all other cells stay."""
    with open(path, encoding="utf-8", newline="") as f:
        head, *lines = f.read().replace("\r\n", "\n").rstrip("\n").split("\n")
    if len(lines) != len(values) or any(len(v) != len(columns) for v in values):
        raise ValueError(f"{path}: {len(lines)} rows need {len(columns)} values each")
    _write(path, "\n".join([head + "," + ",".join(columns)] + [line + "," + ",".join(map(str, v)) for line, v in zip(lines, values, strict=True)]) + "\n")


def only_grew(old: str, new: str) -> bool:
    """Whether a log's text only got rows at its end, or columns at the right of every row with all old cells in place."""
    if new.startswith(old):
        return True
    before, after = list(csv.reader(io.StringIO(old))), list(csv.reader(io.StringIO(new)))
    if not before or len(after) < len(before) or len(after[0]) <= len(before[0]):
        return False
    width = len(before[0])
    return all(len(b) == len(after[0]) for b in after) and all(b[:width] == a for a, b in zip(before, after))
