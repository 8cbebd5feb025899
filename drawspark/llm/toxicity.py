"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on those passages of toxic text whose word stems stand
mostly in toxic documents.  Every window of words is compressed twice, primed with the ordinary dictionary alone and
with the toxic one before it, so that text which both know costs the same and only what toxic text adds makes a
difference.  The savings of a document's windows are summed up in a few figures, whose thresholds a logistic fit on
the labelled sample calibrates.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 8
STEMS = range(3, 11)
#: A stem tells something if it stands in this share of the toxic sample, and is e ** 2 times as frequent there.
STEM_SHARE = 0.03
LEAST_LIFT = 2.0


def _windows(text: str, width: int) -> list[bytes]:
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + width]) + " ").encode("utf-8", "replace") for i in range(0, len(words), width)]


def _stems(word: str) -> list[str]:
    return [" " + word[:n] for n in STEMS if len(word) >= n] + [f" {word} "]


def _frequent_stems(texts: list[str], least: float) -> Counter:
    """In how many texts each stem stands, for stems in ``least`` texts or more; a longer stem is only counted
    where the one before it is frequent, so few are held at a time."""
    held = [set(t.lower().split()) for t in texts]
    out: Counter = Counter()
    for n in STEMS:
        found = Counter(s for words in held for s in {" " + w[:n] for w in words if len(w) >= n and (n == STEMS[0] or " " + w[: n - 1] in out)})
        out.update({s: c for s, c in found.items() if c >= least})
    found = Counter(f" {w} " for words in held for w in words if " " + w[: STEMS[0]] in out)
    out.update({s: c for s, c in found.items() if c >= least})
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    prior: float
    width: int = WINDOW_WORDS

    def _compressor(self, content: bytes) -> Z.ZstdCompressor:
        params = Z.ZstdCompressionParameters(
            window_log=15, hash_log=13, chain_log=13, search_log=5, min_match=4, target_length=64, strategy=Z.STRATEGY_LAZY2,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        held = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return Z.ZstdCompressor(dict_data=held, compression_params=params)

    def open(self) -> Model:
        if self.ordinary and self.toxic:
            self._plain = self._compressor(self.ordinary).compress
            self._both = self._compressor(self.toxic + self.ordinary).compress
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def features(self, text: str) -> list[float]:
        plain, both = self._plain, self._both
        saved = sorted((len(plain(w)) - len(both(w)) for w in _windows(text, self.width)), reverse=True)
        if not saved:
            return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        n = len(saved)
        top = saved[:3]
        return [1.0, saved[0] / 4, sum(top) / len(top) / 4, 4 * max(-1.0, min(2.0, sum(saved) / n)), 10 * sum(s >= 3 for s in saved) / n, math.log1p(sum(s >= 4 for s in saved))]

    def score(self, text: str | None) -> float:
        if not self.weights or not text or not text.strip():
            return self.prior
        z = float(np.dot(self.features(text), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> list[float]:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def train(toxic: list[str], ordinary: list[str], toxic_share: float, dict_bytes: int = 16384) -> Model:
    """Fit the dictionaries and the thresholds.  Without examples of either class the prior is every score."""
    if not toxic or not ordinary:
        return Model(b"", b"", [], float(bool(toxic)) * 0.99)
    kinds = {1: sorted(set(toxic)), 0: sorted(set(ordinary))}
    n1, n0 = len(kinds[1]), len(kinds[0])
    often = _frequent_stems(kinds[1], max(2, STEM_SHARE * n1))
    plain_count = Counter(s for t in kinds[0] for s in {s for w in set(t.lower().split()) for s in _stems(w) if s in often})

    def lift(stem: str) -> float:
        return math.log((often[stem] + 0.5) / (n1 + 1) / ((plain_count[stem] + 0.5) / (n0 + 1)))

    telling = {s for s in often if lift(s) > LEAST_LIFT}
    passages = [f" {w} ".encode("utf-8", "replace") for t in kinds[1] for w in t.lower().split() if any(s in telling for s in _stems(w))]
    plain = [w for t in kinds[0] for w in _windows(t, 6)]
    model = Model(_dictionary(plain, dict_bytes // 2), _dictionary(passages, dict_bytes), [], toxic_share).open()
    if not model.toxic or not model.ordinary:
        return model
    x = np.array([model.features(t) for t in [*kinds[1], *kinds[0]]])
    y = np.r_[np.ones(n1), np.zeros(n0)]
    model.weights = _logistic(x, y, np.r_[np.full(n1, toxic_share / n1), np.full(n0, (1 - toxic_share) / n0)] * (n1 + n0))
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return Z.train_dictionary(size, samples, k=64, d=6, level=3).as_bytes()
    except Z.ZstdError:  # the trainer refuses very few samples; the samples themselves are a dictionary then
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = 1200, most_ordinary: int = 3000) -> Model:
    """Train on a bounded sample of the labelled documents: of each class those of the smallest id hashes.

    At most ``most_toxic`` + ``most_ordinary`` whole texts come to the driver; every window of them is used.  Labels
    without a value, for unknown documents or for null texts count for nothing; of contrary labels the toxic one holds.
    Without examples of one class every score is the share of toxic labels (0 without labels).
    """
    lab = labels.where(F.col("toxic").isNotNull()).select(F.col(id_col).alias("_id"), (F.col("toxic") == 1).alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in lab.groupBy("_y").count().collect()}
    texts = {}
    for kind in (True, False):
        some = lab.where(F.col("_y") == kind).orderBy(F.xxhash64("_id"), "_id").limit(most_toxic if kind else most_ordinary)
        picked = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id").where("_t is not null")
        texts[kind] = sorted(r["_t"] for r in picked.dropDuplicates(["_id"]).select("_t").collect())
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    return train(texts[True], texts[False], share)


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Null, empty and blank texts score the share of toxic labels; repeated rows score alike, one output row
    each; an empty table gives an empty result; other columns are not read.  All windows of a text of any length count.
    """

    def score(batches):
        held = Model(**model.__getstate__()).open()
        for batch in batches:
            ids, texts = batch.columns
            scores = [held.score(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], names=["id", "score"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
