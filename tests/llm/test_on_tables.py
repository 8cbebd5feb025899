"""The queries on a small table, against plain Python and DuckDB."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import brute
from drawspark.llm import queries as Q
from drawspark.llm.encoding import encoder, vocabulary


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = Q.op1_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().groupby("doc_id").toxic.max()
    assert len(rows) == 10000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out & rows.doc_id.isin(labels.index)]
    y = labels.loc[held.doc_id].to_numpy()
    order = held.score.rank().to_numpy()
    auc = (order[y == 1].mean() - ((y == 1).sum() + 1) / 2) / (y == 0).sum()
    f1 = 2 * (held.predicted * y).sum() / (held.predicted.sum() + y.sum())
    print("AUC", auc, "F1", f1)
    assert auc > 0.88 and f1 > 0.6  # 350 toxic examples whose stems are made of common syllables


def test_op2_suffix_sums(spark, sf, docs):
    encode = encoder(vocabulary())
    n = np.array([len(encode(r["text"])) if r["text"] else 0 for r in docs.values()])
    rows = Q.op2_token_counts(spark, sf).collect()
    assert sorted((r["n_tokens"], r["docs"]) for r in rows) == sorted(Counter(n.tolist()).items())
    for r in rows:
        limit = r["n_tokens"]
        assert (r["docs_over"], r["tokens_over"], r["truncated_tokens"]) == ((n > limit).sum(), n[n > limit].sum(), np.minimum(n, limit).sum())
        assert (r["docs_total"], r["tokens_total"], r["whole_docs"]) == (len(n), n.sum(), (n <= limit).sum())


def test_op4_mix(spark, sf, docs):
    rows = Q.op4_mixing(spark, sf).toPandas()
    assert sorted(rows.doc_id) == sorted(docs)
    assert all(len(brute.words(docs[r.doc_id]["text"])) == r.size_ for r in rows.rename(columns={"size": "size_"}).itertuples())
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken >= 0).all()
    by = rows.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), all=("source_size", "first"))
    assert (by["size"] == by["all"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 2).all()
    weights = dict(zip(sorted(by.index), [3, 1, 2] * 7))
    open_ = by[by.target < 2 * by["size"] - 1e-6]
    assert len({round(r.target / weights[i], 6) for i, r in open_.iterrows()}) == 1
    again = Q.op4_mixing(spark, sf).toPandas()
    assert sorted(again.itertuples(index=False, name=None)) == sorted(rows.itertuples(index=False, name=None))


def test_op5_components(spark, sf, docs):
    want = brute.components([(i, r["text"]) for i, r in docs.items()], 85, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op5_ngram_join(spark, sf).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_op6_shards(spark, sf, docs):
    rows = Q.op6_sharding(spark, sf).toPandas()
    assert sorted(rows.doc_id) == sorted(docs)
    total, at = Counter(), defaultdict(set)
    for r in rows.rename(columns={"size": "size_"}).itertuples():
        data = (docs[r.doc_id]["text"] or "").encode()
        assert (r.size_, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        total[r.shard] += r.size_
        at[docs[r.doc_id]["text"]].add(r.shard)
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    mean = sum(total.values()) / 8
    assert set(total) == set(range(8)) and max(total.values()) < 1.1 * mean
    assert sum(len(s) > 1 for s in at.values()) == 0


def test_op8_features(spark, sf, docs):
    for r in Q.op8_quality(spark, sf).collect():
        want = brute.quality(docs[r["doc_id"]]["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op9_round_trip(spark, sf, docs):
    rows = Q.op9_packing(spark, sf).collect()
    encode = encoder(vocabulary())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = np.append(encode(docs[i]["text"] or ""), 0).astype("<u4")
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_ids_are_those_of_the_vocabulary(docs):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(vocabulary()), encoder(vocabulary())
    slow.encode_special_tokens = True
    texts = [r["text"][:3000] for r in list(docs.values())[:60]] + ["a\n\n  b\t c ", "<|endoftext|> x", " 　 é́\U0001f600 don't 12345", " " * 50]
    for t in texts:
        assert slow.encode(t, add_special_tokens=False).ids == fast(t).tolist()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    want = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r[c] for c in cols)) for r in Q.queries()[name](spark, sf).collect()) == want and len(want) >= 100
