"""The join and its parts against plain Python: id clashes, hubs, hot keys, long lists."""

import random

import brute
import pytest
from drawspark.llm import ngram_join
from drawspark.llm.components import components, spread_join

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def _near(words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


@pytest.fixture(scope="module")
def texts():
    passage = [rng.choice(WORDS) for _ in range(40)]
    out = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([4, 5, 9, 25, 60, 150, 300]))]
        out += [" ".join(_near(base, k % 5)) for k in range(8)]
        out.append(" ".join(base + passage))
    return [*out, *out[:5], "a b c", "A b C", "", None]


@pytest.mark.parametrize("percent, width", [(85, 4), (80, 5), (95, 2)])
def test_against_all_pairs(spark, texts, percent, width):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, percent=percent, width=width, frequent_from=3).collect()}
    assert got == brute.components(list(enumerate(texts)), percent, width)


def test_rule_has_classes_at_every_threshold():
    for percent in range(80, 100):
        rule = ngram_join.Rule(percent)
        assert rule.small >= 1 and rule.large >= 8
        assert all(rule.least_shared(n) > rule.large for n in range(ngram_join.LARGE_FROM, 3000))


def test_rows_that_share_an_id(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(3, "something else " + base.replace("word", "other")), (3, base + " tail"), (1, base), (7, base + " end"), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect())
    assert got == [(0, 57, 1), (1, 57, 1), (3, 58, 1), (3, 59, 3), (7, 58, 1)]
    kept = sorted(r["text"][:9] for r in ngram_join.distinct(df.where("doc_id is not null")).collect())
    assert kept == ["something", "word0 wor"]


def test_ids_may_be_text(spark):
    base = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([("b", base), ("a", base + " tail"), ("c", "no relation at all here")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_distinct_keeps_whole_rows(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, text_key string, DOC_IDS long")
    want = brute.components(list(enumerate(texts)), 80, 5)
    heads = {i for i, (n, c) in want.items() if i == c}
    got = ngram_join.distinct(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(heads)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    assert ngram_join.distinct(df.limit(0)).collect() == []


def test_star_and_hot_keys(spark):
    star = spark.range(1, 20_001).selectExpr("id + 5 AS a", "5L AS b")
    chain = spark.range(100_000, 100_300).selectExpr("id AS a", "id + 1 AS b")
    got = components(star.unionByName(chain).unionByName(star.limit(3)), hot_rows=500)
    counted = {r["component"]: r["count"] for r in got.groupBy("component").count().collect()}
    assert counted == {5: 20_001, 100_000: 301}
    assert components(star.limit(0)).collect() == []


def test_spread_join_is_a_join(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 7 else id end AS k")
    right = spark.range(0, 4000).selectExpr("id AS r", "id * 2 AS v")
    for how in ("inner", "left"):
        plain = left.join(right, left["k"] == right["r"], how)
        assert sorted(map(str, spread_join(left, "k", right, "r", 50, how).collect())) == sorted(map(str, plain.collect()))


def test_slices_and_tiles(spark, texts, monkeypatch, few_slices):
    assert few_slices == 4
    monkeypatch.setattr(ngram_join, "SLICES", few_slices)
    monkeypatch.setattr(ngram_join._across, "__defaults__", (2,))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, percent=80, width=5, frequent_from=3).collect()}
    assert got == brute.components(list(enumerate(texts)), 80, 5)
