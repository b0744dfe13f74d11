"""Inputs on which an operator once did less than the whole job."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import crosspoly, jaccard, mixing

from . import brute


def _sources(spark, sizes):
    return spark.createDataFrame([(i * 10_000 + j, f"s{i:05}") for i, n in enumerate(sizes) for j in range(n)], "doc_id long, source string")


@pytest.mark.parametrize("m", [150, 1500])
def test_mixing_many_equal_sources(spark, m):
    docs = _sources(spark, [4] * m)
    rows = mixing.mix(docs, block_docs=2).select("row.*", "mix.*").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["in_mix"] for r in rows)
    assert len({r["position"] for r in rows}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert mixing.mixed_documents(docs, block_docs=2).count() == 4 * m


def test_mixing_long_schedule(spark):
    shares = [1, 7, 2, 30, 10]
    table = spark.createDataFrame(list(enumerate(shares)), "idx int, share int")
    for f in (mixing.frame_schedule, mixing.long_schedule):
        got = f(table, 50).orderBy("slot_in_frame").collect()
        assert [r["idx"] for r in got] == brute.pfair(shares, 50)
        assert all(r["j"] == [x["idx"] for x in got[:t]].count(r["idx"]) for t, r in enumerate(got))


def test_mixed_documents_keep_the_hot_source(spark):
    docs = _sources(spark, [300] + [30] * 20)
    rows = mixing.mix(docs).select("row.doc_id", "mix.position", "mix.in_mix").orderBy("position").collect()
    assert not all(r["in_mix"] for r in rows)  # the hot source goes on when the others have ended
    assert [r["doc_id"] for r in mixing.mixed_documents(docs).collect()] == [r["doc_id"] for r in rows]


def test_the_order_of_the_mix_reaches_the_result(spark, sf, tmp_path):
    docs = _sources(spark, [300] + [30] * 20).withColumn("text", F.concat(F.lit("text "), "doc_id"))
    corpus_pipeline.mix_sources(spark, docs, sf).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r["doc_id"] for r in mixing.mix(docs).select("row.doc_id", "mix.position").orderBy("position").collect()]
    rows = corpus_pipeline.encode_decode(spark, mixed, sf).orderBy("position").collect()
    assert [(r["doc_id"], r["position"]) for r in rows] == list(zip(order, range(len(order)), strict=True))
    other = mixed.orderBy(F.desc("doc_id")).repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    rows = corpus_pipeline.encode_decode(spark, other, sf).orderBy("position").collect()
    assert [r["doc_id"] for r in rows] == sorted(order, reverse=True)


def _grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_by_exact_similarity(spark, sf):
    rng, texts = np.random.default_rng(3), []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, 120, rng.integers(1, 6)):
                copy[at] = "other"
            texts.append(" ".join(copy))
    sets = [_grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = brute.components(set(range(len(texts))), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in jaccard.near_copies(docs).collect()}
    assert got == {i: want[i] for i in got} and len(got) == len(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert kept == set(want.values()) and 40 <= len(kept) < 160


def test_near_dedup_asks_little_of_the_driver(spark, sf):
    """Each exchange costs the driver a thread and a plan, each broadcast a hash table; 64 and 45 of them took it over its memory."""
    store = spark._jsparkSession.sharedState().statusStore()
    start, seen = store.executionsList().size(), Counter()
    assert jaccard.near_copies(spark.read.parquet(f"{sf}/documents.parquet")).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for i in range(start, runs.size()):
        nodes = store.planGraph(runs.apply(i).executionId()).allNodes()
        seen.update(nodes.apply(j).name() for j in range(nodes.size()))
    assert 0 < seen["Exchange"] < 50 and seen["BroadcastExchange"] < 36


@pytest.mark.parametrize("hot", [3, 256])
def test_near_dedup_with_and_without_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng, texts = np.random.default_rng(6), []
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    for i in range(60):
        copy = list(base) if i % 2 else [f"w{x}" for x in rng.integers(0, 5000, 120)]
        copy[int(rng.integers(0, 120))] = f"own{i}"
        texts.append(" ".join(copy))
    sets = [_grams(t) for t in texts]
    want = brute.components(set(range(60)), [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r["id"]: r["component"] for r in jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_unconnected_members_of_a_bucket_are_compared_in_blocks(spark):
    rng = np.random.default_rng(9)
    common, sets = rng.integers(0, 2**62, 300), []
    for i in range(60):  # all share a part, and every third one is a near copy of the one before
        own = rng.integers(0, 2**62, 60 + 30 * (i % 5)) if i % 3 or not sets else np.array(sets[-1][300 + 5 :])
        sets.append(np.unique(np.concatenate([common[: 200 + i % 40], own])).tolist() if i % 3 else [*sets[-1][:-4], i] if sets else common.tolist())
    table = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "fp long, grams array<long>")
    there = table.selectExpr("7 as key", "fp")
    want = brute.components(set(range(60)), [(i, j) for i in range(60) for j in range(i) if brute.jaccard(set(sets[i]), set(sets[j])) >= 0.8])
    assert 1 < len(set(want.values())) < 60
    for block in (7, 256):
        links = [(r["a"], r["b"]) for r in jaccard._in_blocks(there, table, 0.8, block).collect()]
        assert brute.components(set(range(60)), links) == want


@pytest.mark.parametrize("rows", [1000, 10**7, 10**9])
def test_embedding_pairs_at_the_threshold_share_a_bucket(rows):
    tables, hashes = crosspoly.table_plan(rows, 64, 0.9)
    assert hashes == {1000: 3, 10**7: 4, 10**9: 5}[rows]
    rng = np.random.default_rng(8)
    x, z = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (crosspoly.codes(v, tables, hashes) for v in (x, y))
    missed = ~(a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert missed.mean() <= 0.003 + 3 * np.sqrt(0.003 / 4000)
