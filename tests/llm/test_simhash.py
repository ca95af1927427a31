import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tests.llm import data


def brute_fingerprint(text, size=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + size]), 42) for i in range(max(1, len(ws) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes, radius):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(nodes)
    for a in ids:
        for b in ids:
            if a < b and (nodes[a] ^ nodes[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("clash", [False, True])
def test_classes_against_brute_force(spark, clash):
    rows = data.corpus() + data.edge_rows()
    got = simhash.classes(data.docs(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    expected = brute_components(prints, simhash.RADIUS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == expected[r.doc_id]


def test_null_empty_and_blank_texts_are_one_class(spark):
    got = {r.doc_id: r.component_id for r in simhash.classes(data.docs(spark)).where("doc_id <= 3").collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_links_find_every_pair_within_the_radius_once(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(25)})
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id bigint, fp bigint")
    got = simhash.links(nodes, radius).collect()
    expected = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= radius}
    assert sorted((r.a, r.b) for r in got) == sorted(expected)


def test_links_broadcast_no_signatures(spark):
    nodes = spark.range(5000).select("id", F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.min("id").alias("id"))
    got = simhash.links(nodes)
    assert got.count() == 0 and got.collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_components_of_chains_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (200, 202)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200, 202: 200}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_majority_over_long_runs():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) | (np.uint64(1) << np.uint64(63))
    counts = np.array([0, 1, 300, 0, 1699])
    got = simhash.majority(hashes, counts)
    at = 0
    for n, g in zip(counts, got, strict=True):
        part = hashes[at : at + n]
        at += n
        assert int(g) == sum(1 << k for k in range(64) if 2 * int(((part >> np.uint64(k)) & np.uint64(1)).sum()) > n)


def test_keep_first_keeps_one_of_each_class_with_all_columns(spark):
    docs = data.docs(spark, clash=True)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    classes = {r.doc_id: r.component_id for r in simhash.classes(docs).where(F.col("doc_id").isNotNull()).collect()}
    assert ids - {None} == set(classes.values()) and None in ids
    assert simhash.keep_first(data.empty(spark)).count() == 0
