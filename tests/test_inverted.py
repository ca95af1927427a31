"""Nearest vectors through inverted lists against all pairs."""

import math

import numpy as np
import pytest

from tessera.operators import inverted, ranking


def cloud(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return [(i, (centres[i % 10] + 0.5 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("crowded", [False, True])
def test_recall_against_all_pairs(spark, monkeypatch, crowded):
    rows = cloud(1500)
    if crowded:  # one direction holds most rows, and lists are cut small
        monkeypatch.setattr(inverted, "PART", 50)
        rows = [(i, v if i % 3 else [x + 1e-3 * i for x in rows[0][1]]) for i, v in rows]
    vectors = spark.createDataFrame(rows, "doc_id bigint, v array<double>")
    queries = vectors.where("doc_id % 25 = 0").selectExpr("doc_id AS query_id", "v AS q")
    true = ranking.ranked(ranking.dense(vectors, queries), 10)
    found = inverted.nearest(vectors, queries, 10)
    assert inverted.recall(found, true) >= 0.9
    exact = {(r.query_id, r.doc_id): r.score for r in ranking.dense(vectors, queries).collect()}
    got = found.collect()
    assert all(math.isclose(r.score, exact[r.query_id, r.doc_id], abs_tol=1e-9) for r in got) and len(got) == 600
    at = inverted.index(vectors)
    assert at.filed.count() == 1500  # every vector is filed
    everything = inverted.search(at, queries, 10, at.lists)
    assert inverted.recall(everything, true) == 1.0


def test_rows_without_a_direction_and_empty_tables(spark):
    rows = [*cloud(30), (100, None), (101, [0.0] * 8), (102, [math.nan] * 8), (103, [1.0, None]), (None, [1.0] * 8), (104, [])]
    vectors = spark.createDataFrame(rows, "doc_id bigint, v array<double>")
    queries = vectors.selectExpr("doc_id AS query_id", "v AS q")
    found = inverted.nearest(vectors, queries, 3).collect()
    assert {r.query_id for r in found} == set(range(30)) and {r.doc_id for r in found} <= set(range(30))
    assert inverted.nearest(vectors.limit(0), queries, 3).count() == 0
    assert inverted.nearest(vectors, queries.limit(0), 3).count() == 0
