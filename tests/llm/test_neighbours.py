"""Nearest neighbours against brute force: recall, exact products, order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=20, every=20):
    """{query: [(product, id), ...]} of all rows; repeated rows count once."""
    known = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = {}
    for i, v in [(i, v) for i, v in rows if i is not None and (i, tuple(v or [])) in known and i % every == 0]:
        found[i] = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in known if j != i)[:k]
    return found


def searched(spark, rows, **how):
    out = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def close(found, want):
    assert found.keys() == {q for q, w in want.items() if w}
    for q, rows in found.items():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1] for r in rows] == [j for _, j in want[q]]
        assert np.allclose([r[2] for r in rows], [-s for s, _ in want[q]], rtol=1e-12, atol=1e-12)


def cloud(n, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    return [(i, (centres[i % 15] + 0.6 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_products(spark, scaled):
    rows = cloud(3000)
    if scaled:  # lengths differ, so that the nearest by angle are not those by product
        rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in rows]
    found, want = searched(spark, rows, leaf=40), plain(rows)
    assert found.keys() == want.keys()
    vectors = dict(rows)
    met = 0
    for q, got in found.items():
        assert len(got) == 20 and len({i for _, i, _ in got}) == 20 and q not in {i for _, i, _ in got}
        assert all(math.isclose(s, float(np.dot(vectors[q], vectors[i])), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        met += len({i for _, i, _ in got} & {j for _, j in want[q]})
    assert met >= 0.9 * 20 * len(want)


def test_one_leaf_is_exact(spark):
    rows = cloud(230, 5)
    close(searched(spark, rows, leaf=1000), plain(rows))
    few = rows[:9]
    close(searched(spark, few), plain(few))


def test_copies_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else [float(rng.randrange(1, 3)) for _ in range(3)]) for i in range(600)]
    rows += [rows[43], rows[41], (60, [5.0, 0.0, 0.0])]
    unique = [r for r in rows if r[0] != 60]
    close(searched(spark, unique, leaf=1000), plain(unique))
    found = searched(spark, rows, leaf=1000)  # 60 has two vectors: two queries, none of which finds 60
    assert len(found[60]) == 40 and 60 not in {i for _, i, _ in found[60]}


def test_rows_that_take_no_part_and_lengths(spark):
    rows = [*cloud(100, 4), (None, [1.0] * 4), (120, None), (140, [1.0, None]), (160, [math.nan]), (180, [math.inf]), (200, [0.0, 0.0]), (220, []), (240, [2.0]), (260, [1.0] * 7)]
    close(searched(spark, rows, leaf=1000), plain(rows))


def test_empty_and_alone(spark):
    assert searched(spark, []) == {}
    assert searched(spark, [(20, [1.0])]) == {}


def test_clashing_columns(spark):
    rows = cloud(100, 4)
    table = spark.createDataFrame(rows, SCHEMA)
    for c in ("leaf", "q", "h", "place", "score", "part", "rank", "label"):
        table = table.withColumn(c, F.lit("clash"))
    assert neighbours.search(table).count() == 100


def test_tree_places_every_row():
    rows = np.random.default_rng(2).normal(size=(500, 3))
    rows[:200] = rows[0]
    tree = neighbours.build(rows, 20)
    leaf = neighbours.leaves_of(tree, rows)
    assert leaf.min() >= 0 and len(set(leaf[:200])) == 1 and len(set(leaf)) > 10
    order = neighbours.visits(tree, rows[:9], 10**6)
    assert all(sorted(o) == list(range(tree["leaf"].max() + 1)) for o in order)
    assert neighbours.widened(tree, rows[:1], np.array([[0, x] for x in order[0][:4]]), 1.0) == 4
