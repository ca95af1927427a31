"""Hard negatives against a plain sort of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows):
    """All rows of mine(), by sorting every anchor's scores."""
    known = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in known:
        if i % 100:
            continue
        scored = sorted((-max(-negatives.MOST, min(negatives.MOST, sum(a * b for a, b in zip(v, w, strict=False)))), j, other) for j, other, w in known)
        positives = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
        for p, high in positives:
            found = [(j, -s) for s, j, other in scored if other != label and 30 * high <= -100 * s <= 90 * high][:10]
            out += [(i, p, rank, j, high, s) for rank, (j, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    found = negatives.mine(spark.createDataFrame(rows, schema))
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def random_rows(n, seed=1, dim=6, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.3, 0.5) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_as_by_plain_sort(spark, monkeypatch, small):
    if small:  # many tiles, and scores sorted a few at a time
        for name, value in (("ANCHORS", 2), ("TILE_ROWS", 50), ("CELLS", 64)):
            monkeypatch.setattr(negatives, name, value)
    rows = random_rows(700)
    assert mined(spark, rows) == plain(rows)


def test_ties_repeats_and_hot_labels(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(2)) for _ in range(3)], 1 if i % 3 else rng.randrange(3)) for i in range(400)]
    rows += [rows[100], rows[101], (200, [0.0, 1.0, 1.0], 2), (-100, [1.0, 1.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows)


def test_rows_that_take_no_part(spark):
    rows = [*random_rows(205, 3), (None, [1.0] * 6, 1), (300, None, 1), (400, [1.0, None], 1), (500, [1.0, math.nan], 1), (600, [math.inf, 1.0], 1), (700, [1.0] * 6, None), (800, [], 1), (900, [0.5], 2), (1000, [0.5] * 9, 3)]
    assert mined(spark, rows) == plain(rows)


def test_scores_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, 3e9, 1.0, -2.5e12]) * rng.random() for _ in range(3)], rng.randrange(2)) for i in range(230)]
    assert mined(spark, rows) == plain(rows)
    a = np.array([[2.0**40 + 1, 3.0]])
    assert negatives.scores(a, a)[0, 0] == min(negatives.MOST, (2**40 + 1) ** 2 + 9)
    assert negatives.scores(np.array([[2.0**28 + 1]]), np.array([[2.0**29 + 1]]))[0, 0] == (2**28 + 1) * (2**29 + 1)


def test_lone_anchors_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
    assert mined(spark, [(100, [-1.0], 1), (101, [1.0], 1), (102, [0.5], 2)]) == []


def test_clashing_columns_and_floats(spark):
    rows = random_rows(300, 5)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    for c in ("key", "score", "id", "anchor", "positives", "n", "cells"):
        table = table.withColumn(c, F.lit("clash"))
    found = sorted(map(tuple, negatives.mine(table).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert found == plain([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
