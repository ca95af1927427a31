import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprint as fp
from tests.llm import data


def paragraphs(text):
    return Counter(re.split(fp.CUT, text, flags=re.ASCII) if text else [])


def likeness(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("clash,crowd", [(False, 0), (True, 0), (False, 60)])
def test_against_brute_force(spark, clash, crowd):
    rows = data.corpus() + data.edge_rows() + [(None if k % 2 else 7, f"line {k}\nline {k // 3}\nlast", "", "", 0) for k in range(crowd)]
    got = fp.fingerprint_documents(data.docs(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1]), r[1]))
    by_row = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        by_row.setdefault((i, len(t)), []).append((hashlib.sha256(edited.encode()).hexdigest(), round(likeness(paragraphs(t), paragraphs(edited)), 9), round(likeness(paragraphs(t), paragraphs(after)), 9)))
    mine = {}
    for r in got:
        mine.setdefault((r.doc_id, r.n_chars), []).append((r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in by_row.items()}


def test_equal_texts_have_equal_fingerprints_and_others_differ(spark):
    got = fp.fingerprint_documents(data.docs(spark, [(1, "a\nb", "", "", 3), (2, "a\nb", "", "", 3), (3, "a\nc", "", "", 3)])).orderBy("doc_id").collect()
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint


def test_peeling_gives_the_keys_of_the_difference(spark):
    row = spark.createDataFrame([([11, 22, 33], [22, 44])], "a array<bigint>, b array<bigint>").select(F.expr(fp.peel(fp.subtract(fp.sketch("a"), fp.sketch("b")))).alias("d")).first()
    assert sorted((x.k, x.n) for x in row.d) in ([(11, 1), (33, 1), (44, -1)],) or row.d is None


def test_one_row_and_no_rows(spark):
    (row,) = fp.fingerprint_documents(data.docs(spark, [(1, "abcd", "", "", 4)])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprint_documents(data.empty(spark)).count() == 0


def test_place_among_many_cuts(spark):
    cuts = [f"{k:05d}" for k in range(0, 1000, 5)]
    rows = spark.range(0, 1010).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("key"), "id")
    got = rows.select("id", fp._range_of(F.col("key"), cuts).alias("r")).collect()
    assert all(r.r == min(200, r.id // 5 + 1) for r in got)


def test_routes_cover_all_comparisons(spark):
    docs = data.docs(spark, data.corpus() + data.edge_rows())
    n = docs.count()
    got = fp.routes(docs).collect()
    assert {p: sum(r.n for r in got if r.pair == p) for p in ("edited", "next")} == {"edited": n, "next": n}
    assert {r.route for r in got} <= {"first sketch", "larger sketches", "keys compared"}


def test_plan_has_no_python(spark):
    plan = fp.fingerprint_documents(data.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_a_million_lines(spark):
    import time

    n = 1_000_000
    rows = spark.range(1, numPartitions=1).select(F.lit(1).cast("bigint").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('line ', i % {n - 7})), '\n')").alias("text"))
    began = time.time()
    (row,) = fp.fingerprint_documents(rows).collect()
    assert row.near_next == 1.0 and 0.3 < row.near_edited < 0.7 and time.time() - began < 240


def test_places_by_binary_search(spark):
    rows = spark.createDataFrame([([], 3), ([5], 5), ([1, 2, 2, 2, 9], 2), ([1, 2, 2, 2, 9], 10), (list(range(100)), 64)], "a array<bigint>, v bigint")
    assert [r[0] for r in rows.select(F.expr(fp._below("a", "v", fp._steps("a")))).collect()] == [0, 0, 1, 5, 64]
