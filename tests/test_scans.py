"""Running values: the same with one range a key as with many, and with one key that holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledgers, scans, sessions

SCHEMA = "k string, at bigint, v bigint, s string, p boolean"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    hot = [("hot", i, rng.choice([None, 1, 5, -2]), rng.choice("aab"), rng.random() < 0.1) for i in range(900)]
    rest = [(rng.choice(["x", None, "y"]), i, rng.randrange(9), rng.choice("ab"), False) for i in range(60)]
    return spark.createDataFrame(hot + rest, SCHEMA).repartition(5)


def same(df, *others):
    want = sorted(map(str, df.collect()))
    assert all(sorted(map(str, o.collect())) == want for o in others)
    return want


def test_ranges_change_no_value(rows):
    v, s = F.col("v"), F.col("s")
    values = [scans.Running("total", "sum", v), scans.Running("before", "sum", v, False), scans.Running("n", "count", v), scans.Running("top", "max", v, False), scans.Running("last3", "lasts", v, False, 3), scans.Running("own2", "lasts", s, True, 2)]
    found = [scans.running(rows, ["k"], ["at"], *values, most=m) for m in (10**6, 100, 7)]
    assert same(*found)
    assert found[0].columns == found[1].columns


def test_against_plain_python(rows):
    plain, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.k), r.at)):
        held = seen.setdefault(r.k, [])
        plain[str(r.k), r.at, r.v, r.s] = (sum(x for x in held if x is not None) if any(x is not None for x in held) else None, [x for x in reversed(held) if x is not None][:2])
        held.append(r.v)
    ordered = rows.where("k = 'hot'")
    for r in scans.running(ordered, ["k"], ["at"], scans.Running("before", "sum", F.col("v"), False), scans.Running("lasts", "lasts", F.col("v"), False, 2), most=50).collect():
        assert (r.before, r.lasts) == plain[r.k, r.at, r.v, r.s]


def test_no_task_sorts_more_than_its_range(rows):
    cut = scans.ranged(rows, ["k"], ["at"], 100)
    sizes = [r.n for r in cut.groupBy("k", "_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 9 and max(sizes) <= 100


def test_sessions_and_ledgers_with_a_hot_key(spark, rows):
    one = rows.withColumn("seq", F.col("at")).withColumn("ts", F.timestamp_seconds(F.col("at") * F.col("at") % 977 + F.col("at") * 60))
    for run in (
        lambda m: sessions.replay(one, "k", ["at"], "s", "p", 3, most=m),
        lambda m: sessions.streaks(one, "k", ["at"], "s", ["z"], most=m),
        lambda m: sessions.occurrence(one, ["k", "s"], ["at"], most=m),
        lambda m: sessions.preceding(one, "k", "at", "s", F.col("p"), 4, most=m),
        lambda m: sessions.breaches(one, "k", ["at"], "v", 20.0, most=m),
        lambda m: ledgers.one_in_flight(one, "k", "ts", F.col("at") % 90, most=m),
        lambda m: ledgers.debounced(one, "k", "ts", "50 seconds", most=m),
    ):
        assert same(run(10**6), run(60))


def test_empty(spark, rows):
    assert scans.running(rows.limit(0), ["k"], ["at"], scans.Running("n", "count", F.lit(1)), most=1).count() == 0
