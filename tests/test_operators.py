"""Edge cases of operators: empty sides, missing values, ties, cycles and refusals."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import claims
from tessera.functions import text as tx
from tessera.operators import gates, graph, joins, ladders, lists, metrics, noise, recall, segments, sessions, summaries
from tessera.operators import typed_values as tv


def said(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


@pytest.mark.parametrize("text,expected", [
    ("It costs $1,200.50 and 3 films.", [("money", "1200.5", "USD"), ("count", "3", "films")]), ("I wake at 12:05 p.m. daily", [("clock_time", "12:05", "local_time"), ("frequency", "1/day", "daily")]),
    ("twenty-five to thirty hours", [("duration", "30", "hours")]), ("5-6 hours", [("duration", "5-6", "hours")]), ("I have a spare key", [("boolean", "true", None)]), ("do you have a spare key", []),
    ("we put down the book temporarily", [("status", "paused", None)]), ("pages 7", [("count", "7", "pages")]), ("every other week", [("frequency", "every_other_week", "week")]), ("", []), (None, []),
])
def test_spans(spark, text, expected):
    got = said(spark, text).select(tv.spans(F.col("t")).alias("v")).first().v
    assert [(v.kind, v.value, v.unit) for v in got] == expected
    assert all(text[v.start : v.stop] == v.display for v in got)


def test_corrections_look_around_the_value(spark):
    rows = tv.marked(tv.assertions(said(spark, "I used to have 3 bikes. I now have 4 bikes, not 5 bikes.").withColumn("n", F.lit("x")), "n", "i", "i", "t"))
    assert [(r.value, r.past, r.present) for r in rows.orderBy("ordinal").collect()] == [("3", True, False), ("4", False, True), ("5", True, False)]


@pytest.mark.parametrize("role,text,mode", [
    ("user", None, "SKIP"), ("user", "  ", "SKIP"), ("user", "Thanks again!", "CONTEXT_ONLY"), ("user", "I moved again.", "EXTRACT_WHOLE"), ("user", "What are some good books?", "CONTEXT_ONLY"),
    ("user", "Why did I move to Rome?", "EXTRACT_WHOLE"), ("user", "my rent is 2400", "EXTRACT_WHOLE"), ("user", "I think that sounds great", "CONTEXT_ONLY"), ("assistant", "Sure, here are ideas.", "CONTEXT_ONLY"), ("Assistant ", "Your booking is confirmed.", "EXTRACT_WHOLE"),
])
def test_modes(spark, role, text, mode):
    row = spark.createDataFrame([(role, text)], "r string, t string").select(segments.mode(F.col("r"), F.col("t")).alias("m")).first()
    assert row.m == mode


def test_ignored_lines(spark):
    text = ["a 1%", "<!-- claim-scan: ignore-next-line -->", "b 2%", "<!-- claim-scan: ignore-start -->", "c 3%", "<!-- claim-scan: ignore-next-line -->", "<!-- claim-scan: ignore-end -->", "d 4%"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "f string, i int, t string")
    assert [r.t for r in claims.read_lines(rows, ["f"], "i", "t").orderBy("i").collect()] == ["a 1%", "d 4%"]


def test_paths_and_shapes(spark):
    row = said(spark, "see src/a.py, /etc/x/y. and README; run git log").select(claims.paths(F.col("t")).alias("p"), claims.commands(F.col("t")).alias("c")).first()
    assert set(row.p) == {"src/a.py", "/etc/x/y", "README"} and row.c == ["git log"]
    shapes = said(spark, "my_name", "a.b", "camelCase", "word").select(claims.identifier_shape(F.col("t")).alias("s")).collect()
    assert [r.s for r in shapes] == [True, True, True, False]


def test_replay_counts_before_it_decides(spark):
    rows = spark.createDataFrame([("s", t, "a", t == 6, False) for t in range(1, 9)] + [("s", t, "x", False, True) for t in range(1, 9)], "s string, t int, item string, progress boolean, exempt boolean")
    got = sessions.replay(rows, "s", ["t", "item"], "item", "progress", exempt=F.col("exempt")).where("item = 'a'").orderBy("t").collect()
    assert [r.suppressed for r in got] == [False, False, False, True, True, True, False, False]
    assert not sessions.replay(rows, "s", ["t", "item"], "item", "progress", exempt=F.col("exempt")).where("item = 'x' AND suppressed").count()


def test_baseline_must_be_one_row(spark):
    wide = spark.createDataFrame([("a", 0.5), ("a", 0.6), ("b", 0.7)], "condition string, m double")
    with pytest.raises(Exception, match="rows of the baseline"):
        gates.against_baseline(wide, "a", ["m"]).collect()
    assert gates.against_baseline(wide.where("m > 0.5"), "a", ["m"]).first().m_delta == pytest.approx(0.1)


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7)], "id int, before int")
    got = {r.id: (r.root, r.steps) for r in graph.chain(links, 16).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(1, 0), (1, 1), (1, 2), (1, 3)] and got[7][0] in (7, 8)
    tokens = spark.createDataFrame([("g", 1, None), ("g", 2, 1), ("g", 3, 9), ("g", 4, 5), ("g", 5, 4), ("h", 1, None)], "g string, id int, head int")
    assert {r.g: (r.roots, r.loose, r.cyclic) for r in graph.tree_faults(tokens, "g", 8).collect()} == {"g": (1, 1, 2), "h": (1, 0, 0)}


def test_slots_back_fills_and_pairs(spark):
    a = spark.createDataFrame([(1, " Red "), (2, "blue"), (3, "none")], "k int, c string")
    audit = spark.createDataFrame([(1, "red", 1, "x"), (9, "BLUE", 2, "y"), (8, "blue", 1, "z")], "k int, c string, at int, v string")
    got = {r.k: (r.audited, r.how) for r in joins.by_slot(a, audit, ["c"], ["k"], "at", "v").collect()}
    assert got == {1: ("x", "exact"), 2: ("y", "slot"), 3: (None, "none")}
    pairs = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", "x")], "p int, s string, v string")
    assert {r.p: r.invariant for r in joins.paired(pairs, "p", "s", ("a", "b"), "v").collect()} == {1: True, 2: False}


def test_coverage_and_merges(spark):
    held = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", 5)], "q int, t string, r int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "q int, t string")
    assert {r.q: (r.covered, r.half) for r in lists.covered_at(held, gold, "q", "t", "r").collect()} == {1: (5, 1), 2: (None, None)}
    one, two = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "g int, s string, p int"), spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "g int, s string, p int")
    assert [r.s for r in lists.merged([one, two], "g", "s", "p").orderBy("rank").collect()] == ["x", "y", "z"]


def test_measures_without_gold_or_rows(spark):
    returned = spark.createDataFrame([("c", 1, 10), ("c", 1, 11)], "condition string, query_id int, doc_id int")
    gold = spark.createDataFrame([(1, 10), (2, 5)], "query_id int, doc_id int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    row = metrics.set_measures(returned, gold, queries).first()
    assert (row.recall, row.precision, row.leak) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(2.5 / 3, abs=1e-6), pytest.approx(0.5 / 3, abs=1e-6))
    facts = spark.createDataFrame([(["the red car"], ["a red car it was"]), ([], ["x"])], "w array<string>, f array<string>")
    assert [r.v for r in facts.select(metrics.fact_recall(F.col("w"), F.col("f"), ["the", "a"]).alias("v")).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0, 2.5], [7.0] * 9])
def test_percentiles_stand_at_their_places(spark, values):
    rows = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
    n = F.col("n")
    got = summaries.percentiles(rows, "g", "v", {"low": F.lit(0), "mid": F.bround((n - 1) * F.lit(0.5)), "top": n - 1}).first()
    at = sorted(values)
    assert (got.low, got.mid, got.top) == (at[0], at[round((len(at) - 1) * 0.5)], at[-1])


def test_noise_and_anchors(spark):
    draws = [r.u for r in spark.range(500).select(noise.draw("s", F.col("id")).alias("u")).collect()]
    assert all(0 <= u < 1 for u in draws) and 0.4 < sum(draws) / 500 < 0.6
    anchors = spark.createDataFrame([(f, a) for f in range(10) for a in ["all", *(["few"] if f < 2 else [])]], "f int, a string")
    assert {r.f: r.anchors for r in noise.clean_anchors(anchors, "f", "a", 0.15, 5).collect()} == {0: ["few"], 1: ["few"]}


def test_relevance_and_ladders(spark):
    rows = spark.createDataFrame([(["a", "b"], [], ["a"]), (["a", "b"], [], ["a", "b"]), (["a"], [], ["a"]), (["a"], ["s"], ["s"]), ([], [], ["a"])], "a array<string>, s array<string>, w array<string>")
    assert [r.r for r in rows.select(recall.relevant(F.col("a"), F.col("s"), F.col("w")).alias("r")).collect()] == [False, True, True, True, False]
    with pytest.raises(ValueError, match="gives no rank"):
        ladders.ladder({"x": lambda: spark.createDataFrame([(1, 2)], "query_id int, doc_id int")})


@pytest.mark.parametrize("answer,expected", [("It was the blue car.", "right"), ("It wasn't a blue car", "negated"), ("I don't know, a blue car?", "abstained"), ("red", "wrong"), ("", "wrong")])
def test_answer_outcomes(spark, answer, expected):
    assert said(spark, answer).select(tx.answer_outcome(F.col("t"), F.lit("Blue car")).alias("o")).first().o == expected


def test_ranks_of_as_by_full_ranking(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessera.operators import ranking

    rng = random.Random(1)
    rows = [(q, a, d, rng.randrange(6) / 5) for q in range(4) for a in (0.0, 0.5) for d in range(40)]
    scored = spark.createDataFrame(rows, "query_id int, alpha double, doc_id int, score double")
    wanted = scored.where("doc_id % 7 = 0").select("query_id", "alpha", "doc_id").union(scored.limit(1).select("query_id", "alpha", F.lit(999)))
    full = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "alpha").orderBy(F.desc("score"), "doc_id")).cast("bigint")).where("doc_id % 7 = 0")
    found = ranking.ranks_of(scored, wanted, ["query_id", "alpha"], "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.select("query_id", "alpha", "doc_id", "score", "rank").collect()))
