"""Table functions from SQL, against the functions of columns."""

from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import segments, sessions
from tessera.operators import typed_values as tv

SENTENCES = ["I have watched twenty-five films so far.", "It took 4-6 hours, for $1,200.50.", "I used to wake at 7:15 am on Monday.", "I don't have a spare key.", "I go three times a week, or daily.", "nothing here", "", None, "I sold two bikes and bought a new bike.", "She finished it every other week."]


def test_values_from_sql_as_by_columns(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES * 2)], "id int, sentence string")
    rows.createOrReplaceTempView("notes")
    tables.register(spark)
    got = spark.sql("SELECT n.id, v.found, v.kind, v.start, v.stop, v.display, v.value, v.low, v.high, v.unit FROM notes n JOIN stated_values(TABLE(SELECT DISTINCT sentence FROM notes)) v ON v.sentence = n.sentence")
    plain = rows.select("id", F.posexplode(tv.spans(F.col("sentence"))).alias("found", "v")).select("id", "found", "v.*")
    want = sorted(map(str, map(tuple, plain.collect())))
    assert sorted(map(str, map(tuple, got.collect()))) == want and len(want) >= 18
    assert sorted(map(str, map(tuple, tv.stated(rows, "sentence").select("id", "found", "v.*").collect()))) == want


def test_changes_from_sql(spark):
    spark.createDataFrame([(s,) for s in SENTENCES], "sentence string").createOrReplaceTempView("told")
    tables.register(spark)
    got = spark.sql("SELECT noun, sum(amount) AS n FROM count_changes(TABLE(SELECT sentence FROM told)) GROUP BY noun")
    assert {r.noun: r.n for r in got.collect()} == {"bikes": -2, "bike": 1}


def test_claims_are_corrections_and_changes(spark):
    rows = spark.createDataFrame([(1, "Hello there.  Anna moved to Porto. Actually it rained? My brother Tom left. It is fine."), (2, None), (3, ""), (4, "anymore")], "id int, t string")
    got = [tuple(r) for r in segments.claims(rows, ["id"], "t").orderBy("id", "n").collect()]
    assert got == [(1, 1, "Anna moved to Porto.", "new_fact", "Anna", 14, 34), (1, 2, "Actually it rained?", "state_update", "Actually", 35, 54), (1, 3, "My brother Tom left.", "new_fact", "Tom", 55, 75), (4, 0, "anymore", "state_update", "", 0, 7)]


def test_exhaustion_gate(spark):
    rows = [("a", t, "trap", False, False, True) for t in range(6)] + [("a", 9, "good", False, False, False)] + [("b", t, "good", t == 2, False, False) for t in range(6)] + [("c", t, "x", False, True, True) for t in range(6)]
    turns = spark.createDataFrame(rows, "s string, t int, item string, progress boolean, exempt boolean, trap boolean")
    replayed = sessions.replay(turns, "s", ["t"], "item", "progress", exempt=F.col("exempt"))
    got = {r.s: (r.base_loop_rate, r.loop_rate, r.cut, r.productive_kept, r.exempt_kept, r.graduates) for r in sessions.exhaustion_gate(replayed, "s", F.col("trap"), F.col("exempt")).collect()}
    assert got == {"a": (0.5, 0.0, 0.5, 1.0, 1.0, True), "b": (0.0, 0.0, 0.0, 1.0, 1.0, False), "c": (0.0, 0.0, 0.0, 1.0, 1.0, False)}
