import pytest
from pyspark.sql import functions as F

from tessera.functions import measures
from tessera.functions import text as tx


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("word,expected", [("stories", "story"), ("cats", "cat"), ("glass", "glass"), ("bus", "bus")])
def test_singular(spark, word, expected):
    assert value(spark, tx.singular(F.col("w")), w=word) == expected


@pytest.mark.parametrize("word,expected", [("running", "run"), ("planned", "plan"), ("tests", "test"), ("ring", "ring"), ("adding", "ad"), ("cats", "cat"), ("boxes", "box"), ("used", "used"), ("needed", "need")])
def test_stem(spark, word, expected):
    assert value(spark, tx.stem(F.col("w")), w=word) == expected


@pytest.mark.parametrize("text,expected", [("The answer is (B).", "B"), ("Answer: C", "C"), ("maybe A or D", "D"), ("none", None)])
def test_choice_letter(spark, text, expected):
    assert value(spark, tx.choice_letter("t"), t=text) == expected


@pytest.mark.parametrize("text,expected", [("1,200", 1200), ("twenty-five", 25), ("seven", 7), ("lots", None)])
def test_number_word(spark, text, expected):
    assert value(spark, tx.number_word("t"), t=text) == expected


@pytest.mark.parametrize("text,expected", [("about 12k", 12000.0), ("3.5M users", 3.5e6), ("1,234", 1234.0), ("no", None)])
def test_amount(spark, text, expected):
    assert value(spark, tx.amount("t"), t=text) == expected


@pytest.mark.parametrize("seconds,expected", [(0, "0s"), (59, "59s"), (61, "1m 1s"), (90061, "1d 1h")])
def test_duration(spark, seconds, expected):
    assert value(spark, tx.duration("n"), n=seconds) == expected


@pytest.mark.parametrize("a,b,expected", [("Yes", "true", True), ("3.0", "3", True), ("3", "4", False), ("red car", "car", True), ("dog", "cat", False)])
def test_same_value(spark, a, b, expected):
    assert value(spark, tx.same_value(F.col("a"), F.col("b")), a=a, b=b) is expected


def test_texts(spark):
    assert value(spark, tx.tokens("t"), t="A_b, c-D") == ["a_b", "c", "d"]
    assert value(spark, tx.sentences("t"), t="One. Two! three? Four") == ["One.", "Two! three?", "Four"]
    assert value(spark, tx.code_fence("t"), t="x\n```python\ny = 1\n```") == "y = 1\n"
    assert value(spark, tx.normal_answer("t"), t="  It's, OK! ") == "its ok"
    assert str(value(spark, tx.logged_at("t"), t="2023/05/20 (Sat) 02:21")) == "2023-05-20 02:21:00"
    assert value(spark, tx.found("t", "snake"), t="use my_name and my_name, other_one") == ["my_name", "other_one"]
    assert value(spark, tx.slug("t"), t="A b!c") == "a-b-c"
    assert value(spark, tx.unset("t"), t="  ") is None
    assert value(spark, tx.keyword_hit(F.col("t"), F.col("p")), t="he planned tests", p="test planning")
    assert value(spark, tx.whole_number_in(F.col("t"), F.col("n")), t="it is 12 now", n="12")
    assert not value(spark, tx.whole_number_in(F.col("t"), F.col("n")), t="it is 123", n="12")
    assert value(spark, tx.json_array_in("t"), t='so ["a", "b"] it is') == ["a", "b"]


def test_measures(spark):
    row = spark.createDataFrame([(8, 10, [5.0, 1.0, 3.0, 2.0, 4.0])], "a int, n int, v array<double>").select(
        measures.wilson_lower(F.col("a"), F.col("n")).alias("w"), measures.nearest_rank(F.col("v"), 0.5).alias("m"), measures.floor_rank(F.col("v"), 0.9).alias("p"), measures.ratio(F.col("a"), F.col("n") - 10).alias("z")
    ).first()
    assert round(row.w, 4) == 0.4902 and row.m == 3.0 and row.p == 5.0 and row.z == 0.0


@pytest.mark.parametrize("a,b,jaccard,overlap", [(["a", "b"], ["b", "c"], 1 / 3, 0.5), ([], ["a"], 0.0, 0.0), ([], [], 0.0, 0.0)])
def test_set_likeness(spark, a, b, jaccard, overlap):
    assert value(spark, tx.jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(jaccard)
    assert value(spark, tx.overlap(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(overlap)


def test_tokens_of_other_kinds(spark):
    assert value(spark, tx.tokens_any_case("t"), t="It's A_1 né B2") == ["it", "s", "a_1", "n", "b2"]
    assert value(spark, tx.letter_tokens("t"), t="Ça va, ça 東京 a 12 x") == ["ça", "va", "東京", "12"]
    assert value(spark, tx.letter_tokens("t", 2), t="ab abc ABC") == ["abc"]
    assert value(spark, tx.variants(F.col("w")), w=["run", "runs"]) == ["run", "runs", "runed", "runing", "runss", "runsed", "runsing"]
    assert value(spark, F.coalesce(tx.tokens_any_case("t"), F.array(F.lit("none"))), t=None) == ["none"]


def test_first_of_each(spark):
    from tessera.operators import samples

    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9), (None, 5)], "g string, o int")
    assert sorted((str(r.g), r.o) for r in samples.first_of_each(rows, "g", "o", 2).collect()) == [("None", 5), ("a", 1), ("a", 2), ("b", 9)]
