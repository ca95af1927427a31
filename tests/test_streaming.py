import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.streaming import events


def write(path, name, rows, torn=""):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + torn)


def drained(query):
    query.awaitTermination()


def collected(spark, stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_log_skips_torn_lines_and_keeps_first_of_key(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "x", "ts": "2024-01-01T00:00:00"}, {"k": "x", "ts": "2024-01-01T00:00:05"}, {"k": "y", "ts": "2024-01-01T00:00:06"}], '\n{"k": "z", "ts')
    stream = events.first_only(events.tail_log(spark, str(tmp_path / "in"), "k string, ts timestamp"), "k", "ts", "1 hour")
    drained(events.append_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_windows_and_sessions(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "x", "ts": f"2024-01-01T00:{m:02}:00"} for m in (0, 1, 11, 40)])
    stream = events.tail_log(spark, str(tmp_path / "in"), "k string, ts timestamp")
    tumbling = collected(spark, events.window_counts(stream, "ts", "1 minute", "10 minutes"), "tumbling", "complete")
    assert sorted(r.n for r in tumbling.collect()) == [1, 1, 2]
    gaps = collected(spark, events.session_counts(stream, "k", "ts", "1 minute", "15 minutes"), "gaps", "complete")
    assert sorted(r.n for r in gaps.collect()) == [1, 3]


def test_replay_across_batches_equals_batch_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    turns = [("s", t, item, t in (3, 6)) for t in range(1, 9) for item in ("a", "b", "x") if t % 2 or item != "b"]
    for n, part in enumerate((turns[:5], turns[5:])):
        cut = {t for _, t, *_ in turns[:5]}
        rows = [x for x in turns if (x[1] in cut) == (n == 0)]
        write(tmp_path / "in", f"{n}.json", [dict(zip(("session", "turn", "item", "progress"), r, strict=True)) | {"exempt": r[2] == "x"} for r in rows])
        import os

        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = events.tail_log(spark, str(tmp_path / "in"), "session string, turn bigint, item string, progress boolean, exempt boolean", files_per_batch=1)
    got = {(r.turn, r.item): (r.since_progress, r.suppressed) for r in collected(spark, events.replay(stream, 2), "replayed").collect()}
    flat = spark.createDataFrame(turns, "session string, turn bigint, item string, progress boolean")
    by_turn = flat.groupBy("session", "turn").agg(F.max("progress").alias("progress"))
    epochs = sessions.replay(by_turn.withColumn("item", F.lit("-")), "session", ["turn"], "item", "progress", 2).select("session", "turn", "epoch")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("session", "item", "epoch").orderBy("turn"))
    expected = {(r.turn, r.item): (r.n, r.n >= 2 and r.item != "x") for r in flat.join(epochs, ["session", "turn"]).withColumn("n", n).collect()}
    assert got == expected


def test_last_wins(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "x", "ts": "2024-01-01T00:00:00", "v": 1}, {"k": "x", "ts": "2024-01-01T00:00:05", "v": 2}])
    args = (["k"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"))
    drained(events.last_wins(events.tail_log(spark, str(tmp_path / "in"), "k string, ts timestamp, v bigint"), *args))
    write(tmp_path / "in", "b.json", [{"k": "x", "ts": "2024-01-01T00:00:09", "v": 3}])
    drained(events.last_wins(events.tail_log(spark, str(tmp_path / "in"), "k string, ts timestamp, v bigint"), *args))
    assert [(r.k, r.v) for r in events.read_last(spark, str(tmp_path / "out"), ["k"], "ts").collect()] == [("x", 3)]


def test_running_totals(spark, tmp_path):
    write(tmp_path / "in", "a.json", [{"k": "x", "v": 3.0}, {"k": "x", "v": 4.0}, {"k": "y", "v": 1.0}])
    stream = events.tail_log(spark, str(tmp_path / "in"), "k string, v double")
    got = {r.k: (r.total, r.over) for r in collected(spark, events.running_totals(stream, "k", "v", 5.0), "totals", "complete").collect()}
    assert got == {"x": (7.0, True), "y": (1.0, False)}


@pytest.mark.parametrize("rows", [[]])
def test_empty_folder_gives_no_rows(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    stream = events.tail_log(spark, str(tmp_path / "in"), "k string, ts timestamp")
    assert collected(spark, events.first_only(stream, "k", "ts", "1 hour"), "nothing").count() == 0
