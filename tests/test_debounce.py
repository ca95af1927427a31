"""The streamed debounce against the batch one, over restarts; refolds that are the same when run again."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledgers
from tessera.streaming import debounce, events

START = datetime(2024, 1, 1)
SCHEMA = "ns string, ts timestamp, seq bigint, v bigint"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def lay(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps({"ns": ns, "ts": (START + timedelta(minutes=m)).isoformat(), "seq": s, "v": v}) for ns, m, s, v in rows))
    os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def read(spark, folder):
    return events.tail_log(spark, str(folder), SCHEMA, files_per_batch=1)


def rows_in_order(seed, n=60):
    """Rows shuffled within an hour, so that they come out of order but never late."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), m, s, rng.randrange(9)) for s, m in enumerate(sorted(rng.randrange(3000) for _ in range(n)))]
    return sorted(rows, key=lambda r: r[1] // 60 + rng.random())


def test_bursts_as_in_batch_over_restarts(spark, tmp_path):
    rows = rows_in_order(1)
    closing = [("end", 9000, 999, 0)]
    args = dict(namespace="ns", at="ts", quiet="40 minutes", delay="2 hours")
    for stage, part in enumerate((rows[:25], rows[25:], closing)):  # the query ends and starts again from its checkpoint each time
        for k in range(0, len(part), 7):
            lay(tmp_path / "in", stage * 100 + k, part[k : k + 7])
        stream = debounce.bursts(read(spark, tmp_path / "in"), **args)
        events.append_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.schema(f"ns string, {debounce.BURSTS}").json(str(tmp_path / "out"))
    batch = ledgers.debounced(spark.read.schema(SCHEMA).json(str(tmp_path / "in")), "ns", "ts", "40 minutes").where("ns IS NULL OR ns <> 'end'")
    assert sorted((str(r.ns), r.n, r.ready) for r in found.collect()) == sorted((str(r.ns), r.n, r.ready) for r in batch.collect())
    store = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "cp"))
    assert [r.key["key"] if "key" in r.key else r.key[0] for r in store.collect()] in ([], ["end"])  # nothing is held but the burst still open


def test_new_evidence_folds_again_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    evidence = lambda: spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    fold = lambda rows: rows.groupBy("ns").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))

    def run(checkpoint):
        quiet = debounce.bursts(read(spark, tmp_path / "in"), "ns", "ts", "10 minutes", "0 seconds")
        debounce.refold(quiet, evidence, "ns", "ts", fold, str(tmp_path / "views"), str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.ns, r.total, r.n) for r in debounce.views(spark, str(tmp_path / "views"), "ns").collect())

    lay(tmp_path / "in", 0, [("a", 0, 1, 5), ("b", 1, 2, 7), ("a", 5, 3, 1)])
    lay(tmp_path / "in", 1, [("c", 100, 4, 0)])
    first = run("cp")
    assert first == [("a", 6, 2), ("b", 7, 1)]
    lay(tmp_path / "in", 2, [("a", 120, 5, 10)])  # a is dirty again, and c is quiet
    state = debounce.status(evidence(), debounce.views(spark, str(tmp_path / "views"), "ns"), "ns", "ts")
    assert {(r.ns, r.evidence, r.dirty) for r in state.collect()} == {("a", 3, True), ("b", 1, False), ("c", 1, True)}
    lay(tmp_path / "in", 3, [("end", 500, 6, 0)])
    second = run("cp")
    assert second == [("a", 16, 3), ("b", 7, 1), ("c", 0, 1)]
    assert run("cp") == second
    assert run("another") == second  # all batches once more, over the same folders
