import json

import pytest

from tessera.sources import sinks, tables


def test_checkpoint_log_keeps_last_and_skips_torn(spark, tmp_path):
    rows = [{"arm": "a", "task_id": "1", "ts": 1.0, "v": 1}, {"arm": "a", "task_id": "1", "ts": 2.0, "v": 2}, {"arm": "b", "task_id": "1", "ts": 1.0, "v": 3}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"arm": "a", "task')
    got = tables.checkpoint_log(spark, str(tmp_path / "log.jsonl"), "arm string, task_id string, ts double, v bigint")
    assert sorted((r.arm, r.v) for r in got.collect()) == [("a", 2), ("b", 3)]


def test_fixture_corpus_and_names(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"memories": [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]}, indent=1))
    assert tables.fixture(spark, str(tmp_path / "f.json"), "memories").count() == 2
    (tmp_path / "git_diff_1.txt").write_text("one\ntwo")
    row = tables.corpus(spark, str(tmp_path / "*.txt")).first()
    assert (row.name, row.category, row.text) == ("git_diff_1", "git_diff", "one\ntwo")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / ".x").write_text("")
    (tmp_path / "deep" / "checkpoint_lme_v4_gpt.jsonl").write_text('{"arm": "a"}\n')
    log = tables.logs_below(spark, str(tmp_path), "*.jsonl", "arm string").first()
    assert (log.benchmark, log.variant, log.model) == ("lme", "v4", "gpt")


def test_markdown_table(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Title\n\n## Active\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n\n## Old\n| a | b |\n|---|---|\n| 3 | z |\n")
    got = tables.markdown_rows(spark, str(tmp_path / "n.md"), "Active").orderBy("n").collect()
    assert [r.cells for r in got] == [["1", "x"], ["2", "y"]]


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tables.strict_json_lines(spark, str(tmp_path / "bad.jsonl"), "a bigint").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.json_artifact(df, str(tmp_path / "o"))
    sinks.append_log(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    assert sinks.markdown(df) == "| a | b |\n| --- | --- |\n| 1 | x |"
    assert tables.schema_gaps(df, {"a": "int", "b": "bigint", "c": "int"}) == ["b: expected bigint, found string", "c: expected int, found nothing"]


def test_datasets_summaries_scenarios_and_prices(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "question_type": "a"}, {"id": 2, "question_type": "b"}]))
    assert tables.dataset(spark, str(tmp_path / "d.json"), ["b"]).first().id == 2 and tables.dataset(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"total_instances": 4, "resolved": 3}))
    row = tables.harness_summary(spark, str(tmp_path / "s.json"), ["total_instances", "total"], ["resolved", "passed"]).first()
    assert (row.total, row.passed, row.score) == (4.0, 3.0, 0.75)
    (tmp_path / "c.json").write_text(json.dumps({"name": "x", "system": "s", "turns": ["hi", {"tool": "t"}], "probes": [{"question": "q", "keywords": ["k"]}]}))
    got = tables.scenarios(spark, str(tmp_path / "c.json")).orderBy("n").collect()
    assert got[0].turn == "hi" and json.loads(got[1].turn) == {"tool": "t"}
    (tmp_path / "p.json").write_text(json.dumps({"m": {"input": 1.0, "output": 2.0}}))
    assert tuple(tables.prices(spark, str(tmp_path / "p.json")).first()) == ("m", 1.0, 2.0)


def test_source_tree(spark, tmp_path):
    (tmp_path / "t" / "a").mkdir(parents=True)
    (tmp_path / "t" / "a" / "UserService.ts").write_text("x")
    (tmp_path / "t" / "a" / "notes.md").write_text("x")
    row = tables.source_tree(spark, str(tmp_path / "t"), ["ts"]).collect()
    assert [(r.path, r.folder, r.stem, r.extension, r.length) for r in row] == [("a/UserService.ts", "a", "UserService", "ts", 1)]


def test_session_turns(spark):
    turn = lambda r, c: {"role": r, "content": c}
    items = spark.createDataFrame([(1, [[turn("user", "b")], [turn("user", "a1"), turn("assistant", "a2")]], ["2024-02", "2024-01"])], "id int, sessions array<array<struct<role: string, content: string>>>, dates array<string>")
    got = tables.session_turns(items, "id", "sessions", "dates").orderBy("session", "turn").collect()
    assert [(r.session, r.turn, r.content) for r in got] == [(1, 0, "a1"), (1, 1, "a2"), (2, 0, "b")]
    assert [r.content for r in tables.flattened(items, "id", "sessions").orderBy("n").collect()] == ["b", "a1", "a2"]


def test_failed_artifact_keeps_the_old_one(spark, tmp_path):
    sinks.json_artifact(spark.range(3), str(tmp_path / "o"))
    with pytest.raises(Exception):
        sinks.json_artifact(spark.range(3).selectExpr("raise_error('no') AS x"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 3
    sinks.json_artifact(spark.range(5), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 5 and not (tmp_path / "o.new").exists()


def test_published_rows_are_swapped_at_once(spark, tmp_path):
    path = str(tmp_path / "p")
    first = sinks.publish(spark.range(3), path)
    before = sinks.published(spark, path)
    second = sinks.publish(spark.range(5), path)
    assert sinks.published(spark, path).count() == 5 and before.count() == 3 and first != second  # a reader that has begun ends on the old rows
    with pytest.raises(Exception, match="no"):
        sinks.publish(spark.range(3).selectExpr("raise_error('no') AS x"), path)
    assert sinks.published(spark, path).count() == 5
    sinks.publish(spark.range(7), path)
    assert sinks.published(spark, path).count() == 7 and len([x for x in (tmp_path / "p").iterdir() if x.name.startswith("rows-")]) == 2


def test_database(spark):
    got = tables.database(spark, "jdbc:derby:memory:t;create=true", "SELECT 7 AS a, 'x' AS b FROM SYSIBM.SYSDUMMY1")
    assert [tuple(r) for r in got.collect()] == [(7, "x")]
