"""Sessions by the Python data source: rows, partitions and options."""

import json

import pytest

from tessera.sources.sessions_source import Reader, Sessions

ITEMS = [
    {"question_id": "q1", "haystack_dates": ["2024/01/02", "2024/01/05"], "haystack_session_ids": ["a", None], "haystack_sessions": [[{"role": "user", "content": "One here. Two there."}, {"role": "assistant", "content": "Yes. No."}], [{"content": "Hm. Good"}, {"role": "user", "content": ""}, {"role": "user", "content": "Hm. Good"}]]},
    {"question_id": "q2", "haystack_session_ids": ["a"], "haystack_sessions": [[{"role": "user", "content": "Lonely é."}], [], None]},
    {"question_id": "q3"},
]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "items.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in ITEMS * 40) + "\n{torn\n[1]\n")
    (tmp_path / "list.json").write_text(json.dumps(ITEMS))
    return tmp_path


def rows(spark, path, **options):
    spark.dataSource.register(Sessions)
    return spark.read.format("sessions").options(**options).load(str(path))


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_every_line_is_read_once_however_it_is_split(spark, path, split):
    got = rows(spark, path / "items.jsonl", splitBytes=split).collect()
    assert len(got) == 40 * 5
    assert len(Reader({"path": str(path / "items.jsonl"), "splitbytes": str(split)}).partitions()) == -(-(path / "items.jsonl").stat().st_size // split)


def test_rows_of_an_array(spark, path):
    got = [tuple(r) for r in rows(spark, path / "list.json", prefix="v-").collect()]
    assert got[0] == ("v-q1", "q1", "v-q1-a", 0, "2024/01/02", 0, "v-q1|v-q1-a|t0", "user", 0, "One here. Two there.", "One here. Two there.")
    assert [(r[2], r[5], r[6]) for r in got[2:4]] == [("v-q1-s1", 0, "v-q1|v-q1-s1|t0"), ("v-q1-s1", 2, "v-q1|v-q1-s1|t2")]  # equal turns differ
    assert got[4][2] == "v-q2-a" and got[4][4] is None


def test_segmentations(spark, path):
    parts = {m: [(r.role, r.segment, r.content) for r in rows(spark, path / "list.json", segmentation=m).where("session = 0 AND question_id = 'q1'").collect()] for m in ("none", "sentence", "user-sentence")}
    assert [len(parts[m]) for m in ("none", "sentence", "user-sentence")] == [2, 4, 3]
    assert parts["user-sentence"][2] == ("assistant", 0, "Yes. No.")
    with pytest.raises(Exception, match="segmentation"):
        rows(spark, path / "list.json", segmentation="adaptive").count()


def test_folder_of_files_and_missing_path(spark, path):
    assert rows(spark, path).count() == 41 * 5
    with pytest.raises(Exception, match="no file"):
        rows(spark, path / "nothing.json").count()
