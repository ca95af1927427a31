import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tessera.llm import decontaminate, pieces, quality, simhash, toxicity  # noqa: E402
from tests.llm import data  # noqa: E402
from tests.llm.test_decontaminate import brute  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, data.sentence(rng, 25)) for i in range(5)]
    rows, marks = [], []
    for i in range(400):
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        text = data.text(rng, 4) if good else "| ".join(["SALE!!"] * 50)
        text += " vilest scumword" * toxic + (" " + rng.choice(items)[1] if i % 10 == 0 else "")
        rows.append((100 + i, text, "en", "s", len(text)))
        if i % 2:
            marks.append((100 + i, int(good), int(toxic)))
    rows += [(1000 + i, t, *rest) for i, t, *rest in rows[:30]] + data.edge_rows()
    path = tmp_path_factory.mktemp("tables")
    data.docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_each_stage_against_plain_code(spark, folder, tmp_path):
    path, _, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(map(tuple, docs.collect()), key=str)
        if name == "toxicity":
            scores = toxicity.scorer(toxicity.fit(docs, labels))([r[1] for r in before])
            expected = [r for r, s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD]
        elif name == "quality classifier":
            scores = quality.scorer(quality.fit(docs, labels))([r[1] for r in before])
            expected = [r for r, s in zip(before, scores, strict=True) if s >= quality.THRESHOLD]
        elif name == "SimHash near-dedup":
            root = brute_components({r[0]: brute_fingerprint(r[1]) for r in before if r[0] is not None}, simhash.RADIUS)
            expected = [r for r in before if r[0] is None or root[r[0]] == r[0]]
        elif name == "benchmark decontamination":
            gone = {d for d, _ in brute(before, items)}
            expected = [r for r in before if r[0] not in gone]
        else:
            ids = pieces.encoder(pieces.load())([r[1] for r in before])
            expected = [(r[0], len(x), x.tolist()) for r, x in zip(before, ids, strict=True)]
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(map(tuple, docs.collect()), key=str)
        assert got == sorted(expected, key=str), name
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < len(got) < len(before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str) == got


def test_empty_tables(spark, tmp_path):
    data.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.SHINGLE == 5 and quality.THRESHOLD == toxicity.THRESHOLD == 0.7


def test_clashing_columns_pass_through(spark, folder, tmp_path):
    """Columns that are named like those the stages make are carried and change nothing."""
    path, rows, items = folder
    data.docs(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.score for r in first.select("score").distinct().collect()} == {"clash"}
    keyed = lambda d: sorted(((r.doc_id, r.n_tokens) for r in d.collect()), key=str)
    assert keyed(corpus_pipeline.run(spark, str(tmp_path))) == keyed(corpus_pipeline.run(spark, path))
