"""The queries give the columns and rows of their contracts."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from tessera.llm import queries  # noqa: E402
from tests.llm import data  # noqa: E402

COLUMNS = {
    "op1_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_sentencepiece": {"doc_id": "bigint"},
    "op7_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_phrase_mining": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}
HELD = {"op2_toxicity": (3, 1), "op5_language_id": (4, 2), "op9_quality": (4, 2), "op10_lm_scoring": (10, 0)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(i, data.sentence(rng, 25)) for i in range(4)]
    rows = [*data.corpus(40), *data.edge_rows()]
    rows += [(2000 + i, data.text(rng, 2) + " " + t, "en", "s", 0) for i, t in items]
    path = tmp_path_factory.mktemp("contract")
    data.docs(spark, rows, clash=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, k % 3 == 0) for k, r in enumerate(rows)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(k, f"http://a.b/{k}", f"<body><article><p>Page {k}</p></article></body>", "clash") for k in range(5)] + [(None, None, None, None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, text string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [rng.random() for _ in range(4)], rng.randrange(3), "clash") for i in range(130)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int, score string").write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_contract(spark, folder, name):
    path, rows = folder
    out = queries.QUERIES[name](spark, path)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    got = out.collect()
    if name == "op3_html_extraction":
        assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([(str(k), f"Page {k}", 6) for k in range(5)] + [("None", "", 0)])
    elif name == "op8_decontamination":
        assert {(r.doc_id, r.item_id) for r in got} >= {(2000 + i, i) for i in range(4)}
    elif name == "op11_hard_negatives":
        assert {r.anchor_id for r in got} == {0, 100}
    elif name == "op13_nearest_neighbours":
        assert len(got) == 7 * 20
    elif name == "op12_phrase_mining":
        assert got == []
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    if name in HELD:
        modulus, rest = HELD[name]
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == rest) for r in got)
    if "predicted" in kinds:
        assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    if name == "op1_document_fingerprints":
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert hashlib.sha256(b"").hexdigest() in {r.edited_sha256 for r in got}
