import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram
from tests.llm import data


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@pytest.mark.parametrize("hot", [ngram.HOT, 5])
def test_base_scores_are_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram, "HOT", hot)
    rows = data.corpus() + data.edge_rows()
    got = ngram.score_documents(data.docs(spark, rows, clash=True)).collect()
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, held(i), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("many", [600, 60_000])
def test_filter_gives_levels_back(many):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * many))
    own, absent = keys[::2], keys[1::2]
    counts = rng.integers(1, 500, len(own))
    filled, at = [b""] * 256, ngram.segment_of(own, 256)
    for s in np.unique(at):
        filled[s] = ngram.fill(own[at == s], counts[at == s])
        assert np.unpackbits(np.frombuffer(filled[s], np.uint8)).mean() < 0.55
    bits, pages = b"".join(filled), np.array([len(x) * 8 // ngram.PAGE_BITS for x in filled])
    level = ngram.look_up(bits, pages, own)
    assert (level >= ngram.levels(counts)).all()  # a filter never loses what it holds
    assert (level == ngram.levels(counts)).mean() > 0.9
    assert (ngram.look_up(bits, pages, absent) == 0).mean() > 0.9


def test_large_segment_has_more_pages():
    keys = np.arange(1, 60_001, 2, dtype=np.int64)
    counts = np.where(np.arange(len(keys)) < 1000, 50, 1)
    bits = ngram.fill(keys, counts)
    assert len(bits) > ngram.PAGE_BITS // 8 and np.unpackbits(np.frombuffer(bits, np.uint8)).mean() < 0.55
    level = ngram.look_up(bits, np.array([len(bits) * 8 // ngram.PAGE_BITS]), keys)
    assert (level >= ngram.levels(counts)).all() and (level == ngram.levels(counts)).mean() > 0.9


def test_scores_are_those_of_all_counts_by_level(spark):
    rows = data.corpus() + data.edge_rows()
    words = [[None, *(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    train = [ws for ws, (i, *_) in zip(words, rows, strict=True) if not held(i)]
    one, two = Counter(w for ws in train for w in ws[1:]), Counter(p for ws in train for p in zip(ws, ws[1:], strict=False))
    n, v = sum(one.values()), len(one)
    meant = lambda c: float(ngram.MEANING[ngram.levels(np.array([c]))[0]]) if c else 0.0

    def log(a, b):
        pair, single = meant(two[a, b]), meant(one[b])
        p = (1 - ngram.WEIGHT) * (single + 0.1) / (n + 0.1 * (v + 1)) + ngram.WEIGHT * pair / max(meant(one[a]), pair, 1)
        return math.log10(min(p, 1))

    expected = Counter((str(i), round(sum(log(a, b) for a, b in zip(ws, ws[1:], strict=False)), 4)) for ws, (i, *_) in zip(words, rows, strict=True))
    got = Counter((str(r.doc_id), round(r.score, 4)) for r in ngram.score_documents(data.docs(spark, rows)).collect())
    assert (got & expected).total() >= 0.97 * len(rows)  # the rest: a filter may find what is not there


def test_model_prefers_seen_word_pairs(spark):
    rows = [(i, "red fox jumps over lazy dogs", "", "", 0) for i in range(60)] + [(500, "red fox jumps over lazy dogs", "", "", 0), (501, "dogs over red lazy fox jumps", "", "", 0)]
    got = {r.doc_id: r for r in ngram.score_documents(data.docs(spark, rows)).collect()}
    assert got[500].score > got[500].base_score and got[500].score > got[501].score


def test_no_training_text_and_no_rows(spark):
    only = next(i for i in range(1000) if held(i))
    (row,) = ngram.score_documents(data.docs(spark, [(only, "some words", "", "", 0)])).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0
    assert ngram.score_documents(data.empty(spark)).count() == 0


def test_scores_do_not_depend_on_where_the_filter_is(spark, monkeypatch):
    rows = data.corpus() + data.edge_rows() + [(9000 + i, "red fox jumps over red fox", "", "", 0) for i in range(30)]
    docs = data.docs(spark, rows)
    sent = sorted((str(r.doc_id), round(r.score, 6)) for r in ngram.score_documents(docs).collect())
    monkeypatch.setattr(ngram, "BROADCAST", 0)
    apart = sorted((str(r.doc_id), round(r.score, 6)) for r in ngram.score_documents(docs).collect())
    assert sent == apart and len(sent) == len(rows)


def test_the_dealt_out_form_writes_rows_of_slices_not_of_tokens(spark, monkeypatch):
    rng, written, write = np.random.default_rng(5), [], ngram.checkpointed
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 3000)), "", "", 0) for i in range(30)]
    docs = data.docs(spark, rows).coalesce(1)
    columns = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
    sent = sorted(columns(r) for r in ngram.score_documents(docs).collect())
    monkeypatch.setattr(ngram, "BROADCAST", 0)
    monkeypatch.setattr(ngram, "APART", 200_000)
    monkeypatch.setattr(ngram, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    assert sorted(columns(r) for r in ngram.score_documents(docs).collect()) == sent
    assert sum(df.count() for df in written) < 10_000
