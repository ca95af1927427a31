import random

import numpy as np
import pytest

from tessera.llm import langid, quality, toxicity
from tests.llm import data

LABELS = "doc_id bigint, quality int, toxic int"


def rank_accuracy(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def labelled(spark, make, n=700, seed=3):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        text, y = make(rng, i)
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, y, y))
    return data.docs(spark, rows), spark.createDataFrame(marks, LABELS), dict((i, y) for i, y, _ in marks)


def test_machine_learns_pairs_that_weights_cannot():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 6)) < 0.5).astype(np.float32)
    y = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(np.float32)
    y[:1000] = ((x[:1000, 0] == 1) != (x[:1000, 1] == 1)).astype(np.float32)
    x, y = x[:1000], y[:1000]  # either alone, never both: no weights can say that
    z = toxicity.machine(x, *toxicity.fit_machine(x, y, 4, epochs=80))
    assert ((z > 0) == (y > 0)).mean() > 0.95


def test_toxicity_held_out(spark):
    def make(rng, i):
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        extra = ["groupword"] * group + ["insultword"] * insult
        return data.text(rng, 3) + " " + " ".join(extra), int(group and insult)

    docs, labels, truth = labelled(spark, make)
    model = toxicity.fit(docs, labels)
    got = [r for r in toxicity.score_documents(docs, model).collect() if r.held_out]
    assert 150 < len(got) < 320 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score_documents(docs, model).where("predicted = 0").collect()}


def test_toxic_pairs_of_harmless_words(spark):
    """Either of two words alone is toxic, both or none are not: each by itself says nothing, so only pairs can."""

    def make(rng, i):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        return data.text(rng, 3) + " " + " ".join(["alphaword"] * a + ["betaterm"] * b), int(a != b)

    docs, labels, truth = labelled(spark, make, 1500)
    model = toxicity.fit(docs, labels)
    assert {t for w in (b"alphaword", b"betaterm") for t in toxicity.term_ids(w)} & set(model["terms"].tolist())
    got = [r for r in toxicity.score_documents(docs, model).collect() if r.held_out]
    assert np.mean([(r.score > 0.5) == truth[r.doc_id] for r in got]) > 0.9


def test_toxicity_is_the_plain_double_sum():
    rng = np.random.default_rng(3)
    texts = ["some bad words here", "other harmless words", None, "", "bad bad words " * 500]
    terms = np.unique([t for w in b"some bad words here other harmless".split() for t in toxicity.term_ids(w)])
    model = {"bias": np.array([-0.3]), "terms": terms, "w": rng.normal(0, 0.5, len(terms)), "v": rng.normal(0, 0.4, (len(terms), 4))}
    for text, got in zip(texts, toxicity.scorer(model)(texts), strict=True):
        have = sorted({t for w in (text or "").encode().split() for t in toxicity.term_ids(w)} & set(terms.tolist()))
        at = [terms.tolist().index(t) for t in have]
        z = model["bias"][0] + sum(model["w"][i] for i in at) + sum(model["v"][i] @ model["v"][j] for n, i in enumerate(at) for j in at[n + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_very_long_texts_are_scored_whole(spark):
    """A word at the end of a text of two million characters counts."""
    rng = random.Random(7)
    long = " ".join(data.text(rng, 3) for _ in range(10)) + " filler" * 280_000
    docs = data.docs(spark, [(0, long, "", "", 0), (1, long + " insultword", "", "", 0)])
    terms = np.array(sorted(toxicity.term_ids(b"insultword")))
    model = {"bias": np.array([-2.0]), "terms": terms, "w": np.ones(len(terms)) * 3, "v": np.zeros((len(terms), 2))}
    assert [r.predicted for r in toxicity.score_documents(docs, model).orderBy("doc_id").collect()] == [0, 1]
    assert (np.diff(quality.statistics([long, long + "!" * 100_000])[:, quality.FEATURES.index("!")]) > 0).all()
    uni = {"langs": np.array(["x", "y"]), "logp": np.log(np.random.default_rng(1).random((1 << 16, 2))).astype(np.float32), "prior": np.log([0.5, 0.5])}
    assert langid.predict_documents(docs, uni).count() == 2


def test_quality_held_out(spark):
    def make(rng, i):
        good = rng.random() < 0.6
        return (data.text(rng, 4) if good else " | ".join(rng.choice(["BUY!!", "NOW", "$$$"]) for _ in range(60))), int(good)

    docs, labels, truth = labelled(spark, make)
    model = quality.fit(docs, labels)
    got = [r for r in quality.score_documents(docs, model).collect() if r.held_out]
    assert rank_accuracy([r.score for r in got], [truth[r.doc_id] for r in got]) > 0.99


def test_trees_walk_like_a_plain_reader():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x, y, trees=20, depth=3)
    codes = np.stack([np.searchsorted(e, c) for e, c in zip(model["edges"], x.T, strict=True)], 1)
    for row, s in zip(codes[:50], quality.score_features(model, x)[:50], strict=True):
        z = model["base"][0]
        for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        assert s == pytest.approx(1 / (1 + np.exp(-z)))
    assert ((quality.score_features(model, x) > 0.5) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("marks", [[], [(1, 1, 1)], [(1, 0, 0), (4, 0, 0), (4, 0, 0), (None, 1, 1), (6, None, None)]])
def test_few_labels_and_edge_rows(spark, module, marks):
    docs = data.docs(spark, data.edge_rows(), clash=True)
    got = module.score_documents(docs, module.fit(docs, spark.createDataFrame(marks, LABELS))).collect()
    assert len(got) == len(data.edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert got[3].score == got[4].score and got[0].score == got[1].score
    nothing = data.empty(spark)
    assert module.score_documents(nothing, module.fit(nothing, spark.createDataFrame(marks, LABELS))).count() == 0


def test_languages_held_out(spark):
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "nopqrstéü"}
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(alphabets))
        t = data.sentence(rng, 12, alphabets[lang])
        rows.append((i, t, lang if i % 9 else None, "s", len(t)))
    docs = data.docs(spark, rows)
    got = {r.doc_id: r for r in langid.predict_documents(docs, langid.fit(docs)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in rows if got[i].held_out and lang]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97


def test_language_edge_rows(spark):
    docs = data.docs(spark, clash=True)
    got = langid.predict_documents(docs, langid.fit(docs)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    assert [by_id[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and by_id[8].score == 0
    assert langid.predict_documents(data.empty(spark), langid.fit(data.empty(spark))).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(docs, langid.fit(data.empty(spark))).collect()} == {"und"}


def test_marks_alone_are_no_letters_and_slices_of_languages_change_nothing(spark, monkeypatch):
    rows = [(i, f"text of{'abcdefgh'[i % 8]} lang{'abcdefgh'[i % 8]}", f"l{i % 8}", "", 0) for i in range(80)]
    rows += [(90, "\u0301", "l1", "", 0), (91, "123 \u0300", "l1", "", 0), (92, "e\u0301", "l1", "", 0), (93, None, "l2", "", 0), (92, "e\u0301", "l1", "", 0)]
    docs = data.docs(spark, rows, clash=True)
    whole = langid.fit(docs)
    assert len(whole) == 1 and whole[0]["logp"].shape == (langid.BUCKETS, 8)
    want = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.predict_documents(docs, whole).collect())
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    parts = langid.fit(docs)
    assert [m["logp"].shape[1] for m in parts] == [3, 3, 2]
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.predict_documents(docs, parts).collect())
    assert got == want
    assert [x[2] == "und" for x in got if x[0] >= 90] == [True, True, False, False, True]


def test_language_scores_against_plain_sums():
    rng = np.random.default_rng(1)
    model = {"langs": np.array(["x", "y"]), "logp": np.log(rng.random((1 << 16, 2))).astype(np.float32), "prior": np.log([0.4, 0.6])}
    texts = ["hello wörld", "", "a", None, "lorem ipsum " * 50]
    names, scores = langid.predictor(model)(texts)
    letters = langid.letter_table()
    for t, n, s in zip(texts, names, scores, strict=True):
        if not t:
            assert (n, s) == ("und", 0)
            continue
        z = model["prior"] + model["logp"][langid.grams(t, letters)].astype(float).sum(0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert n == "xy"[p.argmax()] and s == pytest.approx(p.max())
