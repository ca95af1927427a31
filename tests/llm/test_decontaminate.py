import random
import re
from collections import Counter

from tessera.llm import decontaminate as dc
from tests.llm import data

ITEMS = "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))


def brute(docs, items, similarity=dc.SIMILARITY):
    found = {}
    for d, t, *_ in docs:
        w = words(t)
        for i, it in items:
            iw = words(it)
            if not iw or not w:
                continue
            k, n = min(5, len(iw)), len(iw)
            own = shingles(iw, k)
            best = max((sum((own & x).values()) / sum((own | x).values()) for x in (shingles(w[s : s + n], k) for s in range(max(1, len(w) - n + 1)))))
            if best >= similarity:
                found[d, i] = round(best, 9)
    return found


def cases():
    rng = random.Random(8)
    items = [(i, data.sentence(rng, n)) for i, n in enumerate([30, 45, 12, 60, 20, 3, 1])] + [(7, ""), (8, None), (9, "?!"), (10, "la " * 15), (11, "la la la la la la la la")]
    rows = []
    for i in range(120):
        body = data.text(rng, 3).split(" ")
        if i % 2:
            passage = items[rng.choice([0, 1, 2, 3, 4])][1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):  # words changed, left out or added
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1, 1])] = [data.sentence(rng, 1).lower()[:-1]]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() if i % 3 == 0 else w for w in passage]
        rows.append((100 + i, " ".join(body), "en", "s", 0))
    short = items[5][1]
    return rows + [(500, short, "", "", 0), (501, "la " * 40, "", "", 0), (502, items[0][1] + " x " + items[0][1], "", "", 0)], items


def test_against_brute_force(spark):
    rows, items = cases()
    got = dc.leaks(data.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    mine = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got}
    expected = brute(rows, items)
    assert len(got) == len(mine) and mine == expected and len(expected) > 30


def test_truncated_items_are_found(spark):
    rng = random.Random(3)
    items = [(n, data.sentence(rng, n)) for n in (18, 30, 58, 6, 4)]
    rows = [(1000 * n + (at > 0) * 100 + cut, " ".join(words(text)[at : at + n - cut]), "en", "s", 0) for n, text in items for cut in range(min(n, 12)) for at in {0, cut}]
    expected = brute(rows, items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.leaks(data.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == expected and {(18002, 18), (30004, 30), (58008, 58)} <= set(got)


def test_moved_sentences_are_found(spark):
    rng = random.Random(4)
    items = [(n, data.sentence(rng, n)) for n in (58, 40)] + [(99, "la li " * 20 + data.sentence(rng, 20))]
    rows = []
    for n, text in items:
        w = words(text)
        for moved in range(1, 12):
            for k, passage in enumerate((w[-moved:] + w[:-moved], w[moved:] + w[:moved], w[:10] + w[10 + moved :] + w[10 : 10 + moved])):
                body = words(data.text(rng, 2))
                rows.append((1000 * n + 10 * moved + k, " ".join(body[:9] + passage + body[9:]), "en", "s", 0))
    expected = brute(rows, items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.leaks(data.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == expected and (58080, 58) in got


def test_windows_start_where_they_say(spark):
    rows, items = cases()
    texts, by_item = {i: words(t) for i, t, *_ in rows}, dict(items)
    for r in dc.leaks(data.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect():
        w = texts[r.doc_id][r.start_word : r.start_word + r.n_words]
        k = min(5, len(words(by_item[r.item_id])))
        own, x = shingles(words(by_item[r.item_id]), k), shingles(w, k)
        assert round(sum((own & x).values()) / sum((own | x).values()), 9) == round(r.similarity, 9)


def test_clean_documents_stay_with_all_columns(spark):
    rows, items = cases()
    docs = data.docs(spark, rows + data.edge_rows(), clash=True)
    kept = dc.drop_leaks(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns
    gone = {d for d, _ in brute(rows, items)}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows + data.edge_rows()} - gone
    none = spark.createDataFrame([], ITEMS)
    assert dc.drop_leaks(docs, none).count() == docs.count() and dc.leaks(data.empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0


def test_flips_cover_the_radius():
    for low, width in dc._blocks(dc.BLOCKS):
        masks = dc._flips(width, dc.RADIUS // dc.BLOCKS)
        assert len(masks) == len(set(masks)) and all(m.bit_count() <= 2 for m in masks)
    assert (dc.RADIUS // dc.BLOCKS + 1) * dc.BLOCKS > dc.RADIUS


def test_plan_has_no_python(spark):
    rows, items = cases()
    plan = dc.leaks(data.docs(spark, rows), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_radius_holds_windows_at_the_least_similarity():
    """Random shingle hashes, as many shared as a similarity of 0.8 needs: nearly all fingerprints lie within the radius."""
    import numpy as np

    rng = np.random.default_rng(0)
    outside = total = 0
    for n in range(9, 61, 3):
        m = n - dc.SHINGLE + 1
        c = int(np.ceil(0.8 * 2 * m / 1.8 - 1e-9))
        common, a, b = (rng.integers(0, 2, (400, k, 64), dtype=np.int16).sum(1) for k in (c, m - c, m - c))
        distance = ((2 * (common + a) > m) != (2 * (common + b) > m)).sum(1)
        outside, total = outside + (distance > dc.RADIUS).sum(), total + 400
    assert outside <= 0.001 * total
