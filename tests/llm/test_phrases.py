"""Phrases against plain counts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases
from tests.llm import data

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=2000, longest=5):
    f, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(UPPER)):
            ws = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    kept = {x: n for x, n in f.items() if n >= least}
    inside = Counter()
    for (lang, ws), n in kept.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i : i + m]] = max(inside[lang, ws[i : i + m]], n)
    found: dict = {}
    for (lang, ws), a in kept.items():
        if len(ws) > 1 and inside[lang, ws] < a:
            n = total[lang]
            score, _, left, right = min((1000 * a * n // (kept[lang, ws[:k]] * kept[lang, ws[k:]]), k, kept[lang, ws[:k]], kept[lang, ws[k:]]) for k in range(1, len(ws)))
            found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right, n))
    return sorted((lang, rank, p.decode(), -a, left, right, n, -s) for lang, rows_ in found.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(rows_)[:most], 1))


def mined(docs, least, **how):
    return sorted(map(tuple, phrases.mine(docs, least, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    ws = [f"w{i}" for i in range(12)] + ["É", "A", "ß", "東京", "😀"]
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(ws) + rng.choice(["", "", "", ",", ".", "\t", "  ", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, body + " one Fixed phrase of words", rng.choice(["en", "de", None, "und", ""]), "s", 0))
    return rows


@pytest.mark.parametrize("least", [2, 5])
def test_as_by_plain_counts(spark, least):
    rows = corpus()
    assert mined(data.docs(spark, rows, clash=True), least) == plain(rows, least)


def test_first_of_each_lang_and_shorter_phrases(spark):
    rows = corpus(seed=2)
    docs = data.docs(spark, rows)
    assert mined(docs, 2, most=7) == plain(rows, 2, 7)
    assert mined(docs, 2, longest=3) == plain(rows, 2, longest=3)


def test_crowded_bitmap_and_slices_change_nothing(spark, monkeypatch):
    rows = corpus(seed=3)
    want = plain(rows, 3)
    for name, value in (("FILTER", 11), ("SLICE", 200), ("PENDING", 50), ("SEGMENT_CHARS", 4)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(data.docs(spark, rows), 3) == want


def test_edges(spark):
    assert mined(data.empty(spark), 1) == []
    rows = data.edge_rows()
    assert mined(data.docs(spark, rows), 2) == plain(rows, 2)
    long = [(1, "la la la la la la " * 5000, "en", "s", 0), (1, None, None, None, None), (2, "la la", "en", "s", 0)]
    assert mined(data.docs(spark, long), 100) == plain(long, 100)


def test_one_lang_holds_nearly_all(spark):
    rows = [(i, "hot words here, and hot words there", "en", "s", 0) for i in range(300)] + [(1000 + i, "kalte worte hier", "de", "s", 0) for i in range(3)]
    assert mined(data.docs(spark, rows), 3) == plain(rows, 3)


def test_products_past_64_bits(spark):
    n = 10**17
    table = spark.createDataFrame([("x", 0, "", n), ("x", 1, "a", 10**12), ("x", 1, "b", 10**12 + 7), ("x", 2, "a b", 10**12 - 3)], "lang string, words int, phrase string, f bigint")
    (row,) = phrases.scored(table.withColumn("extra", F.lit(1))).collect()
    assert row.score == 1000 * (10**12 - 3) * n // (10**12 * (10**12 + 7))
