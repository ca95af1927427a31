"""Small tables for the training-data operators."""

from __future__ import annotations

import random
import string

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int, letters: str = string.ascii_lowercase) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def text(rng: random.Random, lines: int = 4) -> str:
    return "\n".join(sentence(rng, rng.randint(5, 25)) for _ in range(lines))


def edge_rows() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, one very long text, and odd characters."""
    rng = random.Random(5)
    long = text(rng, 400)
    return [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 5), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "one", None, "s", 3), (None, "no id here", "en", "s", 10), (6, long, "en", "s", len(long)), (7, "é▁ñ 😀\x0b中文́ １２", "es", None, 9), (8, "!!! ... ???", "en", "s", 11)]


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = text(rng, rng.randint(1, 6))
        rows.append((10 + i, t, "en", f"s{i % 3}", len(t)))
    for i in range(10):  # exact copies and one-word edits
        base = rows[i][1]
        rows.append((1000 + i, base if i % 2 else base.replace(".", " extra.", 1), "en", "s0", len(base)))
    return rows


def docs(spark, rows=None, clash: bool = False):
    df = spark.createDataFrame(corpus() + edge_rows() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for c in ("score", "fingerprint", "fp", "component_id", "keys", "start", "held_out", "n", "w", "known_id", "gone_id"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
