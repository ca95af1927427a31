"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs without letters and marks become one blank, and runs of two and three characters are hashed into
BUCKETS buckets. The matrix of log probabilities (bucket by language) is broadcast, LANGUAGES languages at a time (64 MB): with more languages than that, each further slice of them is
broadcast in turn and scores all texts, and the slices' best and sums are joined by text. So the model does not change with the number of languages, and none is left out. A batch of
texts becomes one long array of buckets; gathered rows of the matrix are summed by text.

score is the posterior probability of the language named. Null texts and texts without a letter (category L; marks alone
are none), and all texts where nothing was learned, get `und` with score 0. Ties go to the language that sorts first.
Repeated rows get equal results. Further columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, map_texts, small_side

BUCKETS = 1 << 16
#: Bound of the texts learned from, for each language.
SAMPLE = 4000
#: Languages of a slice of the matrix.
LANGUAGES = 256
HELD_OUT = (4, 2)
UNKNOWN = "und"
#: Grams gathered at once.
SPAN = 1 << 19


def letter_table() -> np.ndarray:
    """2 at the code points that are letters, 1 at marks, 0 elsewhere."""
    return np.fromiter(("_ML".find(unicodedata.category(chr(i))[0]) for i in range(0x110000)), np.int8, 0x110000).clip(0)


def grams(text: str, letters: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of a text; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kinds = letters[c]
    if not (kinds == 2).any():
        return np.zeros(0, np.int64)
    is_letter = kinds > 0
    c = np.where(is_letter, c, 0)
    c = np.concatenate([[0], c[is_letter | np.concatenate([[False], is_letter[:-1]])], [0]]).astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
    both = np.concatenate([two, three])
    both ^= both >> np.uint64(29)
    both *= np.uint64(0x94D049BB133111EB)
    return (both >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)


def training_sample(docs: DataFrame, sample: int) -> DataFrame:
    """About `sample` texts of each language from outside the held-out part, taken by the hash of the id."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share"))
    hashed = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 52))
    return known.join(small_side(shares), "lang").where(hashed < F.col("share") * float(1 << 52)).select("text", "lang")


def counted(texts: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n): how often the n-grams of a language's texts fall into each bucket; bucket -1 counts its texts."""

    def run(batches):
        letters = letter_table()
        for b in batches:
            names, of = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(names):
                found = [grams(t, letters, buckets) for t in b.column("text").take(pa.array(np.flatnonzero(of == k))).to_pylist()]
                bucket, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([str(name)] * (len(n) + 1)), "bucket": pa.array([-1, *bucket.tolist()], pa.int64()), "n": pa.array([len(found), *n.tolist()], pa.int64())})

    # dealt out anew, since few of the rows read are in the sample; summed, it has a row for a cell of the matrix at most
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(parts).mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, smooth: float = 0.5) -> list[dict[str, np.ndarray]]:
    """For each slice of languages in order: their names and their log probabilities (buckets by languages), and their priors. One slice without languages, if there are none."""
    cells = checkpointed(counted(training_sample(docs, sample), buckets))
    sizes = cells.where("bucket = -1").select("lang", "n").toPandas().sort_values("lang")  # a number for each language
    langs, docs_of = sizes["lang"].to_numpy(str), sizes["n"].to_numpy(np.float64)
    order = np.argsort(langs, kind="stable")
    langs, docs_of = langs[order], docs_of[order]
    out = []
    for low in range(0, max(1, len(langs)), LANGUAGES):
        some = langs[low : low + LANGUAGES]
        total = np.zeros((buckets, len(some)))
        if len(some):
            held = cells.where("bucket >= 0").where(F.col("lang").isin(*some.tolist())).toArrow()
            total[held.column("bucket").to_numpy(), np.searchsorted(some, np.array(held.column("lang").to_pylist(), str))] = held.column("n").to_numpy()
        logp = np.log(total + smooth) - np.log((total + smooth).sum(0)) if len(some) else total
        out.append({"langs": some, "logp": logp.astype(np.float32), "prior": np.log(docs_of[low : low + LANGUAGES] / max(1, docs_of.sum()))})
    return out


def scorer(model: dict[str, np.ndarray]) -> Callable[[list], tuple[list, np.ndarray, np.ndarray]]:
    """fn(texts) -> the best language of a slice (None: no letter, or no language), its log probability with the text, and the logarithm of the sum over the slice."""
    langs, logp, prior = [str(x) for x in model["langs"]], model["logp"], model["prior"]
    letters, buckets = letter_table(), len(logp)

    def score(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        names, best, total = [None] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        if not langs:
            return names, best, total
        found = [grams(t, letters, buckets) if t else np.zeros(0, np.int64) for t in texts]
        rows = np.array([i for i, g in enumerate(found) if len(g)], np.int64)
        if not len(rows):
            return names, best, total
        z = np.zeros((len(rows), len(langs)))
        held, at, size = [], [], 0

        def settle() -> None:
            nonlocal held, at, size
            starts = np.concatenate([[0], np.cumsum([len(g) for g in held])[:-1]]).astype(np.int64)
            np.add.at(z, at, np.add.reduceat(logp[np.concatenate(held)], starts, axis=0, dtype=np.float64))
            held, at, size = [], [], 0

        for k, i in enumerate(rows):
            for start in range(0, len(found[i]), SPAN):
                held.append(found[i][start : start + SPAN])
                at.append(k)
                size += len(held[-1])
                if size >= SPAN:
                    settle()
        if held:
            settle()
        z += prior
        top = z.argmax(1)
        best[rows] = z[np.arange(len(rows)), top]
        total[rows] = best[rows] + np.log(np.exp(z - best[rows][:, None]).sum(1))
        for i, b in zip(rows, top, strict=True):
            names[i] = langs[b]
        return names, best, total

    return score


def predictor(model: dict[str, np.ndarray]) -> Callable[[list], tuple[list[str], np.ndarray]]:
    """fn(texts) -> languages and their posterior probabilities, by a slice that has all languages."""
    score = scorer(model)

    def predict(texts: list) -> tuple[list[str], np.ndarray]:
        names, best, total = score(texts)
        known = np.isfinite(best)
        p = np.zeros(len(texts))
        p[known] = np.clip(np.exp(best[known] - total[known]), 0, 1)
        return [UNKNOWN if n is None else n for n in names], p

    return predict


def predict_documents(docs: DataFrame, model: list[dict[str, np.ndarray]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    base = docs.select("doc_id", "text", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    sc = docs.sparkSession.sparkContext
    if len(model) == 1:
        shared = sc.broadcast(model[0])

        def make():
            predict = predictor(shared.value)

            def rows(batch, texts):
                names, scores = predict(texts)
                return [batch.column("doc_id"), batch.column("held_out"), names, scores]

            return rows

        return map_texts(base, "text", "doc_id bigint, held_out boolean, lang_pred string, score double", make)
    base = checkpointed(base).withColumn("row", F.monotonically_increasing_id())  # the files of the checkpoint fix the order
    found = reduce(DataFrame.union, (_scored(base, sc.broadcast(part)) for part in model))
    top = F.min_by(F.struct("lang", "best"), F.struct((-F.col("best")).alias("below"), "lang"))
    most = found.groupBy("row").agg(F.max("total").alias("most"))
    summed = found.join(most, "row").groupBy("row").agg(top.alias("top"), F.sum(F.exp(F.col("total") - F.col("most"))).alias("sum"), F.max("most").alias("most"))
    p = F.least(F.lit(1.0), F.exp(F.col("top.best") - F.col("most")) / F.col("sum"))
    return base.join(summed, "row", "left").select("doc_id", "held_out", F.coalesce("top.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("top").isNotNull(), p).otherwise(0.0).alias("score"))


def _scored(base: DataFrame, shared) -> DataFrame:
    """row, lang, best, total of the texts with a letter, by one slice of languages."""

    def make():
        score = scorer(shared.value)

        def rows(batch, texts):
            names, best, total = score(texts)
            at = np.array([n is not None for n in names], bool)
            return [batch.column("row").filter(pa.array(at)), [n for n in names if n is not None], best[at], total[at]]

        return rows

    return map_texts(base.select("row", "text"), "text", "row bigint, lang string, best double, total double", make)
