"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if the text has a word of hashed term i. The
factors v let a pair of terms (an insult and a mention of a group) weigh more than the sum of both.

Terms are words without the punctuation around them and the words' beginnings (inflected forms of one stem share these).
They are hashed into `buckets`. A screen on the sample keeps the terms whose presence goes with the label, and those of pairs
(of the PAIRED terms in most texts) that go with it as a pair, whatever each does alone; at most `max_terms` in all.

Null and empty texts have no term and get the model's bias. With no labels, or labels of one kind, every text gets the
smoothed share of positive labels. Repeated rows get equal scores. Further columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filter_texts, fit_in_task, labelled_sample, map_texts, sigmoid, words

BUCKETS = 1 << 20
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 12_000
MAX_TERMS = 1024
FACTORS = 8
MIN_RATIO = 1.0
#: Terms whose pairs are screened, and the standard errors from zero that a pair's own effect must have (of two million pairs one passes by chance).
PAIRED = 2048
PAIR_ERRORS = 5.0
THRESHOLD = 0.7
HELD_OUT = (3, 1)
PREFIXES = (4, 5)
STRIP = b".,;:!?\"'()[]{}<>*#%&$|-_"
CACHE = 150_000


def term_ids(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its beginnings."""
    core = word.strip(STRIP) or word
    ids = [xxhash.xxh32_intdigest(core, 0) % buckets]
    ids += [xxhash.xxh32_intdigest(core[:n], n) % buckets for n in PREFIXES if len(core) > n]
    return ids


def text_terms(texts: list, buckets: int = BUCKETS) -> list[np.ndarray]:
    cache: dict[bytes, list[int]] = {}
    out = []
    for text in texts:
        found: set[int] = set()
        for w in set(words(text)):
            ids = cache.get(w)
            if ids is None:
                if len(cache) > CACHE:
                    cache.clear()
                ids = cache[w] = term_ids(w, buckets)
            found.update(ids)
        out.append(np.sort(np.fromiter(found, np.int32, len(found))))
    return out


def screen(ids: list[np.ndarray], y: np.ndarray, buckets: int, max_terms: int) -> np.ndarray:
    """The terms to learn from: `max_terms` at most, three quarters of them by themselves and the rest as members of pairs."""
    pos = np.zeros(buckets)
    neg = np.zeros(buckets)
    for label, into in ((1, pos), (0, neg)):
        if got := [x for x, k in zip(ids, y, strict=True) if k == label]:
            into += np.bincount(np.concatenate(got), minlength=buckets)
    paired = pair_terms(ids, y, pos + neg)
    single = single_terms(pos, neg, max(1, int((y == 1).sum())), max(1, int((y == 0).sum())))
    most = max_terms - min(len(paired), max_terms // 4)
    return np.union1d(single[:most], paired[: max_terms - min(len(single), most)])


def single_terms(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Buckets whose log odds ratio is MIN_RATIO or more either way and four standard errors or more from zero, the clearest first."""
    a, b, c, d = pos + 0.5, n1 - pos + 0.5, neg + 0.5, n0 - neg + 0.5
    ratio = np.log(a / b) - np.log(c / d)
    z = ratio / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[(pos + neg < 5) | (np.abs(ratio) < MIN_RATIO)] = 0
    order = np.argsort(-np.abs(z), kind="stable")
    return order[np.abs(z[order]) >= 4]


def pair_terms(ids: list[np.ndarray], y: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Buckets of the pairs whose joint presence changes the log odds of the label by more than both terms do (MIN_RATIO, PAIR_ERRORS), the clearest first.

    With a and b for the terms, the effect is logit(ab) - logit(a alone) - logit(b alone) + logit(neither).
    """
    common = np.argsort(-df, kind="stable")[:PAIRED]
    common = np.sort(common[df[common] >= 5])
    if len(common) < 2:
        return common[:0]
    x = np.zeros((len(y), len(common)), np.float32)
    for i, row in enumerate(ids):
        x[i, np.searchsorted(common, np.intersect1d(row, common, assume_unique=True))] = 1
    marked = x[y == 1]
    pos, every = (marked.T @ marked, marked.sum(0), len(marked)), (x.T @ x, x.sum(0), len(x))
    del x, marked
    effect = error = np.float32(0)
    for sign, (both, one, n) in ((1, pos), (-1, tuple(a - b for a, b in zip(every, pos, strict=True)))):
        for cell, s in ((both, 1), (one[:, None] - both, -1), (one[None, :] - both, -1), (n - one[:, None] - one[None, :] + both, 1)):
            effect = effect + np.float32(sign * s) * np.log(cell + np.float32(0.5))
            error = error + 1 / (cell + np.float32(0.5))
    z = np.abs(effect) / np.sqrt(error)
    z[np.abs(effect) < MIN_RATIO] = 0
    i, j = np.nonzero(np.triu(z >= PAIR_ERRORS, 1))
    order = np.argsort(-z[i, j], kind="stable")
    members = common[np.stack([i[order], j[order]], 1).ravel()]
    return members[np.sort(np.unique(members, return_index=True)[1])]


def machine(x: np.ndarray, b: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return b + x @ w + 0.5 * (((x @ v) ** 2).sum(1) - x @ (v**2).sum(1))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_machine(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 40, size: int = 256, rate: float = 0.02, decay: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the log loss. x: rows by terms, 0 or 1. Every tenth row is kept back; the epoch that does best on those is returned."""
    rng = np.random.default_rng(17)
    n, t = x.shape
    params = [np.full(1, np.log((y.sum() + 1) / (n - y.sum() + 1)), np.float32), np.zeros(t, np.float32), rng.normal(0, 0.03, (t, factors)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    back = np.arange(n) % 10 == 9
    best, least = None, np.inf
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~back))
        for start in range(0, len(order), size):
            xb, yb = x[order[start : start + size]], y[order[start : start + size]]
            xv = xb @ params[2]
            z = machine(xb, *params)
            g = ((sigmoid(z) - yb) / len(yb)).astype(np.float32)
            gw = g @ xb
            grads = [g.sum(keepdims=True), gw + decay * params[1], xb.T @ (g[:, None] * xv) - gw[:, None] * params[2] + 100 * decay * params[2]]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * d
                v *= 0.999
                v += 0.001 * d * d
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        loss = log_loss(machine(x[back], *params), y[back]) if back.any() else 0.0
        if best is None or loss < least:
            best, least = [p.copy() for p in params], loss
    return float(best[0][0]), best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, max_terms: int = MAX_TERMS, factors: int = FACTORS) -> dict[str, np.ndarray]:
    """The model, from a sample of at most about `sample` labelled rows outside the held-out part."""
    rows = labelled_sample(docs, labels, "toxic", *HELD_OUT, sample)
    features = map_texts(rows, "text", "doc_id bigint, y int, ids array<int>", lambda: lambda b, texts: [b.column("doc_id"), b.column("y"), text_terms(texts, buckets)])

    def in_task(got: pa.Table | None) -> dict[str, np.ndarray]:
        nothing = {"bias": np.zeros(1), "terms": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, factors))}
        if got is None:
            return nothing
        got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        y = got["y"].to_numpy().astype(np.float32)
        ids = [np.asarray(x, np.int64) for x in got["ids"].combine_chunks().to_numpy(zero_copy_only=False)]
        first = sorted({(x.tobytes(), k): i for i, (x, k) in reversed(list(enumerate(zip(ids, y, strict=True))))}.values())
        ids, y = [ids[i] for i in first], y[first]  # copies would pass for evidence
        terms = screen(ids, y, buckets, max_terms)
        if not len(terms):
            return nothing | {"bias": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])}
        x = np.zeros((len(y), len(terms)), np.float32)
        for i, row in enumerate(ids):
            x[i, np.searchsorted(terms, np.intersect1d(row, terms, assume_unique=True))] = 1
        b, w, v = fit_machine(x, y, factors)
        return {"bias": np.array([b]), "terms": terms, "w": w, "v": v}

    return fit_in_task(features, in_task)


def scorer(model: dict[str, np.ndarray], buckets: int = BUCKETS) -> Callable[[list], np.ndarray]:
    """fn(texts) -> scores from 0 to 1."""
    column = {int(t): i for i, t in enumerate(model["terms"])}
    bias, w, v = float(model["bias"][0]), model["w"], model["v"]
    cache: dict[bytes, tuple] = {}

    def score(texts: list) -> np.ndarray:
        z = np.full(len(texts), bias)
        for k, text in enumerate(texts):
            found: set[int] = set()
            for word in set(words(text)):
                ids = cache.get(word)
                if ids is None:
                    if len(cache) > CACHE:
                        cache.clear()
                    ids = cache[word] = tuple(column[t] for t in term_ids(word, buckets) if t in column)
                if ids:
                    found.update(ids)
            if found:
                at = np.sort(np.fromiter(found, np.int64, len(found)))
                vs = v[at]
                z[k] += w[at].sum() + 0.5 * float((vs.sum(0) ** 2 - (vs**2).sum(0)).sum())
        return sigmoid(z)

    return score


def score_documents(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)

        def rows(batch, texts):
            s = score(texts)
            return [batch.column("doc_id"), batch.column("held_out"), s, (s >= threshold).astype(np.int32)]

        return rows

    base = docs.select("doc_id", "text", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    return map_texts(base, "text", "doc_id bigint, held_out boolean, score double, predicted int", make)


def keep_clean(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: score(texts) < threshold

    return filter_texts(docs, "text", make)
