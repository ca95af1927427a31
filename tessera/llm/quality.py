"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics are taken of each whole text in numpy; feature values are cut at quantiles of a labelled sample, trees grow
level by level on histograms of gradients, and the fitted forest lies in flat arrays (feature, cut, leaf) that a batch of
rows walks together, one gather a level.

Null and empty texts have all statistics 0 and are scored like any other. With no labels, or labels of one kind, each
text gets the smoothed share of positive labels. Repeated rows get equal scores. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc_mod, filter_texts, fit_in_task, labelled_sample, map_texts, sigmoid, words

#: Bound of the labelled sample that the trees are fitted on.
SAMPLE = 12_000
TREES = 60
DEPTH = 5
BINS = 64
RATE = 0.2
THRESHOLD = 0.7
HELD_OUT = (4, 2)

CLASSES = ("A-Z", "a-z", "0-9", " ", "\n", "!", "|", "*#%&$", ".?", ",;:", "<>{}[]()=/\\", "@_~^`\"'+-")
FEATURES = ("chars", "words", "word_length", "distinct_words", "top_word", "repeated_next", "lines", "distinct_lines", "line_length", "ends_closed", "high_bytes", "long_words", *CLASSES)


def _class_table() -> np.ndarray:
    """256 byte values by character classes, and a last column for bytes beyond ASCII."""
    out = np.zeros((256, len(CLASSES) + 1))
    for k, c in enumerate(CLASSES):
        members = range(ord(c[0]), ord(c[2]) + 1) if len(c) == 3 and c[1] == "-" else map(ord, c)
        out[list(members), k] = 1
    out[128:, -1] = 1
    return out


TABLE = _class_table()


def statistics(texts: list) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        shares = np.bincount(raw, minlength=256) @ TABLE / len(raw)
        ws = words(text)
        n = max(1, len(ws))
        lines = [x for x in text.split("\n") if x.strip()]
        m = max(1, len(lines))
        count = Counter(ws)
        out[i, :12] = (
            np.log1p(len(text)), np.log1p(len(ws)), len(raw) / n, len(count) / n, max(count.values(), default=0) / n, sum(map(eq, ws, ws[1:])) / n,
            np.log1p(len(lines)), len(set(lines)) / m, np.log1p(len(text) / m), sum(x.rstrip()[-1] in ".!?" for x in lines) / m, shares[-1], sum(len(w) > 20 for w in count) / n,
        )
        out[i, 12:] = shares[:-1]
    return out


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree: feature and cut of the inner nodes in heap order, value of the leaves. A node without a gain sends all rows left."""
    n, f = codes.shape
    feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, bins, np.int32)
    node = np.zeros(n, np.int64)
    cells = codes.astype(np.int64) + np.arange(f) * bins
    for level in range(depth):
        width = 2**level
        at = (node[:, None] * (f * bins) + cells).ravel()
        hist = [np.bincount(at, np.repeat(x, f), width * f * bins).reshape(width, f, bins) for x in (g, h)]
        left_g, left_h = (x.cumsum(2) for x in hist)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        gain[(left_h < 1) | (right_h < 1)] = 0
        flat = gain.reshape(width, -1)
        best = flat.argmax(1)
        split = flat[np.arange(width), best] > 1e-6
        here = slice(width - 1, 2 * width - 1)
        feature[here] = np.where(split, best // bins, 0)
        cut[here] = np.where(split, best % bins, bins)
        inner = node + width - 1
        node = node * 2 + (codes[np.arange(n), feature[inner]] > cut[inner])
    sums = [np.bincount(node, x, 2**depth) for x in (g, h)]
    return feature, cut, -sums[0] / (sums[1] + penalty)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> dict[str, np.ndarray]:
    edges = np.quantile(x, np.linspace(0, 1, bins)[1:-1], axis=0).T.astype(np.float32)  # feature by inner edge
    codes = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1).astype(np.int32)
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z = np.full(len(y), base)
    grown = []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = sigmoid(z)
        tree = _grow(codes, p - y, p * (1 - p), depth, bins)
        z += rate * walk_tree(codes, *tree, depth)
        grown.append(tree)
    flat = [np.stack(a) if grown else np.zeros((0, k)) for a, k in zip(zip(*grown, strict=True) if grown else [()] * 3, (2**depth - 1, 2**depth - 1, 2**depth), strict=True)]
    return {"edges": edges, "feature": flat[0].astype(np.int32), "cut": flat[1].astype(np.int32), "leaf": flat[2] * rate, "base": np.array([base]), "depth": np.array([depth])}


def walk_tree(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each row: all rows step down together."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(depth):
        inner = node + 2**level - 1
        node = node * 2 + (codes[rows, feature[inner]] > cut[inner])
    return leaf[node]


def score_features(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    codes = np.stack([np.searchsorted(e, c) for e, c in zip(model["edges"], x.T, strict=True)], 1).astype(np.int32)
    z = np.full(len(x), float(model["base"][0]))
    for tree in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        z += walk_tree(codes, *tree, int(model["depth"][0]))
    return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """The forest, from a sample of at most about `sample` labelled rows outside the held-out part."""
    rows = labelled_sample(docs, labels, "quality", *HELD_OUT, sample)
    features = map_texts(rows, "text", "doc_id bigint, y int, x array<float>", lambda: lambda b, texts: [b.column("doc_id"), b.column("y"), list(statistics(texts))])

    def in_task(got: pa.Table | None) -> dict[str, np.ndarray]:
        if got is None:
            return fit_trees(np.zeros((1, len(FEATURES)), np.float32), np.zeros(0), 0, depth)
        got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        return fit_trees(np.stack(got["x"].combine_chunks().to_numpy(zero_copy_only=False)), got["y"].to_numpy().astype(float), trees, depth)

    return fit_in_task(features, in_task)


def scorer(model: dict[str, np.ndarray]) -> Callable[[list], np.ndarray]:
    return lambda texts: score_features(model, statistics(texts))


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


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model predicts to be of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: score(texts) >= threshold

    return filter_texts(docs, "text", make)
