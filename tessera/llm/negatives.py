"""Hard negatives by a full sort of each anchor's scores.

Components become floor(256 x), x as double; a score is the integer inner product with the anchor. Rows without an id or a label, and
rows whose vector is null or has a null or non-finite component, take no part. Where vec_id is divisible by MOVED, the label
is first replaced by (label + 1) % CLASSES, as mislabelled rows that mining has to live with.

Anchors and rows are laid out as tiles: a block of anchors meets a partition of blocks of rows in one task (anchors are a stated
hundredth of the rows, and blocks are joined, not rows). Within a tile each anchor's scores are sorted in full, by score and then by id. A first
pass reads the first POSITIVES entries of the anchor's label in each tile and keeps the first of all tiles. A second one, which knows
them, finds each positive's upper limit in the sorted scores by binary search, reads the first NEGATIVES entries of other labels from there down to the
lower limit, and the first of all tiles stay. Nothing larger than a tile's scores is held.

"Other" rows are those of another vec_id; a vec_id that is repeated stands for as many rows and, where it is an anchor, as many anchors.
Vectors of different lengths are compared over the components that both have. Scores are exact: products of sums up to 2^53 by floating point,
larger ones by whole numbers of any size, and held at the ends of 64 bits beyond these. Anchors without a positive, and positives without a negative within
the limits (all those of negative score), give no row. Empty tables give none. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import BLOCK, BLOCK_SCHEMA, Best, Block, block_row, column, common, finite, matrix, runs, spread

EVERY = 100
MOVED, CLASSES = 7, 10
POSITIVES = 5
NEGATIVES = 10
#: Limits of a negative's score, in hundredths of the positive's.
LOWER, UPPER = 30, 90
#: Anchors of a block, rows of a tile.
ANCHORS = 2048
TILE_ROWS = 1 << 19
#: Scores sorted at once.
CELLS = 1 << 21
MOST = (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, labels moved."""
    label = F.col("label").cast("bigint")
    moved = F.pmod(F.pmod(label, F.lit(CLASSES)) + 1, F.lit(CLASSES))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    return known.select("vec_id", F.when(F.col("vec_id") % MOVED == 0, moved).otherwise(label).alias("label"), "embedding")


def quantised(vectors: pa.Array) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * matrix(vectors)), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    a, b = common(a, b)
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([int(x) for x in m.ravel()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            row = block_row(column(part, "vec_id").to_numpy(), quantised(column(part, "embedding")), column(part, "label").to_numpy())
            yield pa.RecordBatch.from_pylist([row])

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of anchors: numbers for their vec_ids, with the vec_ids and the positives found so far (ids and scores, a list for each anchor) beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ANCHORS):
            number = column(part, "anchor").to_numpy()
            row = block_row(number, quantised(column(part, "embedding")), column(part, "label").to_numpy())
            order = np.argsort(number, kind="stable")
            own = column(part, "vec_id").to_numpy()[order]
            found = column(part, "positives").take(pa.array(order))
            yield pa.RecordBatch.from_pylist([{f"a_{k}": v for k, v in row.items()} | {"own": own.tobytes(), "positives": found.to_pylist()}], schema=schema)

    fields = ", ".join(f"a_{x}" for x in BLOCK_SCHEMA.split(", "))
    ddl = f"{fields}, own binary, positives array<array<struct<score: bigint, id: bigint>>>"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(anchors.sparkSession.createDataFrame([], ddl).schema)
    return anchors.mapInArrow(run, ddl)


def tiles(rows: DataFrame, anchors: DataFrame, schema: str, k: int, read: Callable) -> DataFrame:
    """Sorts each anchor's scores in every tile. read(anchor's place, its block, sorted scores, ids, whether of its label, whether its own) gives (keys, scores, ids); the first k of each key in a task's blocks come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b, a = Block(row), Block(row, "a_")
                own = np.frombuffer(row["own"], np.int64)
                step = max(1, CELLS // max(1, len(b.ids)))
                for low in range(0, len(a.ids), step):
                    high = min(low + step, len(a.ids))
                    found = scores(a.cells[low:high], b.cells)
                    # rows stand in the order of their ids, so a stable sort by score sorts by score and id
                    order = np.argsort(-found, axis=1, kind="stable")
                    found = np.take_along_axis(found, order, axis=1)
                    ids = b.ids[order]
                    alike = b.labels[order] == a.labels[low:high, None]
                    best.add(*read(a.ids[low:high], row["positives"][low:high], found, ids, alike, ids == own[low:high, None]))
        keys, score, ids = best.settle()
        for low in range(0, len(keys), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[part]), "score": pa.array(score[part]), "id": pa.array(ids[part])})

    return rows.crossJoin(anchors).mapInArrow(run, schema)


def first_alike(numbers, _, found, ids, alike, own):
    """The first POSITIVES entries of each anchor's label, but those of its own id."""
    fits = alike & ~own
    at = fits & (np.cumsum(fits, axis=1) <= POSITIVES)
    return np.repeat(numbers, at.sum(axis=1)), found[at], ids[at]


def between(numbers, positives, found, ids, alike, own):
    """For each positive the first NEGATIVES entries of other labels between its limits; the key counts an anchor's positives."""
    keys, score, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, number in enumerate(numbers):
        other = np.flatnonzero(~alike[i])
        falling = -found[i][other]
        for p, positive in enumerate(positives[i]):
            top, bottom = UPPER * positive["score"] // 100, -(-LOWER * positive["score"] // 100)
            start, end = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -bottom, "right")
            at = other[start : min(start + NEGATIVES, end)]
            if len(at):
                keys.append(np.full(len(at), number * POSITIVES + p))
                score.append(found[i][at])
                chosen.append(ids[i][at])
    return np.concatenate(keys), np.concatenate(score), np.concatenate(chosen)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    known = usable(rows)
    held = checkpointed(blocks(known))
    n = held.agg(F.sum("n")).first()[0] or 0
    tiled = spread(held, n, TILE_ROWS)
    numbered = checkpointed(known.where(F.col("vec_id") % EVERY == 0)).withColumn("anchor", F.monotonically_increasing_id())  # the files of the checkpoint fix the order
    parts = max(1, -(-numbered.count() // ANCHORS))
    none = F.array().cast("array<struct<score: bigint, id: bigint>>")
    first = tiles(tiled, anchor_blocks(numbered.withColumn("positives", none).repartition(parts)), "key bigint, score bigint, id bigint", POSITIVES, first_alike)
    below = F.struct((-F.col("score")).alias("below"), "id")
    sorted_ = F.slice(F.array_sort(F.collect_list(below)), 1, POSITIVES)  # some entries from each tile
    positives = first.groupBy(F.col("key").alias("anchor")).agg(F.transform(sorted_, lambda x: F.struct((-x["below"]).alias("score"), x["id"].alias("id"))).alias("positives"))
    ready = checkpointed(numbered.join(positives, "anchor"))
    second = tiles(tiled, anchor_blocks(ready.repartition(parts)), "key bigint, score bigint, id bigint", NEGATIVES, between)
    listed = ready.select("vec_id", "anchor", F.posexplode("positives").alias("p", "positive")).select((F.col("anchor") * POSITIVES + F.col("p")).alias("key"), F.col("vec_id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    taken = second.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(below)), 1, NEGATIVES).alias("negatives"))
    return listed.join(taken, "key").select("anchor_id", "positive_id", "positive_score", F.posexplode("negatives").alias("at", "negative")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", (-F.col("negative.below")).alias("negative_score")
    )
