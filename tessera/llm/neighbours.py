"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Rows without an id, and rows whose vector is null, zero or has a null or non-finite component, take no part. Rows repeated with id and
vector count once as candidates. Of a vector that many rows share, only the `k` + 1 smallest ids can be among the nearest, so only these are
candidates: a group of copies is never searched as a whole.

Tree: fitted in one task on about SAMPLE rows, taken by the hash of their ids (the bound of what is fitted on; every candidate is indexed).
A node with more sampled rows than its share of LEAF rows is cut into up to BRANCHES children by k-means, until no further cut helps.
Every candidate goes down the tree to the nearest centroid at each node. The rows of a leaf are stored in blocks of about BLOCK rows, so that a crowded
leaf is many blocks.

Search: a query keeps a priority queue of nodes, best first: by the inner product with the centroid, and as much above it as a node's spread
promises. Taking an inner node from the queue puts its children in, taking a leaf visits it. Queries are brought to the blocks of the leaves that they visit by an
equality join; a task keeps the best `k` of each query over its blocks, and those of all tasks are merged, some hundred queries at a time.

How many leaves are visited: CALIBRATED rows are taken by hash, and their true neighbours found among all candidates. The visits are widened, leaf by
leaf, until RECALL of these neighbours lie in the leaves visited.

Products are in double precision on the original vectors: a matrix product chooses, and what it chooses is computed again in one order for all pairs, so that equal
vectors tie. Ties go to the smaller vec_id. A query never finds rows of its own vec_id; repeated queries get as many results. With fewer candidates than k, all are found.
Vectors of different lengths are compared over the components that both have. Empty tables give no rows. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drawn, fit_in_task
from .vectors import BLOCK, BLOCK_SCHEMA, Best, Block, block_row, column, common, finite, joined, matrix, packed, runs, spread, unpacked

EVERY = 20
NEAREST = 20
SAMPLE = 1 << 16
LEAF = 256
BRANCHES = 16
ROUNDS = 10
CALIBRATED = 256
RECALL = 0.96
#: Sampled rows that a cut leaves in a node at least, on average.
LEAST = 4
#: How far above the centroid's product a node's best row is expected, in standard deviations of its rows in one direction.
ABOVE = 2.4
#: Queries traversed at once, and those merged in one group.
BATCH, MERGED = 2048, 128
#: Products computed at once.
CELLS = 1 << 21


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    return rows.where(F.col("vec_id").isNotNull() & finite("embedding") & F.expr("exists(embedding, x -> x != 0)")).select("vec_id", "embedding")


def candidates(known: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the nearest: of each vector those of the k + 1 smallest ids, once each."""
    same = Window.partitionBy("h", "embedding").orderBy("vec_id")
    ranked = known.withColumn("h", F.xxhash64("embedding")).withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    before = F.lag("vec_id").over(same)
    return ranked.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("vec_id"))).select("vec_id", "embedding")


def means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Group of each row, by k-means; fewer than k groups where rows are alike."""
    centres = np.unique(rows[rng.choice(len(rows), k, replace=False)], axis=0)
    for _ in range(ROUNDS):
        group = (rows @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(group, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, group, rows)
        centres = total[n > 0] / n[n > 0, None]
    return np.unique((rows @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1), return_inverse=True)[1]


def build(rows: np.ndarray, capacity: float, seed: int = 0) -> dict[str, np.ndarray]:
    """A tree as arrays by node: centre, spread, first child and number of children, number of the leaf (-1: inner)."""
    rng = np.random.default_rng(seed)
    centres, spreads, first, children, groups = [], [], [], [], [np.arange(len(rows))]
    at = 0
    while at < len(groups):  # children of a node stand side by side
        own = rows[groups[at]]
        centre = own.mean(0) if len(own) else np.zeros(rows.shape[1])
        centres.append(centre)
        spreads.append(np.sqrt(((own - centre) ** 2).sum(1).mean() / max(1, rows.shape[1])) if len(own) else 0.0)
        first.append(len(groups))
        children.append(0)
        if len(own) > max(capacity, 2 * LEAST):
            k = int(min(BRANCHES, max(2, np.ceil(len(own) / max(capacity, LEAST)))))
            group = means(own, k, rng)
            if group.max() > 0:
                children[at] = int(group.max()) + 1
                groups += [groups[at][group == g] for g in range(children[at])]
        at += 1
    children = np.array(children)
    leaf = np.where(children == 0, np.cumsum(children == 0) - 1, -1)
    return {"centres": np.array(centres), "spreads": np.array(spreads), "first": np.array(first), "children": children, "leaf": leaf}


def fit(known: DataFrame, n: int, leaf: int = LEAF, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A tree for n rows, from about `sample` of them."""
    share = min(1.0, sample / max(1, n))
    some = known.where(drawn(share, "vec_id")) if share < 1 else known

    def tree(rows: pa.Table | None) -> dict[str, np.ndarray]:
        if rows is None:
            return build(np.zeros((0, 1)), 1)
        order = np.argsort(column(rows, "vec_id").to_numpy(), kind="stable")
        cells = matrix(column(rows, "embedding"))[order]
        return build(cells[np.lexsort(cells.T[::-1])], max(LEAST, leaf * share))

    return fit_in_task(some, tree)


def leaves_of(tree: dict[str, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """Leaf of each row: down the tree, at each node to the nearest child."""
    node = np.zeros(len(cells), np.int64)
    rows = np.arange(len(cells))
    while len(rows := rows[tree["children"][node[rows]] > 0]):
        order = np.argsort(node[rows], kind="stable")
        rows = rows[order]
        cuts = np.flatnonzero(np.diff(node[rows])) + 1
        for some in np.split(rows, cuts):
            parent = node[some[0]]
            first, n = tree["first"][parent], tree["children"][parent]
            own, centres = common(cells[some], tree["centres"][first : first + n])
            node[some] = first + (own @ centres.T - 0.5 * (tree["centres"][first : first + n] ** 2).sum(1)).argmax(1)
    return tree["leaf"][node]


def visits(tree: dict[str, np.ndarray], cells: np.ndarray, most: int) -> np.ndarray:
    """The first `most` leaves that each query visits, best bin first (all, if fewer)."""
    own, centres = common(cells, tree["centres"])
    promise = -(own @ centres.T + ABOVE * np.sqrt((cells**2).sum(1))[:, None] * tree["spreads"])
    first, children, leaf = tree["first"].tolist(), tree["children"].tolist(), tree["leaf"].tolist()
    out = np.zeros((len(cells), min(most, int(tree["leaf"].max()) + 1)), np.int64)
    for q, row in enumerate(promise.tolist()):
        queue, found = [(row[0], 0)], 0
        while found < out.shape[1]:
            _, node = heapq.heappop(queue)
            if children[node]:
                for child in range(first[node], first[node] + children[node]):
                    heapq.heappush(queue, (row[child], child))
            else:
                out[q, found] = leaf[node]
                found += 1
    return out


def nearest(queries: np.ndarray, own: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, product, id) of each query's k nearest rows of a block, but those of the query's own id; rows that tie with the last may be more."""
    places, products, ids = [], [], []
    q, cells = common(queries, block.cells)
    step = max(1, CELLS // max(1, len(block.ids)))
    longest = np.sqrt((cells**2).sum(1).max(initial=0))
    for low in range(0, len(q), step):
        some = q[low : low + step]
        found = some @ cells.T
        found[block.ids == own[low : low + step, None]] = -np.inf
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.full(len(some), -np.inf)
        # what rounding may have put below the last one is computed again too
        near = found >= (least - 1e-9 * longest * np.sqrt((some**2).sum(1)))[:, None]
        at, row = np.nonzero(near & (found > -np.inf))
        for part in range(0, len(at), CELLS // 16):
            a, r = at[part : part + CELLS // 16], row[part : part + CELLS // 16]
            products.append(np.einsum("ij,ij->i", some[a], cells[r]))
            places.append(a + low)
            ids.append(block.ids[r])
    none = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or y) for x, y in zip((places, products, ids), none, strict=True))


def indexed(known: DataFrame, tree: dict[str, np.ndarray]) -> DataFrame:
    """vec_id, embedding, leaf."""
    shared = known.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(leaves_of(shared.value, matrix(batch.column("embedding"))))) if batch.num_rows else batch.append_column("leaf", pa.array([], pa.int64()))

    return known.mapInArrow(run, f"vec_id bigint, embedding {dict(known.dtypes)['embedding']}, leaf bigint")


def leaf_blocks(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """Blocks with their leaf and part, and the number of parts of each leaf."""
    counts = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each leaf of a bounded tree
    parts = [max(1, -(-counts.get(i, 0) // block)) for i in range(max(counts, default=-1) + 1)]
    several = rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(parts) if n > 1], "leaf bigint, parts int")
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)).cast("bigint"))
    dealt = rows.join(F.broadcast(several), "leaf", "left").select("leaf", part.alias("part"), "vec_id", "embedding")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids = column(group, "vec_id").to_numpy()
        row = block_row(ids, matrix(column(group, "embedding")))
        return pa.Table.from_pylist([{"leaf": key[0].as_py(), "part": key[1].as_py()} | row])

    return dealt.groupBy("leaf", "part").applyInArrow(run, f"leaf bigint, part bigint, {BLOCK_SCHEMA}"), parts


def true_neighbours(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> np.ndarray:
    """(query's place, leaf) for each of the k nearest candidates of some queries, exactly; rows: vec_id, embedding, leaf. The queries are a bounded number."""
    own, cells = np.array([q[0] for q in queries]), joined([q[1] for q in queries])
    shared = rows.sparkSession.sparkContext.broadcast((own, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = shared.value
        best, leaf = Best(k), {}
        for part in runs(batches):
            ids = column(part, "vec_id").to_numpy()
            block = Block(block_row(ids, matrix(column(part, "embedding"))))
            at, product, found = nearest(cells, own, block, k)
            best.add(at, product, found)
            at, product, found = best.settle()
            leaf |= dict(zip(ids.tolist(), column(part, "leaf").to_pylist(), strict=True))
            kept = set(found.tolist())
            leaf = {i: x for i, x in leaf.items() if i in kept}
        at, product, found = best.settle()
        yield pa.RecordBatch.from_pydict({"q": pa.array(at, pa.int64()), "product": pa.array(product, pa.float64()), "id": pa.array(found, pa.int64()), "leaf": pa.array([leaf[i] for i in found.tolist()], pa.int64())})

    order = Window.partitionBy("q").orderBy(F.desc("product"), "id")
    found = rows.mapInArrow(run, "q bigint, product double, id bigint, leaf bigint").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("q", "leaf").collect()
    return np.array([(r.q, r.leaf) for r in found], np.int64).reshape(-1, 2)


def widened(tree: dict[str, np.ndarray], cells: np.ndarray, truth: np.ndarray, recall: float) -> int:
    """Leaves to visit so that `recall` of the true neighbours, given as (query, leaf), are met."""
    n = int(tree["leaf"].max()) + 1
    if not len(truth):
        return n
    place = np.zeros((len(cells), n), np.int64)
    np.put_along_axis(place, visits(tree, cells, n), np.arange(n)[None], axis=1)
    met = np.cumsum(np.bincount(place[truth[:, 0], truth[:, 1]], minlength=n))
    return int(np.searchsorted(met, recall * len(truth))) + 1


def search(rows: DataFrame, k: int = NEAREST, every: int = EVERY, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score."""
    known = usable(rows)
    unique = checkpointed(candidates(known, k))
    n = unique.count()
    tree = fit(unique, n, leaf)
    held = checkpointed(indexed(spread(unique, n, 1 << 19), tree))
    blocks, parts = leaf_blocks(held)
    n_calibrated = min(1.0, CALIBRATED / max(1, n))
    asked = [(r.vec_id, np.array([r.embedding], np.float64)) for r in unique.where(drawn(n_calibrated, "vec_id")).orderBy("vec_id").limit(2 * CALIBRATED).collect()]
    most = widened(tree, joined([x[1] for x in asked]), true_neighbours(held, asked, k), recall) if asked else len(parts)
    shared = rows.sparkSession.sparkContext.broadcast((tree, np.array(parts, np.int64)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, parts = shared.value
        for part in runs(batches, BATCH):
            cells = matrix(column(part, "embedding"))
            number, own = column(part, "q").to_numpy(), column(part, "vec_id").to_numpy()
            chosen = visits(tree, cells, most)
            row = np.repeat(np.arange(len(cells)), chosen.shape[1])
            order = np.argsort(chosen.ravel(), kind="stable")
            leaf, row = chosen.ravel()[order], row[order]
            for some in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                at = leaf[some[0]]
                if at >= len(parts):  # a leaf that no row went to
                    continue
                data, wide = packed(cells[row[some]])
                base = {"leaf": int(at), "q_n": len(some), "q_width": cells.shape[1], "q_wide": wide, "q_own": own[row[some]].tobytes(), "q_number": number[row[some]].tobytes(), "q_cells": data}
                yield pa.RecordBatch.from_pylist([base | {"part": p} for p in range(parts[at])], schema=brought)

    ddl = "leaf bigint, part bigint, q_n int, q_width int, q_wide boolean, q_own binary, q_number binary, q_cells binary"
    from pyspark.sql.pandas.types import to_arrow_schema

    brought = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    queries = checkpointed(known.where(F.col("vec_id") % every == 0)).withColumn("q", F.monotonically_increasing_id())  # the files of the checkpoint fix the order
    going = spread(queries, queries.count(), BATCH).mapInArrow(go, ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, owner = Best(k), {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own, number = np.frombuffer(row["q_own"], np.int64), np.frombuffer(row["q_number"], np.int64)
                at, product, ids = nearest(unpacked(row["q_cells"], row["q_width"], row["q_wide"], row["q_n"]), own, Block(row), k)
                best.add(number[at], product, ids)
                owner |= dict(zip(number.tolist(), own.tolist(), strict=True))
        keys, product, ids = best.settle()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(keys)].astype(np.int64)
        for low in range(0, len(starts), 1 << 12):
            some = [(int(keys[s]), s, e) for s, e in zip(starts[low : low + (1 << 12)], ends[low : low + (1 << 12)], strict=True)]
            yield pa.RecordBatch.from_pydict({"q": pa.array([x[0] for x in some], pa.int64()), "query_id": pa.array([owner[x[0]] for x in some], pa.int64()), "products": pa.array([product[s:e].tobytes() for _, s, e in some], pa.binary()), "ids": pa.array([ids[s:e].tobytes() for _, s, e in some], pa.binary())})

    met = blocks.join(going, ["leaf", "part"]).mapInArrow(meet, "q bigint, query_id bigint, products binary, ids binary")

    def merge(group: pa.Table) -> pa.Table:
        n = np.array([len(x) // 8 for x in group.column("ids").to_pylist()], np.int64)
        best = Best(k)
        keys = np.repeat(group.column("q").to_numpy(), n)
        best.add(keys, np.frombuffer(b"".join(group.column("products").to_pylist()), np.float64), np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64))
        keys, product, ids = best.settle()
        owner = dict(zip(group.column("q").to_pylist(), group.column("query_id").to_pylist(), strict=True))
        new = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) + 1
        return pa.table({"query_id": pa.array([owner[x] for x in keys.tolist()], pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(product, pa.float64())})

    groups = max(1, -(-n // every // MERGED))
    return met.groupBy(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("group")).applyInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")
