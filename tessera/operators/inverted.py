"""Nearest vectors through inverted lists: vectors are filed under their nearest centroid, and a query looks into the lists whose centroids are nearest to it.

Centroids are fitted on a bounded sample (SAMPLE rows, taken by a hash of the id), every vector is filed. Lists are cut into parts of about PART rows, so that one crowded list is many parts.
How many lists a query looks into is measured: probes are doubled until a sample of queries (CHECKED of them, compared with `ranking.dense`) finds RECALL of its true neighbours.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import dot
from . import ranking
from .sizes import checkpointed, small_side

SAMPLE = 50_000
PART = 4096
CHECKED = 100
RECALL = 0.93
#: Lists for n vectors: about the square root of n, at most MOST.
MOST = 1024


class Index(NamedTuple):
    """Vectors of length 1 by list and part, and the centroids."""

    filed: DataFrame  # doc_id, v, list, part
    centroids: DataFrame  # one row: centroids, an array of arrays
    lists: int
    parts: DataFrame  # list, parts


def unit(column: str) -> Column:
    v = F.transform(column, lambda x: x.cast("double"))
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors with a direction, of length 1: rows whose vector is null, empty, zero, or has a null or non-finite component have none."""
    real = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    return vectors.where(F.col(key).isNotNull() & real).select(F.col(key).alias("doc_id"), unit(vector).alias("v"))


def drawn(key: str, n: int, most: int) -> Column:
    """Whether a row is among about `most` of n."""
    return F.pmod(F.xxhash64(F.lit("drawn"), key), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, n)))


def nearest_lists(v: Column, centroids: Column, k: int) -> Column:
    """Numbers of the k lists whose centroids have the largest product with a vector, the first first."""
    scored = F.transform(centroids, lambda c, i: F.struct((-dot(c, v)).alias("below"), i.alias("list")))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda s: s["list"])


def index(vectors: DataFrame, key: str = "doc_id", vector: str = "v", seed: int = 7) -> Index:
    spark = vectors.sparkSession
    known = checkpointed(usable(vectors, key, vector))
    n = known.count()
    lists = max(1, min(MOST, int(n**0.5)))
    centres = [[0.0]]
    if n:
        model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(known.where(drawn("doc_id", n, SAMPLE)).select(array_to_vector("v").alias("f"))) if lists > 1 else None
        centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else [[0.0] * len(known.first().v)]
    centroids = spark.createDataFrame([(centres,)], "centroids array<array<double>>")  # `lists` of them at most
    filed = known.crossJoin(F.broadcast(centroids)).select("doc_id", "v", F.get(nearest_lists(F.col("v"), F.col("centroids"), 1), F.lit(0)).alias("list"))
    filed = checkpointed(filed)
    parts = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = filed.join(F.broadcast(parts), "list").select("doc_id", "v", "list", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    return Index(checkpointed(placed), centroids, len(centres), parts)


def search(at: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Ranking (query_id, doc_id, score, rank) of the k nearest by cosine among the lists looked into; queries: query_id, q. A vector is not its own neighbour."""
    asked = usable(queries, "query_id", "q").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    going = asked.crossJoin(F.broadcast(at.centroids)).select("query_id", "q", F.explode(nearest_lists(F.col("q"), F.col("centroids"), probes)).alias("list"))
    going = going.join(F.broadcast(at.parts), "list").select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = at.filed.join(going, ["list", "part"]).where(F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("q")))).alias("score"))
    return ranking.ranked(met, k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    row = true.join(found.select("query_id", "doc_id", F.lit(1).alias("_f")), ["query_id", "doc_id"], "left").agg(F.count("_f"), F.count(F.lit(1))).first()
    return row[0] / row[1] if row[1] else 1.0


def calibrated(at: Index, queries: DataFrame, k: int, goal: float = RECALL) -> int:
    """Lists to look into: doubled until a sample of the queries finds `goal` of its true neighbours, all lists at the end."""
    n = queries.count()
    some = checkpointed(queries.where(drawn("query_id", n, CHECKED)))
    if not some.take(1):
        return at.lists
    true = checkpointed(ranking.ranked(ranking.dense(at.filed.select("doc_id", "v"), some), k))
    probes = 1
    while probes < at.lists and recall(search(at, some, k, probes), true) < goal:
        probes *= 2
    return min(probes, at.lists)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, goal: float = RECALL) -> DataFrame:
    """The k nearest vectors (doc_id, v) of each query (query_id, q), as `search` finds them with calibrated probes."""
    at = index(vectors)
    return search(at, small_side(queries), k, calibrated(at, queries, k, goal))
