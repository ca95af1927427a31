"""Deterministic samples: rows are ordered by a digest of seed and id, which any engine computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, noise, texts
from .sizes import checkpointed


def quotas(counts: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, quota): shares of `size` by largest remainder; equal remainders by name."""
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") * size / F.col("total")
    rows = counts.crossJoin(F.broadcast(total)).withColumn("base", F.floor(share)).withColumn("rest", F.round(share - F.floor(share), 9))
    left = rows.agg((F.lit(size) - F.sum("base")).alias("left"))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))  # one row a stratum
    return rows.withColumn("place", place).crossJoin(F.broadcast(left)).select(stratum, (F.col("base") + (F.col("place") <= F.col("left")).cast("int")).cast("bigint").alias("quota"))


#: Cells of the digest's range; a stratum's rows are ranked cell by cell.
CELLS = 256


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: str = "s1") -> DataFrame:
    """Rows of a stratified sample of `size`: in each stratum those with the least digests of seed and key.

    Strata are cut by the first byte of the digest, so that no task sorts a whole stratum: counts of cells give each cell's place.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    marked = df.withColumn("_d", digest).withColumn("_c", F.conv(F.substring("_d", 1, 2), 16, 10).cast("int"))
    cells = marked.groupBy(stratum, "_c").agg(F.count(F.lit(1)).alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(stratum).orderBy("_c")) - F.col("_in")
    wanted = quotas(cells.groupBy(stratum).agg(F.sum("_in").alias("n")), stratum, size)
    open_cells = cells.withColumn("_before", before).join(wanted, stratum).where(F.col("_before") < F.col("quota")).select(stratum, "_c", "_before", "quota")
    place = F.row_number().over(Window.partitionBy(stratum, "_c").orderBy("_d", key)) + F.col("_before")
    return marked.join(open_cells, [stratum, "_c"]).withColumn("_n", place).where(F.col("_n") <= F.col("quota")).drop("_n", "_d", "_c", "_before", "quota")


def first_of_each(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def without_leaks(rows: DataFrame, threshold: float, test: float, seed: str = "split") -> DataFrame:
    """(id, cluster, size, split) of rows (id, items) that have items: whole clusters of near-duplicates go to test or to train.

    Rows whose distinct items have Jaccard `threshold` or more are linked, and the components of the links are the clusters, named by their smallest id, so no link crosses a
    split. A cluster is in test if the draw of its name is below `test`.
    """
    placed = texts.signed(rows).where(F.size("h") > 0)
    reps = checkpointed(placed.groupBy("key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")))
    links = texts.similar_signed(texts.first_sets(placed, reps), threshold)
    of = graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = reps.join(of, reps["class"] == of["node"], "left").select("key", "n", F.coalesce("component", "class").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.sum("n").alias("size"))
    out = placed.select("id", "key").join(named.select("key", "cluster"), "key").join(sizes, "cluster")
    return out.select("id", "cluster", "size", F.when(noise.draw(seed, F.col("cluster")) < test, "test").otherwise("train").alias("split"))
