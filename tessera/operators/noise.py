"""Noise that any engine draws alike: from digests of seed and key; parameter grids; hygiene of anchors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations of a few parameters' values."""
    return spark.createDataFrame(list(product(*parameters.values())), list(parameters))


def noisy(rows: DataFrame, column: str, seed: str, key: Column, rate: float, policy: str, others: Column) -> DataFrame:
    """Replaces the value of a share of rows: dropped (null), or swapped for another value."""
    new = F.lit(None) if policy == "drop" else others
    return rows.withColumn(column, F.when(draw(seed, key) < rate, new).otherwise(F.col(column)))


def clean_anchors(anchors: DataFrame, file: str, anchor: str, most_share: float, cap: int) -> DataFrame:
    """(file, anchors): anchors in no more than max(3, a share) of all files, sorted, the first `cap` as the feature asks."""
    total = anchors.agg(F.count_distinct(file).alias("_total"))
    spread = anchors.groupBy(anchor).agg(F.count_distinct(file).alias("_files")).crossJoin(F.broadcast(total)).where(F.col("_files") <= F.greatest(F.lit(3.0), most_share * F.col("_total")))
    return anchors.join(spread.select(anchor), anchor).groupBy(file).agg(F.slice(F.array_sort(F.collect_set(anchor)), 1, cap).alias("anchors"))


def corrupted(references: DataFrame, group: str, reference: str, share: float, seed: str) -> DataFrame:
    """Adds corrupted: a share of each group's references, those with the least digests."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), reference).cast("binary")), 1, 8), 16, 10).cast("bigint")
    place = F.row_number().over(Window.partitionBy(group).orderBy(digest, reference))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return references.withColumn("corrupted", place <= F.bround(n * F.lit(share)))
