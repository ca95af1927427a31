"""Summaries of runs: families, exact decimals, histograms, nested counters, signals of a file tree, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exact amounts.
EXACT = "decimal(38,10)"


def by_family(rows: DataFrame, group: str, family: str, families: list[str], value: Column, name: str) -> DataFrame:
    """Mean of a value for each group, one column `<name>__<family>` a family; missing values do not count."""
    wide = rows.withColumn("_v", value).groupBy(group).pivot(family, families).agg(F.round(F.avg("_v"), 6))
    return wide.select(group, *(F.col(f).alias(f"{name}__{f}") for f in families))


def exact_summary(rows: DataFrame, arm: str, cost: Column, latency: str) -> DataFrame:
    """Rows, exact cost (a decimal, as text) and latency total and mean of each arm."""
    return rows.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.sum(cost.cast(EXACT)).cast("decimal(38,4)").cast("string").alias("cost"), F.round(F.sum(latency), 4).alias("latency"), F.round(F.avg(latency), 6).alias("mean_latency"))


def mean_of_present(total: Column, present: Column) -> Column:
    """Sum over all rows by the number of rows that have the value."""
    return F.try_divide(F.sum(total), F.count_if(present))


def histogram(value: Column, edges: list[float]) -> Column:
    """Number of the bucket: how many edges lie at or below the value."""
    return F.size(F.filter(F.lit(edges), lambda e: e <= value))


def merged_counters(rows: DataFrame, counters: str) -> DataFrame:
    """(key, total) over the maps of all rows."""
    return rows.select(F.explode(counters).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"))


def recurring_shapes(files: DataFrame, folder: str, role: str) -> DataFrame:
    """(shape, folders): sets of two roles or more that stand together in two folders or more."""
    shapes = files.groupBy(folder).agg(F.array_sort(F.collect_set(role)).alias("shape")).where(F.size("shape") >= 2)
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("folders")).where("folders >= 2")


def spread_names(files: DataFrame, name: str, folder: str, noise: list[str]) -> DataFrame:
    """(name, folders, files) of the names in two folders or more that are no noise."""
    return files.where(~F.col(name).isin(noise)).groupBy(name).agg(F.count_distinct(folder).alias("folders"), F.count(F.lit(1)).alias("files")).where("folders >= 2")


def stems_with_roles(files: DataFrame, stem: str, role: str, most: int = 8) -> DataFrame:
    """(stem, roles): stems that carry two roles or more of the `most` most frequent ones."""
    top = files.groupBy(role).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), role).limit(most).select(role)
    return files.join(F.broadcast(top), role, "left_semi").groupBy(stem).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") >= 2)


def percentiles(rows: DataFrame, group: str, value: str, places: dict[str, Column]) -> DataFrame:
    """Values at the given places (from 0, as columns over n) of each group's sorted values.

    Values are counted first, so a group is a list of distinct values with counts; the running counts say which value stands at a place. Distinct values are
    cut into ranges, so that no task needs a whole group: counts of ranges first, then the place within its range.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c")).withColumn("cell", F.floor(F.col(value)))
    cells = counted.groupBy(group, "cell").agg(F.sum("c").alias("in_cell"))
    by_group = Window.partitionBy(group)
    cells = cells.withColumn("below", F.sum("in_cell").over(by_group.orderBy("cell")) - F.col("in_cell")).withColumn("n", F.sum("in_cell").over(by_group))
    wanted = cells.select(group, "cell", "below", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("bigint").alias("place")) for k, p in places.items()))).alias("w")).select(group, "cell", "below", "w.*")
    wanted = wanted.join(cells.select(group, "cell", "in_cell"), [group, "cell"]).where((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("in_cell")))
    inside = counted.join(wanted.drop("in_cell"), [group, "cell"])
    upto = F.sum("c").over(Window.partitionBy(group, "cell", "name").orderBy(value)) + F.col("below")
    hit = inside.withColumn("upto", upto).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    return hit.groupBy(group).pivot("name", list(places)).agg(F.first(value))
