"""Ranked and ordered lists: coverage, merges without repeats, turns, fallbacks, what was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, group: str, order: str, value: str, preferred: Column) -> DataFrame:
    """(group, value): that of the last preferred row, else of the last row."""
    return rows.groupBy(group).agg(F.coalesce(F.max_by(F.when(preferred, F.col(value)), F.when(preferred, F.col(order))), F.max_by(value, order)).alias(value))


def covered_at(held: DataFrame, gold: DataFrame, query: str, token: str, rank: str, share: float = 0.5) -> DataFrame:
    """(query, covered, half): the least rank up to which all gold tokens have stood, and a share of them; null if never.

    A token counts from its first rank on, so all are there at the largest first rank, and k of n at the k-th smallest.
    """
    first = gold.distinct().join(held.groupBy(query, token).agg(F.min(rank).alias("at")), [query, token], "left")
    all_of = first.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("found"), F.max("at").alias("last"), F.array_sort(F.collect_list("at")).alias("ats"))
    need = F.ceil(F.col("n") * share).cast("int")
    return all_of.select(query, F.when(F.col("found") == F.col("n"), F.col("last")).alias("covered"), F.when(F.col("found") >= need, F.try_element_at("ats", need)).alias("half"))


def merged(parts: list[DataFrame], group: str, item: str, order: str) -> DataFrame:
    """(group, item, rank): the lists one after another, each in its order; an item stands where it comes first."""
    rows = [p.select(group, item, F.struct(F.lit(k).alias("list"), F.col(order).alias("at")).alias("_at")) for k, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = out.groupBy(group, item).agg(F.min("_at").alias("_at"))
    return first.select(group, item, F.row_number().over(Window.partitionBy(group).orderBy("_at")).cast("bigint").alias("rank"))


def interleaved(rankings: list[DataFrame], forced: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank): rankings by turns, the first one leading; forced documents come before all."""
    n = len(rankings)
    out = None if forced is None else forced.select("query_id", "doc_id", F.lit(0).cast("bigint").alias("at"))
    for k, r in enumerate(rankings):
        rows = r.select("query_id", "doc_id", (F.col("rank") * n + k).cast("bigint").alias("at"))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("bigint").alias("rank"))


def missed(gold: DataFrame, *found: DataFrame, on: list[str]) -> DataFrame:
    """Distinct gold rows that none of the others has."""
    out = gold.select(*on).distinct()
    for f in found:
        out = out.join(f.select(*on), on, "left_anti")
    return out
