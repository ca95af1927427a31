"""Running values along an order within keys, where one key may hold most rows.

A window by key sorts a key in one task. Here rows are dealt into ranges of (key, order) of about `most` rows; a range sorts its own rows,
each range of a key gives one partial value, the partial values run along a key's ranges (a row for each range, not for each row), and what came out before
a range is combined with what its rows give. Keys are counted first: where none has more than `most` rows, a key is one range and a window by key gives the same values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import checkpointed

#: Rows of a key that one task sorts.
MOST = 1 << 20
PARTIAL = {"sum": F.sum, "count": F.count, "max": F.max}


class Running(NamedTuple):
    """A value that runs along the order, with the row itself or (not inclusive) up to the row before.

    kind: sum, count (of values that are not null), max, or lasts (an array of the last `n` values that are not null, the last first).
    A sum or maximum of no value is null.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True
    n: int = 1


def _names(columns: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _within(v: Running, held: str, key: list[str], order: list[str]) -> Column:
    """The running value in a window by key; the values stand in column `held`."""
    if v.kind == "lasts":
        earlier = (F.expr(f"lag({held}, {k}) IGNORE NULLS OVER (PARTITION BY {_names(key)} ORDER BY {_names(order)})") for k in range(1, v.n + 1))
        return F.slice(F.array_compact(F.array(*([F.col(held)] if v.inclusive else []), *earlier)), 1, v.n)
    by = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1)
    return PARTIAL[v.kind](held).over(by)


def _joined(v: Running, own: Column, before: Column) -> Column:
    """What a range's rows give and what came before the range, as one."""
    if v.kind == "lasts":
        return F.slice(F.concat(own, F.coalesce(before, F.slice(own, 1, 0))), 1, v.n)
    if v.kind == "max":
        return F.greatest(own, before)
    return F.coalesce(own + before, own, before)


def hot(rows: DataFrame, key: list[str], most: int) -> bool:
    """Whether a key has more than `most` rows."""
    return bool(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).take(1))


def ranged(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """Adds _range: a number that rises along each key's order, for some `most` rows or fewer. Written down, since ranges are cut at sampled values."""
    parts = max(1, -(-2 * rows.count() // most))
    return checkpointed(rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, key: list[str], order: list[str], *values: Running, most: int = MOST) -> DataFrame:
    """Adds the running values. Rows that are equal in key and order run in any order, and stay in one range. Null keys are a key."""
    held = {f"_v{k}": v.value for k, v in enumerate(values)}
    if not hot(rows, key, most):
        return rows.withColumns(held).withColumns({v.name: _within(v, f"_v{k}", key, order) for k, v in enumerate(values)}).drop(*held)
    parted = [*key, "_range"]
    cut = ranged(rows, key, order, most).withColumns(held)
    plain = [(k, v) for k, v in enumerate(values) if v.kind != "lasts"]
    parts = cut.groupBy(*parted).agg(F.count(F.lit(1)).alias("_rows"), *(PARTIAL[v.kind](f"_v{k}").alias(f"_t{k}") for k, v in plain))
    for k, v in enumerate(values):
        if v.kind == "lasts":  # the last values of each range, then of all ranges before
            place = F.row_number().over(Window.partitionBy(*parted).orderBy(*(F.desc(c) for c in order)))
            last = cut.where(F.col(f"_v{k}").isNotNull()).withColumn("_p", place).where(F.col("_p") <= v.n)
            own = last.groupBy(*(F.col(c).alias(f"_o_{c}") for c in parted)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(f"_v{k}").alias("v")))), lambda x: x["v"]).alias(f"_t{k}"))
            parts = parts.join(own, _alike(parted, "_o_"), "left").drop(*(f"_o_{c}" for c in parted))
    along = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    across = {"sum": F.sum, "count": F.sum, "max": F.max}
    before = [F.slice(F.flatten(F.reverse(F.collect_list(f"_t{k}").over(along))), 1, v.n) if v.kind == "lasts" else across[v.kind](f"_t{k}").over(along) for k, v in enumerate(values)]
    heads = parts.select(*(F.col(c).alias(f"_h_{c}") for c in parted), *(b.alias(f"_b{k}") for k, b in enumerate(before)))
    scanned = cut.withColumns({f"_w{k}": _within(v, f"_v{k}", parted, order) for k, v in enumerate(values)})
    out = scanned.join(heads, _alike(parted, "_h_"))
    return out.withColumns({v.name: _joined(v, F.col(f"_w{k}"), F.col(f"_b{k}")) for k, v in enumerate(values)}).select(*rows.columns, *(v.name for v in values))


def _alike(columns: list[str], prefix: str) -> Column:
    return reduce(and_, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns))
