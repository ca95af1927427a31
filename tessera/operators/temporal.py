"""Validity, belief and supersession over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_at(valid: Column, invalid: Column, at: Column) -> Column:
    """World time: valid from `valid`, no longer at `invalid`."""
    return (valid <= at) & (invalid.isNull() | (invalid > at))


def known_at(created: Column, expired: Column, at: Column) -> Column:
    """Belief time: recorded by `at` and not yet expired then."""
    return (created <= at) & (expired.isNull() | (expired > at))


def history(facts: DataFrame, key: list[str], at: str, *ties: str) -> DataFrame:
    """Adds valid_to (when the next fact of the key begins), current, and version from 1."""
    order = Window.partitionBy(*key).orderBy(at, *ties)
    return facts.withColumn("valid_to", F.lead(at).over(order)).withColumn("version", F.row_number().over(order).cast("bigint")).withColumn("current", F.col("valid_to").isNull())


def latest(facts: DataFrame, key: list[str], at: str, *ties: str) -> DataFrame:
    """The last fact of each key: one pass of partial aggregates, no sort."""
    rest = [c for c in facts.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("_b")
    return facts.groupBy(*key).agg(best).select(*key, "_b.*")


def latest_with_status(facts: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """(key, value, status): unique or ambiguous, by how many values share the last time."""
    top = facts.groupBy(*key).agg(F.max(at).alias("_t"))
    last = facts.join(top, key).where(F.col(at) == F.col("_t")).groupBy(*key).agg(F.min(value).alias("value"), F.count_distinct(value).alias("n"))
    return last.select(*key, "value", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"))


def rolling_distinct(events: DataFrame, key: str, at: str, item: str, days: int) -> DataFrame:
    """(key, day, items): distinct items of a key in the `days` days up to each day that has an event.

    Each (key, item, day) counts on the days it reaches, so one key's rows spread over its days; no ordered window holds a key.
    """
    seen = events.select(key, F.to_date(at).alias("on"), item).distinct()
    reach = seen.select(key, item, F.explode(F.sequence("on", F.date_add("on", days - 1), F.expr("interval 1 day"))).alias("day"))
    active = seen.select(key, F.col("on").alias("day")).distinct()
    return reach.join(active, [key, "day"], "left_semi").groupBy(key, "day").agg(F.count_distinct(item).alias("items"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Adds to each left row the value of the last right row of its key at or before it: both sides in one ordered window."""
    both = left.withColumn("_l", F.lit(1)).withColumn("_t", F.col(left_at)).withColumn(value, F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(key, F.col(right_at).alias("_t"), value, F.lit(0).alias("_l")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("_t", "_l").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(order)).where("_l = 1").drop("_l", "_t")


def believed(expired: Column) -> Column:
    """What is believed now: not expired."""
    return expired.isNull()


def folded(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row for each key, with the least value of its repeats."""
    return events.groupBy(*key).agg(F.min(value).alias(value))
