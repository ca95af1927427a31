"""Joins of reports, claims and runs: wide rows, ranges, containment, anchors, slots, back-fills, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_arm(rows: DataFrame, key: list[str], arm: str, columns: list[str]) -> DataFrame:
    """One row for each key with arms: a map from arm to the struct of its columns."""
    return rows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(arm, F.struct(*columns)))).alias("arms"))


def within(changes: DataFrame, windows: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Changes joined to the windows (start to end, inclusive) of their key."""
    return changes.join(windows, key).where(F.col(at).between(F.col(start), F.col(end)))


def first_sharing(failures: DataFrame, artifacts: DataFrame, keys: list[str], anchor: str, order: str) -> DataFrame:
    """(keys, failure, match): the first artifact in order that shares any anchor. failures and artifacts: keys, id, anchor; artifacts: order."""
    left = failures.select(*keys, F.col("id").alias("failure"), anchor)
    right = artifacts.select(*keys, F.col("id").alias("_a"), F.col(order).alias("_o"), anchor)
    return left.join(right, [*keys, anchor]).groupBy(*keys, "failure").agg(F.min_by("_a", F.struct("_o", "_a")).alias("match"))


def by_slot(assertions: DataFrame, audit: DataFrame, slot: list[str], rest: list[str], at: str, value: str) -> DataFrame:
    """Adds the value of the latest audit row of the same slot and rest, else of the same slot alone. Texts compare trimmed and in lower case."""
    kinds = dict(audit.dtypes)
    plain = lambda c: F.lower(F.trim(c)) if kinds[c] == "string" else F.col(c)
    exact = audit.groupBy(*(plain(c).alias(f"_{c}") for c in slot + rest)).agg(F.max_by(value, at).alias("_exact"))
    loose = audit.groupBy(*(plain(c).alias(f"_{c}") for c in slot)).agg(F.max_by(value, at).alias("_loose"))
    rows = assertions.select("*", *(plain(c).alias(f"_{c}") for c in slot + rest))
    rows = rows.join(exact, [f"_{c}" for c in slot + rest], "left").join(loose, [f"_{c}" for c in slot], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "slot").otherwise("none")
    return rows.select(*assertions.columns, F.coalesce("_exact", "_loose").alias("audited"), how.alias("how"))


def backfilled(rows: DataFrame, column: str, is_default: Column, *sources: tuple[DataFrame, list[str], str]) -> DataFrame:
    """Replaces a column where it is a default by the first source (table, key, column) that has a value."""
    out, found = rows, []
    for k, (source, key, name) in enumerate(sources):
        out = out.join(source.select(*key, F.col(name).alias(f"_b{k}")), key, "left")
        found.append(F.col(f"_b{k}"))
    return out.withColumn(column, F.when(is_default, F.coalesce(*found, F.col(column))).otherwise(F.col(column))).drop(*(f"_b{k}" for k in range(len(sources))))


def around(lines: DataFrame, group: list[str], order: str, text: str, reach: int) -> DataFrame:
    """Adds context: the texts of up to `reach` lines before and after each line, joined by blanks."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(-reach, reach)
    return lines.withColumn("context", F.concat_ws(" ", F.collect_list(text).over(window)))


def rank_change(before: Column, after: Column) -> Column:
    """regressed: reached before and not after, or a worse rank; gained, improved, same or unreached otherwise."""
    return F.when(before.isNull() & after.isNull(), "unreached").when(before.isNull(), "gained").when(after.isNull() | (after > before), "regressed").when(after < before, "improved").otherwise("same")


def paired(rows: DataFrame, pair: str, side: str, sides: tuple[str, str], value: str) -> DataFrame:
    """(pair, a, b, invariant): the values of both sides of each pair, and whether they are equal or both missing."""
    wide = rows.groupBy(pair).pivot(side, list(sides)).agg(F.first(value))
    return wide.select(pair, F.col(sides[0]).alias("a"), F.col(sides[1]).alias("b")).withColumn("invariant", F.col("a").eqNullSafe(F.col("b")))
