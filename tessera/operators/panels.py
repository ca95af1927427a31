"""Panels of measured cases: outcomes, mismatches, slices, comparisons of two paths, and validators of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio


def mismatches(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the dimensions in which both sides differ; missing on both sides is equal."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items())))


def outcome(found: Column, wrong: Column, expected: Column, abstained: Column, refused: Column) -> Column:
    """Outcome of a case: unjoinable, ambiguous, refused, abstained (rightly or not), invented, exact, near or wrong."""
    n = F.size(wrong)
    return (
        F.when(found == 0, F.when(expected, "unjoinable").otherwise("rightly_absent"))
        .when(found > 1, "ambiguous")
        .when(refused, "refused")
        .when(abstained, F.when(expected, "abstained").otherwise("rightly_abstained"))
        .when(~expected, "invented")
        .when(n == 0, "exact")
        .when(n == 1, "near")
        .otherwise("wrong")
    )


def accuracy(rows: DataFrame, role: str, fields: dict[str, Column]) -> DataFrame:
    """(role, n, <field>...): how many cases have each field right."""
    return rows.groupBy(role).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(ok, F.lit(False))).alias(f) for f, ok in fields.items()))


def compared(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(class, n, differing): keys in both paths, or in one alone, and how many values differ in both."""
    left = a.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    right = b.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_l").isNull(), "second_only").when(F.col("_r").isNull(), "first_only").otherwise("both")
    both = left.join(right, key, "full").select(kind.alias("class"), (~F.col("_a").eqNullSafe(F.col("_b"))).alias("d"))
    return both.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("class") == "both") & F.col("d")).alias("differing"))


def agreement(rows: DataFrame, group: str, same: Column, total: Column) -> DataFrame:
    """(group, agreed, n, share, balanced): agreement, and whether the stated total is the number of rows."""
    g = rows.groupBy(group).agg(F.count_if(same).alias("agreed"), F.count(F.lit(1)).alias("n"), F.max(total).alias("_t"))
    return g.select(group, "agreed", "n", F.round(ratio(F.col("agreed"), F.col("n")), 6).alias("share"), (F.col("_t") == F.col("n")).alias("balanced"))


def inventory(rows: DataFrame, key: list[str], operation: str) -> DataFrame:
    """(key, class): absolute, delta or mixed, by the operations of a key's rows."""
    kinds = rows.groupBy(*key).agg(F.array_sort(F.collect_set(operation)).alias("_k"))
    only = F.size("_k") == 1
    return kinds.select(*key, F.when(only & (F.get("_k", F.lit(0)) == "set"), "absolute").when(only, "delta").otherwise("mixed").alias("class"))


def below_minimum(rows: DataFrame, group: list[str], least: int) -> DataFrame:
    """Groups of fewer rows than a population needs."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def findings(checks: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(severity, code, place) of checks (severity, code, rows, place column)."""
    out = None
    for severity, code, rows, place in checks:
        row = rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(place).cast("string").alias("place"))
        out = row if out is None else out.unionByName(row)
    return out


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    return rows.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def spans_stated(rows: DataFrame, content: str, start: str, stop: str, said: str) -> DataFrame:
    """Rows whose span does not hold what is said of it."""
    return rows.where(~F.substring(F.col(content), F.col(start) + 1, F.col(stop) - F.col(start)).eqNullSafe(F.col(said)))


def shared_between(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in several splits."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
