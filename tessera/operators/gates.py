"""Gates and comparisons of measured conditions against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import percent_saved, ratio


def against_baseline(wide: DataFrame, baseline: str, measures: list[str]) -> DataFrame:
    """Rows of the other conditions with `<measure>_delta`. A baseline with several rows, or without one, fails the query; so does a missing measure."""
    each = wide.where(F.col("condition") == baseline).agg(F.count(F.lit(1)).alias("_n"), *(F.first(m).alias(f"_{m}") for m in measures))
    told = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows of the baseline: "), F.col("_n").cast("string"))).cast("boolean"))
    joined = wide.where(F.col("condition") != baseline).crossJoin(F.broadcast(each.where(told).drop("_n")))
    return joined.select("*", *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in measures))


def win_gate(wide: DataFrame, baseline: str, primary: list[str], guards: list[str], tolerance: float = 0.0, ceiling: float = 1.0, need_all: bool = False) -> DataFrame:
    """Per condition: primaries that can still rise must (one of them, or all); none may fall beyond the tolerance, and no guard either.

    The winner is the passing condition with the largest sum of primaries, then the least guard loss, then by name.
    """
    rows = against_baseline(wide, baseline, primary + guards)
    open_ = [F.col(f"_{m}") < ceiling for m in primary]
    rises = [o & (F.col(f"{m}_delta") > 0) for o, m in zip(open_, primary, strict=True)]
    some, every = F.lit(False), F.lit(True)
    for o, r in zip(open_, rises, strict=True):
        some, every = some | r, every & (~o | r)
    held = F.lit(True)
    for m in primary + guards:
        held = held & (F.col(f"{m}_delta") >= -tolerance)
    loss = sum((F.greatest(F.lit(0.0), -F.col(f"{m}_delta")) for m in guards), F.lit(0.0))
    out = rows.select("condition", ((every if need_all else some) & held).alias("passes"), F.round(sum((F.col(m) for m in primary), F.lit(0.0)), 6).alias("primary_sum"), F.round(loss, 6).alias("guard_loss"))
    top = F.min_by("condition", F.struct(-F.col("primary_sum"), "guard_loss", "condition"))
    winner = out.where("passes").agg(top.alias("winner"))
    return out.crossJoin(F.broadcast(winner)).select("condition", "passes", "primary_sum", "guard_loss", F.coalesce(F.col("condition") == F.col("winner"), F.lit(False)).alias("wins"))


def verdict(delta_overall: Column, worst_group: Column) -> Column:
    """FAIL below -0.02 overall, WARN if a group fell by more than 0.10, else PASS."""
    return F.when(delta_overall < -0.02, "FAIL").when(worst_group < -0.10, "WARN").otherwise("PASS")


def transition(before: Column, after: Column) -> Column:
    """Class of a pass/fail pair."""
    return F.when(before & after, "stayed_pass").when(before, "regressed").when(after, "recovered").otherwise("stayed_fail")


def deltas(arms: DataFrame, arm: str, baseline: str, scores: list[str], costs: list[str]) -> DataFrame:
    """Each other arm's `<score>_delta` and `<cost>_reduction` in per cent (0 where the baseline has no cost)."""
    base = arms.where(F.col(arm) == baseline).agg(*(F.first(c).alias(f"_{c}") for c in scores + costs))
    rows = arms.where(F.col(arm) != baseline).crossJoin(F.broadcast(base))
    return rows.select(arm, *(F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"{c}_delta") for c in scores), *(F.round(percent_saved(F.col(f"_{c}"), F.col(c)), 6).alias(f"{c}_reduction") for c in costs))


def promotion(wide: DataFrame, challenger: str, baselines: list[str], lower: list[str], higher: list[str], recall: str, tolerance: float = 0.10) -> DataFrame:
    """One row: the challenger's gains over the best of the baselines, and whether it graduates: some gain, and a recall no more than the tolerance below their best."""
    of = lambda c, f: F.min(F.when(F.col("condition").isin(*baselines), F.col(c))) if f == "min" else F.max(F.when(F.col("condition").isin(*baselines), F.col(c)))
    own = lambda c: F.max(F.when(F.col("condition") == challenger, F.col(c)))
    gains = [F.round(of(c, "min") - own(c), 6).alias(f"{c}_gain") for c in lower] + [F.round(own(c) - of(c, "max"), 6).alias(f"{c}_gain") for c in higher]
    row = wide.agg(*gains, F.round(of(recall, "max") - own(recall), 6).alias(f"{recall}_loss"))
    some = F.greatest(*(F.col(f"{c}_gain") for c in lower + higher)) > 0
    return row.withColumn("graduates", some & (F.col(f"{recall}_loss") <= tolerance))


def intent_verdict(x: DataFrame, margin: float = 0.15, tolerance: float = 1e-9) -> DataFrame:
    """x: default, on, shuffle, harm_off, harm_on. The intent must beat the default, a wrong one must lose more than the margin, and queries without one may not suffer."""
    on = F.col("on")
    tests = {"beats_default": on > F.col("default") + tolerance, "shuffle_collapses": on - F.col("shuffle") > margin, "no_harm": F.col("harm_on") >= F.col("harm_off") - tolerance}
    return x.select(*(c.alias(n) for n, c in tests.items()), (tests["beats_default"] & tests["shuffle_collapses"] & tests["no_harm"]).alias("graduates"), F.round(on - F.col("default"), 6).alias("lift"), F.round(on - F.col("shuffle"), 6).alias("lift_vs_shuffle"))


def gain_without_loss(wide: DataFrame, baseline: str, gain: str, keep: str, tolerance: float = 0.0, lower_is_better: bool = False) -> DataFrame:
    """(condition, gain, loss, graduates) of the other conditions: one measure must improve and the other may not fall beyond the tolerance."""
    rows = against_baseline(wide, baseline, [gain, keep])
    rise = F.round(F.col(f"{gain}_delta") * (-1 if lower_is_better else 1), 6)
    loss = F.round(-F.col(f"{keep}_delta"), 6)
    return rows.select("condition", rise.alias("gain"), loss.alias("loss"), ((rise > 0) & (loss <= tolerance)).alias("graduates"))


def pairwise(known: DataFrame, baseline: str, challenger: str, tolerance: int = 0) -> DataFrame:
    """(regression_rate, mrr_gain, passes) from known ranks (condition, query_id, known_rank)."""
    of = lambda c, n: known.where(F.col("condition") == c).select("query_id", F.col("known_rank").alias(n))
    both = of(challenger, "c").join(of(baseline, "b"), "query_id")
    row = both.agg(F.avg((F.col("c") > F.col("b") + tolerance).cast("int")).alias("regression_rate"), (F.avg(1 / F.col("c")) - F.avg(1 / F.col("b"))).alias("mrr_gain"))
    return row.select(F.round("regression_rate", 6).alias("regression_rate"), F.round("mrr_gain", 6).alias("mrr_gain"), ((F.col("mrr_gain") > 0) & (F.col("regression_rate") <= 0)).alias("passes"))


def cheaper(cost: Column, base: Column, cached: Column) -> Column:
    """Verdict on costs; without cache data on both sides it is inconclusive."""
    return F.when(~cached, "INCONCLUSIVE").when(cost < base, "CHEAPER").otherwise("MORE EXPENSIVE")


def all_hold(rows: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """Adds a column for each limit, and passes: whether all hold."""
    passes = F.lit(True)
    for c in limits.values():
        passes = passes & c
    return rows.select("*", *(c.alias(n) for n, c in limits.items()), passes.alias("passes"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, before, after, change): added, removed, changed or same."""
    a = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("_b"))
    b = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return both.select(*key, "before", "after", change.alias("change"))


def dimensions(rows: DataFrame, group: str, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each dimension (applies, holds) the share of the rows to which it applies that it holds for; null where it never applies."""
    return rows.groupBy(group).agg(*(F.round(F.avg(F.when(applies, holds.cast("int"))), 6).alias(n) for n, (applies, holds) in tests.items()))


SEVERITIES = ["PASS", "INFO", "WARN", "FAIL"]


def rolled_up(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, outcome, overall) of checks, each a table of one severity from 0 to 3."""
    rows = None
    for name, c in checks.items():
        row = c.toDF("s").select(F.lit(name).alias("name"), "s")
        rows = row if rows is None else rows.unionByName(row)
    said = lambda s: F.element_at(F.lit(SEVERITIES), s.cast("int") + 1)
    worst = rows.agg(F.max("s").alias("w"))
    return rows.crossJoin(F.broadcast(worst)).select("name", said(F.col("s")).alias("outcome"), said(F.col("w")).alias("overall"))


def never_worse(rows: DataFrame, a: Column, b: Column, better: int) -> DataFrame:
    """(never_worse, strictly_better, accepted): a is at least b in all rows and above it in `better` or more."""
    row = rows.agg(F.bool_and(a >= b).alias("never_worse"), F.count_if(a > b).alias("strictly_better"))
    return row.withColumn("accepted", F.col("never_worse") & (F.col("strictly_better") >= better))


def beliefs(items: DataFrame, conditions: dict[str, tuple[list[str] | None, list[str] | None]]) -> DataFrame:
    """(condition, stale_asserted, poisoned, preserved). Conditions name the buckets that are asserted and those that are surfaced, None: all. items: bucket, gold_current, gold_historical, noise."""
    among = lambda b: F.lit(True) if b is None else F.col("bucket").isin(*b)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), among(a).alias("asserted"), among(s).alias("surfaced")) for n, (a, s) in conditions.items())))
    rows = items.withColumn("_c", each).select("*", "_c.*")
    share = lambda hit, of, none: F.round(ratio(F.count_if(hit & of), F.count_if(of), none), 6)
    return rows.groupBy("condition").agg(share(~F.col("gold_current"), F.col("asserted"), 0.0).alias("stale_asserted"), share(F.col("noise"), F.col("surfaced"), 0.0).alias("poisoned"), share(F.col("surfaced"), F.col("gold_historical"), 1.0).alias("preserved"))


def wardens(rows: DataFrame, guards: dict[str, Column], conditions: dict[str, list[str]], should_refuse: Column) -> DataFrame:
    """(condition, refuse_recall, admit_retention) of chains of guards. A guard gives 0 (admit), 1 (warn) or 2 (refuse); the most restrictive of a chain wins."""
    verdict = lambda names: F.greatest(F.lit(0), F.lit(0), *(guards[g] for g in names))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), (verdict(names) == 2).alias("refused")) for n, names in conditions.items())))
    flat = rows.select(should_refuse.alias("bad"), each.alias("_c")).select("bad", "_c.*")
    share = lambda hit, of: F.round(ratio(F.count_if(hit & of), F.count_if(of), 1.0), 6)
    return flat.groupBy("condition").agg(share(F.col("refused"), F.col("bad")).alias("refuse_recall"), share(~F.col("refused"), ~F.col("bad")).alias("admit_retention"))


def narrowed(rows: DataFrame, group: list[str], key: str, matches: Column, least: int) -> DataFrame:
    """The rows whose key matches, in groups where `least` distinct keys do; all rows of the others."""
    support = rows.groupBy(*group).agg(F.count_distinct(F.when(matches, F.col(key))).alias("_s"))
    return rows.join(support, group).where((F.col("_s") < least) | matches).drop("_s")
