"""Costs, usage and telemetry: helper spend, exact answers, run summaries, throughput, audits, provenance, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio
from .scans import MOST, Running, running

EXACT = "decimal(38,18)"


def helper_spend(rows: DataFrame, key: list[str], helpers: dict[str, tuple[Column, Column]], rate: Column, output_rate: Column) -> DataFrame:
    """(key, helper, cost): prompt and output tokens of each helper at its rates a million, in rows."""
    each = F.array(*(F.struct(F.lit(n).alias("helper"), F.coalesce(p, F.lit(0)).alias("prompt"), F.coalesce(o, F.lit(0)).alias("output")) for n, (p, o) in helpers.items()))
    flat = rows.select(*key, rate.alias("_r"), output_rate.alias("_o"), F.inline(each))
    return flat.groupBy(*key, "helper").agg(F.round(F.sum((F.col("prompt") * F.col("_r") + F.col("output") * F.col("_o")) / 1e6), 6).alias("cost"))


def cache_split(prompt: Column, hit: Column, told: Column) -> Column:
    """(hit, miss) of a prompt: what was not hit is missed; without cache data both are 0."""
    h = F.coalesce(hit, F.lit(0))
    return F.struct(F.when(told, h).otherwise(0).alias("hit"), F.when(told, F.greatest(F.lit(0), prompt - h)).otherwise(0).alias("miss"))


def exact_cost(prompt: Column, output: Column, rate: str, output_rate: str) -> Column:
    """Cost of an answer as a decimal; the rates a million are decimal texts."""
    return ((prompt.cast("decimal(20,0)") * F.lit(rate).cast("decimal(12,6)") + output.cast("decimal(20,0)") * F.lit(output_rate).cast("decimal(12,6)")) / F.lit("1000000").cast("decimal(8,0)")).cast("decimal(38,12)")


def run_summary(turns: DataFrame, group: list[str], upstream: Column, raw: Column, collapsed: Column, passthrough: Column) -> DataFrame:
    """Saved tokens, upstream reduction in per cent, share of collapsed turns, and the passthrough's difference and ratio."""
    sums = turns.groupBy(*group).agg(F.sum(raw).alias("raw"), F.sum(upstream).alias("upstream"), F.sum(passthrough).alias("passthrough"), F.avg(collapsed.cast("int")).alias("collapse"))
    saved = F.col("raw") - F.col("upstream")
    return sums.select(*group, F.round(saved, 4).alias("saved"), F.round(100 * ratio(saved, F.col("raw")), 6).alias("reduction"), F.round("collapse", 6).alias("collapse_rate"), F.round(F.col("passthrough") - F.col("upstream"), 4).alias("passthrough_delta"), F.round(ratio(F.col("upstream"), F.col("passthrough")), 6).alias("passthrough_ratio"))


def estimate_errors(rows: DataFrame, group: str, estimated: Column, actual: Column) -> DataFrame:
    """Mean and worst error of an estimate in per cent; rows without an actual count are left out."""
    e = F.when(actual > 0, (estimated - actual) * 100.0 / actual)
    return rows.groupBy(group).agg(F.round(F.avg(e), 6).alias("mean_error"), F.round(F.max(F.abs(e)), 6).alias("worst_error"))


def throughput(rows: DataFrame, group: str, cost: Column, hit: Column, prompt: Column, seconds: Column, waited: Column) -> DataFrame:
    """Cost a thousand rows, cache-hit rate, and rows a minute net of waits."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"), F.sum(hit).alias("hit"), F.sum(prompt).alias("prompt"), F.sum(seconds).alias("seconds"), F.sum(waited).alias("waited"))
    net = F.greatest(F.col("seconds") - F.col("waited"), F.lit(0.0))
    return g.select(group, F.round(1000 * ratio(F.col("cost"), F.col("n")), 6).alias("per_thousand"), F.round(ratio(F.col("hit"), F.col("prompt")), 6).alias("hit_rate"), F.round(60 * ratio(F.col("n"), net), 6).alias("per_minute"))


def audit(before: DataFrame, after: DataFrame, server: str, tokens: str, waste: str) -> DataFrame:
    """(server, before, after, waste, share, status): servers of either side with the change of their tokens, and their share of all tokens after."""
    b = before.groupBy(server).agg(F.sum(tokens).alias("before"))
    a = after.groupBy(server).agg(F.sum(tokens).alias("after"), F.sum(waste).alias("waste"))
    total = a.agg(F.sum("after").alias("_t"))
    rows = b.join(a, server, "full").crossJoin(F.broadcast(total))
    x, y = F.col("before"), F.col("after")
    status = F.when(x.isNull(), "added").when(y.isNull(), "removed").when(y < x, "reduced").when(y > x, "grown").otherwise("same")
    return rows.select(server, F.coalesce(x, F.lit(0.0)).alias("before"), F.coalesce(y, F.lit(0.0)).alias("after"), F.coalesce("waste", F.lit(0.0)).alias("waste"), F.round(ratio(y, F.col("_t")), 6).alias("share"), status.alias("status"))


def interrupted(phases: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Starts without an end."""
    return phases.where(F.col(kind) == "start").select(*key).distinct().join(phases.where(F.col(kind) == "end").select(*key), key, "left_anti")


def changed_identity(rows: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Keys whose identity, which must not change, has several values."""
    return rows.groupBy(*key).agg(F.count_distinct(identity).alias("identities")).where("identities > 1")


def progress(rows: DataFrame, group: list[str], at: str, expected: int) -> DataFrame:
    """Rows done, rate an hour and hours left of an expected number; no rate before two rows at different times."""
    g = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("done"), (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("span"))
    rate = F.when(F.col("span") > 0, (F.col("done") - 1) * 3600.0 / F.col("span"))
    return g.select(*group, "done", F.round(rate, 6).alias("rate"), F.round(F.greatest(F.lit(0), F.lit(expected) - F.col("done")) / rate, 6).alias("left"))


def one_in_flight(rows: DataFrame, namespace: str, start: str, seconds: Column, most: int = MOST) -> DataFrame:
    """Adds begins and ends (seconds since the epoch): rows of a namespace run one after another, none before its own start.

    end_k = max over j <= k of (start_j + sum of the lengths from j to k): a running maximum of start less the lengths before it, plus the lengths so far.
    """
    order = [start, "seq"]
    timed = running(rows.withColumn("_len", seconds), [namespace], order, Running("_run", "sum", F.col("_len")), most=most)
    timed = timed.withColumn("_free", F.unix_timestamp(start).cast("double") - (F.col("_run") - F.col("_len")))
    timed = running(timed, [namespace], order, Running("_most", "max", F.col("_free")), most=most)
    return timed.withColumn("ends", F.col("_most") + F.col("_run")).withColumn("begins", F.col("ends") - F.col("_len")).drop("_run", "_len", "_free", "_most")


def debounced(rows: DataFrame, namespace: str, at: str, quiet: str, most: int = MOST) -> DataFrame:
    """(namespace, burst, n, ready): bursts of evidence, ready to be folded once nothing came for a quiet time."""
    order = [at, "seq"]
    timed = running(rows, [namespace], order, Running("_last", "lasts", F.col(at), inclusive=False), most=most)
    new = F.coalesce((F.col(at) - F.try_element_at("_last", F.lit(1))) > F.expr(f"interval {quiet}"), F.lit(True)).cast("int")
    marked = running(timed.withColumn("_new", new), [namespace], order, Running("burst", "sum", F.col("_new")), most=most)
    return marked.groupBy(namespace, "burst").agg(F.count(F.lit(1)).alias("n"), (F.max(at) + F.expr(f"interval {quiet}")).alias("ready"))
