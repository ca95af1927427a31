"""Evidence about (query, candidate) pairs from several sources, and combiners of it.

Evidence rows: query_id, doc_id, source, polarity (support, contradict, neutral, missing), target, prob, conf, direct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap
from .facets import STALE_BUCKETS

#: Fixed values of the combiners.
FAMILY_WEIGHT = {"semantic": 0.8, "structure": 1.0, "temporal": 1.0, "scope": 0.6, "evidence": 1.2}
TARGET_PENALTY = {"currentness": 2.5, "scope": 2.0, "conflict": 3.0}
OTHER_PENALTY = 2.0
PENALTY_POWER = 1.5
FAMILY_CAP = 3.0
HISTORY_GAIN = 0.5
SCOPE_SHARE = 0.25
STRONG = ["git", "test", "user"]
INFERRED = ["agent_inference"]
#: Order in which sources draw on a family's cap.
SOURCES = ["semantic", "structure", "scope", "temporal", "evidence"]


def _row(source: str, polarity: Column | str, target: Column | str, prob: Column | float, conf: Column | float = 1.0, direct: Column | float = 1.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(source).alias("source"), lit(polarity).alias("polarity"), lit(target).alias("target"), lit(prob).cast("double").alias("prob"), lit(conf).cast("double").alias("conf"), lit(direct).cast("double").alias("direct"))


def similarity(given: Column, words: Column, asked: Column) -> Column:
    """The given similarity, clamped to [0, 1]; without one, the overlap of the words."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given.cast("double"), overlap(words, asked))))


def time_status(created: Column, valid: Column, invalid: Column, superseded: Column, bucket: Column, as_of: Column) -> Column:
    """First rule that holds; comparisons with unset times are false. Times are ISO texts."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(created > as_of), "not_yet_known")
        .when(no(superseded) | no(invalid <= as_of), "superseded")
        .when(no(bucket.isin(*STALE_BUCKETS)), "superseded")
        .when(no(valid > as_of), "not_yet_valid")
        .when(no(valid <= as_of) | no(invalid > as_of) | no(bucket == "current"), "current")
        .otherwise("unknown")
    )


def collect(pairs: DataFrame) -> DataFrame:
    """Five rows of evidence for each pair.

    pairs: query_id, doc_id, intent, as_of, similarity, structure (overlap of structural values), compared, conflicts,
    created, valid, invalid, superseded, bucket, kinds (array).
    """
    c = F.col
    status = time_status(c("created"), c("valid"), c("invalid"), c("superseded"), c("bucket"), c("as_of"))
    past = c("intent") == "historical"
    no = lambda x: F.coalesce(x, F.lit(False))
    direct = F.when(c("status").isin("not_yet_known", "not_yet_valid"), 1.0).when(c("status") == "superseded", F.when(no(c("superseded")) | no(c("invalid") <= c("as_of")), 1.0).otherwise(0.6)).when(c("status") == "current", F.when(c("valid").isNotNull() | c("invalid").isNotNull(), 1.0).otherwise(0.6)).otherwise(0.5)
    by_status = lambda known, valid, old_then, old, now_then, now, other: F.when(c("status") == "not_yet_known", known).when(c("status") == "not_yet_valid", valid).when((c("status") == "superseded") & past, old_then).when(c("status") == "superseded", old).when((c("status") == "current") & past, now_then).when(c("status") == "current", now).otherwise(other)
    kinds = F.size("kinds")
    inferred = F.size(F.array_except("kinds", F.lit(INFERRED))) == 0
    strong = F.arrays_overlap("kinds", F.lit(STRONG))
    rows = [
        _row("semantic", F.when(c("similarity") > 0, "support").otherwise("neutral"), "relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("similarity")))),
        _row("structure", F.when(c("structure") > 0, "support").otherwise("missing"), "relevance", c("structure")),
        _row("scope", F.when(c("compared") == 0, "missing").when(c("conflicts") > 0, "contradict").otherwise("support"), "scope", F.when(c("compared") == 0, 0.0).when(c("conflicts") > 0, c("conflicts") / F.greatest(c("compared"), F.lit(1))).otherwise(1.0), F.when(c("compared") == 0, 0.5).otherwise(1.0)),
        _row(
            "temporal",
            by_status("contradict", "contradict", "support", "contradict", "neutral", "support", "missing"),
            by_status("currentness", "currentness", "historicality", "currentness", "historicality", "currentness", "currentness"),
            by_status(1.0, 0.9, 1.0, 1.0, 0.3, 0.8, 0.0), by_status(1.0, 0.9, 0.9, 0.9, 0.6, 0.8, 0.4), direct,
        ),
        _row("evidence", F.when(kinds == 0, "missing").otherwise("support"), "relevance", F.when(kinds == 0, 0.0).when(strong, 1.0).otherwise(0.5), F.when(kinds == 0, 0.3).when(strong, 1.0).when(inferred, 0.5).otherwise(0.7), F.when(kinds == 0, 0.3).when(strong, 1.0).when(inferred, 0.4).otherwise(0.7)),
    ]
    return pairs.withColumn("status", status).select("query_id", "doc_id", "intent", F.inline(F.array(*rows)))


def _weight(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILY_WEIGHT.items() for x in kv))
    return F.coalesce(table[source], F.lit(1.0))


def _penalty(target: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TARGET_PENALTY.items() for x in kv))
    return F.coalesce(table[target], F.lit(OTHER_PENALTY))


def weighted(evidence: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, uncertainty): weighted sum of support less contradiction; missing sources only make it less certain."""
    size = _weight(F.col("source")) * F.col("prob") * F.col("conf") * F.col("direct")
    signed = F.when(F.col("polarity") == "support", size).when(F.col("polarity") == "contradict", -size).otherwise(0.0)
    return evidence.groupBy("query_id", "doc_id").agg(F.sum(signed).alias("score"), (F.count_if(F.col("polarity") == "missing") / F.count(F.lit(1))).alias("uncertainty"))


def log_space(evidence: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevant, current, historical, conflict, blocked, uncertainty, score).

    Each row weighs 1 / sqrt(rows of its family); a family's support adds up to FAMILY_CAP at most, in the order of SOURCES: what a row
    adds is the growth of the capped running sum.
    """
    c = F.col
    family = Window.partitionBy("query_id", "doc_id", "source")
    order = F.array_position(F.lit(SOURCES), c("source"))
    q = c("prob") * c("conf") * c("direct") / F.sqrt(F.count(F.lit(1)).over(family))
    rows = evidence.withColumn("q", q).withColumn("loss", _penalty(c("target")) * F.pow("q", F.lit(PENALTY_POWER)))
    gain = F.when(c("polarity") == "support", _weight(c("source")) * c("q") * F.when(c("target") == "scope", SCOPE_SHARE).when(c("target") == "conflict", 0.0).otherwise(1.0)).otherwise(0.0)
    running = F.sum("gain").over(family.orderBy(order, "target").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("gain", gain).withColumn("run", running)
    rows = rows.withColumn("gain", F.least(c("run"), F.lit(FAMILY_CAP)) - F.least(c("run") - c("gain"), F.lit(FAMILY_CAP)))
    against = c("polarity") == "contradict"
    on = lambda t: c("target") == t
    add = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    z = rows.groupBy("query_id", "doc_id", "intent").agg(
        (add(on("relevance") | on("scope"), c("gain")) - add(against & (on("relevance") | on("scope")), c("loss"))).alias("relevant"),
        (add(on("currentness"), c("gain")) - add(against & (on("currentness") | on("conflict")), c("loss"))).alias("current"),
        (add(on("historicality"), c("gain")) + add(against & on("currentness"), HISTORY_GAIN * c("q"))).alias("historical"),
        add(against & on("conflict"), c("loss")).alias("conflict"),
        add(against & on("scope"), c("loss")).alias("blocked"),
        (F.count_if(c("polarity") == "missing") / F.count(F.lit(1))).alias("uncertainty"),
    )
    score = F.when(c("intent") == "historical", c("relevant") + c("historical") - c("blocked")).when(c("intent") == "any", c("relevant") - c("blocked")).otherwise(c("relevant") + c("current") - c("blocked") - c("conflict"))
    return z.withColumn("score", score)
