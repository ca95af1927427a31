"""Retrieval measures over rankings (condition, query_id, doc_id, rank) and gold answers (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio
from ..functions.text import content_tokens, tokens


def judged(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Rankings with hit (whether the document is gold) and n_gold of the query; queries without gold have 0."""
    marked = rankings.join(gold.select("query_id", "doc_id").distinct().withColumn("is_gold", F.lit(True)), ["query_id", "doc_id"], "left")
    counts = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_gold"))
    return marked.join(counts, "query_id", "left").select("*", F.coalesce("is_gold", F.lit(False)).alias("hit")).drop("is_gold").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))


def _within(k: int, value: Column) -> Column:
    return F.sum(F.when(F.col("rank") <= k, value).otherwise(0))


def ideal_gain(n: Column, k: int) -> Column:
    """Discounted gain of the best order of n answers."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def per_query(j: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """Recall, precision, reciprocal rank, NDCG and sufficiency of each (condition, query). Precision divides by what was returned; a query without gold scores 0."""
    hit = F.col("hit").cast("int")
    first = F.min(F.when(F.col("hit"), F.col("rank")))
    rows = j.groupBy("condition", "query_id").agg(
        _within(k, hit).alias("hits"), _within(k, F.lit(1)).alias("shown"), first.alias("first"), F.max("n_gold").alias("n_gold"), _within(depth, F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain")
    )
    return rows.select(
        "condition", "query_id", "n_gold",
        ratio(F.col("hits"), F.col("n_gold")).alias("recall"),
        ratio(F.col("hits"), F.col("shown")).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n_gold") > 0, F.col("gain") / ideal_gain(F.col("n_gold"), depth)).otherwise(0.0).alias("ndcg"),
        F.when((F.col("n_gold") > 0) & (F.col("hits") == F.col("n_gold")), 1.0).otherwise(0.0).alias("sufficient"),
    )


MEASURES = ("recall", "precision", "reciprocal_rank", "ndcg", "sufficient")


def means(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), digits).alias(m) for m in MEASURES))


def known_item(j: DataFrame, limit: int) -> DataFrame:
    """Rank of the first gold document of each (condition, query) with gold; limit + 1 where it was not returned."""
    found = j.where("n_gold > 0").groupBy("condition", "query_id").agg(F.min(F.when(F.col("hit") & (F.col("rank") <= limit), F.col("rank"))).alias("at"))
    return found.select("condition", "query_id", F.coalesce("at", F.lit(limit + 1)).cast("bigint").alias("known_rank"))


def regressions(known: DataFrame, baseline: str, tolerance: int = 0) -> DataFrame:
    """Queries of each condition whose known rank is worse than the baseline's by more than a tolerance."""
    base = known.where(F.col("condition") == baseline).select("query_id", F.col("known_rank").alias("base"))
    return (
        known.where(F.col("condition") != baseline).join(base, "query_id").groupBy("condition")
        .agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("known_rank") > F.col("base") + tolerance).alias("worse"), F.count_if(F.col("known_rank") < F.col("base")).alias("better"))
    )


def share_of_top(j: DataFrame, flag: Column, k: int, name: str) -> DataFrame:
    """Mean over queries of the share of the first k documents for which a flag holds."""
    each = j.where(F.col("rank") <= k).groupBy("condition", "query_id").agg(F.avg(flag.cast("double")).alias("share"))
    return each.groupBy("condition").agg(F.round(F.avg("share"), 6).alias(name))


def stability(j: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Mean Jaccard of the first k documents over pairs of queries of one group (query_id, grp), by condition."""
    tops = j.where(F.col("rank") <= k).groupBy("condition", "query_id").agg(F.collect_set("doc_id").alias("top")).join(groups, "query_id")
    a, b = tops.alias("a"), tops.alias("b")
    pairs = a.join(b, (F.col("a.condition") == F.col("b.condition")) & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.query_id") < F.col("b.query_id")))
    like = F.size(F.array_intersect("a.top", "b.top")) / F.size(F.array_union("a.top", "b.top"))
    return pairs.groupBy(F.col("a.condition").alias("condition")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(like), 6).alias("stability"))


def any_within(j: DataFrame, k: int) -> DataFrame:
    """(condition, query_id, found): 1 if any gold document stands among the first k, 0 if none does or there is no gold."""
    return j.groupBy("condition", "query_id").agg(F.max(F.when(F.col("hit") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("found"))


def target_hit(rankings: DataFrame, docs: DataFrame, queries: DataFrame, target: str, values: str, k: int, text: str | None = None) -> DataFrame:
    """(condition, query_id, hit): 1 if one of the first k documents has the query's target among its values or in its text; queries without a target are left out."""
    rows = rankings.where(F.col("rank") <= k).join(queries.where(F.coalesce(F.col(target), F.lit("")) != "").select("query_id", target), "query_id").join(docs, "doc_id")
    held = F.array_contains(values, F.col(target))
    held = held | F.contains(F.col(text), F.col(target)) if text else held
    return rows.groupBy("condition", "query_id").agg(F.max(F.when(held, 1.0).otherwise(0.0)).alias("hit"))


def of_top(j: DataFrame, queries: DataFrame, flag: Column, k: int, name: str, where: Column | None = None, none: float = 0.0) -> DataFrame:
    """Mean over all queries of the share of the first k documents for which a flag holds; `none` for a query without documents, or outside `where`."""
    counts = F.col("rank") <= k
    each = j.groupBy("condition", "query_id").agg(F.try_divide(F.count_if(counts & flag), F.count_if(counts)).alias("share"))
    grid = queries.crossJoin(F.broadcast(j.select("condition").distinct())).join(each, ["condition", "query_id"], "left")
    value = F.coalesce("share", F.lit(none))
    return grid.groupBy("condition").agg(F.round(F.avg(value if where is None else F.when(where, value).otherwise(none)), 6).alias(name))


def suppression(rankings: DataFrame, queries: DataFrame, stale: DataFrame, k: int) -> DataFrame:
    """(condition, suppression): mean over queries of the share of all stale documents that the first k leave out; 1 for other than current intent, or where nothing is stale."""
    n = stale.agg(F.count(F.lit(1)).alias("n"))
    shown = rankings.where(F.col("rank") <= k).join(stale, "doc_id").groupBy("condition", "query_id").agg(F.count(F.lit(1)).alias("shown"))
    grid = queries.crossJoin(F.broadcast(rankings.select("condition").distinct())).join(shown, ["condition", "query_id"], "left").crossJoin(F.broadcast(n))
    share = F.when((F.col("intent") != "current") | (F.col("n") == 0), 1.0).otherwise(1 - F.coalesce("shown", F.lit(0)) / F.col("n"))
    return grid.groupBy("condition").agg(F.round(F.avg(share), 6).alias("suppression"))


def set_measures(returned: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(condition, recall, precision, leak) of sets (condition, query_id, doc_id), averaged over queries: without gold the recall is 1, with nothing returned the precision is 1 and the leak 0."""
    got = returned.join(gold.withColumn("g", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("condition", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("hits"))
    many = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    grid = queries.crossJoin(F.broadcast(returned.select("condition").distinct())).join(got, ["condition", "query_id"], "left").join(many, "query_id", "left").na.fill(0, ["n", "hits", "n_gold"])
    share = lambda a, b, none: F.round(F.avg(ratio(a, b, none)), 6)
    hits, n = F.col("hits"), F.col("n")
    return grid.groupBy("condition").agg(share(hits, F.col("n_gold"), 1.0).alias("recall"), share(hits, n, 1.0).alias("precision"), share(n - hits, n, 0.0).alias("leak"))


def dispersion(evidence: DataFrame, query: str) -> DataFrame:
    """How far a query's evidence is spread: memories, tokens, episodes, sessions, entities and days between the first and the last. evidence: memory, text, episode, session, entity, at."""
    return evidence.groupBy(query).agg(
        F.count_distinct("memory").alias("memories"), F.sum(F.size(tokens("text"))).alias("tokens"), F.count_distinct("episode").alias("episodes"), F.count_distinct("session").alias("sessions"),
        F.count_distinct("entity").alias("entities"), F.date_diff(F.max("at"), F.min("at")).alias("days"),
    )


def named_recall(wanted: Column, found: Column) -> Column:
    """Share of the wanted names (array) that stand in some found text (array), either case; 1 without any wanted."""
    low = F.transform(found, F.lower)
    hits = F.size(F.filter(wanted, lambda w: F.exists(low, lambda t: F.contains(t, F.lower(w)))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(hits / F.size(wanted))


def fact_recall(wanted: Column, found: Column, stop_words: list[str], least: float = 0.6) -> Column:
    """Share of the wanted facts (array) of whose content tokens some found text has `least` or more; 1 without any wanted."""
    sets = F.transform(found, lambda t: content_tokens(t, stop_words))

    def met(fact: Column) -> Column:
        own = content_tokens(fact, stop_words)
        return F.exists(sets, lambda s: F.size(F.array_intersect(own, s)) >= least * F.size(own)) & (F.size(own) > 0)

    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, met)) / F.size(wanted))
