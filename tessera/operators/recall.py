"""Recall of artifacts, snippets and views for a question, and briefs made of what is recalled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap
from .sizes import small_side


def by_anchor_and_topic(artifacts: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): 1 for a shared anchor plus the overlap of the words; what shares neither is left out.

    artifacts: id, words, anchors; asked: query_id, words, anchors (arrays). Both meet by a word or an anchor that they share.
    """
    tags = lambda df, key: df.select(F.col(key).alias(key), F.explode(F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.transform("anchors", lambda a: F.concat(F.lit("a:"), a))))).alias("tag"))
    pairs = tags(artifacts, "id").join(small_side(tags(asked, "query_id")), "tag").select("query_id", "id").distinct()
    rows = pairs.join(artifacts, "id").join(small_side(asked.withColumnsRenamed({"words": "q_words", "anchors": "q_anchors"})), "query_id")
    score = F.when(F.arrays_overlap("anchors", "q_anchors"), 1.0).otherwise(0.0) + overlap(F.col("words"), F.col("q_words"))
    return _top(rows.select("query_id", "id", F.round(score, 4).alias("score")), limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def by_words(snippets: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): a group's snippets by shared words between blanks, equal ones and those without any in their order. snippets: group, id, text; asked: group, query_id, text."""
    cut = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    pairs = snippets.select("group", "id", cut("text").alias("_s")).join(asked.select("group", "query_id", cut("text").alias("_q")), "group")
    return _top(pairs.select("query_id", "id", F.size(F.array_intersect("_s", "_q")).cast("double").alias("score")), limit)


def bucket(kind: Column, status: Column, historical: Column) -> Column:
    """Where an artifact stands in a brief: stale, hypothesis, or by its type; null for other types."""
    return F.when(historical, "stale_or_contradicted").when(status == "candidate", "hypotheses").when(kind == "failure", "failed_approaches").when(kind == "decision", "decisions").when(kind == "incident", "risks")


def briefs(matches: DataFrame) -> DataFrame:
    """(query_id, bucket, items): ids by bucket in order of rank. matches: query_id, id, rank, kind, status, historical."""
    rows = matches.withColumn("bucket", bucket(F.col("kind"), F.col("status"), F.col("historical"))).where("bucket IS NOT NULL")
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return rows.groupBy("query_id", "bucket").agg(items.alias("items"))


def first_actions(matches: DataFrame) -> DataFrame:
    """(query_id, avoid, prefer): the first trusted failure, and the first trusted decision that shares an anchor with it. matches also have anchors."""
    trusted = matches.where((F.col("status") == "trusted") & ~F.col("historical"))
    failure = trusted.where("kind = 'failure'").groupBy("query_id").agg(F.min_by(F.struct("id", "anchors"), "rank").alias("f"))
    decision = trusted.where("kind = 'decision'").select("query_id", F.col("id").alias("d_id"), F.col("anchors").alias("d_anchors"), "rank")
    met = failure.join(decision, "query_id").where(F.arrays_overlap("d_anchors", F.col("f.anchors"))).groupBy("query_id").agg(F.min_by("d_id", "rank").alias("prefer"))
    return failure.select("query_id", F.col("f.id").alias("avoid")).join(met, "query_id", "left")


def relevant(attribute: Column, scope: Column, words: Column) -> Column:
    """Whether a view is about the question: a word of its scope, or two of its attribute; without a scope all of a one-word attribute or two words."""
    shared = F.size(F.array_intersect(attribute, words))
    return F.when(F.size(scope) > 0, F.arrays_overlap(scope, words) | (shared >= 2)).otherwise((F.size(attribute) > 0) & (shared >= F.least(F.size(attribute), F.lit(2))))


def packet(views: DataFrame, past: Column, most_current: int = 3, most_history: int = 5) -> DataFrame:
    """(query_id, section, id, place): current views, and of the same slots what was before (all relevant ones if asked for the past).

    views: query_id, id, slot, relevant, current, valid_at; past: whether the question asks for history.
    """
    rows = views.withColumn("past", past)
    live = rows.groupBy("query_id", "slot").agg(F.bool_or(F.col("relevant") & F.col("current")).alias("live"))
    rows = rows.join(live, ["query_id", "slot"])
    now = rows.where(F.col("relevant") & F.col("current")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("place") <= most_current)
    then = rows.where(F.col("live") & (~F.col("current") | F.col("past"))).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("valid_at", "id"))).where(F.col("place") <= most_history)
    named = lambda d, s: d.select("query_id", F.lit(s).alias("section"), "id", F.col("place").cast("bigint").alias("place"))
    return named(now, "current").unionByName(named(then, "history"))
