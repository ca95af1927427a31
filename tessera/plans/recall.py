"""Queries of recall: parts as artifacts and views, customers as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recall
from ..sources.tables import table
from .catalog import many, query

ARTIFACTS = """a AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS words, [p_brand] AS anchors, CASE p_type WHEN 'ECONOMY' THEN 'failure' WHEN 'STANDARD' THEN 'decision' ELSE 'incident' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'candidate' ELSE 'trusted' END AS status, p_size % 5 = 0 AS historical FROM part),
q AS (SELECT n_nationkey::BIGINT AS query_id, ['small', 'red', 'ring'] AS words, ['Brand#' || (n_nationkey + 1)] AS anchors FROM nation),
s AS (SELECT query_id, id, round((CASE WHEN len(list_intersect(a.anchors, q.anchors)) > 0 THEN 1.0 ELSE 0.0 END) + len(list_intersect(list_distinct(a.words), q.words)) / least(len(list_distinct(a.words)), 3), 4) AS score FROM a, q),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0), m AS (SELECT * FROM t JOIN a USING (id) WHERE rank <= 10)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    kind = F.when(t == "ECONOMY", "failure").when(t == "STANDARD", "decision").otherwise("incident")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"), F.array("p_brand").alias("anchors"), kind.alias("kind"), F.when(F.col("p_size") % 3 == 0, "candidate").otherwise("trusted").alias("status"), (F.col("p_size") % 5 == 0).alias("historical"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = artifacts(spark, sf_dir)
    n = F.col("n_nationkey")
    q = table(spark, sf_dir, "nation").select(n.cast("bigint").alias("query_id"), F.array(F.lit("small"), F.lit("red"), F.lit("ring")).alias("words"), F.array(F.concat(F.lit("Brand#"), (n + 1).cast("string"))).alias("anchors"))
    return recall.by_anchor_and_topic(a.select("id", "words", "anchors"), q).join(a, "id")


@query(f"WITH {ARTIFACTS} SELECT query_id, id, score, rank FROM m")
def artifact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("query_id", "id", "score", "rank")


@query(f"WITH {ARTIFACTS}, b AS (SELECT query_id, id, rank, CASE WHEN historical THEN 'stale_or_contradicted' WHEN status = 'candidate' THEN 'hypotheses' WHEN kind = 'failure' THEN 'failed_approaches' WHEN kind = 'decision' THEN 'decisions' ELSE 'risks' END AS bucket FROM m) SELECT query_id, bucket, string_agg(id::VARCHAR, ',' ORDER BY rank) AS items FROM b GROUP BY ALL")
def cold_start_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = recall.briefs(matches(spark, sf_dir))
    return b.select("query_id", "bucket", F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("items"))


@query(f"WITH {ARTIFACTS}, f AS (SELECT query_id, arg_min(id, rank) AS avoid, arg_min(anchors, rank) AS fa FROM m WHERE kind = 'failure' AND status = 'trusted' AND NOT historical GROUP BY 1), d AS (SELECT f.query_id, arg_min(m.id, m.rank) AS prefer FROM f JOIN m ON m.query_id = f.query_id AND m.kind = 'decision' AND m.status = 'trusted' AND NOT m.historical AND len(list_intersect(m.anchors, fa)) > 0 GROUP BY 1) SELECT query_id, avoid, coalesce(prefer, -1) AS prefer FROM f LEFT JOIN d USING (query_id)")
def first_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.first_actions(matches(spark, sf_dir)).withColumn("prefer", F.coalesce("prefer", F.lit(-1)))


@query(f"WITH {ARTIFACTS}, s2 AS (SELECT query_id, count(*) FILTER (kind = 'failure' AND status = 'trusted' AND NOT historical) AS failures, count(*) FILTER (historical) AS stale, count(*) AS shown FROM m GROUP BY 1) SELECT query_id, (failures > 0)::INT AS failed_surfaced, (stale > 0)::INT AS stale_flagged, round(failures / shown, 6) AS accuracy_per_item FROM s2")
def brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether briefs show a failed approach and flag what is stale, and how much of them is of use."""
    fresh = (F.col("kind") == "failure") & (F.col("status") == "trusted") & ~F.col("historical")
    g = matches(spark, sf_dir).groupBy("query_id").agg(F.count_if(fresh).alias("f"), F.count_if("historical").alias("s"), many().alias("n"))
    return g.select("query_id", (F.col("f") > 0).cast("int").alias("failed_surfaced"), (F.col("s") > 0).cast("int").alias("stale_flagged"), F.round(F.col("f") / F.col("n"), 6).alias("accuracy_per_item"))


@query("WITH s AS (SELECT n_nationkey::BIGINT AS query_id, p_partkey AS id, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['blue', 'ring']))::DOUBLE AS score FROM part JOIN nation ON p_partkey % 25 = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def stub_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five part names of each group by the words they share with "Blue ring", others after them in order."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("group"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("group"), F.col("n_nationkey").cast("bigint").alias("query_id"), F.lit("Blue ring").alias("text"))
    return recall.by_words(p, q, 5)


VIEWS = "v AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_orderpriority AS slot, o_orderpriority IN ('1-URGENT', '2-HIGH') AS relevant, o_orderdate AS valid_at, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current, o_custkey % 2 = 0 AS past FROM orders), l AS (SELECT *, bool_or(relevant AND current) OVER (PARTITION BY query_id, slot) AS live FROM v)"


@query(f"WITH {VIEWS}, n AS (SELECT query_id, 'current' AS section, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place, 3 AS most FROM l WHERE relevant AND current UNION ALL SELECT query_id, 'history', id, row_number() OVER (PARTITION BY query_id ORDER BY valid_at, id), 5 FROM l WHERE live AND (NOT current OR past)) SELECT query_id, section, id, place FROM n WHERE place <= most")
def packet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as views of customers' slots (priorities): what holds now, and what held before."""
    o = table(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("top"))
    v = o.join(latest, ["o_custkey", "o_orderpriority"])
    about = recall.relevant(F.array(F.col("o_orderpriority")), F.array().cast("array<string>"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    views = v.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("slot"), about.alias("relevant"), (F.col("o_orderkey") == F.col("top.o_orderkey")).alias("current"), F.col("o_orderdate").alias("valid_at"))
    return recall.packet(views, F.col("query_id") % 2 == 0)
