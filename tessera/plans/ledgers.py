"""Queries of costs, usage, audits, provenance and progress over line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import ledgers, temporal
from ..operators.costs import estimated_tokens
from ..sources.tables import table
from .catalog import many, query


@query("""WITH h AS (SELECT l_linestatus, unnest([{'h': 'curator', 'p': l_quantity, 'o': l_tax * 100}, {'h': 'embedding', 'p': CASE WHEN l_returnflag = 'A' THEN l_quantity END, 'o': 0.0}, {'h': 'extractor', 'p': l_discount * 1000, 'o': l_quantity}]) AS x FROM lineitem)
SELECT l_linestatus, x.h AS helper, round(sum((coalesce(x.p, 0) * 0.5 + coalesce(x.o, 0) * 2.0) / 1e6), 6) AS cost FROM h GROUP BY ALL""")
def helper_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, zero = F.col("l_quantity"), F.lit(0.0)
    helpers = {"curator": (q, F.col("l_tax") * 100), "embedding": (F.when(F.col("l_returnflag") == "A", q), zero), "extractor": (F.col("l_discount") * 1000, q)}
    return ledgers.helper_spend(table(spark, sf_dir, "lineitem"), ["l_linestatus"], helpers, F.lit(0.5), F.lit(2.0))


@query("SELECT l_returnflag, sum(CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity / 2) ELSE 0 END)::BIGINT AS hit, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity - floor(l_quantity / 2) ELSE 0 END)::BIGINT AS miss FROM lineitem GROUP BY 1")
def cache_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    s = table(spark, sf_dir, "lineitem").select("l_returnflag", ledgers.cache_split(q, F.floor(q / 2), F.col("l_returnflag") != "N").alias("s"))
    return s.groupBy("l_returnflag").agg(F.sum("s.hit").alias("hit"), F.sum("s.miss").alias("miss"))


@query("SELECT l_linestatus, sum(((l_quantity::DECIMAL(20,0) * 0.15 + l_linenumber * 0.6) / 1000000)::DECIMAL(38,12))::VARCHAR AS cost FROM (SELECT l_linestatus, l_quantity, l_linenumber FROM lineitem) GROUP BY 1")
def exact_answer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledgers.exact_cost(F.col("l_quantity"), F.col("l_linenumber"), "0.15", "0.6")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum(c).cast("decimal(38,12)").cast("string").alias("cost"))


@query("WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS raw, sum(l_extendedprice * (1 - l_discount)) AS up, sum(l_extendedprice * (1 + l_tax)) AS pt, avg((l_quantity > 40)::INT) AS c FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(raw - up, 2) AS saved, round(100 * (raw - up) / raw, 6) AS reduction, round(c, 6) AS collapse_rate, round(pt - up, 2) AS passthrough_delta, round(up / pt, 6) AS passthrough_ratio FROM s")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    out = ledgers.run_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], p * (1 - F.col("l_discount")), p, F.col("l_quantity") > 40, p * (1 + F.col("l_tax")))
    return out.withColumn("saved", F.round("saved", 2)).withColumn("passthrough_delta", F.round("passthrough_delta", 2))


@query("WITH e AS (SELECT lang, greatest(1, length(text) // 4) AS est, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS act FROM documents) SELECT lang, round(avg(CASE WHEN act > 0 THEN (est - act) * 100.0 / act END), 6) AS mean_error, round(max(abs(CASE WHEN act > 0 THEN (est - act) * 100.0 / act END)), 6) AS worst_error FROM e GROUP BY lang")
def estimator_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter-of-characters estimate against counted words."""
    return ledgers.estimate_errors(table(spark, sf_dir, "documents"), "lang", estimated_tokens(F.col("text")), F.size(tokens("text")))


@query("SELECT event_type, round(1000 * sum(value) / count(*), 6) AS per_thousand, round(sum(value * 0.3) / sum(value + 1), 6) AS hit_rate, round(60.0 * count(*) / (sum(value) - sum(CASE WHEN user_id % 2 = 0 THEN value * 0.5 ELSE 0 END)), 6) AS per_minute FROM events GROUP BY 1")
def episode_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return ledgers.throughput(table(spark, sf_dir, "events"), "event_type", v, v * 0.3, v + 1, v, F.when(F.col("user_id") % 2 == 0, v * 0.5).otherwise(0.0))


@query("WITH b AS (SELECT l_suppkey AS server, sum(l_quantity) AS before FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 7 <> 0 GROUP BY 1), a AS (SELECT l_suppkey AS server, sum(l_quantity) AS after, sum(l_tax) AS waste FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 5 <> 0 GROUP BY 1) SELECT coalesce(b.server, a.server) AS server, coalesce(before, 0) AS before, coalesce(after, 0) AS after, round(coalesce(waste, 0), 6) AS waste, round(coalesce(after, 0) / (SELECT sum(after) FROM a), 6) AS share, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN after < before THEN 'reduced' WHEN after > before THEN 'grown' ELSE 'same' END AS status FROM b FULL JOIN a ON a.server = b.server")
def server_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("server", F.col("l_suppkey"))
    return ledgers.audit(li.where("l_linestatus = 'F' AND l_suppkey % 7 <> 0"), li.where("l_linestatus = 'O' AND l_suppkey % 5 <> 0"), "server", "l_quantity", "l_tax").withColumn("waste", F.round("waste", 6))


@query("SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS attempt FROM events WHERE event_type = 'signup' AND (user_id, json_extract_string(props, '$.k')) NOT IN (SELECT (user_id, json_extract_string(props, '$.k')) FROM events WHERE event_type = 'purchase')")
def interrupted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that were started by a signup and never ended by a purchase."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    return ledgers.interrupted(table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("attempt"), kind.alias("kind")), ["user_id", "attempt"], "kind")


@query("SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS identities FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def changed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.changed_identity(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")


@query("WITH g AS (SELECT user_id, count(*) AS done, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS span FROM events GROUP BY 1) SELECT user_id, done, round((done - 1) * 3600.0 / span, 6) AS rate, round(greatest(0, 200 - done) / ((done - 1) * 3600.0 / span), 6) AS \"left\" FROM g WHERE span > 0")
def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.progress(table(spark, sf_dir, "events"), ["user_id"], "ts", 200).where("rate IS NOT NULL")


@query("WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS t, round(value * 60) AS len, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, event_id, k, t + len AS ends, len FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(r.ends, e.t) + e.len, e.len FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, ends - len AS begins, ends FROM r")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as jobs that run one after another."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.col("event_id").alias("seq"))
    return ledgers.one_in_flight(e, "user_id", "ts", F.round(F.col("value") * 60)).select("event_id", "begins", "ends")


@query("WITH n AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 3 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM n) SELECT user_id, burst::BIGINT AS burst, count(*) AS n, strftime(max(ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS ready FROM b GROUP BY ALL")
def debounced_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"))
    return ledgers.debounced(e, "user_id", "ts", "3 hours").withColumn("ready", F.date_format("ready", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT o_custkey, count(*) AS n, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def current_belief_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts still believed (not expired) of each customer, and the days between the first and the last."""
    o = table(spark, sf_dir, "orders").withColumn("expired_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))
    b = o.where(temporal.believed(F.col("expired_at")))
    return b.groupBy("o_custkey").agg(many().alias("n"), F.date_diff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))).alias("days"))


@query("SELECT user_id, count(*) AS events, round(sum(v), 6) AS total FROM (SELECT user_id, ts::DATE AS d, json_extract_string(props, '$.k') AS k, min(value) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def timeline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded once for each day and item."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("item"), "value")
    return temporal.folded(e, ["user_id", "day", "item"], "value").groupBy("user_id").agg(many().alias("events"), F.round(F.sum("value"), 6).alias("total"))
