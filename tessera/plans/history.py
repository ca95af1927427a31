"""Temporal and session queries over orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledgers, sessions, temporal
from ..sources.tables import table
from .catalog import query

AT = "1998-06-30"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts about a customer's status: valid from their date until 90 days after, recorded the next day."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("valid_at"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("invalid_at"), F.date_add(day, 1).alias("created_at"), F.when(F.col("o_orderstatus") == "P", F.date_add(day, 365)).alias("expired_at"))


FACTS = """f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS valid_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 90 END AS invalid_at, o_orderdate::DATE + 1 AS created_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE + 365 END AS expired_at FROM orders)"""


@query(f"WITH {FACTS} SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM f WHERE valid_at <= DATE '{AT}' AND (invalid_at IS NULL OR invalid_at > DATE '{AT}') GROUP BY o_orderstatus")
def asof_world_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where(temporal.true_at(F.col("valid_at"), F.col("invalid_at"), F.lit(AT).cast("date")))
    return f.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(f"WITH {FACTS} SELECT o_orderkey, o_custkey FROM f WHERE created_at <= DATE '{AT}' AND (expired_at IS NULL OR expired_at > DATE '{AT}')")
def known_at_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where(temporal.known_at(F.col("created_at"), F.col("expired_at"), F.lit(AT).cast("date"))).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, max(o_orderdate)::DATE::VARCHAR AS since FROM orders GROUP BY o_custkey")
def slot_current_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return temporal.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").cast("string").alias("since"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER w AS version, (lead(o_orderdate) OVER w)::DATE::VARCHAR AS valid_to, lead(o_orderdate) OVER w IS NULL AS current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return temporal.history(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "version", F.to_date("valid_to").cast("string").alias("valid_to"), "current")


@query("WITH t AS (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1), l AS (SELECT o.o_custkey, min(o_orderstatus) AS value, count(DISTINCT o_orderstatus) AS n FROM orders o JOIN t ON o.o_custkey = t.o_custkey AND o_orderdate = t GROUP BY 1) SELECT o_custkey, value, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM l")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest_with_status(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderstatus")


@query("WITH s AS (SELECT DISTINCT user_id, ts::DATE AS d, json_extract_string(props, '$.k') AS k FROM events) SELECT a.user_id, a.d::VARCHAR AS day, count(DISTINCT b.k) AS items FROM (SELECT DISTINCT user_id, d FROM s) a JOIN s b ON a.user_id = b.user_id AND b.d BETWEEN a.d - 6 AND a.d GROUP BY ALL")
def rolling_distinct_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.get_json_object("props", "$.k").alias("k"))
    return temporal.rolling_distinct(e, "user_id", "ts", "k", 7).select("user_id", F.col("day").cast("string").alias("day"), "items")


@query("SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'")
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max_by("value", "event_id").alias("last_purchase"))
    return temporal.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "at", "last_purchase").select("event_id", "last_purchase")


REPLAY = """
t AS (SELECT event_id, user_id, ts, event_type AS item, event_type = 'purchase' AS progress, event_type = 'signup' AS exempt, event_type IN ('click', 'error') AS trap FROM events),
e AS (SELECT *, coalesce(sum(progress::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM t),
r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, item, epoch ORDER BY ts, event_id) AS since_progress, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS total FROM e),
r AS (SELECT *, since_progress >= 4 AND NOT exempt AS suppressed FROM r0)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as retrievals of their type: a purchase is progress, signups are exempt, clicks and errors are traps."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", t.alias("item"), (t == "purchase").alias("progress"), (t == "signup").alias("exempt"), t.isin("click", "error").alias("trap"))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(_turns(spark, sf_dir), "user_id", ["ts", "event_id"], "item", "progress", exempt=F.col("exempt"))


@query(f"WITH {REPLAY} SELECT event_id, since_progress, total, suppressed FROM r")
def exhaustion_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select("event_id", "since_progress", "total", "suppressed")


@query(f"""WITH {REPLAY} SELECT user_id, round(CASE WHEN count(*) FILTER (trap) = 0 THEN 0 ELSE count(*) FILTER (trap AND NOT suppressed AND since_progress >= 4) / count(*) FILTER (trap) END, 6)::DOUBLE AS loop_rate,
round(CASE WHEN count(*) FILTER (NOT trap AND NOT exempt) = 0 THEN 1 ELSE count(*) FILTER (NOT trap AND NOT exempt AND NOT suppressed) / count(*) FILTER (NOT trap AND NOT exempt) END, 6)::DOUBLE AS productive_kept,
round(CASE WHEN count(*) FILTER (exempt) = 0 THEN 1 ELSE count(*) FILTER (exempt AND NOT suppressed) / count(*) FILTER (exempt) END, 6)::DOUBLE AS exempt_kept FROM r GROUP BY user_id""")
def loop_rate_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.loop_measures(_replayed(spark, sf_dir), "user_id", F.col("trap"), F.col("exempt"))


@query(f"""WITH {REPLAY}, g AS (SELECT user_id, round(CASE WHEN count(*) FILTER (trap) = 0 THEN 0 ELSE count(*) FILTER (trap AND since_progress >= 4) / count(*) FILTER (trap) END, 6)::DOUBLE AS base_loop_rate, round(CASE WHEN count(*) FILTER (trap) = 0 THEN 0 ELSE count(*) FILTER (trap AND since_progress >= 4 AND NOT suppressed) / count(*) FILTER (trap) END, 6)::DOUBLE AS loop_rate,
round(CASE WHEN count(*) FILTER (NOT trap AND NOT exempt) = 0 THEN 1 ELSE count(*) FILTER (NOT trap AND NOT exempt AND NOT suppressed) / count(*) FILTER (NOT trap AND NOT exempt) END, 6)::DOUBLE AS productive_kept, round(CASE WHEN count(*) FILTER (exempt) = 0 THEN 1 ELSE count(*) FILTER (exempt AND NOT suppressed) / count(*) FILTER (exempt) END, 6)::DOUBLE AS exempt_kept FROM r GROUP BY user_id)
SELECT *, round(base_loop_rate - loop_rate, 6) AS cut, base_loop_rate - loop_rate > 0 AND productive_kept >= 1 AND exempt_kept >= 1 AS graduates FROM g""")
def exhaustion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' replays with the penalty against those without, and whether it graduates."""
    return sessions.exhaustion_gate(_replayed(spark, sf_dir), "user_id", F.col("trap"), F.col("exempt"))


@query("WITH t AS (SELECT * FROM events WHERE event_type NOT IN ('view')), c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM c) SELECT user_id, streak::BIGINT AS streak, event_type, count(*) AS length FROM s GROUP BY ALL HAVING count(*) >= 2")
def loop_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sessions.streaks(e, "user_id", ["ts", "event_id"], "event_type", ["view"]).where("length >= 2")


@query("SELECT event_id, row_number() OVER w AS nth, row_number() OVER w > 1 AS repeat FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def first_seen_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.occurrence(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "nth", "repeat")


@query("WITH p AS (SELECT conv_id, turn, role, list(CASE WHEN role = 'user' THEN length(text) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations) SELECT conv_id, turn, coalesce(len(list_filter(b, lambda x: x IS NOT NULL))::BIGINT, 0) AS n_before, array_to_string(list_reverse(list_filter(b, lambda x: x IS NOT NULL))[1:4], ',') AS lengths FROM p WHERE role = 'assistant'")
def preceding_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four user turns before each answer, the last first, by their lengths."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("string").alias("size"))
    rows = sessions.preceding(c, "conv_id", "turn", "size", F.col("role") == "user", 4).where("role = 'assistant'")
    return rows.select("conv_id", "turn", "n_before", F.concat_ws(",", "before").alias("lengths"))


@query("WITH r AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_breach FROM r WHERE round(spent, 6) > 1000 GROUP BY user_id")
def budget_first_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event at which a user's running total passes a cap."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return sessions.breaches(e, "user_id", ["ts", "event_id"], "value", 1000).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_breach"))


@query("WITH o AS (SELECT event_id, user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT user_id, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events: a pause of more than six hours starts a new one."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"))
    return ledgers.debounced(e, "user_id", "ts", "6 hours").select("user_id", F.col("burst").alias("session"), "n")
