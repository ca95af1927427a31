"""Queries of joins over orders, line items, events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, texts
from ..operators.sizes import small_side
from ..sources.tables import table
from .catalog import many, query


@query("SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a_quantity, sum(l_quantity) FILTER (l_returnflag = 'N') AS n_quantity, count(*) FILTER (l_returnflag = 'R') AS r_lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def manifest_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items by return flag."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    arms = joins.by_arm(li.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), many().alias("lines")), ["l_orderkey"], "l_returnflag", ["quantity", "lines"])
    arm = lambda k: F.try_element_at("arms", F.lit(k))
    return arms.select("l_orderkey", arm("A")["quantity"].alias("a_quantity"), arm("N")["quantity"].alias("n_quantity"), F.coalesce(arm("R")["lines"], F.lit(0)).alias("r_lines"))


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY GROUP BY o_orderkey")
def changes_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of each order in the four hundred days after it."""
    w = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 400 days")).alias("end"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"))
    return joins.within(c, w, ["o_orderkey"], "at", "start", "end").groupBy("o_orderkey").agg(many().alias("n"))


@query("SELECT item_id, count(*) AS n, min(doc_id) AS first FROM (SELECT item_id, substr(text, 1, 40) AS part FROM benchmark) JOIN documents ON contains(text, part) GROUP BY item_id")
def prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first forty characters of a benchmark text."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("part"))
    return texts.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", parts, "part").groupBy("item_id").agg(many().alias("n"), F.min("doc_id").alias("first"))


@query("""WITH i AS (SELECT DISTINCT o_custkey, o_orderkey, o_orderstatus, o_orderdate, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT f.o_custkey, f.o_orderkey AS failure, arg_min(a.o_orderkey, (a.o_orderdate, a.o_orderkey)) AS match FROM i f JOIN i a ON a.o_custkey = f.o_custkey AND a.l_suppkey = f.l_suppkey WHERE f.o_orderstatus = 'F' AND a.o_orderstatus = 'O' GROUP BY f.o_custkey, f.o_orderkey""")
def anchor_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open order of the customer that shares a supplier with each finished one."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    i = o.select("o_custkey", F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderdate", "l_suppkey").distinct()
    return joins.first_sharing(i.where("o_orderstatus = 'F'"), i.where("o_orderstatus = 'O'"), ["o_custkey"], "l_suppkey", "o_orderdate")


@query("""WITH e AS (SELECT event_id, user_id, ' ' || upper(event_type) AS kind, json_extract_string(props, '$.k')::BIGINT AS k, value, ts FROM events), b AS (SELECT * FROM e WHERE event_id % 2 = 1),
x AS (SELECT user_id, trim(lower(kind)) AS kind, k, arg_max(value, event_id) AS v FROM b GROUP BY ALL), l AS (SELECT user_id, trim(lower(kind)) AS kind, arg_max(value, event_id) AS v FROM b GROUP BY ALL)
SELECT a.event_id, coalesce(x.v, l.v) AS audited, CASE WHEN x.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'slot' ELSE 'none' END AS how FROM (SELECT event_id, user_id, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 2 = 0) a LEFT JOIN x USING (user_id, kind, k) LEFT JOIN l ON l.user_id = a.user_id AND l.kind = a.kind""")
def slot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events against the latest odd one of the same user, kind and k, else of the same user and kind."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit(" "), F.upper("event_type")).alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value")
    even, odd = e.where("event_id % 2 = 0").drop("value"), e.where("event_id % 2 = 1")
    return joins.by_slot(even, odd, ["user_id", "kind"], ["k"], "event_id", "value").select("event_id", "audited", "how")


@query("SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN coalesce(s.d, c.d, o_orderdate) ELSE o_orderdate END)::DATE::VARCHAR AS day FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_orderkey = o_orderkey LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c ON c.o_custkey = o.o_custkey")
def date_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders take the date of their first returned item, else of their customer's first finished order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    shipped = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("d"))
    done = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    out = joins.backfilled(o, "o_orderdate", F.col("o_orderstatus") == "P", (shipped, ["o_orderkey"], "d"), (done, ["o_custkey"], "d"))
    return out.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("""WITH l AS (SELECT *, string_agg(event_type, ' ') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS context FROM events), a AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'purchase' ELSE 'error' END AS word FROM part WHERE p_partkey < 50)
SELECT event_id, count(p_partkey) AS approvals FROM l LEFT JOIN a ON floor(value)::BIGINT = p_size AND contains(context, word) WHERE event_type = 'view' GROUP BY event_id""")
def claims_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as claims: approved by entries of the same value whose word stands within five events around them."""
    lines = joins.around(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", 5).where("event_type = 'view'").select("event_id", "context", F.floor("value").alias("p_size"))
    approved = table(spark, sf_dir, "part").where("p_partkey < 50").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"), F.when(F.col("p_partkey") % 2 == 0, "purchase").otherwise("error").alias("word"))
    met = lines.join(small_side(approved), "p_size").where(F.contains("context", F.col("word"))).groupBy("event_id").agg(many().alias("approvals"))
    return lines.select("event_id").join(met, "event_id", "left").select("event_id", F.coalesce("approvals", F.lit(0)).alias("approvals"))


@query("WITH h AS (SELECT item_id, lower(split_part(text, ' ', 2)) AS word FROM benchmark) SELECT item_id, count(doc_id) AS evidence, CASE WHEN count(doc_id) = 0 THEN 'warning' ELSE 'ok' END AS status FROM h LEFT JOIN documents ON contains(lower(text), ' ' || word || ' ') AND lang = 'en' GROUP BY item_id")
def headline_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents that name the second word of each benchmark text; those without any are warned about."""
    heads = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("word"))
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lower("text").alias("t"))
    named = texts.containing(docs, "doc_id", "t", heads.select("item_id", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w")), "w").groupBy("item_id").agg(many().alias("evidence"))
    out = heads.select("item_id").join(named, "item_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    return out.withColumn("status", F.when(F.col("evidence") == 0, "warning").otherwise("ok"))


@query("""WITH r AS (SELECT o_custkey, min(l_linenumber) FILTER (o_orderstatus = 'F') AS before_, min(l_linenumber) FILTER (o_orderstatus = 'O') AS after_, count(*) FILTER (o_orderstatus = 'P') AS writes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN before_ IS NULL AND after_ IS NULL THEN 'unreached' WHEN before_ IS NULL THEN 'gained' WHEN after_ IS NULL OR after_ > before_ THEN 'regressed' WHEN after_ < before_ THEN 'improved' ELSE 'same' END AS change, count(*) AS n, sum(writes)::BIGINT AS writes, median(before_) AS median_before, median(after_) AS median_after FROM r GROUP BY 1""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by how their first line's number changed from finished to open orders, with the pending lines between."""
    r = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")
    rank = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("l_linenumber")))
    each = r.groupBy("o_custkey").agg(rank("F").alias("before"), rank("O").alias("after"), F.count_if(F.col("o_orderstatus") == "P").alias("writes"))
    return each.groupBy(joins.rank_change(F.col("before"), F.col("after")).alias("change")).agg(many().alias("n"), F.sum("writes").alias("writes"), F.median("before").alias("median_before"), F.median("after").alias("median_after"))


@query("WITH p AS (SELECT o_orderkey // 2 AS pair, max(o_orderpriority) FILTER (o_orderkey % 2 = 0) AS a, max(o_orderpriority) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1) SELECT coalesce(a, '-') AS clean, count(*) AS pairs, count(*) FILTER (a IS NOT DISTINCT FROM b) AS invariant FROM p GROUP BY 1")
def pair_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders as clean and noisy sides: pairs whose priority is the same."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, "clean").otherwise("noisy").alias("side"), "o_orderpriority")
    p = joins.paired(o, "pair", "side", ("clean", "noisy"), "o_orderpriority")
    return p.groupBy(F.coalesce("a", F.lit("-")).alias("clean")).agg(many().alias("pairs"), F.count_if("invariant").alias("invariant"))
