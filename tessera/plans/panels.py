"""Queries of panels and validators: orders as cases, their line items as what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, panels
from ..sources.tables import table
from .catalog import many, query

CASES = """f AS (SELECT l_orderkey, count(*) AS found, min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
c AS (SELECT o_orderkey, o_orderpriority AS role, coalesce(found, 0) AS found, flag IS DISTINCT FROM CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS wrong_flag, status IS DISTINCT FROM CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS wrong_status, o_orderkey % 5 <> 0 AS expected, o_orderkey % 11 = 0 AS abstained, o_orderkey % 13 = 0 AS refused FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
o AS (SELECT *, CASE WHEN found = 0 THEN CASE WHEN expected THEN 'unjoinable' ELSE 'rightly_absent' END WHEN found > 1 THEN 'ambiguous' WHEN refused THEN 'refused' WHEN abstained THEN CASE WHEN expected THEN 'abstained' ELSE 'rightly_abstained' END WHEN NOT expected THEN 'invented' WHEN NOT wrong_flag AND NOT wrong_status THEN 'exact' WHEN wrong_flag AND wrong_status THEN 'wrong' ELSE 'near' END AS outcome FROM c)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    f = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(many().alias("found"), F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    o, k, s = table(spark, sf_dir, "orders").join(f, "o_orderkey", "left"), F.col("o_orderkey"), F.col("o_orderstatus")
    flag = F.when(s == "F", "A").when(s == "O", "N").otherwise("R")
    wrong = panels.mismatches({"flag": (F.col("flag"), flag), "status": (F.col("status"), F.when(s == "F", "F").otherwise("O"))})
    rows = o.select(k, F.col("o_orderpriority").alias("role"), F.coalesce("found", F.lit(0)).alias("found"), wrong.alias("wrong"), (k % 5 != 0).alias("expected"), (k % 11 == 0).alias("abstained"), (k % 13 == 0).alias("refused"))
    return rows.withColumn("outcome", panels.outcome(*(F.col(c) for c in ("found", "wrong", "expected", "abstained", "refused"))))


@query(f"WITH {CASES} SELECT outcome, count(*) AS n, count(*) FILTER (wrong_flag) AS wrong_flag, count(*) FILTER (wrong_status) AS wrong_status FROM o GROUP BY outcome")
def panel_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda n: F.count_if(F.array_contains("wrong", n))
    return cases(spark, sf_dir).groupBy("outcome").agg(many().alias("n"), has("flag").alias("wrong_flag"), has("status").alias("wrong_status"))


@query(f"WITH {CASES} SELECT role, count(*) AS n, count(*) FILTER (NOT wrong_flag) AS flag, count(*) FILTER (NOT wrong_status) AS status FROM o GROUP BY role")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.accuracy(cases(spark, sf_dir), "role", {"flag": ~F.array_contains("wrong", "flag"), "status": ~F.array_contains("wrong", "status")})


@query(f"WITH {CASES}, p AS (SELECT o_orderkey // 2 AS pair, role, max(outcome) FILTER (o_orderkey % 2 = 0) AS a, max(outcome) FILTER (o_orderkey % 2 = 1) AS b FROM o GROUP BY 1, 2) SELECT role, count(*) AS pairs, count(*) FILTER (a IS NOT DISTINCT FROM b) AS invariant FROM p GROUP BY role")
def noisy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of neighbouring cases of one role, as clean and noisy sides."""
    c = cases(spark, sf_dir).select(F.struct(F.floor(F.col("o_orderkey") / 2).alias("pair"), "role").alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, "clean").otherwise("noisy").alias("side"), "outcome")
    return joins.paired(c, "pair", "side", ("clean", "noisy"), "outcome").groupBy("pair.role").agg(many().alias("pairs"), F.count_if("invariant").alias("invariant"))


@query("WITH a AS (SELECT l_orderkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) SELECT CASE WHEN a.k IS NULL THEN 'second_only' WHEN b.k IS NULL THEN 'first_only' ELSE 'both' END AS class, count(*) AS n, count(*) FILTER (a.k = b.k AND a.v IS DISTINCT FROM b.v) AS differing FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: table(spark, sf_dir, "lineitem").where(c).groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_returnflag").alias("v"))
    return panels.compared(of("l_linenumber <= 3"), of("l_linenumber >= 3"), ["k"], "v")


@query(f"WITH {CASES} SELECT role, count(*) FILTER (outcome IN ('exact', 'near')) AS agreed, count(*) AS n, round(count(*) FILTER (outcome IN ('exact', 'near')) / count(*), 6) AS share, count(*) = (SELECT count(*) FROM orders WHERE o_orderpriority = role) AS balanced FROM o GROUP BY role")
def shadow_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by role, checked against the number of orders of that priority."""
    total = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(many().alias("total"))
    return panels.agreement(cases(spark, sf_dir).join(total, "role"), "role", F.col("outcome").isin("exact", "near"), F.col("total"))


@query("WITH k AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS s, bool_or(l_returnflag <> 'A') AS d FROM lineitem GROUP BY 1) SELECT CASE WHEN s AND d THEN 'mixed' WHEN s THEN 'absolute' WHEN d THEN 'delta' END AS class, count(*) AS n FROM (SELECT l_orderkey, s, d FROM k) GROUP BY 1")
def memory_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "A", "set").otherwise("add")
    return panels.inventory(table(spark, sf_dir, "lineitem").select("l_orderkey", op.alias("operation")), ["l_orderkey"], "operation").groupBy("class").agg(many().alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) < 8")
def small_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.below_minimum(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 8)


MEMORY = "m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'historical' WHEN 'O' THEN 'current' END AS bucket, o_orderdate AS valid_at, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate - INTERVAL 1 DAY END AS invalid_at, o_orderdate AS created_at, o_custkey % 7 AS scope, o_orderpriority AS topic FROM orders), q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'historical' ELSE 'current' END AS intent, c_custkey * 10 AS support, TIMESTAMP '1998-01-01' AS as_of, c_custkey % 9 AS scope FROM customer)"


@query(f"""WITH {MEMORY} SELECT 'error' AS severity, 'DATE-ORDER' AS code, id::VARCHAR AS place FROM m WHERE valid_at > invalid_at UNION ALL SELECT 'error', 'DANGLING-SUPPORT', id::VARCHAR FROM q WHERE support NOT IN (SELECT id FROM m)
UNION ALL SELECT 'error', 'STALE-GOLD', q.id::VARCHAR FROM q JOIN m ON m.id = support WHERE intent = 'current' AND bucket = 'historical' UNION ALL SELECT 'error', 'ANACHRONISTIC-GOLD', q.id::VARCHAR FROM q JOIN m ON m.id = support WHERE created_at > as_of
UNION ALL SELECT 'warn', 'THIN-SCOPE', q.id::VARCHAR FROM q LEFT JOIN (SELECT scope, count(*) AS n FROM m GROUP BY 1) s USING (scope) WHERE coalesce(n, 0) < 5""")
def evidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of memories and of the answers that queries name."""
    o, s = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    m = o.select(F.col("o_orderkey").alias("m_id"), F.when(s == "F", "historical").when(s == "O", "current").alias("bucket"), F.col("o_orderdate").alias("valid_at"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate") - F.expr("interval 1 day")).alias("invalid_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 7).alias("scope"))
    c = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 3 == 0, "historical").otherwise("current").alias("intent"), (c * 10).alias("m_id"), F.lit("1998-01-01").cast("timestamp").alias("as_of"), (c % 9).alias("scope"))
    answered = q.join(m.drop("scope"), "m_id")
    deep = m.groupBy("scope").agg(many().alias("n"))
    return panels.findings([
        ("error", "DATE-ORDER", m.where("valid_at > invalid_at"), "m_id"), ("error", "DANGLING-SUPPORT", panels.dangling(q, "m_id", m, "m_id"), "id"),
        ("error", "STALE-GOLD", answered.where("intent = 'current' AND bucket = 'historical'"), "id"), ("error", "ANACHRONISTIC-GOLD", answered.where("created_at > as_of"), "id"),
        ("warn", "THIN-SCOPE", q.join(deep, "scope", "left").where("coalesce(n, 0) < 5"), "id"),
    ])


@query("""WITH t AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT count(DISTINCT p_type) AS n FROM part) SELECT 'warn' AS severity, 'SINGLE-ROLE-CORPUS' AS code, 'fixture' AS place FROM r WHERE n < 3 UNION ALL SELECT 'warn', 'TOPIC-NOT-CONSTANT', 'fixture' FROM (SELECT max(n) AS n FROM t) WHERE n < 2 UNION ALL SELECT 'error', 'DUP-QUERY-ID', user_id::VARCHAR FROM events GROUP BY user_id HAVING count(*) > 1 UNION ALL SELECT 'warn', 'NO-PREFERRED-ROLE', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)""")
def intent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of an intent fixture over parts, events and suppliers."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    whole = F.lit("fixture").alias("place")
    return panels.findings([
        ("warn", "SINGLE-ROLE-CORPUS", p.agg(F.count_distinct("p_type").alias("n")).where("n < 3").select(whole), "place"),
        ("warn", "TOPIC-NOT-CONSTANT", p.groupBy("p_name").agg(many().alias("n")).agg(F.max("n").alias("n")).where("n < 2").select(whole), "place"),
        ("error", "DUP-QUERY-ID", panels.repeated(table(spark, sf_dir, "events"), "user_id"), "user_id"),
        ("warn", "NO-PREFERRED-ROLE", panels.dangling(table(spark, sf_dir, "supplier"), "s_suppkey", li.where("l_returnflag = 'A' AND l_quantity > 49"), "l_suppkey"), "s_suppkey"),
    ])


@query("""SELECT 'error' AS severity, 'SPLIT-LEAK' AS code, p_name AS place FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey % 2) > 1 UNION ALL SELECT 'error', 'SPAN', item_id::VARCHAR FROM benchmark WHERE substr(text, 6, 10) IS DISTINCT FROM CASE WHEN item_id % 2 = 0 THEN substr(text, 6, 10) ELSE substr(text, 7, 10) END
UNION ALL SELECT 'error', 'HASH', item_id::VARCHAR FROM benchmark WHERE sha256(text) <> sha256(CASE WHEN item_id % 3 = 0 THEN text || '.' ELSE text END)""")
def panel_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in both splits, spans and digests that are not as stated."""
    b = table(spark, sf_dir, "benchmark")
    said = F.when(F.col("item_id") % 2 == 0, F.substring("text", 6, 10)).otherwise(F.substring("text", 7, 10))
    spans = b.select("item_id", "text", F.lit(5).alias("start"), F.lit(15).alias("stop"), said.alias("said"))
    hashed = b.where(F.sha2("text", 256) != F.sha2(F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256))
    p = table(spark, sf_dir, "part").withColumn("split", F.col("p_partkey") % 2)
    return panels.findings([("error", "SPLIT-LEAK", panels.shared_between(p, "p_name", "split"), "p_name"), ("error", "SPAN", panels.spans_stated(spans, "text", "start", "stop", "said"), "item_id"), ("error", "HASH", hashed, "item_id")])


@query("""SELECT 'error' AS severity, 'NO-EVIDENCE' AS code, o_orderkey::VARCHAR AS place FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') UNION ALL SELECT 'error', 'LOST-PREDECESSOR', (o_orderkey)::VARCHAR FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey + 14995 NOT IN (SELECT o_orderkey FROM orders)""")
def write_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted rows need evidence that is not inferred, and a superseded row must stay."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    promoted = o.where("o_orderstatus = 'F'")
    claimed = o.where("o_orderkey % 10 = 0").withColumn("old", F.col("o_orderkey") + 14995)
    return panels.findings([("error", "NO-EVIDENCE", panels.dangling(promoted, "o_orderkey", li.where("l_returnflag <> 'R'"), "l_orderkey"), "o_orderkey"), ("error", "LOST-PREDECESSOR", panels.dangling(claimed, "old", o, "o_orderkey"), "o_orderkey")])


@query("""WITH h AS (SELECT p_brand AS product, count(*) AS headlines, max(p_size) AS top FROM part GROUP BY 1) SELECT 'error' AS severity, 'STALE-HEADLINE' AS code, product AS place FROM h WHERE top < 50 UNION ALL SELECT 'warn', 'TOO-MANY', product FROM h WHERE headlines > 10 UNION ALL SELECT 'error', 'UNKNOWN-PRODUCT', p FROM (SELECT unnest(['Brand#1', 'Brand#99']) AS p) WHERE p NOT IN (SELECT product FROM h)""")
def headline_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines without recent evidence, too many of them, and products that nobody knows."""
    h = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("product")).agg(many().alias("headlines"), F.max("p_size").alias("top"))
    stated = spark.createDataFrame([("Brand#1",), ("Brand#99",)], "product string")
    return panels.findings([("error", "STALE-HEADLINE", h.where("top < 50"), "product"), ("warn", "TOO-MANY", h.where("headlines > 10"), "product"), ("error", "UNKNOWN-PRODUCT", panels.dangling(stated, "product", h, "product"), "product")])


@query("""SELECT 'error' AS severity, 'MISSING-ARM' AS code, o_custkey::VARCHAR AS place FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) < 3 UNION ALL SELECT 'error', 'BAD-USAGE', event_id::VARCHAR FROM events WHERE value <= 0.5 UNION ALL SELECT 'warn', 'REPEATED-TASK', k FROM (SELECT o_custkey || '/' || o_orderstatus || '/' || o_orderpriority AS k FROM orders) GROUP BY k HAVING count(*) > 3""")
def checkpoint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without every arm, usage that is not positive, and repeats."""
    o = table(spark, sf_dir, "orders")
    keyed = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("k"))
    return panels.findings([
        ("error", "MISSING-ARM", o.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n < 3"), "o_custkey"), ("error", "BAD-USAGE", table(spark, sf_dir, "events").where("value <= 0.5"), "event_id"),
        ("warn", "REPEATED-TASK", keyed.groupBy("k").agg(many().alias("n")).where("n > 3"), "k"),
    ])
