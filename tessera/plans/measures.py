"""Queries of retrieval measures and gates: orders ranked for their customers by price and by date.

A customer is a query and asks for the finished orders above 300,000 (gold); orders are the documents. Pending orders are stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gates, graph, intent, metrics, temporal
from ..operators.sizes import small_side
from ..sources.tables import table
from .catalog import many, query

K = 3


def runs(spark: SparkSession, sf_dir: str, depth: int = 6) -> DataFrame:
    """(condition, query_id, doc_id, rank) of both rankings."""
    o = table(spark, sf_dir, "orders")
    ranked = lambda name, *by: o.select(F.lit(name).alias("condition"), F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by, "o_orderkey")).cast("bigint").alias("rank"))
    both = ranked("price", F.desc("o_totalprice")).unionByName(ranked("date", F.desc("o_orderdate")))
    return both.where(F.col("rank") <= depth)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as queries with intent, an exact string, a symbol and a topic."""
    c = F.col("c_custkey")
    goal = F.when(c % 3 == 2, "historical").otherwise("current")
    exact = F.when(c % 4 == 0, "URGENT").when(c % 4 == 1, "P").when(c % 4 == 3, "zzz")
    return table(spark, sf_dir, "customer").select(c.alias("query_id"), goal.alias("intent"), exact.alias("exact"), F.when(c % 3 > 0, "F").alias("symbol"), F.when(c % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("topic"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"), F.array("o_orderstatus").alias("symbols"), "o_orderstatus")


RUNS = """
rk AS (SELECT 'price' AS condition, o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders UNION ALL SELECT 'date', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) FROM orders),
runs AS (SELECT * FROM rk WHERE rank <= 6),
gold AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000),
asked AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 2 THEN 'historical' ELSE 'current' END AS intent, CASE c_custkey % 4 WHEN 0 THEN 'URGENT' WHEN 1 THEN 'P' WHEN 3 THEN 'zzz' END AS exact, CASE WHEN c_custkey % 3 > 0 THEN 'F' END AS symbol, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS topic FROM customer),
docs AS (SELECT o_orderkey AS doc_id, o_orderpriority AS text, o_orderstatus AS status FROM orders),
j AS (SELECT r.*, g.doc_id IS NOT NULL AS hit, coalesce(n, 0) AS n_gold FROM runs r LEFT JOIN gold g USING (query_id, doc_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) USING (query_id)),
conds AS (SELECT DISTINCT condition FROM runs), grid AS (SELECT * FROM asked, conds)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged(runs(spark, sf_dir), answers(spark, sf_dir))


@query(f"WITH {RUNS}, f AS (SELECT condition, query_id, max(CASE WHEN hit AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS found FROM j GROUP BY ALL) SELECT condition, round(avg(found), 6) AS recall_at_3 FROM f GROUP BY condition")
def known_item_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.any_within(judged(spark, sf_dir), K).groupBy("condition").agg(F.round(F.avg("found"), 6).alias("recall_at_3"))


@query(f"WITH {RUNS}, h AS (SELECT condition, query_id, max(CASE WHEN status = exact OR contains(text, exact) THEN 1.0 ELSE 0.0 END) AS hit FROM runs JOIN asked USING (query_id) JOIN docs USING (doc_id) WHERE rank <= 3 AND exact IS NOT NULL GROUP BY ALL) SELECT condition, count(*) AS n, round(avg(hit), 6) AS exact_hit FROM h GROUP BY condition")
def exact_string_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.target_hit(runs(spark, sf_dir), shown(spark, sf_dir), asked(spark, sf_dir), "exact", "symbols", K, "text")
    return h.groupBy("condition").agg(many().alias("n"), F.round(F.avg("hit"), 6).alias("exact_hit"))


@query(f"WITH {RUNS}, h AS (SELECT condition, query_id, max(CASE WHEN status = symbol THEN 1.0 ELSE 0.0 END) AS hit FROM runs JOIN asked USING (query_id) JOIN docs USING (doc_id) WHERE rank <= 3 AND symbol IS NOT NULL GROUP BY ALL) SELECT condition, count(*) AS n, round(avg(hit), 6) AS symbol_hit FROM h GROUP BY condition")
def symbol_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.target_hit(runs(spark, sf_dir), shown(spark, sf_dir), asked(spark, sf_dir), "symbol", "symbols", K)
    return h.groupBy("condition").agg(many().alias("n"), F.round(F.avg("hit"), 6).alias("symbol_hit"))


@query(f"WITH {RUNS}, s AS (SELECT condition, query_id, avg((status = 'P')::INT) AS share FROM runs JOIN docs USING (doc_id) WHERE rank <= 3 GROUP BY ALL) SELECT condition, round(avg(CASE WHEN intent = 'current' THEN coalesce(share, 0) ELSE 0 END), 6) AS stale FROM grid LEFT JOIN s USING (condition, query_id) GROUP BY condition")
def stale_rate_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of stale documents among the first three, for queries about what is current."""
    j = runs(spark, sf_dir).join(shown(spark, sf_dir), "doc_id")
    return metrics.of_top(j, asked(spark, sf_dir), F.col("o_orderstatus") == "P", K, "stale", F.col("intent") == "current")


@query(f"WITH {RUNS}, s AS (SELECT condition, query_id, avg((NOT hit AND text = topic)::INT) AS share FROM j JOIN docs USING (doc_id) JOIN asked USING (query_id) WHERE rank <= 3 GROUP BY ALL) SELECT condition, round(avg(coalesce(share, 0)), 6) AS false_neighbours FROM grid LEFT JOIN s USING (condition, query_id) GROUP BY condition")
def false_neighbour_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first three documents that are no answer but share the query's topic."""
    q = asked(spark, sf_dir)
    j = judged(spark, sf_dir).join(shown(spark, sf_dir), "doc_id").join(q.select("query_id", "topic"), "query_id")
    return metrics.of_top(j, q, ~F.col("hit") & (F.col("text") == F.col("topic")), K, "false_neighbours")


@query(f"WITH {RUNS}, n AS (SELECT count(*) AS n FROM docs WHERE status = 'P'), s AS (SELECT condition, query_id, count(*) AS shown FROM runs JOIN docs USING (doc_id) WHERE rank <= 3 AND status = 'P' GROUP BY ALL) SELECT condition, round(avg(CASE WHEN intent <> 'current' OR n = 0 THEN 1 ELSE 1 - coalesce(shown, 0) / n END), 6) AS suppression FROM grid LEFT JOIN s USING (condition, query_id), n GROUP BY condition")
def corpus_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = shown(spark, sf_dir).where("o_orderstatus = 'P'").select("doc_id")
    return metrics.suppression(runs(spark, sf_dir), asked(spark, sf_dir), stale, K)


@query(f"WITH {RUNS}, r AS (SELECT condition, query_id, count(*) FILTER (hit AND rank <= 3) / nullif(max(n_gold), 0) AS recall FROM j GROUP BY ALL) SELECT condition, round(avg(CASE WHEN intent = 'historical' THEN coalesce(recall, 0) ELSE 1 END), 6) AS preservation FROM grid LEFT JOIN r USING (condition, query_id) GROUP BY condition")
def historical_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of queries about the past; 1 for the others."""
    per = metrics.per_query(judged(spark, sf_dir), K).select("condition", "query_id", "recall")
    q = asked(spark, sf_dir).crossJoin(F.broadcast(per.select("condition").distinct())).join(per, ["condition", "query_id"], "left")
    return q.groupBy("condition").agg(F.round(F.avg(F.when(F.col("intent") == "historical", F.coalesce("recall", F.lit(0.0))).otherwise(1.0)), 6).alias("preservation"))


PREFERS = ", ".join(f"('{i}', '{r}')" for i, fits in intent.FIT.items() for r in fits["prefers"])
ROLE = "CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'plan' ELSE 'benchmark' END"


@query(f"WITH {RUNS}, p(intent, role) AS (VALUES {PREFERS}), t AS (SELECT r.condition, CASE query_id % 3 WHEN 0 THEN 'debug_failure' WHEN 1 THEN 'plan_next_action' ELSE 'verify_currentness' END AS intent, {ROLE} AS role FROM runs r JOIN orders ON o_orderkey = doc_id WHERE rank = 1) SELECT condition, round(avg((p.role IS NOT NULL)::INT), 6) AS intent_correct FROM t LEFT JOIN p USING (intent, role) GROUP BY condition")
def intent_correct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first document has a role that the query's intent prefers."""
    s = F.col("o_orderstatus")
    role = F.when(s == "F", "failure").when(s == "O", "plan").otherwise("benchmark")
    goal = F.when(F.col("query_id") % 3 == 0, "debug_failure").when(F.col("query_id") % 3 == 1, "plan_next_action").otherwise("verify_currentness")
    top = runs(spark, sf_dir).where("rank = 1").join(shown(spark, sf_dir), "doc_id").select("condition", goal.alias("intent"), role.alias("role"))
    liked = intent.fit_table(spark).where("fit = 'prefers'").select("intent", "role", F.lit(1).alias("ok"))
    return top.join(F.broadcast(liked), ["intent", "role"], "left").groupBy("condition").agg(F.round(F.avg(F.coalesce("ok", F.lit(0))), 6).alias("intent_correct"))


BELIEFS = "b AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'historical' ELSE 'anergic' END AS bucket, o_totalprice > 100000 AS gold_current, o_orderdate < TIMESTAMP '1997-06-01' AS gold_historical, o_orderpriority = '5-LOW' AS noise FROM orders)"


@query(f"""WITH {BELIEFS}, c AS (SELECT 'all' AS condition, true AS asserted, true AS surfaced, b.* FROM b UNION ALL SELECT 'buckets', bucket = 'current', bucket IN ('current', 'historical'), b.* FROM b UNION ALL SELECT 'packet', bucket = 'current', true, b.* FROM b)
SELECT condition, round(coalesce(count(*) FILTER (asserted AND NOT gold_current) / nullif(count(*) FILTER (asserted), 0), 0), 6) AS stale_asserted, round(coalesce(count(*) FILTER (surfaced AND noise) / nullif(count(*) FILTER (surfaced), 0), 0), 6) AS poisoned, round(coalesce(count(*) FILTER (surfaced AND gold_historical) / nullif(count(*) FILTER (gold_historical), 0), 1), 6) AS preserved FROM c GROUP BY condition""")
def belief_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asserted and surfaced by three conditions over beliefs in buckets."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    b = o.select(F.when(s == "F", "current").when(s == "O", "historical").otherwise("anergic").alias("bucket"), (F.col("o_totalprice") > 100000).alias("gold_current"), (F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp")).alias("gold_historical"), (F.col("o_orderpriority") == "5-LOW").alias("noise"))
    return gates.beliefs(b, {"all": (None, None), "buckets": (["current"], ["current", "historical"]), "packet": (["current"], None)})


FACTS = "f AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderdate::DATE AS valid_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 90 END AS invalid_at, o_totalprice FROM orders), q AS (SELECT c_custkey AS query_id FROM customer), g AS (SELECT query_id, doc_id FROM f WHERE valid_at <= DATE '1998-01-01' AND (invalid_at IS NULL OR invalid_at > DATE '1998-01-01') AND o_totalprice > 50000)"


@query(f"""WITH {FACTS}, r AS (SELECT 'blind' AS condition, query_id, doc_id FROM f UNION ALL SELECT 'lens', query_id, doc_id FROM f WHERE valid_at <= DATE '1998-01-01' AND (invalid_at IS NULL OR invalid_at > DATE '1998-01-01')),
s AS (SELECT condition, r.query_id, count(*) AS n, count(g.doc_id) AS hits FROM r LEFT JOIN g USING (query_id, doc_id) GROUP BY ALL), m AS (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1),
x AS (SELECT c.condition, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, coalesce(n_gold, 0) AS n_gold FROM q CROSS JOIN (SELECT DISTINCT condition FROM r) c LEFT JOIN s ON s.query_id = q.query_id AND s.condition = c.condition LEFT JOIN m ON m.query_id = q.query_id)
SELECT condition, round(avg(CASE WHEN n_gold = 0 THEN 1 ELSE hits / n_gold END), 6) AS recall, round(avg(CASE WHEN n = 0 THEN 1 ELSE hits / n END), 6) AS precision, round(avg(CASE WHEN n = 0 THEN 0 ELSE (n - hits) / n END), 6) AS leak FROM x GROUP BY condition""")
def temporal_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts seen through a lens on world time, and without one."""
    day = F.to_date("o_orderdate")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), day.alias("valid_at"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("invalid_at"), "o_totalprice")
    seen = f.where(temporal.true_at(F.col("valid_at"), F.col("invalid_at"), F.lit("1998-01-01").cast("date")))
    named = lambda n, d: d.select(F.lit(n).alias("condition"), "query_id", "doc_id")
    return metrics.set_measures(named("blind", f).unionByName(named("lens", seen)), seen.where("o_totalprice > 50000").select("query_id", "doc_id"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")))


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), d AS (SELECT s, count(*) AS n FROM e GROUP BY s), g AS (SELECT p, s FROM (SELECT e.*, row_number() OVER (PARTITION BY p ORDER BY s) AS k FROM e) WHERE k <= 3),
f AS (SELECT p, s FROM (SELECT e.*, row_number() OVER (PARTITION BY p ORDER BY s) AS k FROM e JOIN d USING (s) WHERE n < 250) WHERE k <= 5)
SELECT p AS seed, (SELECT count(*) FROM g JOIN f USING (p, s) WHERE g.p = e.p) / count(DISTINCT e.s) FILTER (e.s IN (SELECT g.s FROM g WHERE g.p = e.p)) AS recall, (SELECT count(*) FROM f WHERE f.p = e.p) + 1 AS pool FROM e GROUP BY p""")
def structural_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each part's three first suppliers a search of one step reaches, hubs left out, and how large the pool is."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    seeds = e.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    busy = e.groupBy(F.col("dst").alias("node")).agg(many().alias("degree")).where("degree >= 250").select("node")
    found = graph.reach(e.join(busy.withColumnRenamed("node", "dst"), "dst", "left_anti"), seeds, depth=1, hub=1_000_000)
    gold = e.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("k <= 3").select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    hits = gold.join(found.select("seed", "node", F.lit(1).alias("f")), ["seed", "node"], "left").groupBy("seed").agg((F.count("f") / many()).alias("recall"))
    pool = seeds.select("seed").join(found.groupBy("seed").agg(many().alias("n")), "seed", "left").select("seed", (F.coalesce("n", F.lit(0)) + 1).alias("pool"))
    return hits.join(pool, "seed").select("seed", "recall", "pool")


@query("""WITH c AS (SELECT event_id, event_type = 'error' AS should_refuse, value, user_id FROM events), v AS (SELECT 'none' AS condition, false AS refused, c.* FROM c UNION ALL SELECT 'currentness', value > 100, c.* FROM c UNION ALL SELECT 'chain', value > 100 OR user_id % 10 = 0, c.* FROM c)
SELECT condition, round(coalesce(count(*) FILTER (refused AND should_refuse) / nullif(count(*) FILTER (should_refuse), 0), 1), 6) AS refuse_recall, round(coalesce(count(*) FILTER (NOT refused AND NOT should_refuse) / nullif(count(*) FILTER (NOT should_refuse), 0), 1), 6) AS admit_retention FROM v GROUP BY condition""")
def warden_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards as a chain, the most restrictive wins: how many bad rows are refused and good ones let in."""
    e = table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("should_refuse"), "value", "user_id")
    guards = {"currentness": F.when(F.col("value") > 100, 2).otherwise(0), "scope": F.when(F.col("user_id") % 10 == 0, 2).otherwise(0)}
    return gates.wardens(e, guards, {"none": [], "currentness": ["currentness"], "chain": ["currentness", "scope"]}, F.col("should_refuse"))


@query(f"WITH {RUNS}, p AS (SELECT condition, query_id, coalesce(max((rank = 1 AND hit)::INT), 0) AS first, count(*) FILTER (hit AND rank <= 3) / nullif(max(n_gold), 0) AS r, coalesce(max((rank = 1 AND status = 'P')::INT), 0) AS noise FROM j JOIN docs USING (doc_id) GROUP BY ALL) SELECT condition, round(avg(first), 6) AS culprit_first, round(avg(coalesce(r, 0)), 6) AS culprit_recall, round(avg(noise), 6) AS noise_first FROM p GROUP BY condition")
def culprit_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).join(shown(spark, sf_dir), "doc_id")
    first = lambda c: F.max(F.when((F.col("rank") == 1) & c, 1).otherwise(0))
    p = j.groupBy("condition", "query_id").agg(first(F.col("hit")).alias("first"), F.try_divide(F.count_if(F.col("hit") & (F.col("rank") <= K)), F.max("n_gold")).alias("r"), first(F.col("o_orderstatus") == "P").alias("noise"))
    return p.groupBy("condition").agg(F.round(F.avg("first"), 6).alias("culprit_first"), F.round(F.avg(F.coalesce("r", F.lit(0.0))), 6).alias("culprit_recall"), F.round(F.avg("noise"), 6).alias("noise_first"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS memories, sum(len(regexp_extract_all(lower(o_orderpriority), '[a-z0-9_]+')))::BIGINT AS tokens, count(DISTINCT l_suppkey) AS episodes, count(DISTINCT year(o_orderdate)) AS sessions, count(DISTINCT l_partkey) AS entities, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def evidence_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey"), "o_orderkey")
    e = o.select("o_custkey", F.col("o_orderkey").alias("memory"), F.col("o_orderpriority").alias("text"), F.col("l_suppkey").alias("episode"), F.year("o_orderdate").alias("session"), F.col("l_partkey").alias("entity"), F.to_date("o_orderdate").alias("at"))
    return metrics.dispersion(e, "o_custkey")


@query("""WITH b AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS found FROM part GROUP BY 1), w AS (SELECT p_brand, found, ['red ring', 'small widget', 'blue'] AS names FROM b)
SELECT p_brand, round(len(list_filter(names, lambda n: len(list_filter(found, lambda f: contains(f, n))) > 0)) / 3, 6) AS entity_recall, round(len(list_filter(names, lambda n: len(list_filter(found, lambda f: len(list_intersect(string_split(f, ' '), string_split(n, ' '))) >= 0.6 * len(string_split(n, ' ')))) > 0)) / 3, 6) AS fact_recall FROM w""")
def entity_fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three stated names the part names of each brand hold, as they stand and by their words."""
    wanted = F.array(*(F.lit(w) for w in ("red ring", "small widget", "blue")))
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("found"))
    return b.select("p_brand", F.round(metrics.named_recall(wanted, F.col("found")), 6).alias("entity_recall"), F.round(metrics.fact_recall(wanted, F.col("found"), ["the"]), 6).alias("fact_recall"))


WIDE = "w AS (SELECT o_orderpriority AS condition, round(avg((o_orderstatus = 'F')::INT), 6) AS recall, round(avg((o_orderstatus = 'P')::INT), 6) AS stale, round(avg((o_totalprice > 400000)::INT), 6) AS wrong, round(avg((o_totalprice < 100000)::INT), 6) AS support FROM orders GROUP BY 1)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as conditions with four measures."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("condition")).agg(share(s == "F").alias("recall"), share(s == "P").alias("stale"), share(p > 400000).alias("wrong"), share(p < 100000).alias("support"))


@query(f"""WITH {WIDE}, b AS (SELECT min(stale) AS stale, min(wrong) AS wrong, max(support) AS support, max(recall) AS recall FROM w WHERE condition IN ('1-URGENT', '2-HIGH')), f AS (SELECT * FROM w WHERE condition = '5-LOW')
SELECT round(b.stale - f.stale, 6) AS stale_gain, round(b.wrong - f.wrong, 6) AS wrong_gain, round(f.support - b.support, 6) AS support_gain, round(b.recall - f.recall, 6) AS recall_loss, (round(b.stale - f.stale, 6) > 0 OR round(b.wrong - f.wrong, 6) > 0 OR round(f.support - b.support, 6) > 0) AND round(b.recall - f.recall, 6) <= 0.1 AS graduates FROM b, f""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.promotion(wide(spark, sf_dir), "5-LOW", ["1-URGENT", "2-HIGH"], lower=["stale", "wrong"], higher=["support"], recall="recall")


@query(f"WITH {WIDE}, x AS (SELECT (SELECT recall FROM w WHERE condition = '1-URGENT') AS d, (SELECT recall FROM w WHERE condition = '2-HIGH') AS n, (SELECT avg(recall) FROM w WHERE condition NOT IN ('1-URGENT', '2-HIGH')) AS s, (SELECT support FROM w WHERE condition = '1-URGENT') AS h0, (SELECT support FROM w WHERE condition = '2-HIGH') AS h1) SELECT n > d + 1e-9 AS beats_default, n - s > 0.15 AS shuffle_collapses, h1 >= h0 - 1e-9 AS no_harm, n > d + 1e-9 AND n - s > 0.15 AND h1 >= h0 - 1e-9 AS graduates, round(n - d, 6) AS lift, round(n - s, 6) AS lift_vs_shuffle FROM x")
def intent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    of = lambda c, m: F.avg(F.when(F.col("condition").isin(*c), F.col(m)))
    x = w.agg(of(["1-URGENT"], "recall").alias("default"), of(["2-HIGH"], "recall").alias("on"), F.avg(F.when(~F.col("condition").isin("1-URGENT", "2-HIGH"), F.col("recall"))).alias("shuffle"), of(["1-URGENT"], "support").alias("harm_off"), of(["2-HIGH"], "support").alias("harm_on"))
    return gates.intent_verdict(x)


@query(f"WITH {WIDE}, a AS (SELECT * FROM w WHERE condition = '1-URGENT') SELECT w.condition, round(w.recall - a.recall, 6) AS gain, round(a.support - w.support, 6) AS loss, round(w.recall - a.recall, 6) > 0 AND round(a.support - w.support, 6) <= 0.01 AS graduates FROM w, a WHERE w.condition <> '1-URGENT'")
def two_row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure must rise and another may not fall by more than a hundredth."""
    return gates.gain_without_loss(wide(spark, sf_dir), "1-URGENT", gain="recall", keep="support", tolerance=0.01)


@query(f"""WITH {RUNS}, k AS (SELECT condition, query_id, coalesce(min(rank) FILTER (hit), 7) AS at_ FROM j WHERE n_gold > 0 GROUP BY ALL), r AS (SELECT avg((c.at_ > b.at_)::INT) AS regressed, avg(1 / c.at_) - avg(1 / b.at_) AS gain FROM k c JOIN k b USING (query_id) WHERE c.condition = 'date' AND b.condition = 'price') SELECT round(regressed, 6) AS regression_rate, round(gain, 6) AS mrr_gain, gain > 0 AND regressed <= 0 AS passes FROM r""")
def pairwise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A challenger against one baseline: its mean reciprocal rank must rise and no query may fall."""
    return gates.pairwise(metrics.known_item(judged(spark, sf_dir), 6), "price", "date")


@query("""WITH a AS (SELECT l_linestatus AS arm, l_returnflag AS scenario, sum(l_extendedprice) AS cost, bool_or(l_tax > 0.079) AS cached FROM lineitem GROUP BY ALL), d AS (SELECT scenario, cost, cached FROM a WHERE arm = 'F') SELECT a.scenario, round(a.cost - d.cost, 2) AS delta, CASE WHEN NOT (a.cached AND d.cached) THEN 'INCONCLUSIVE' WHEN a.cost < d.cost THEN 'CHEAPER' ELSE 'MORE EXPENSIVE' END AS verdict FROM a JOIN d USING (scenario) WHERE a.arm = 'O'""")
def cost_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("scenario")).agg(F.sum("l_extendedprice").alias("cost"), F.bool_or(F.col("l_tax") > 0.079).alias("cached"))
    base = a.where("arm = 'F'").select("scenario", F.col("cost").alias("base"), F.col("cached").alias("base_cached"))
    both = a.where("arm = 'O'").join(base, "scenario")
    return both.select("scenario", F.round(F.col("cost") - F.col("base"), 2).alias("delta"), gates.cheaper(F.col("cost"), F.col("base"), F.col("cached") & F.col("base_cached")).alias("verdict"))


@query("""SELECT user_id, count(*) - count(DISTINCT event_type) AS duplicate_keys, count(*) FILTER (value > 200) AS out_of_scope, count(*) FILTER (event_type = 'error') / count(*) <= 0.3 AS error_rate_ok, count(*) FILTER (value > 200) = 0 AS scope_ok, count(*) FILTER (event_type = 'error') / count(*) <= 0.3 AND count(*) FILTER (value > 200) = 0 AS passes FROM events GROUP BY user_id""")
def hygiene_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and rates of each user held against limits: all must hold."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((many() - F.count_distinct("event_type")).alias("duplicate_keys"), F.count_if(F.col("value") > 200).alias("out_of_scope"), (F.count_if(F.col("event_type") == "error") / many()).alias("error_rate"))
    return gates.all_hold(e, {"error_rate_ok": F.col("error_rate") <= 0.3, "scope_ok": F.col("out_of_scope") == 0}).drop("error_rate")


SNAP = "b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"


@query(f"WITH {SNAP}, d AS (SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN b.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN n ON b.k = n.k) SELECT change, count(*) AS n FROM d GROUP BY 1")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views before and after: added, removed, changed and unchanged keys."""
    of = lambda c: table(spark, sf_dir, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return gates.snapshot_changes(of("o_orderstatus = 'F'"), of("o_orderstatus <> 'P'"), ["k"], "v").groupBy("change").agg(many().alias("n"))


@query(f"WITH {SNAP} SELECT c_custkey AS k, coalesce(n.v > 300000, false) AS view_value, coalesce(b.v = n.v, false) AS untouched_value, coalesce(n.v > b.v, false) AS superseded, n.k IS NULL AS no_view FROM customer LEFT JOIN b ON b.k = c_custkey LEFT JOIN n ON n.k = c_custkey")
def scenario_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is expected of each customer's view over two snapshots."""
    of = lambda c, v: table(spark, sf_dir, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias(v))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(of("o_orderstatus = 'F'", "b"), "k", "left").join(of("o_orderstatus <> 'P'", "n"), "k", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    b, n = F.col("b"), F.col("n")
    return x.select("k", no(n > 300000).alias("view_value"), no(b == n).alias("untouched_value"), no(n > b).alias("superseded"), n.isNull().alias("no_view"))


@query("SELECT event_type, round(avg(CASE WHEN value > 20 THEN (value > 100)::INT END), 6) AS correct_if_asked, round(avg((value <= 20)::INT), 6) AS abstained, round(avg((json_extract_string(props, '$.k')::INT % 2 = 0)::INT), 6) AS independent FROM events GROUP BY 1")
def question_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of questions, each a share over the rows to which it applies."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    return gates.dimensions(table(spark, sf_dir, "events"), "event_type", {"correct_if_asked": (v > 20, v > 100), "abstained": (F.lit(True), v <= 20), "independent": (F.lit(True), k % 2 == 0)})


@query("""WITH c AS (SELECT 'rows' AS name, CASE WHEN count(*) = 0 THEN 3 ELSE 0 END AS s FROM documents UNION ALL SELECT 'labels', CASE WHEN count(*) FILTER (quality IS NULL) > 0 THEN 2 ELSE 0 END FROM labels UNION ALL SELECT 'lengths', CASE WHEN count(*) FILTER (length(text) <> n_chars) > 0 THEN 3 ELSE 1 END FROM documents UNION ALL SELECT 'sources', CASE WHEN count(DISTINCT source) < 3 THEN 2 ELSE 1 END FROM documents)
SELECT name, CASE s WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'INFO' ELSE 'PASS' END AS outcome, (SELECT CASE max(s) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'INFO' ELSE 'PASS' END FROM c) AS overall FROM c""")
def run_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a run with their severities, and the worst of all."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    checks = [
        ("rows", d.agg(F.when(many() == 0, 3).otherwise(0))), ("labels", lab.agg(F.when(F.count_if(F.col("quality").isNull()) > 0, 2).otherwise(0))),
        ("lengths", d.agg(F.when(F.count_if(F.length("text") != F.col("n_chars")) > 0, 3).otherwise(1))), ("sources", d.agg(F.when(F.count_distinct("source") < 3, 2).otherwise(1))),
    ]
    return gates.rolled_up({n: c for n, c in checks})


@query("WITH s AS (SELECT o_orderpriority AS budget, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1) SELECT bool_and(a >= b) AS never_worse, count(*) FILTER (a > b) AS strictly_better, bool_and(a >= b) AND count(*) FILTER (a > b) >= 2 AS accepted FROM s")
def budget_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("budget")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return gates.never_worse(s, F.col("a"), F.col("b"), 2)


@query("WITH p AS (SELECT o_orderpriority AS arm, avg(o_totalprice) AS cost, avg((o_orderstatus = 'F')::INT) AS score FROM orders GROUP BY 1), d AS (SELECT * FROM p WHERE arm = '1-URGENT') SELECT p.arm, round(p.score - d.score, 6) AS score_delta, round(CASE WHEN d.cost <= 0 THEN 0 ELSE (d.cost - p.cost) * 100.0 / d.cost END, 6) AS cost_reduction FROM p, d WHERE p.arm <> '1-URGENT'")
def arm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("cost"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("score"))
    return gates.deltas(p, "arm", "1-URGENT", ["score"], ["cost"]).select("arm", "score_delta", "cost_reduction")
