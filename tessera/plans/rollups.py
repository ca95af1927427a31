"""Summaries, costs, shares and gates over orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import costs, gates, summaries
from ..sources.tables import table
from .catalog import query

#: Rates a million tokens by model: plain, cache hit, cache write (0: unset), output.
RATES = [("small-a", 0.15, 0.075, 0.0, 0.6), ("small-b", 0.1, 0.025, 0.125, 0.4), ("large-a", 2.5, 1.25, 0.0, 10.0), ("large-a-mini", 0.4, 0.1, 0.5, 1.6), ("large", 3.0, 0.3, 3.75, 15.0)]
RATE_ROWS = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, c, d in RATES)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as turns of model calls: quantity is the prompt in thousands, return flags are cache states."""
    li = table(spark, sf_dir, "lineitem")
    prompt = (F.col("l_quantity") * 1000).cast("bigint")
    hit = F.when(F.col("l_returnflag") == "A", (F.col("l_quantity") * 400).cast("bigint")).when(F.col("l_returnflag") == "R", F.lit(0).cast("bigint"))
    model = F.when(F.col("l_suppkey") % 3 == 0, "vendor/small-a-2024").when(F.col("l_suppkey") % 3 == 1, "large-a-mini-v2").otherwise("unknown-model")
    return li.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("operation"), model.alias("model"), prompt.alias("prompt"), hit.alias("hit"), (F.col("l_discount") * 10000).cast("bigint").alias("output"), "l_extendedprice")


TURNS = """t AS (SELECT l_orderkey, l_linenumber, l_linestatus AS arm, l_returnflag AS operation, CASE WHEN l_suppkey % 3 = 0 THEN 'vendor/small-a-2024' WHEN l_suppkey % 3 = 1 THEN 'large-a-mini-v2' ELSE 'unknown-model' END AS model,
 trunc(l_quantity * 1000)::BIGINT AS prompt, CASE WHEN l_returnflag = 'A' THEN trunc(l_quantity * 400)::BIGINT WHEN l_returnflag = 'R' THEN 0 END AS hit, trunc(l_discount * 10000)::BIGINT AS output, l_extendedprice FROM lineitem)"""
PRICED = (
    TURNS
    + f""",
rates(name, rate, hit_rate, write_rate, output_rate) AS (VALUES {RATE_ROWS}),
best AS (SELECT model, arg_max(name, (length(name), name)) AS name FROM (SELECT DISTINCT model FROM t) JOIN rates ON contains(lower(model), name) GROUP BY model),
p AS (SELECT t.*, name, rate, hit_rate, write_rate, output_rate FROM t LEFT JOIN best USING (model) LEFT JOIN rates USING (name)),
c AS (SELECT *, round((CASE WHEN coalesce(hit, 0) > 0 THEN hit * coalesce(hit_rate, 0) + greatest(0, prompt - hit) * coalesce(nullif(write_rate, 0), rate) ELSE prompt * coalesce(rate, 0) END + output * coalesce(output_rate, 0)) / 1e6, 6) AS cost FROM p)"""
)


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the rates of the longest rate name that their model's name holds. Models are few: they are matched once each."""
    t = turns(spark, sf_dir)
    rates = spark.createDataFrame(RATES, "name string, rate double, hit_rate double, write_rate double, output_rate double")
    models = t.select("model").distinct()
    best = models.join(F.broadcast(rates), F.contains(F.lower("model"), F.col("name"))).groupBy("model").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    by_model = best.join(F.broadcast(rates), "name")
    c = F.col
    return t.join(F.broadcast(by_model), "model", "left").withColumn("cost", costs.turn_cost(c("prompt"), c("hit"), c("output"), c("rate"), c("hit_rate"), c("write_rate"), c("output_rate")))


@query(f"WITH {PRICED} SELECT model, name, count(*) AS n FROM c GROUP BY ALL")
def longest_key_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("model", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRICED} SELECT arm, model, round(sum(cost), 4) AS cost, bool_or(coalesce(hit, 0) > 0) AS any_cache FROM c GROUP BY ALL")
def turn_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("arm", "model").agg(F.round(F.sum("cost"), 4).alias("cost"), F.bool_or(F.coalesce("hit", F.lit(0)) > 0).alias("any_cache"))


@query(f"WITH {PRICED} SELECT arm, count(*) AS n, round(avg(CASE WHEN output > 500 THEN 1.0 ELSE 0.0 END), 6) AS correct, sum(prompt)::BIGINT AS prompt, sum(output)::BIGINT AS output, round(sum(cost), 4) AS cost FROM c GROUP BY arm")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("output") > 500, 1.0).otherwise(0.0)), 6).alias("correct"), F.sum("prompt").alias("prompt"), F.sum("output").alias("output"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"WITH {TURNS} SELECT arm, operation, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(output)::BIGINT AS output FROM t GROUP BY GROUPING SETS ((), (arm), (operation))")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.groupingSets([[], [F.col("arm")], [F.col("operation")]], "arm", "operation").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt"), F.sum("output").alias("output"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS before, sum(greatest(1, length(text) // 4))::BIGINT AS after, round((sum(n_chars) - sum(greatest(1, length(text) // 4))) * 100.0::DOUBLE / sum(n_chars), 6) AS saved FROM documents GROUP BY ROLLUP (lang)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", costs.estimated_tokens(F.col("text")).alias("t"))
    return d.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("before"), F.sum("t").alias("after"), F.round(measures.percent_saved(F.sum("n_chars"), F.sum("t")), 6).alias("saved"))


@query("WITH g AS (SELECT o_orderpriority AS relation, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1), p AS (SELECT *, hits / n AS p FROM g) SELECT relation, n, hits, round(p, 6) AS precision, round((p + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS wilson FROM p")
def wilson_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    return g.select("relation", "n", "hits", F.round(measures.ratio(F.col("hits"), F.col("n")), 6).alias("precision"), F.round(measures.wilson_lower(F.col("hits"), F.col("n")), 6).alias("wilson"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95, max(value) FILTER (i = least(n - 1, floor(n * 0.9))) AS floor_p90, round(max(m), 6) AS median FROM r JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by three definitions, from counts of values, range by range."""
    e = table(spark, sf_dir, "events")
    n = F.col("n")
    at = summaries.percentiles(e, "event_type", "value", {"p50": F.bround((n - 1) * F.lit(0.5)), "p95": F.bround((n - 1) * F.lit(0.95)), "floor_p90": F.least(n - 1, F.floor(n * F.lit(0.9))), "low": F.floor((n - 1) / 2), "high": F.ceil((n - 1) / 2)})
    return at.select("event_type", "p50", "p95", "floor_p90", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"))


@query("WITH b AS (SELECT o_custkey, sum(CASE WHEN o_orderdate < DATE '1998-01-01' THEN o_totalprice END) > 1000000 AS before_, sum(CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_totalprice END) > 1000000 AS after_ FROM orders GROUP BY 1), t AS (SELECT CASE WHEN before_ AND after_ THEN 'stayed_pass' WHEN before_ THEN 'regressed' WHEN after_ THEN 'recovered' ELSE 'stayed_fail' END AS class, o_custkey FROM (SELECT o_custkey, coalesce(before_, false) AS before_, coalesce(after_, false) AS after_ FROM b)) SELECT class, count(*) AS n, min(o_custkey) AS first FROM t GROUP BY class")
def transition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    large = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("o_totalprice"))) > 1_000_000, F.lit(False))
    b = o.groupBy("o_custkey").agg(large(early).alias("before"), large(~early).alias("after"))
    return b.select(gates.transition(F.col("before"), F.col("after")).alias("class"), "o_custkey").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("first"))


@query("SELECT coalesce(o_orderstatus, '<null>') AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT coalesce(CASE WHEN quality = 1 THEN 'good' END, '<null>'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "orders").select(F.coalesce("o_orderstatus", F.lit("<null>")).alias("value"))
    grade = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.coalesce(F.when(F.col("quality") == 1, "good"), F.lit("<null>")).alias("value"))
    count = lambda d: d.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return count(status).unionAll(count(grade))


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS orders_, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN orders_ = 0 THEN 'no_order' WHEN done = 0 THEN 'none_done' WHEN top < 400000 THEN 'none_large' ELSE 'passed' END AS stage, count(*) AS n FROM c GROUP BY 1")
def funnel_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stage that a customer fails."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    stage = F.when(F.col("n").isNull(), "no_order").when(F.col("done") == 0, "none_done").when(F.col("top") < 400000, "none_large").otherwise("passed")
    return c.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS correct, bool_or(event_type = 'error' AND value > 90) AS violated, count(*) FILTER (event_type <> 'error') >= 40 AND NOT bool_or(event_type = 'error' AND value > 90) AS accepted FROM events GROUP BY user_id")
def vote_with_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with forty good events or more, unless one violation vetoes."""
    error = F.col("event_type") == "error"
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~error).alias("correct"), F.bool_or(error & (F.col("value") > 90)).alias("violated"))
    return g.withColumn("accepted", (F.col("correct") >= 40) & ~F.col("violated"))


@query("WITH x AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS score, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey::BIGINT AS nation, round(sum(score * n) / sum(n), 6) AS weighted FROM x GROUP BY 1")
def weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of groups weighted by their sizes."""
    x = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("score"), F.count(F.lit(1)).alias("n"))
    return x.groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("SELECT t::DOUBLE AS threshold, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= t) AS f, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice >= t) AS o, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice >= t) AS p FROM orders, (SELECT unnest([0, 100000, 200000, 300000, 400000]) AS t) GROUP BY t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by threshold; a threshold without rows does not appear."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.explode(F.lit([0.0, 1e5, 2e5, 3e5, 4e5])).alias("threshold")).where(F.col("o_totalprice") >= F.col("threshold"))
    wide = o.groupBy("threshold").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("threshold", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c.lower()) for c in "FOP"))


@query("SELECT c_mktsegment AS segment, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most, round(stddev_pop(c_acctbal), 6) AS spread FROM customer GROUP BY 1")
def seeded_run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.round(F.stddev_pop("c_acctbal"), 6).alias("spread"))


@query("WITH m AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, arg_min(p_size, (-n, p_size))::BIGINT AS p_size, max(n) AS n FROM m GROUP BY p_brand")
def smallest_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent size of each brand, the smallest of equals."""
    m = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("p_brand").agg(F.min_by("p_size", F.struct(-F.col("n"), "p_size")).cast("bigint").alias("p_size"), F.max("n").alias("n"))


@query("WITH w AS (SELECT o_orderpriority AS family, avg(CASE WHEN o_orderdate < DATE '1998-01-01' THEN (o_orderstatus = 'F')::INT END) AS base, avg(CASE WHEN o_orderdate >= DATE '1998-01-01' THEN (o_orderstatus = 'F')::INT END) AS now FROM orders GROUP BY 1), a AS (SELECT avg(CASE WHEN o_orderdate >= DATE '1998-01-01' THEN (o_orderstatus = 'F')::INT END) - avg(CASE WHEN o_orderdate < DATE '1998-01-01' THEN (o_orderstatus = 'F')::INT END) AS overall FROM orders) SELECT round(overall, 6) AS overall, round(min(now - base), 6) AS worst, CASE WHEN overall < -0.02 THEN 'FAIL' WHEN min(now - base) < -0.1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM w, a GROUP BY overall")
def ci_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate of a run against its baseline: overall change, and the worst family's."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("old"), (F.col("o_orderstatus") == "F").cast("int").alias("ok"))
    change = F.avg(F.when(~F.col("old"), F.col("ok"))) - F.avg(F.when(F.col("old"), F.col("ok")))
    worst = o.groupBy("o_orderpriority").agg(change.alias("d")).agg(F.min("d").alias("worst"))
    both = o.agg(change.alias("overall")).crossJoin(worst)
    return both.select(F.round("overall", 6).alias("overall"), F.round("worst", 6).alias("worst"), gates.verdict(F.col("overall"), F.col("worst")).alias("verdict"))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 0)::BIGINT AS paid, count(*) FILTER (event_type = 'purchase' AND value < 5) AS paid_but_empty FROM events GROUP BY user_id")
def conditional_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(t == "error").alias("failed"), F.count_if(t == "purchase").alias("paid"), F.count_if((t == "purchase") & (F.col("value") < 5)).alias("paid_but_empty"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(costs.estimated_tokens(F.col("text"))).alias("tokens"))


@query("WITH f AS (SELECT source, count(*) AS found, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT sum(good) AS all_good FROM f) SELECT source, round(good / found, 6) AS precision, round(good / all_good, 6) AS recall, round(CASE WHEN good = 0 THEN 0 ELSE 2 * (good / found) * (good / all_good) / (good / found + good / all_good) END, 6) AS f1 FROM f, t")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("quality") == 1).alias("good"))
    rows = f.crossJoin(F.broadcast(f.agg(F.sum("good").alias("total"))))
    p, r = measures.ratio(F.col("good"), F.col("found")), measures.ratio(F.col("good"), F.col("total"))
    return rows.select("source", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(measures.f_one(p, r), 6).alias("f1"))
