"""Queries of ladders of conditions, and of small text functions over texts made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import facets, intent, ladders, ranking
from ..sources.tables import table
from . import evidence, retrieval
from .catalog import many, query
from .measures import ROLE

MODES = {"gold": ("repo", "project", "operation", "symbol", "evidence_type"), "extracted": ("symbol",), "hybrid": ("project", "symbol")}
FIVE = retrieval.BM25 + retrieval.COSINE + retrieval.FUSED


def _mode_sql() -> str:
    parts = []
    for mode, names in MODES.items():
        inside = ", ".join(f"'{n}'" for n in names)
        parts.append(f"""sh_{mode} AS (SELECT * FROM sh WHERE facet IN ({inside})), ca_{mode} AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM sh_{mode} GROUP BY ALL), car_{mode} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ca_{mode}),
fc_{mode} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM sh_{mode} WHERE facet = 'symbol' GROUP BY ALL)),
cf_{mode} AS (SELECT query_id, doc_id, count(*) FILTER (df.value <> qf.value) AS conflicts FROM df JOIN qf USING (facet) WHERE facet IN ('repo', 'branch', 'project', 'namespace') AND facet IN ({inside}) GROUP BY ALL),
met_{mode} AS (SELECT query_id, doc_id, count(DISTINCT facet) FILTER (facet IN ('repo', 'project', 'namespace', 'operation', 'object', 'symbol')) AS required, count(*) FILTER (facet IN ('file', 'symbol', 'test')) AS vals, count(*) FILTER (facet = 'evidence_type') AS kinds FROM sh_{mode} GROUP BY ALL),
mp_{mode} AS (SELECT query_id, doc_id, 2.0::DOUBLE * required + 1.5 * vals + t.kinds + CASE WHEN m.valid_time <= q.valid_time THEN 1.0 ELSE 0.0 END - CASE WHEN q.intent = 'current' AND bucket IN ('historical', 'anergic', 'blocked') THEN 4.0 ELSE 0.0 END - 5.0 * coalesce(conflicts, 0) AS score FROM met_{mode} t JOIN m USING (doc_id) JOIN q USING (query_id) LEFT JOIN cf_{mode} USING (query_id, doc_id)),
mpr_{mode} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mp_{mode}),
all_{mode} AS (SELECT '{mode}' AS mode, * FROM (SELECT 'bm25' AS condition, query_id, doc_id, rank FROM bmr UNION ALL SELECT 'cosine', query_id, doc_id, rank FROM cor UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fur UNION ALL SELECT 'file_context', query_id, doc_id, rank FROM fc_{mode} UNION ALL SELECT 'index', query_id, doc_id, rank FROM car_{mode} UNION ALL SELECT 'meeting_point', query_id, doc_id, rank FROM mpr_{mode}))""")
    return ",\n".join(parts)


@query(f"WITH {FIVE},{evidence.MEETING},\n{_mode_sql()}, u AS ({' UNION ALL '.join(f'SELECT * FROM all_{m}' for m in MODES)}) SELECT mode, condition, count(*) AS shown, round(avg(CASE WHEN bucket IN ('historical', 'blocked') THEN 1.0 ELSE 0.0 END), 6) AS stale_share FROM u JOIN m USING (doc_id) WHERE rank <= 5 GROUP BY ALL")
def facet_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six conditions in three views of the facets: how often the first five are stale."""
    m, q, _, qf = evidence._facets(spark, sf_dir)
    lexical, counts = retrieval.both_rankings(spark, sf_dir, 50)
    plain = ladders.ladder({"bm25": lambda: lexical.where("rank <= 5"), "cosine": lambda: counts.where("rank <= 5"), "rrf": lambda: ranking.ranked(ranking.fuse(lexical, counts), 5)})
    plain = plain.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in MODES], "mode string")))  # no view of the facets changes them
    docs = facets.listed(m, "doc_id", evidence.FACETS, "bucket", "valid_time")
    ranked = facets.tops(docs, qf, q.select("query_id", "intent", "valid_time"), MODES, 5).drop("score")
    rows = plain.unionByName(ranked).join(m.select("doc_id", "bucket"), "doc_id")
    return rows.groupBy("mode", "condition").agg(many().alias("shown"), F.round(F.avg(F.when(F.col("bucket").isin("historical", "blocked"), 1.0).otherwise(0.0)), 6).alias("stale_share"))


INTENTS = sorted(intent.FIT)
FITS = ", ".join(f"('{i}', '{r}', {intent.WEIGHT[f]}::DOUBLE)" for i, fits in intent.FIT.items() for f, roles in fits.items() for r in roles)
NAMES = ", ".join(f"'{i}'" for i in INTENTS)


@query(f"""WITH fit(intent, role, weight) AS (VALUES {FITS}), q AS (SELECT c_custkey AS query_id, ([{NAMES}])[c_custkey % 8 + 1] AS goal FROM customer), d AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, {ROLE} AS role, o_totalprice AS semantic FROM orders),
f AS (SELECT query_id, goal, i AS forced FROM q, (SELECT unnest([{NAMES}]) AS i)), r AS (SELECT query_id, goal, forced, d.role AS role, row_number() OVER (PARTITION BY query_id, forced ORDER BY weight DESC, semantic DESC, doc_id) AS rank FROM f JOIN d USING (query_id) JOIN fit ON fit.intent = forced AND fit.role = d.role),
t AS (SELECT r.query_id, goal, forced, w.weight = 1.0 AS ok FROM r JOIN fit w ON w.intent = goal AND w.role = r.role WHERE rank = 1), s AS (SELECT query_id, avg(ok::INT) AS shuffle FROM t WHERE forced <> goal GROUP BY 1), n AS (SELECT query_id, ok::INT AS on_ FROM t WHERE forced = goal),
b AS (SELECT d.query_id, (w.weight = 1.0)::INT AS off FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, doc_id) AS rank FROM d) d JOIN q USING (query_id) JOIN fit w ON w.intent = goal AND w.role = d.role WHERE rank = 1)
SELECT round(avg(off), 6) AS semantic, round(avg(on_), 6) AS intent_on, round(avg(shuffle), 6) AS shuffled FROM n JOIN s USING (query_id) JOIN b USING (query_id)""")
def intent_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First documents by content alone, with the query's intent, and with each wrong one in its place."""
    status = F.col("o_orderstatus")
    role = F.when(status == "F", "failure").when(status == "O", "plan").otherwise("benchmark")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), role.alias("role"), F.col("o_totalprice").alias("semantic"))
    goal = F.element_at(F.lit(INTENTS), (F.col("c_custkey") % 8 + 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), goal.alias("goal"))
    return intent.ladder(d, asked)


@query("WITH b AS (SELECT c_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice AS score, o_orderstatus = 'F' AND o_totalprice > 300000 AS gold FROM customer JOIN orders ON o_custkey = c_custkey), q AS (SELECT query_id, min(rank) FILTER (gold) AS first, max(score) AS top FROM b GROUP BY 1) SELECT round(avg(CASE WHEN first IS NOT NULL THEN (first <= 1)::INT END), 6) AS recall_at_1, round(avg(CASE WHEN first IS NOT NULL THEN (first <= 5)::INT END), 6) AS recall_at_5, round(avg(1 / first), 6) AS mrr, round(avg(CASE WHEN first IS NULL THEN (top > 450000)::INT END), 6) AS negative_fpr FROM q")
def content_vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, mean reciprocal rank, and how often a query without an answer gets one above the threshold."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    gold = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)
    q = o.select("o_custkey", rank.alias("rank"), "o_totalprice", gold.alias("gold")).groupBy("o_custkey").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"), F.max("o_totalprice").alias("top"))
    at = lambda k: F.round(F.avg((F.col("first") <= k).cast("int")), 6).alias(f"recall_at_{k}")
    return q.agg(at(1), at(5), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg(F.when(F.col("first").isNull(), (F.col("top") > 450000).cast("int"))), 6).alias("negative_fpr"))


@query("WITH v AS (SELECT user_id, event_id AS view, json_extract_string(props, '$.k')::BIGINT AS value FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id AS correction, json_extract_string(props, '$.k')::BIGINT AS old FROM events WHERE event_type = 'error'), n AS (SELECT user_id, value, count(*) AS n, min(view) AS view FROM v GROUP BY ALL) SELECT correction, coalesce(CASE WHEN n = 1 THEN view END, -1) AS bound FROM c LEFT JOIN n ON n.user_id = c.user_id AND n.value = c.old")
def counter_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections bind to a view only where exactly one has the old value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("value"))
    views = e.where("event_type = 'view'").groupBy("user_id", "value").agg(many().alias("n"), F.min("event_id").alias("view"))
    out = e.where("event_type = 'error'").join(views, ["user_id", "value"], "left")
    return out.select(F.col("event_id").alias("correction"), F.coalesce(F.when(F.col("n") == 1, F.col("view")), F.lit(-1)).alias("bound"))


@query("SELECT p_partkey, p_name, 'Repo' AS product FROM part WHERE NOT (p_name LIKE '%ring' OR regexp_matches(p_name, '^(red|blue) ')) AND starts_with(p_brand, 'Brand#1') ORDER BY p_partkey LIMIT 20")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty parts that no exclusion fits, of the namespaces with a prefix."""
    p = table(spark, sf_dir, "part").where(~(F.col("p_name").like("%ring") | F.col("p_name").rlike("^(red|blue) ")) & F.col("p_brand").startswith("Brand#1"))
    return p.orderBy("p_partkey").limit(20).select("p_partkey", "p_name", F.lit("Repo").alias("product"))


@query(f"WITH {evidence.MEMORIES} SELECT doc_id, facet, value FROM df WHERE facet IN ('repo', 'project')")
def stripped_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets with the structural ones taken off."""
    m = evidence.memories(spark, sf_dir)
    bare = m.withColumn("symbol", F.array().cast("array<string>")).withColumn("evidence_type", F.array().cast("array<string>")).withColumn("operation", F.lit(None).cast("string"))
    return facets.unpivot(bare, "doc_id", ["repo", "project", "operation", "symbol", "evidence_type"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE '-' END AS choice, event_id % 40 + 0.0 AS amount, event_id % 20 AS number, event_id % 2 = 0 AS same, CASE WHEN event_id % 60 = 0 THEN '0s' ELSE (event_id % 60) || 's' END AS duration,
strftime(TIMESTAMP '2024-03-01 00:00:00' + to_minutes((event_id % 1000)::INT), '%Y-%m-%d %H:%M') AS logged, 'item-' || event_id AS slug, event_id % 3 = 0 AS keyword, event_id % 2 = 0 AS yes, 'its ok ' || event_id AS answer, event_id % 7 AS whole, 2::BIGINT AS listed, 'Service' AS suffix FROM events""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over texts that are made from ids, so that their results are known."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i)
    s = i.cast("string")
    word = lambda n: F.element_at(F.lit(list(tx.NUMBER_WORDS)[:20]), (n + 1).cast("int"))
    choice = F.when(i % 4 == 0, "The answer is (A).").when(i % 4 == 1, "I say B, no, C").when(i % 4 == 2, "Answer: d").otherwise("none of these")
    stamp = F.lit("2024-03-01").cast("timestamp") + F.make_interval(mins=(i % 1000).cast("int"))
    said = F.concat(F.date_format(stamp, "yyyy/MM/dd"), F.lit(" (Fri) "), F.date_format(stamp, "HH:mm"))
    return e.select(
        i, F.coalesce(tx.choice_letter(choice), F.lit("-")).alias("choice"), tx.amount(F.concat((i % 40).cast("string"), F.lit(" in all"))).alias("amount"), tx.number_word(word(i % 20)).alias("number"),
        tx.same_value(F.when(i % 2 == 0, "Yes").otherwise("4"), F.when(i % 2 == 0, "true").otherwise("5")).alias("same"), tx.duration(i % 60).alias("duration"), F.date_format(tx.logged_at(said), "yyyy-MM-dd HH:mm").alias("logged"),
        tx.slug(F.concat(F.lit("Item! "), s)).alias("slug"), tx.keyword_hit(F.when(i % 3 == 0, "they planned the tests").otherwise("nothing here"), F.lit("test planning")).alias("keyword"), tx.says_yes(F.when(i % 2 == 0, " Yes, so it is").otherwise("No")).alias("yes"),
        tx.normal_answer(F.concat(F.lit(" It's, OK! "), s)).alias("answer"), F.when(tx.whole_number_in(F.concat(F.lit("it is "), (i % 7).cast("string"), F.lit(" now")), (i % 7).cast("string")), i % 7).otherwise(-1).alias("whole"),
        F.size(tx.json_array_in(F.concat(F.lit('so ["a", "'), s, F.lit('"] it is')))).cast("bigint").alias("listed"), tx.pascal_suffix(F.lit("UserAccountService")).alias("suffix"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'abstained' WHEN o_orderkey % 4 = 1 THEN 'right' WHEN o_orderkey % 4 = 2 THEN 'negated' ELSE 'wrong' END AS outcome FROM orders")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold the truth, deny it, abstain or miss."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "I don't know.").when(k == 1, "It was the Blue car, I think.").when(k == 2, "It was not the blue car.").otherwise("a red one")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.answer_outcome(said, F.lit("blue car")).alias("outcome"))
