"""Queries of small checks: statuses of samples, verdicts on cases, completeness of runs, times of facts, heads of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as ev
from ..operators import graph, intent
from ..operators import typed_values as tv
from ..sources.tables import table
from . import values
from .catalog import many, query

TIMES = """m AS (SELECT o_orderkey AS id, (o_orderdate + INTERVAL 1 DAY)::DATE::VARCHAR AS created, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE::VARCHAR END AS valid, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderdate + INTERVAL 200 DAY)::DATE::VARCHAR END AS invalid, o_orderkey % 11 = 0 AS superseded, CASE o_orderpriority WHEN '1-URGENT' THEN 'historical' WHEN '2-HIGH' THEN 'current' END AS bucket FROM orders),
s AS (SELECT *, CASE WHEN created > '1998-01-01' THEN 'not_yet_known' WHEN superseded OR coalesce(invalid <= '1998-01-01', false) THEN 'superseded' WHEN coalesce(bucket = 'historical', false) THEN 'superseded' WHEN coalesce(valid > '1998-01-01', false) THEN 'not_yet_valid' WHEN coalesce(valid <= '1998-01-01', false) OR coalesce(invalid > '1998-01-01', false) OR coalesce(bucket = 'current', false) THEN 'current' ELSE 'unknown' END AS status FROM m)"""


@query(f"WITH {TIMES} SELECT status, bucket, count(*) AS n FROM s GROUP BY ALL")
def time_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts with all their times, classified as of the start of 1998."""
    k, p, day = F.col("o_orderkey"), F.col("o_orderpriority"), F.to_date("o_orderdate")
    m = table(spark, sf_dir, "orders").select(
        F.date_add(day, 1).cast("string").alias("created"), F.when(k % 7 != 0, day.cast("string")).alias("valid"), F.when(k % 5 == 0, F.date_add(day, 200).cast("string")).alias("invalid"), (k % 11 == 0).alias("superseded"),
        F.when(p == "1-URGENT", "historical").when(p == "2-HIGH", "current").alias("bucket"),
    )
    status = ev.time_status(*(F.col(c) for c in ("created", "valid", "invalid", "superseded", "bucket")), F.lit("1998-01-01"))
    return m.groupBy(status.alias("status"), "bucket").agg(many().alias("n"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN least(1, p_size / 40) ELSE len(list_intersect(list_distinct(string_split(p_name, ' ')), ['blue', 'ring'])) / least(len(list_distinct(string_split(p_name, ' '))), 2) END, 6) AS similarity FROM part")
def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that is given, clamped, else the overlap of the words."""
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 40)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ev.similarity(given, F.split("p_name", " "), F.array(F.lit("blue"), F.lit("ring"))), 6).alias("similarity"))


FITS = ", ".join(f"('{i}', '{r}', {intent.WEIGHT[f]}::DOUBLE)" for i, fits in intent.FIT.items() for f, roles in fits.items() for r in roles)


@query(f"WITH fit(intent, role, weight) AS (VALUES {FITS}), e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'debug_failure' WHEN 'view' THEN 'explain_decision' WHEN 'click' THEN 'plan_next_action' END AS intent, CASE WHEN value > 50 THEN 'failure' ELSE 'decision' END AS role FROM events) SELECT event_id, CASE WHEN e.intent IS NULL THEN 'neutral' WHEN weight > 0 THEN 'support' ELSE 'neutral' END AS polarity, CASE WHEN e.intent IS NULL THEN 0.25 ELSE weight END AS prob, CASE WHEN e.intent IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS conf FROM e LEFT JOIN fit USING (intent, role)")
def intent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fit of intent and role says about a candidate; without an intent it is neutral."""
    t = F.col("event_type")
    goal = F.when(t == "error", "debug_failure").when(t == "view", "explain_decision").when(t == "click", "plan_next_action")
    e = table(spark, sf_dir, "events").select("event_id", goal.alias("intent"), F.when(F.col("value") > 50, "failure").otherwise("decision").alias("role"))
    return intent.evidence(e).select("event_id", "polarity", "prob", "conf")


@query("WITH s AS (SELECT user_id, event_type, count(DISTINCT json_extract_string(props, '$.k')) FILTER (value > 80) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, (CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END) = CASE WHEN user_id % 3 = 0 THEN 'none' WHEN user_id % 3 = 1 THEN 'unique' ELSE 'ambiguous' END AS correct FROM s")
def sample_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of samples by how many values they show, against the expected one."""
    n = F.count_distinct(F.when(F.col("value") > 80, F.get_json_object("props", "$.k")))
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(n.alias("n"))
    status = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    expected = F.when(F.col("user_id") % 3 == 0, "none").when(F.col("user_id") % 3 == 1, "unique").otherwise("ambiguous")
    return s.select("user_id", "event_type", status.alias("status"), (status == expected).alias("correct"))


@query(f"WITH {values.STATED_SQL}, c AS (SELECT user_id, kind, count(DISTINCT display) AS d, bool_or(past) AS r, count(DISTINCT CASE WHEN NOT past THEN display END) AS l FROM st GROUP BY ALL), x AS (SELECT st.user_id, st.kind, display, CASE WHEN d <= 1 THEN 'none' WHEN r AND l = 1 THEN CASE WHEN past THEN 'superseded' ELSE 'current' END ELSE 'candidate' END AS label FROM st JOIN c ON c.user_id = st.user_id AND c.kind = st.kind), b AS (SELECT user_id, kind, display, max(CASE label WHEN 'current' THEN 2 ELSE 0 END) AS score FROM x WHERE label <> 'superseded' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, kind, display) AS rank FROM b) SELECT user_id, display, rank FROM r WHERE rank <= 5")
def advisory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without the rejected ones, those labelled current first."""
    rows = tv.labelled(tv.marked(values.stated(spark, sf_dir)).withColumn("cluster", F.col("kind")))
    kept = rows.where(F.coalesce(F.col("label") != "superseded", F.lit(True)))
    best = kept.groupBy(F.col("namespace").alias("user_id"), "kind", "display").agg(F.max(F.when(F.col("label") == "current", 2).otherwise(0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "kind", "display")).cast("bigint")
    return best.withColumn("rank", rank).where("rank <= 5").select("user_id", "display", "rank")


@query("WITH t AS (SELECT DISTINCT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS id, o_orderstatus = 'F' AS verb FROM orders) SELECT g AS sentence, id, coalesce(max(CASE WHEN verb THEN id END) OVER (PARTITION BY g ORDER BY id), 1) AS predicate FROM t")
def nearest_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's nearest verb on the way to the root, else the root: here heads are the tokens before."""
    o = table(spark, sf_dir, "orders")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint")
    t = o.select(F.col("o_custkey").alias("g"), at.alias("n"), (F.col("o_orderstatus") == "F").alias("verb"))
    links = t.select(F.struct("g", "n").alias("id"), F.when(~F.col("verb") & (F.col("n") > 1), F.struct("g", (F.col("n") - 1).alias("n"))).alias("before"))
    return graph.chain(links, 256).select(F.col("id.g").alias("sentence"), F.col("id.n").alias("id"), F.col("root.n").alias("predicate"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'hedge' WHEN p_name LIKE '%ring' THEN 'negation' WHEN p_size > 40 THEN 'time' ELSE 'other' END AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'hedge' WHEN p_name LIKE '%ring' THEN 'negation' WHEN p_size > 40 THEN 'time' ELSE 'other' END) AS place FROM part")
def marker_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by the first class that fits, in order of their place."""
    c = F.when(F.col("p_name").like("small%"), "hedge").when(F.col("p_name").like("%ring"), "negation").when(F.col("p_size") > 40, "time").otherwise("other")
    p = table(spark, sf_dir, "part").withColumn("category", c)
    return p.select("p_partkey", "category", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey", "category")).cast("bigint").alias("place"))


@query("WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS first FROM part GROUP BY 1) SELECT part.p_brand, count(*) AS active FROM part JOIN f USING (p_brand) WHERE first NOT LIKE '%ring' GROUP BY part.p_brand")
def active_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each brand; a brand whose first one is a sentinel has none."""
    p = table(spark, sf_dir, "part")
    none = p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first")).where(F.col("first").like("%ring")).select("p_brand")
    return p.join(none, "p_brand", "left_anti").groupBy("p_brand").agg(many().alias("active"))


@query("SELECT doc_id, length(text) AS before, length(regexp_replace(text, '[0-9]+', '', 'g')) AS after, round(1 - length(regexp_replace(text, '[0-9]+', '', 'g')) / length(text), 6) AS saved FROM documents WHERE length(text) > 0")
def filtered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's length before and after a filter (digits out), and what it saves."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.length("text").alias("before"), F.length(F.regexp_replace("text", "[0-9]+", "")).alias("after"))
    return d.withColumn("saved", F.round(1 - F.col("after") / F.col("before"), 6))


@query("SELECT l_linestatus AS arm, count(*) AS tasks, round(avg((l_returnflag = 'A')::INT), 4) AS score, sum(l_quantity)::BIGINT AS tokens, round(sum(round(l_quantity * 0.15 / 1e6, 6)), 6) AS cost, count(*) = (SELECT count(*) FROM lineitem) // 2 AS complete, bool_and(l_quantity > 0) AS usage_ok FROM lineitem GROUP BY 1")
def external_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms from a harness summary: score, tokens, cost of rounded parts, and whether rows and usage are complete."""
    li = table(spark, sf_dir, "lineitem")
    half = li.agg(F.floor(many() / 2).alias("half"))
    g = li.groupBy(F.col("l_linestatus").alias("arm")).agg(
        many().alias("tasks"), F.round(F.avg((F.col("l_returnflag") == "A").cast("int")), 4).alias("score"), F.sum("l_quantity").cast("bigint").alias("tokens"),
        F.round(F.sum(F.round(F.col("l_quantity") * 0.15 / 1e6, 6)), 6).alias("cost"), F.bool_and(F.col("l_quantity") > 0).alias("usage_ok"),
    )
    return g.crossJoin(F.broadcast(half)).select("arm", "tasks", "score", "tokens", "cost", (F.col("tasks") == F.col("half")).alias("complete"), "usage_ok")


@query("WITH b AS (SELECT c_mktsegment AS suite, c_custkey AS id, (c_acctbal > 5000)::INT AS first_arm FROM customer WHERE c_custkey % 10 <> 3) SELECT suite, count(*) AS questions, sum(first_arm)::BIGINT AS passed FROM b GROUP BY suite")
def baseline_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline files as JSON texts: of each question's arms the first one counts; stubs are left out."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    text = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.array(F.struct((F.col("c_acctbal") > 5000).alias("passed")), F.struct(F.lit(True).alias("passed"))).alias("arms")))
    read = c.select(F.col("c_mktsegment").alias("suite"), F.from_json(text, "id bigint, arms array<struct<passed: boolean>>").alias("q"))
    first = read.select("suite", "q.id", F.get("q.arms", F.lit(0))["passed"].cast("int").alias("ok"))
    return first.groupBy("suite").agg(many().alias("questions"), F.sum("ok").alias("passed"))


@query("""WITH v AS (SELECT o_custkey AS c, bool_or(o_orderstatus = 'F' AND o_totalprice > 300000) AS view, bool_or(o_orderstatus = 'P') AS stray, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'advisory' ELSE 'nothing' END AS expected, CASE c_custkey % 3 WHEN 0 THEN coalesce(view, false) WHEN 1 THEN NOT coalesce(stray, false) ELSE n IS NULL OR NOT coalesce(view, false) AND NOT coalesce(stray, false) END AS passes FROM customer LEFT JOIN v ON c = c_custkey""")
def scalar_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by what they expect: a matching view, no stray one, or nothing at all."""
    s = F.col("o_orderstatus")
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or((s == "F") & (F.col("o_totalprice") > 300000)).alias("view"), F.bool_or(s == "P").alias("stray"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(v, "c_custkey", "left").na.fill(False, ["view", "stray"])
    k = F.col("c_custkey") % 3
    expected = F.when(k == 0, "view").when(k == 1, "advisory").otherwise("nothing")
    return c.select("c_custkey", expected.alias("expected"), F.when(k == 0, F.col("view")).when(k == 1, ~F.col("stray")).otherwise(~F.col("view") & ~F.col("stray")).alias("passes"))


@query("SELECT e.event_id, EXISTS (SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id < e.event_id) AS bound, NOT EXISTS (SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'purchase' AND v.event_id > e.event_id) AS unexpired FROM events e WHERE event_type = 'error'")
def correction_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that have a view before them and nothing that expires them after."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    edge = e.groupBy("user_id").agg(F.min(F.when(t == "view", F.col("event_id"))).alias("v"), F.max(F.when(t == "purchase", F.col("event_id"))).alias("p"))
    rows = e.where("event_type = 'error'").join(edge, "user_id")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("event_id", no(F.col("v") < F.col("event_id")).alias("bound"), (~no(F.col("p") > F.col("event_id"))).alias("unexpired"))


@query("SELECT event_id, 'Item' || event_id || 'Service' AS stem, CASE WHEN event_id % 2 = 0 THEN 'ts' ELSE 'md' END AS extension, 'Service' AS suffix, event_id % 2 = 0 AS code FROM events WHERE event_type <> 'view'")
def lane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all lanes but one, in their parts."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    name = F.concat(F.lit("Item"), F.col("event_id").cast("string"), F.lit("Service."), F.when(F.col("event_id") % 2 == 0, "ts").otherwise("md"))
    rows = e.select("event_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"))
    return rows.select("event_id", "stem", "extension", tx.pascal_suffix("stem").alias("suffix"), (F.col("extension") == "ts").alias("code"))


#: Questions by event type: text, token and reason.
QUESTIONS = {
    "signup": ("Which mountain bike did I buy most recently?", "bike", ""), "view": ("What kind of gadget did I get in the latest sale?", "", "generic_noun"), "click": ("Which film did I see?", "", "missing_recency_cue"),
    "error": ("  ", "", "no_question"), "purchase": ("Which of the books did I read most recently?", "", "no_noun_phrase"),
}


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{t}' THEN '{q[1]}'" for t, q in QUESTIONS.items()) + " END AS token, CASE event_type " + " ".join(f"WHEN '{t}' THEN '{q[2]}'" for t, q in QUESTIONS.items()) + " END AS reason FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, '', CASE WHEN event_type = 'error' THEN 'no_question' ELSE 'not_latest_intent' END FROM events WHERE event_id % 7 = 0")
def scope_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noun that a question about the latest of something asks for, or why none is taken."""
    asked = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(q[0])) for t, q in QUESTIONS.items()))
    goal = F.when(F.col("event_id") % 7 == 0, "predecessor").otherwise("latest")
    s = table(spark, sf_dir, "events").select("event_id", tx.latest_scope(asked, goal).alias("s"))
    return s.select("event_id", F.coalesce("s.token", F.lit("")).alias("token"), F.coalesce("s.reason", F.lit("")).alias("reason"))
