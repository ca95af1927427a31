"""Queries of graphs and patterns: customers, orders, parts and suppliers as nodes and edges; samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import counters, gates, graph, noise, ranking, samples
from ..sources.tables import table
from .catalog import many, query

PREV = "l AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS steps FROM orders)"


@query(f"WITH {PREV} SELECT id, first_value(id) OVER (PARTITION BY o_custkey ORDER BY steps) AS root, steps FROM l")
def supersedes_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first predecessor of its customer and the links to it."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(by).alias("before"))
    return graph.chain(links, 64)


@query("WITH t AS (SELECT l_orderkey AS g, l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 5 THEN 99 WHEN l_linenumber = 6 THEN 7 WHEN l_linenumber = 7 THEN 6 ELSE l_linenumber - 1 END AS head FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT t.g AS sentence, count(*) FILTER (head IS NULL) AS roots, count(*) FILTER (head IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t x WHERE x.g = t.g AND x.id = t.head)) AS loose, CASE WHEN count(*) FILTER (id = 6) = 1 AND count(*) FILTER (id = 7) = 1 THEN 2 ELSE 0 END AS cyclic FROM t GROUP BY t.g")
def tree_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens whose heads form trees, with loose ends and a loop."""
    n = F.col("l_linenumber")
    head = F.when(n == 1, F.lit(None)).when(n == 5, 99).when(n == 6, 7).when(n == 7, 6).otherwise(n - 1)
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence"), n.alias("id")).distinct()
    return graph.tree_faults(t.withColumn("l_linenumber", F.col("id")).select("sentence", "id", head.cast("int").alias("head")), "sentence", 8)


@query("SELECT c_name AS src_name, o_orderstatus AS relation, l_suppkey AS supplier, s_name AS dst_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_custkey < 40 GROUP BY ALL")
def fact_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers joined by the status of orders."""
    c = table(spark, sf_dir, "customer").where("c_custkey < 40").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    e = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("o_orderstatus").alias("relation"))
    t = graph.triples(c.unionByName(s), e)
    return t.groupBy("src_name", "relation", F.substring("dst", 2, 20).cast("bigint").alias("supplier"), "dst_name").agg(many().alias("n"))


@query("WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) SELECT node, count(*) AS links, count(DISTINCT other) AS neighbours FROM u GROUP BY node")
def link_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return graph.census(e)


@query("SELECT o_orderkey, count(DISTINCT l_suppkey) AS founders, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS kinds FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def optional_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what their line items name, if they have any."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("founders"), F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("kinds"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce("founders", F.lit(0)).alias("founders"), F.coalesce("kinds", F.lit("")).alias("kinds"))


@query("SELECT r_name, count(DISTINCT o_orderkey) AS orders_, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def three_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count_distinct("o_orderkey").alias("orders_"), F.count_distinct("c_custkey").alias("customers"))


@query("SELECT DISTINCT source AS namespace FROM documents WHERE source IS NOT NULL")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("namespace")).distinct()


@query("SELECT o_orderkey AS id, o_custkey AS subject, coalesce(o_orderstatus, 'none') AS attribute, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'unset') AS value FROM orders WHERE o_orderkey % 3 <> 1")
def assertion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection with defaults for what is unset."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 != 1)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.coalesce("o_orderstatus", F.lit("none")).alias("attribute"), F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("unset")).alias("value"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v), s AS (SELECT q.vec_id AS q, greatest(0, least(1, list_dot_product(q.e, d.e) / (q.norm * d.norm))) AS c FROM n q JOIN n d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) SELECT q AS query_id, count(*) FILTER (round(c, 9) >= 0.3) AS near, round(max(c), 6) AS top FROM s GROUP BY q")
def cosine_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors lie within a cosine of 0.3 of each of the query set, and the best one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = v.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    counted = lambda scores, held, docs, ids: (ids[held.any(0)], ((np.round(scores, 9) >= 0.3) & held).sum(0)[held.any(0)], np.where(held, scores, 0.0).max(0)[held.any(0)])
    rows = ranking.dense_blocks(v, asked, "query_id bigint, near bigint, top double", counted)
    return rows.groupBy("query_id").agg(F.sum("near").alias("near"), F.round(F.max("top"), 6).alias("top"))


@query("SELECT source, count(*) FILTER (contains(lower(text), 'casino')) = 0 AS absent FROM documents GROUP BY source")
def keyword_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.count_if(F.contains(F.lower("text"), F.lit("casino"))) == 0).alias("absent"))


@query("SELECT 'entities' AS probe, count(*) FILTER (contains(c_name, '0')) AS n FROM customer UNION ALL SELECT 'current', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'expired', count(*) FILTER (o_orderstatus = 'F' AND o_orderdate IS NOT NULL) FROM orders UNION ALL SELECT 'episodes', count(DISTINCT l_orderkey) FROM lineitem")
def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a graph must show after a run."""
    o = table(spark, sf_dir, "orders")
    rows = [
        table(spark, sf_dir, "customer").agg(F.lit("entities").alias("probe"), F.count_if(F.contains("c_name", F.lit("0"))).alias("n")), o.agg(F.lit("current").alias("probe"), F.count_if(F.col("o_orderstatus") == "O").alias("n")),
        o.agg(F.lit("expired").alias("probe"), F.count_if((F.col("o_orderstatus") == "F") & F.col("o_orderdate").isNotNull()).alias("n")), table(spark, sf_dir, "lineitem").agg(F.lit("episodes").alias("probe"), F.count_distinct("l_orderkey").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


HASHED = "('0x' || substr(md5('n1|' || {0}), 1, 8))::BIGINT"


@query(f"WITH r AS (SELECT * FROM (SELECT unnest([0.0, 0.1, 0.3]) AS rate), (SELECT unnest(['drop', 'swap']) AS policy)), h AS (SELECT p_partkey, {HASHED.format('p_partkey')} / 4294967296.0 AS u FROM part) SELECT rate::DOUBLE AS rate, policy, count(*) FILTER (u < rate) AS noisy FROM h, r GROUP BY ALL")
def noise_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts are made noisy at each rate and by each policy."""
    grid = noise.grid(spark, {"rate": [0.0, 0.1, 0.3], "policy": ["drop", "swap"]})
    p = table(spark, sf_dir, "part").select("p_partkey", noise.draw("n1", F.col("p_partkey")).alias("u"))
    return p.crossJoin(F.broadcast(grid)).groupBy("rate", "policy").agg(F.count_if(F.col("u") < F.col("rate")).alias("noisy"))


@query("WITH n AS (SELECT p_brand, count(DISTINCT p_type) AS all_ FROM part GROUP BY 1), k AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL), b AS (SELECT p_type, count(DISTINCT p_brand) AS files FROM part GROUP BY 1), t AS (SELECT count(DISTINCT p_brand) AS total FROM part) SELECT k.p_brand, string_agg(k.p_type, ',' ORDER BY k.p_type) AS kept FROM k JOIN b USING (p_type), t WHERE files <= greatest(3, 0.95 * total) GROUP BY k.p_brand")
def anchor_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each brand without those that nearly all brands have."""
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("anchor")).distinct()
    return noise.clean_anchors(a, "file", "anchor", 0.95, 8).select(F.col("file").alias("p_brand"), F.concat_ws(",", "anchors").alias("kept"))


@query("SELECT lang, CASE WHEN doc_id % 10 < 2 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents WHERE coalesce(trim(text), '') <> '' GROUP BY ALL")
def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return d.groupBy("lang", F.when(F.col("doc_id") % 10 < 2, "test").otherwise("train").alias("split")).agg(many().alias("n"))


@query(f"WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {HASHED.format('l_orderkey || l_linenumber || l_partkey')}, l_orderkey, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n, l_suppkey FROM lineitem) SELECT l_suppkey, count(*) FILTER (k <= round_even(n * 0.2, 0)) AS corrupted, round(100.0 * count(*) FILTER (k <= round_even(n * 0.2, 0)) / count(*), 6) AS dead FROM h GROUP BY 1")
def drift_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each supplier's references are corrupted, and the share that is dead then."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("ref"))
    out = noise.corrupted(li, "l_suppkey", "ref", 0.2, "n1")
    return out.groupBy("l_suppkey").agg(F.count_if("corrupted").alias("corrupted"), F.round(100.0 * F.count_if("corrupted") / many(), 6).alias("dead"))


@query("SELECT event_id, least(2, CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) AS verdict, event_type <> 'error' AND value <= 100 AS served FROM events")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most restrictive of guards on currentness and on scope, and what is served."""
    v = F.col("value")
    verdict = F.greatest(F.when(v > 100, 2).otherwise(0), F.when(v > 50, 1).otherwise(0))
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"), ((F.col("event_type") != "error") & (verdict < 2)).alias("served"))


@query("WITH k AS (SELECT user_id, json_extract_string(props, '$.k') AS key FROM events), s AS (SELECT user_id, count(DISTINCT key) FILTER (regexp_matches(key, '(^|[^0-9])7([^0-9]|$)')) AS support FROM k GROUP BY 1) SELECT k.user_id, count(*) AS kept FROM k JOIN s USING (user_id) WHERE support < 2 OR regexp_matches(key, '(^|[^0-9])7([^0-9]|$)') GROUP BY k.user_id")
def narrowed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps the keys that hold a phrase as a whole token if two distinct ones do, else all."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("key"))
    return gates.narrowed(e, ["user_id"], "key", F.regexp_like("key", F.lit("(^|[^0-9])7([^0-9]|$)")), 2).groupBy("user_id").agg(many().alias("kept"))


@query("SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS first, bool_or(o_totalprice > 450000) AS leads FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey")
def first_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order that matches a need, and whether any has the value that leads."""
    m = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return m.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).cast("string").alias("first"), F.bool_or(F.col("o_totalprice") > 450000).alias("leads"))


@query("SELECT o_orderpriority, o_orderstatus, metric, value FROM (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean_price, count(*)::DOUBLE AS orders_ FROM orders GROUP BY ALL) UNPIVOT (value FOR metric IN (mean_price, orders_))")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a suite as rows."""
    w = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), many().cast("double").alias("orders_"))
    return w.unpivot(["o_orderpriority", "o_orderstatus"], ["mean_price", "orders_"], "metric", "value")


@query("SELECT user_id, event_type, count(*) AS expected FROM events GROUP BY ALL HAVING sum(value) > 100 EXCEPT SELECT user_id, event_type, count(*) FROM events GROUP BY ALL HAVING count(*) % 2 = 0")
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that should have a view and have none."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(many().alias("expected"), F.sum("value").alias("v"))
    have = g.where("expected % 2 = 0").select("user_id", "event_type")
    return g.where("v > 100").join(have, ["user_id", "event_type"], "left_anti").select("user_id", "event_type", "expected")


@query("SELECT l_returnflag AS \"set\", sum((l_quantity > 25)::INT)::BIGINT AS kept, count(*) AS total, round(avg(l_quantity / 50), 6) AS graded FROM lineitem GROUP BY 1")
def graded_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs scored as kept or not, and by degree."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("set")).agg(F.count_if(F.col("l_quantity") > 25).alias("kept"), many().alias("total"), F.round(F.avg(F.col("l_quantity") / 50), 6).alias("graded"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND coalesce(json_extract_string(props, '$.k')::INT > 50, false)")
def failed_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.coalesce(F.get_json_object("props", "$.k").cast("int") > 50, F.lit(False))
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & flag).select("event_id")


@query("SELECT doc_id, regexp_matches(text, '\\*\\*') AS bold, regexp_matches(text, '(?m)^- ') AS bullets, contains(text, '```') AS fence FROM documents")
def presentation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_like(t, F.lit(r"\*\*")).alias("bold"), F.regexp_like(t, F.lit(r"(?m)^- ")).alias("bullets"), F.contains(t, F.lit("```")).alias("fence"))


LINKED = """s AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS items FROM documents), r AS (SELECT items, min(id) AS id FROM s WHERE len(items) > 0 GROUP BY items), t AS (SELECT id, len(items) AS n, unnest(items) AS item FROM r),
i AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.item = b.item AND a.id < b.id AND b.n >= 0.9 * a.n AND a.n >= 0.9 * b.n GROUP BY ALL HAVING count(*) / (max(a.n) + max(b.n) - count(*)) >= 0.9),
e AS (SELECT a AS u, b AS v FROM i UNION SELECT b, a FROM i), reach(id, other) AS (SELECT id, id FROM r UNION SELECT reach.id, e.v FROM reach JOIN e ON e.u = reach.other), root AS (SELECT id AS class, min(other) AS cluster FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {LINKED}, m AS (SELECT s.id AS doc_id, cluster FROM s JOIN r USING (items) JOIN root ON class = r.id) SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size, CASE WHEN ('0x' || substr(md5('split|' || cluster), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM m")
def leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with words by near-duplicate cluster (Jaccard 0.9 or more); a fifth of the clusters is for tests."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens("text").alias("items"))
    return samples.without_leaks(d, 0.9, 0.2).withColumnRenamed("id", "doc_id")


WORDS = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
tk AS (SELECT item_id AS sentence, i - 1 AS id, CASE WHEN i > 1 THEN i // 2 - 1 END AS head, CASE WHEN len(w[i]) <= 2 THEN 'cc' WHEN w[i] LIKE '%e' THEN 'conj' WHEN w[i] LIKE '%n' THEN 'relcl' ELSE 'obj' END AS dep, len(array_to_string(w[1:i - 1], ' ')) + (i > 1)::INT AS start, len(array_to_string(w[1:i], ' ')) AS stop FROM w, range(1, 400) r(i) WHERE i <= len(w))"""


@query(f"""WITH RECURSIVE {WORDS}, up(sentence, id, above) AS (SELECT sentence, id, id FROM tk UNION ALL SELECT up.sentence, up.id, tk.head FROM up JOIN tk ON tk.sentence = up.sentence AND tk.id = up.above WHERE tk.head IS NOT NULL),
b AS (SELECT up.sentence, up.above AS id, min(t.start) FILTER (dep <> 'cc') AS low, max(t.stop) AS high FROM up JOIN tk t ON t.sentence = up.sentence AND t.id = up.id GROUP BY ALL), a AS (SELECT up.sentence, up.id, bool_or(dep = 'relcl') AS embedded FROM up JOIN tk t ON t.sentence = up.sentence AND t.id = up.above GROUP BY ALL), s AS (SELECT sentence, min(start) AS s, max(stop) AS e FROM tk GROUP BY 1)
SELECT tk.sentence, tk.id, CASE WHEN dep = 'conj' THEN low ELSE s END AS start, CASE WHEN dep = 'conj' THEN CASE WHEN low IS NOT NULL THEN high END ELSE e END AS stop, embedded FROM tk JOIN b USING (sentence, id) JOIN a USING (sentence, id) JOIN s USING (sentence)""")
def clause_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the benchmark's words; each word hangs on the one at half its place, and its ending tells its relation (there is no parser)."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence"), tokens("text").alias("w")).select("sentence", "w", F.posexplode("w").alias("id", "t"))
    dep = F.when(F.length("t") <= 2, "cc").when(F.col("t").endswith("e"), "conj").when(F.col("t").endswith("n"), "relcl").otherwise("obj")
    start = F.length(F.concat_ws(" ", F.slice("w", F.lit(1), F.col("id")))) + (F.col("id") > 0).cast("int")
    head = F.when(F.col("id") > 0, F.floor((F.col("id") + 1) / 2).cast("int") - 1)
    t = w.select("sentence", "id", head.alias("head"), dep.alias("dep"), start.alias("start"), (start + F.length("t")).alias("stop"))
    out = graph.clause_spans(t, "sentence")
    return out.select("sentence", *(F.col(c).cast("bigint").alias(c) for c in ("id", "start", "stop")), "embedded")


@query("""WITH RECURSIVE v AS (SELECT user_id, event_id % 7 AS counter, arg_max(json_extract_string(props, '$.k')::BIGINT % 6, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), l AS (SELECT user_id, list(counter ORDER BY counter) AS counters, list(value ORDER BY counter) AS vals FROM v GROUP BY 1),
c AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT % 6 AS old, (json_extract_string(props, '$.k')::BIGINT + event_id % 4 + 1) % 6 AS new, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events WHERE event_type = 'error'),
f(user_id, counters, vals, step, applied) AS (SELECT user_id, counters, vals, 0::BIGINT, 0::BIGINT FROM l UNION ALL SELECT f.user_id, counters, CASE WHEN len([x FOR x IN vals IF x = old]) = 1 THEN [CASE WHEN x = old THEN new ELSE x END FOR x IN vals] ELSE vals END, c.step, applied + (len([x FOR x IN vals IF x = old]) = 1)::INT FROM f JOIN c ON c.user_id = f.user_id AND c.step = f.step + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS last FROM f) SELECT user_id, unnest(counters) AS counter, unnest(vals) AS value FROM e WHERE last = 1""")
def corrected_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a user after all corrections, each of which changes what later ones meet."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("namespace"), (F.col("event_id") % 7).alias("counter"), (F.col("k") % 6).alias("value"), F.col("event_id").alias("seq"))
    fixes = e.where("event_type = 'error'").select(F.col("user_id").alias("namespace"), F.col("event_id").alias("seq"), (F.col("k") % 6).alias("old"), ((F.col("k") + F.col("event_id") % 4 + 1) % 6).alias("new"))
    return counters.corrected(views, fixes)[0].select(F.col("namespace").alias("user_id"), "counter", "value")
