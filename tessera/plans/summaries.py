"""Queries of summaries, windows and set operations over orders, events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import lists, summaries
from ..operators.sizes import checkpointed, small_side
from ..sources.tables import table
from .catalog import many, query

#: Pairs of a query and a part that a partition counts, about.
MOST_MET = 1 << 21


@query("SELECT o_orderstatus AS condition, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 6) AS price__urgent, round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 6) AS price__low FROM orders GROUP BY 1")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("condition"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low").alias("family"), "o_totalprice")
    return summaries.by_family(o, "condition", "family", ["urgent", "low"], F.col("o_totalprice"), "price")


@query("SELECT l_linestatus, count(*) AS n, sum(l_extendedprice::DECIMAL(38,10))::DECIMAL(38,4)::VARCHAR AS cost, round(sum(l_quantity), 4) AS latency, round(avg(l_quantity), 6) AS mean_latency FROM lineitem GROUP BY 1")
def exact_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.exact_summary(table(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_extendedprice"), "l_quantity")


@query("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 0), 6) AS retained, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 6) AS recall FROM orders GROUP BY 1")
def four_way_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the rows that have a value above zero, and over those where it exists."""
    done, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(summaries.mean_of_present(F.when(done, price).otherwise(0.0), done & (price > 0)), 6).alias("retained"), F.round(F.avg(F.when(F.col("o_orderstatus") == "P", price)), 6).alias("recall"))


@query("SELECT key, sum(n)::BIGINT AS total FROM (SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'tax', sum((l_tax > 0)::INT) FROM lineitem) GROUP BY key")
def nested_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each order's line items, merged."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(many().alias("n"), F.count_if(F.col("l_tax") > 0).alias("tax"))
    maps = each.select(F.create_map(F.col("l_returnflag"), F.col("n"), F.lit("tax"), F.col("tax")).alias("counters"))
    return summaries.merged_counters(maps, "counters")


@query("""WITH f AS (SELECT source, lang, count(*) AS found, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang))), t AS (SELECT count(*) FILTER (quality = 1) AS g FROM documents JOIN labels USING (doc_id))
SELECT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, good, found, round(good / found, 6) AS precision, round(good / g, 6) AS recall, round(2 * (good / found) * (good / g) / (good / found + good / g), 6) AS f1 FROM f, t WHERE good > 0""")
def sliced_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of documents as finds of good ones: in all (the micro average), by source and by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    f = d.groupingSets([[], [F.col("source")], [F.col("lang")]], "source", "lang").agg(many().alias("found"), F.count_if(F.col("quality") == 1).alias("good"))
    rows = f.crossJoin(F.broadcast(d.agg(F.count_if(F.col("quality") == 1).alias("g")))).where("good > 0")
    p, r = measures.ratio(F.col("good"), F.col("found")), measures.ratio(F.col("good"), F.col("g"))
    return rows.select(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang"), "good", "found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(measures.f_one(p, r), 6).alias("f1"))


@query("SELECT event_type, len(list_filter([10.0, 50.0, 100.0, 200.0], lambda e: e <= value))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    return e.groupBy("event_type", summaries.histogram(F.col("value"), [10.0, 50.0, 100.0, 200.0]).cast("bigint").alias("bucket")).agg(many().alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: the brand is the folder, the name's last word the role, the first the stem."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.element_at(F.split("p_name", " "), -1).alias("role"), F.element_at(F.split("p_name", " "), 1).alias("stem"), F.col("p_name").alias("name"))


FILES = "f AS (SELECT p_brand AS folder, string_split(p_name, ' ')[-1] AS role, string_split(p_name, ' ')[1] AS stem, p_name AS name FROM part)"


@query(f"WITH {FILES} SELECT role AS name, count(DISTINCT folder) AS folders, count(*) AS files FROM f WHERE role <> 'ring' GROUP BY role HAVING count(DISTINCT folder) >= 2")
def spread_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return summaries.spread_names(f.select(F.col("role").alias("name"), "folder"), "name", "folder", ["ring"])


@query(f"WITH {FILES}, s AS (SELECT folder, list_sort(list(DISTINCT role)) AS shape FROM (SELECT p_type || p_size AS folder, string_split(p_name, ' ')[-1] AS role FROM part) GROUP BY folder HAVING count(DISTINCT role) >= 2) SELECT array_to_string(shape, ' ') AS shape, count(*) AS folders FROM s GROUP BY shape HAVING count(*) >= 2")
def folder_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of roles that stand together in two types and sizes or more."""
    p = table(spark, sf_dir, "part").select(F.concat("p_type", "p_size").alias("folder"), F.element_at(F.split("p_name", " "), -1).alias("role"))
    return summaries.recurring_shapes(p, "folder", "role").select(F.concat_ws(" ", "shape").alias("shape"), "folders")


@query(f"WITH {FILES}, t AS (SELECT role FROM f GROUP BY role ORDER BY count(*) DESC, role LIMIT 3) SELECT stem, array_to_string(list_sort(list(DISTINCT role)), ' ') AS roles FROM f WHERE role IN (SELECT role FROM t) GROUP BY stem HAVING count(DISTINCT role) >= 2")
def entity_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.stems_with_roles(_files(spark, sf_dir), "stem", "role", 3).select("stem", F.concat_ws(" ", "roles").alias("roles"))


@query("SELECT 'bucket' AS stat, coalesce(o_orderstatus, '-') AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'intent', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'group', (o_custkey % 5)::VARCHAR, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM orders")
def fixture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one scan at several keys at once."""
    o = table(spark, sf_dir, "orders")
    keys = F.array(*(F.struct(F.lit(s).alias("stat"), k.alias("key")) for s, k in (("bucket", F.coalesce("o_orderstatus", F.lit("-"))), ("intent", F.col("o_orderpriority")), ("group", (F.col("o_custkey") % 5).cast("string")), ("all", F.lit("")))))
    return o.select(F.inline(keys)).groupBy("stat", "key").agg(many().alias("n"))


@query("SELECT l_linestatus AS arm, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'N') AS no, count(*) FILTER (l_returnflag = 'R') AS unclear FROM lineitem GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("arm")).pivot("l_returnflag", ["A", "N", "R"]).agg(many())
    return wide.select("arm", *(F.coalesce(a, F.lit(0)).alias(b) for a, b in (("A", "yes"), ("N", "no"), ("R", "unclear"))))


@query("WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, md5(p_partkey::VARCHAR)) AS rank FROM part) SELECT * FROM r WHERE rank <= 5")
def neutral_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest parts of each brand, equal sizes in the order of a digest of their keys."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.md5(F.col("p_partkey").cast("string").cast("binary")))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(order).cast("bigint").alias("rank")).where("rank <= 5")


@query("SELECT conv_id, coalesce(arg_max(length(text), turn) FILTER (role = 'system'), arg_max(length(text), turn)) AS size FROM conversations GROUP BY conv_id")
def latest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each conversation's last system turn, else of its last turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("size"))
    return lists.last_of(c, "conv_id", "turn", "size", F.col("role") == "system")


COVER = """k AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
h AS (SELECT k.o_custkey, l_suppkey AS token, min(rank) AS pos FROM k JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), g AS (SELECT c_custkey AS o_custkey, unnest([c_custkey % 50, (c_custkey + 7) % 50, (c_custkey + 13) % 50]) AS token FROM customer)"""


@query(f"WITH {COVER} SELECT g.o_custkey, CASE WHEN count(pos) = count(*) THEN max(pos) END::DOUBLE AS covered, CASE WHEN count(pos) * 2 >= count(*) THEN list_sort(list(pos) FILTER (pos IS NOT NULL))[CAST(ceil(count(*) * 0.5) AS INT)] END::DOUBLE AS half FROM g LEFT JOIN h USING (o_custkey, token) GROUP BY g.o_custkey")
def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order at which a customer has met three stated suppliers, and half of them."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("rank"))
    held = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("token")), "o_orderkey")
    c = F.col("c_custkey")
    gold = table(spark, sf_dir, "customer").select(c.alias("o_custkey"), F.explode(F.array(c % 50, (c + 7) % 50, (c + 13) % 50)).alias("token"))
    return lists.covered_at(held, gold, "o_custkey", "token", "rank").select("o_custkey", F.col("covered").cast("double").alias("covered"), F.col("half").cast("double").alias("half"))


@query("""WITH u AS (SELECT user_id, json_extract_string(props, '$.k') AS s, 0 AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, json_extract_string(props, '$.k'), 1, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events WHERE event_type = 'click'),
m AS (SELECT user_id, s, min((l, p)) AS pos FROM u GROUP BY ALL), r AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank, greatest(3, 20 // count(*) OVER (PARTITION BY user_id)) AS most FROM m) SELECT user_id, s AS snippet, rank FROM r WHERE rank <= most""")
def merged_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, then clicks of each user without repeats, up to max(3, 20 over their number)."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("snippet"), "event_id", "event_type")
    lists_of = [e.where(F.col("event_type") == t).select("user_id", "snippet", F.col("event_id").alias("at")) for t in ("view", "click")]
    merged = lists.merged(lists_of, "user_id", "snippet", "at")
    many = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return merged.withColumn("most", F.greatest(F.lit(3), F.floor(F.lit(20) / many))).where("rank <= most").select("user_id", "snippet", "rank")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1), u AS (SELECT o_custkey, o_orderkey, 2 * rank AS pos FROM a UNION ALL SELECT o_custkey, o_orderkey, 2 * rank + 1 FROM b UNION ALL SELECT *, 0 FROM f), m AS (SELECT o_custkey, o_orderkey, min(pos) AS pos FROM u GROUP BY ALL)
SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS rank FROM m) WHERE rank <= 4""")
def forced_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest and latest orders by turns, the first order forced to the front."""
    o = table(spark, sf_dir, "orders")
    ranked = lambda *by: o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by, "o_orderkey")).alias("rank"))
    forced = o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.min("o_orderkey").alias("doc_id"))
    out = lists.interleaved([ranked(F.desc("o_totalprice")), ranked(F.desc("o_orderdate"))], forced).where("rank <= 4")
    return out.select(F.col("query_id").alias("o_custkey"), F.col("doc_id").alias("o_orderkey"), "rank")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def missed_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with pending orders that neither the finished nor the open ones show."""
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select("o_custkey")
    return lists.missed(of("P"), of("F"), of("O"), on=["o_custkey"])


@query("WITH q AS (SELECT o_custkey AS q, array_agg(DISTINCT l_suppkey) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0 GROUP BY 1), m AS (SELECT l_partkey AS m, array_agg(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY 1), s AS (SELECT q, m, len(list_intersect(q.v, m.v)) AS score FROM q, m), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, m) AS rank FROM s WHERE score > 0) SELECT q, m, score, rank FROM r WHERE rank <= 3")
def file_context_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share the most suppliers with the customers of the query set (ids divisible by 50): values meet by a join. As many partitions by query as the pairs need, so that none counts more than about MOST_MET of them."""
    li = table(spark, sf_dir, "lineitem")
    asked = table(spark, sf_dir, "orders").where("o_custkey % 50 = 0").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("l_orderkey")).join(li, "l_orderkey").select("q", "l_suppkey").distinct()
    held = li.select(F.col("l_partkey").alias("m"), "l_suppkey").distinct()
    held, asked = checkpointed(held), checkpointed(asked)
    each = lambda side, name: side.groupBy("l_suppkey").agg(many().alias(name))
    pairs = each(held, "a").join(each(asked, "b"), "l_suppkey").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]
    met = held.join(small_side(asked), "l_suppkey").select("q", "m").repartition(1 + pairs // MOST_MET, "q").groupBy("q", "m").agg(many().alias("score"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "m")).cast("bigint")).where("rank <= 3")


@query("SELECT event_type AS kind, coalesce(json_extract_string(props, '$.model'), 'none') AS model, user_id % 3 AS endpoint, count(*) AS calls, round(sum(value), 4) AS spent FROM events GROUP BY ALL")
def usage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("kind"), F.coalesce(F.get_json_object("props", "$.model"), F.lit("none")).alias("model"), (F.col("user_id") % 3).alias("endpoint")).agg(many().alias("calls"), F.round(F.sum("value"), 4).alias("spent"))


@query("SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).agg(F.lit(t).alias("what"), many().alias("n")) for t in ("documents", "labels", "pages")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("what", "n")
