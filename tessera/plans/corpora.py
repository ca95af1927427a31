"""Text, graph, sampling and quality queries over documents, pages, conversations and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, samples, texts
from ..operators.sizes import small_side
from ..sources.tables import table
from .catalog import query


def _letter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(tx.tokens("text")).alias("items"))


@query("""WITH s AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS items FROM documents), r AS (SELECT items, min(id) AS id, count(*) AS members FROM s GROUP BY items), t AS (SELECT id, len(items) AS n, unnest(items) AS item FROM r), i AS (SELECT a.id AS a, b.id AS b, max(a.n) AS na, max(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.item = b.item AND a.id < b.id AND b.n >= 0.9 * a.n AND a.n >= 0.9 * b.n GROUP BY ALL HAVING count(*) / (max(a.n) + max(b.n) - count(*)) >= 0.9),
p AS (SELECT unnest([a, b]) AS id FROM i) SELECT s.id, r.id AS class, members, coalesce(k, 0) AS links FROM s JOIN r USING (items) LEFT JOIN (SELECT id, count(*) AS k FROM p GROUP BY 1) p ON p.id = r.id""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of its word set, the class's size, and how many other classes are like it (Jaccard 0.9 or more)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.tokens("text").alias("items"))
    return texts.similar_classes(d, 0.9)


@query("WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS line FROM orders) SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'unjoinable' WHEN n = 1 THEN 'joined' ELSE 'ambiguous' END AS outcome, count(*) AS n_cases FROM c LEFT JOIN l ON l_orderkey = o_orderkey AND l_linenumber = line GROUP BY 1")
def span_locator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases located by two keys: none, one or several rows found."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).alias("l_linenumber"))
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return texts.located(cases, spans, ["l_orderkey", "l_linenumber"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cases"))


@query("SELECT c_custkey AS o_custkey, p AS o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p)")
def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and priorities that never met."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    return texts.uncovered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), orders.select("o_orderpriority").distinct(), orders)


EDGES = """e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return li.join(o, "l_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


@query(f"WITH {EDGES} SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY dst")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


@query(
    """WITH p AS (SELECT l_orderkey, 'p' || l_partkey AS part, 's' || l_suppkey AS supp FROM lineitem),
e AS (SELECT DISTINCT part AS src, supp AS dst FROM p UNION SELECT DISTINCT supp, part FROM p),
d AS (SELECT src, count(DISTINCT dst) AS d FROM e GROUP BY src), k AS (SELECT * FROM e WHERE src NOT IN (SELECT src FROM d WHERE d >= 600) AND dst NOT IN (SELECT src FROM d WHERE d >= 600)),
n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM k), nn AS (SELECT src, dst FROM n WHERE n <= 5),
f1 AS (SELECT DISTINCT s.seed, nn.dst AS node FROM (SELECT 'p' || p_partkey AS seed FROM part) s JOIN nn ON nn.src = s.seed), f2 AS (SELECT DISTINCT f1.seed, nn.dst AS node FROM f1 JOIN nn ON nn.src = f1.node),
a AS (SELECT seed, node, min(d) AS distance FROM (SELECT seed, node, 1 AS d FROM f1 UNION ALL SELECT seed, node, 2 FROM f2 UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey, 0 FROM part) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS n FROM a WHERE distance > 0)
SELECT seed, node, distance::BIGINT AS distance FROM r WHERE n <= 20"""
)
def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts within two steps of each part, hubs left out."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    edges = li.unionByName(li.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("seed")).withColumn("node", F.col("seed"))
    return graph.reach(edges, seeds, hub=600)


@query("SELECT p_name FROM part GROUP BY p_name HAVING count(*) = 2 AND count(DISTINCT p_brand) = 2")
def two_group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur once in each of exactly two brands."""
    return graph.in_exactly(table(spark, sf_dir, "part"), "p_name", "p_brand", 2)


@query("SELECT term FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY term HAVING count(*) = 1")
def unique_name_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a single benchmark text has."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("term"))
    return graph.in_exactly(t, "term", "item_id", 1)


@query(f"WITH {EDGES} SELECT count(*) AS n_rows, sum(('0x' || substr(md5(src || chr(31) || dst), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM e")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and order-free digest of the customer-supplier graph."""
    return graph.fingerprint(_edges(spark, sf_dir), ["src", "dst"])


def _kinds_sql() -> str:
    rest, parts = "text", []
    for kind, pattern, unit in texts.VALUE_PATTERNS:
        pattern = pattern.replace("'", "''")
        parts.append(f"list_transform(regexp_extract_all({rest}, '{pattern}', 1), lambda v: {{'kind': '{kind}', 'value': replace(v, ',', ''), 'unit': '{unit}'}})")
        rest = f"regexp_replace({rest}, '{pattern}', ' ', 'g')"
    return "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])


@query(f"WITH v AS (SELECT doc_id, unnest({_kinds_sql()}) AS v FROM documents) SELECT doc_id, v.kind AS kind, v.value AS value, v.unit AS unit, count(*) AS n FROM v GROUP BY ALL")
def typed_value_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.inline(texts.values(F.col("text"))))
    return found.groupBy("doc_id", "kind", "value", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, value, event_type = 'error' AS past, event_type = 'purchase' AS present FROM events), p AS (SELECT *, NOT past OR NOT bool_or(NOT past) OVER (PARTITION BY user_id) AS pool FROM r), v AS (SELECT *, bool_or(pool AND present) OVER (PARTITION BY user_id) AS vouched FROM p)
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM v WHERE pool AND (present OR NOT vouched) GROUP BY user_id""")
def cluster_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current value of each user: errors are past values, purchases corrections."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("past"), (F.col("event_type") == "purchase").alias("present"))
    return texts.current_of_cluster(e, ["user_id"], ["event_id"]).select("user_id", "event_id", "value")


@query("""WITH r AS (SELECT user_id, event_id AS seq, event_type = 'signup' AND value > 80 AS a, event_type IN ('click', 'view') AS d, CASE WHEN event_type = 'signup' THEN floor(value / 20)::BIGINT WHEN event_type = 'click' THEN 1 ELSE -1 END AS amount FROM events),
a AS (SELECT user_id, min(amount) AS anchor, min(seq) AS since FROM r WHERE a GROUP BY 1 HAVING count(DISTINCT amount) = 1), t AS (SELECT r.user_id, anchor, sum(amount) AS change FROM r JOIN a USING (user_id) WHERE d AND seq >= since GROUP BY ALL HAVING sum(amount) <> 0)
SELECT user_id, anchor, (anchor + change)::BIGINT AS total FROM t WHERE anchor + change >= 0""")
def delta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated numbers (large signups) and later changes (clicks add, views take away)."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    kind = F.when((t == "signup") & (F.col("value") > 80), "anchor").when(t.isin("click", "view"), "delta")
    amount = F.when(t == "signup", F.floor(F.col("value") / 20)).when(t == "click", 1).otherwise(-1).cast("bigint")
    return texts.folded(e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), amount.alias("amount")), "user_id")


MODE_SQL = "CASE WHEN n_words < 3 THEN 'SKIP' WHEN role <> 'user' THEN 'CONTEXT_ONLY' WHEN n_sentences >= 3 THEN 'SEGMENT_CLAIMS' ELSE 'EXTRACT_WHOLE' END"


@query(f"WITH c AS (SELECT conv_id, turn, role, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS n_sentences, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n_words FROM conversations) SELECT conv_id, turn, n_sentences::BIGINT AS n_sentences, {MODE_SQL} AS mode FROM c")
def segmentation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a turn would be taken in: skipped, as context, whole or by claims."""
    c = table(spark, sf_dir, "conversations")
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    rows = c.select("conv_id", "turn", "role", F.size(tx.sentences("text")).cast("bigint").alias("n_sentences"), words.alias("n_words"))
    mode = F.when(F.col("n_words") < 3, "SKIP").when(F.col("role") != "user", "CONTEXT_ONLY").when(F.col("n_sentences") >= 3, "SEGMENT_CLAIMS").otherwise("EXTRACT_WHOLE")
    return rows.select("conv_id", "turn", "n_sentences", mode.alias("mode"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), b AS (SELECT source, floor(n * 100 / total) AS base, round(n * 100 / total - floor(n * 100 / total), 9) AS rest FROM c, t), l AS (SELECT 100 - sum(base) AS l FROM b), q AS (SELECT source, base + (row_number() OVER (ORDER BY rest DESC, source) <= l)::INT AS quota FROM b, l),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1|' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, source FROM d JOIN q USING (source) WHERE n <= quota""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, by source in proportion."""
    return samples.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 100)


@query("WITH l AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT source, line, count(*) AS k FROM l GROUP BY ALL) SELECT source, line, k FROM c JOIN n USING (source) WHERE k > greatest(3, 0.15 * n) AND line <> ''")
def boilerplate_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in more than three and 15 % of a source's documents."""
    d = table(spark, sf_dir, "documents")
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    lines = d.select("source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("k"))
    return lines.join(small_side(n), "source").where((F.col("k") > F.greatest(F.lit(3.0), 0.15 * F.col("n"))) & (F.col("line") != "")).select("source", "line", "k")


@query("""SELECT 'error' AS severity, 'DUPLICATE_ID' AS code, doc_id::VARCHAR AS place FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'error', 'EMPTY_TEXT', doc_id::VARCHAR FROM documents WHERE coalesce(trim(text), '') = ''
UNION ALL SELECT 'warn', 'DANGLING_LABEL', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'warn', 'UNLABELLED_SOURCE', source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(quality) = 0
UNION ALL SELECT 'info', 'SHORT_TEXT', doc_id::VARCHAR FROM documents WHERE length(text) < 40
UNION ALL SELECT 'warn', 'LENGTH_MISMATCH', doc_id::VARCHAR FROM documents WHERE length(text) <> n_chars""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    row = lambda df, severity, code, place="doc_id": df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(place).cast("string").alias("place"))
    checks = [
        row(d.groupBy("doc_id").count().where("count > 1"), "error", "DUPLICATE_ID"),
        row(d.where(F.coalesce(F.trim("text"), F.lit("")) == ""), "error", "EMPTY_TEXT"),
        row(labels.join(d.select("doc_id"), "doc_id", "left_anti"), "warn", "DANGLING_LABEL"),
        row(d.join(labels, "doc_id", "left").groupBy("source").agg(F.count("quality").alias("n")).where("n = 0"), "warn", "UNLABELLED_SOURCE", "source"),
        row(d.where(F.length("text") < 40), "info", "SHORT_TEXT"),
        row(d.where(F.length("text") != F.col("n_chars")), "warn", "LENGTH_MISMATCH"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT page_id, contains(html, '<article') AS has_article, contains(html, '<nav') AS has_nav, regexp_matches(html, '<title>[^<]+</title>') AS has_title, regexp_matches(html, '<html[^>]* lang=') AS has_lang, contains(html, '<article')::INT + contains(html, '<nav')::INT + regexp_matches(html, '<title>[^<]+</title>')::INT + regexp_matches(html, '<html[^>]* lang=')::INT AS score FROM pages")
def page_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence checks on pages and how many hold."""
    html = F.col("html")
    flags = {"has_article": F.contains(html, F.lit("<article")), "has_nav": F.contains(html, F.lit("<nav")), "has_title": F.regexp_like(html, F.lit("<title>[^<]+</title>")), "has_lang": F.regexp_like(html, F.lit("<html[^>]* lang="))}
    p = table(spark, sf_dir, "pages").select("page_id", *(f.alias(n) for n, f in flags.items()))
    return p.withColumn("score", sum((F.col(n).cast("int") for n in flags), F.lit(0)))


@query("WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s?%'))::BIGINT AS percents, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents) SELECT doc_id, percents, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, substr(sha256(array_to_string(w, ' ')), 1, 24) AS stable_id FROM d")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a stable id of each text's tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(tx.percentages("text")).cast("bigint").alias("percents"), tx.tokens("text").alias("w"))
    return d.select("doc_id", "percents", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), tx.stable_id(F.concat_ws(" ", "w")).alias("stable_id"))


@query("WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def consecutive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each benchmark text to the one after it."""
    t = _letter_sets(spark, sf_dir)
    a, b = t.select(F.col("id").alias("a"), F.col("items").alias("x")), t.select(F.col("id").alias("b"), F.col("items").alias("y"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(tx.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(tx.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 90")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.where("k >= 90")


@query("WITH l AS (SELECT n_nationkey FROM nation), s AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1), u AS (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) SELECT coalesce(s.k, u.k)::BIGINT AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM s FULL JOIN u ON s.k = u.k WHERE c IS DISTINCT FROM s")
def surface_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose counts differ between two tables."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("s"))
    out = a.join(b, "k", "full").where(~F.col("c").eqNullSafe(F.col("s")))
    return out.select(F.col("k").cast("bigint").alias("nation"), F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("SELECT event_id, round(sum(value) OVER w, 6) AS around, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and number of the rows up to two before and after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 6).alias("around"), F.count(F.lit(1)).over(w).alias("n"))
